"""Operator 9. Toxicity by a weighted finite-state pattern grammar.

Words are read as six kinds: insult, threat, target, negation, reported speech, other.
Six small transducers over these kinds are composed into one machine (``compose``):
insult and threat emit the weight of the word, target raises what follows an address,
negation and reported speech divert it to accounts of their own, and what they have left
is raised when an address follows it. The machine runs over clauses that hold an insult or
a threat, found by an Aho-Corasick automaton, and its accounts over all clauses of a
document give the score by a logistic model.

Insults (whole words and word beginnings) and the weights are learned from labels, on a
bounded sample: at most ``toxic_docs`` and ``clean_docs`` training documents in the order
of their id's hash, equal texts once. How clear a word's evidence must be is chosen by
cross-validation inside that sample. Threats are fixed stems with their languages'
endings; the words of the other kinds are fixed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, whole_row

#: Word lists in English, German, French and Spanish. A threat is a stem and an ending.
THREAT_STEMS = "kill murder hurt strangl stab stabb shoot beat töt umbring erschieß erstech erstich verprügel tue tuer égorg poignard étrangl mat asesin apuñal golpe".split()
THREAT_ENDINGS = " s e es ed er ing en est t te ten et end n st ai as a ons ez ent é ar o an aré ará aron ado".split(" ")
THREAT = frozenset(s + e for s in THREAT_STEMS for e in THREAT_ENDINGS if len(s + e) > 3) | frozenset("killt töte tötet umbringe umbringt matarte tuer tué".split())
TARGET = frozenset("you your yourself u he him she her they them du dich dir euch ihr tu toi te vous ton votre tú ti usted ustedes vosotros".split())
NEGATION = frozenset("not never isn't aren't don't nicht kein keine niemals nie pas jamais aucun nunca jamás ni".split())
REPORTED = frozenset("said says wrote called quoted claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[.!?;\n]")
INSULT_KIND, THREAT_KIND, TARGET_KIND, NEGATION_KIND, REPORTED_KIND, OTHER_KIND = range(6)
#: Accounts of a document, where the score's weights start from, and how firmly they are held there.
ACCOUNTS = ("insult", "aimed", "negated", "reported", "threat")
PRIOR, HOLD = np.array([-4.0, 6.0, 7.0, 1.0, 1.0, 4.0]), np.array([0.1, 0.1, 0.1, 1.0, 1.0, 1.0])
SHORTEST_STEM, LONGEST_STEM = 4, 7


@dataclass(frozen=True)
class Transducer:
    """A deterministic machine over kinds: states, start, and step(state, kind, mark) -> (state, mark)."""

    states: tuple
    start: object
    step: Callable


def window(trigger: int, length: int, change: dict[str, str]) -> Transducer:
    """Changes marks on the ``length`` words after a word of kind ``trigger``."""
    def step(left: int, kind: int, mark: str) -> tuple[int, str]:
        if kind == trigger:
            return length, mark
        return max(0, left - 1), change.get(mark, mark) if left else mark

    return Transducer(tuple(range(length + 1)), 0, step)


def latch(trigger: int, change: dict[str, str]) -> Transducer:
    """Changes marks from a word of kind ``trigger`` on, to the end of the clause."""
    def step(on: bool, kind: int, mark: str) -> tuple[bool, str]:
        return on or kind == trigger, change.get(mark, mark) if on else mark

    return Transducer((False, True), False, step)


def follow(trigger: int, length: int, change: dict[str, str]) -> Transducer:
    """Marks a word of kind ``trigger`` that comes within ``length`` words after a mark, by that mark; once for each mark."""
    names = ("", *change)

    def step(state: tuple, kind: int, mark: str) -> tuple[tuple, str]:
        waiting, left = state
        if mark in change:
            return (mark, length), mark
        if kind == trigger and waiting:
            return ("", 0), change[waiting]
        return ((waiting, left - 1) if left > 1 else ("", 0)), mark

    return Transducer((("", 0), *product(names[1:], range(1, length + 1))), ("", 0), step)


def emit(kinds: dict[int, str]) -> Transducer:
    """Marks words of the given kinds."""
    return Transducer((0,), 0, lambda state, kind, mark: (state, kinds.get(kind, mark)))


def compose(*machines: Transducer) -> tuple[list[list[tuple[int, str]]], int]:
    """One machine whose marks pass through all: table[state][kind] = (state, mark), and the start state."""
    names = {s: i for i, s in enumerate(product(*(m.states for m in machines)))}
    table = []
    for state in names:
        row = []
        for kind in range(6):
            mark, after = "", []
            for m, s in zip(machines, state, strict=True):
                s, mark = m.step(s, kind, mark)
                after.append(s)
            row.append((names[tuple(after)], mark))
        table.append(row)
    return table, names[tuple(m.start for m in machines)]


MACHINES = (
    emit({INSULT_KIND: "insult"}),
    emit({THREAT_KIND: "threat"}),
    window(TARGET_KIND, 4, {"insult": "aimed", "threat": "aimed threat"}),
    window(NEGATION_KIND, 3, {"insult": "negated", "aimed": "negated", "threat": "negated", "aimed threat": "negated"}),
    latch(REPORTED_KIND, {"insult": "reported", "aimed": "reported", "threat": "reported", "aimed threat": "reported"}),
    follow(TARGET_KIND, 4, {"insult": "aim insult", "threat": "aim threat"}),
)
MACHINE = compose(*MACHINES)


class Grammar:
    """The lexicon, as an automaton, and the weights of the score."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray):
        import ahocorasick

        self.lexicon, self.weights = lexicon, np.asarray(weights, float)
        self.words = {w: x for w, x in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: x for w, x in lexicon.items() if w.endswith("*")}
        self.lengths = sorted({len(s) for s in self.stems})
        self.automaton = ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *THREAT}:
            self.automaton.add_word(w, len(w))
        if len(self.automaton):
            self.automaton.make_automaton()

    def kind(self, word: str) -> tuple[int, float]:
        if word in self.words:
            return INSULT_KIND, self.words[word]
        for n in self.lengths:
            if word[:n] in self.stems:
                return INSULT_KIND, self.stems[word[:n]]
        for kind, words in ((THREAT_KIND, THREAT), (TARGET_KIND, TARGET), (NEGATION_KIND, NEGATION), (REPORTED_KIND, REPORTED)):
            if word in words:
                return kind, 1.0
        return OTHER_KIND, 0.0

    def clauses(self, text: str) -> Iterator[str]:
        """The clauses (lower case) in which a word starts with a pattern."""
        text = text.lower()
        done = 0
        for end, size in self.automaton.iter(text) if len(self.automaton) else ():
            begin = end - size + 1
            if begin < done or begin and text[begin - 1].isalpha():
                continue
            a = max((m for m in (text.rfind(c, 0, begin) for c in ".!?;\n")), default=-1) + 1 if begin - done < 1 << 12 else done + _last(CLAUSE, text[done:begin])
            stop = CLAUSE.search(text, end + 1)
            done = stop.start() if stop else len(text)
            yield text[a:done]

    def accounts(self, text: str | None) -> np.ndarray:
        """The weights found, by account."""
        found = dict.fromkeys(ACCOUNTS, 0.0)
        table, start = MACHINE
        for clause in self.clauses(text or ""):
            state, last = start, 0.0
            for word in WORD.findall(clause):
                kind, weight = self.kind(word.replace("’", "'"))
                state, mark = table[state][kind]
                if not mark:
                    continue
                if mark == "aimed threat":
                    found["threat"] += 2 * weight
                elif mark == "aim threat":
                    found["threat"] += last
                elif mark == "aim insult":  # it was an insult until its target came
                    found["insult"] -= last
                    found["aimed"] += last
                else:
                    found[mark] += weight
                last = weight
        return np.log1p([found[k] for k in ACCOUNTS])

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + self.weights[1:] @ self.accounts(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _last(pattern: re.Pattern, text: str) -> int:
    at = 0
    for m in pattern.finditer(text):
        at = m.end()
    return at


def features(text: str) -> set[str]:
    """Words, and word beginnings marked by a star."""
    words = {w for w in WORD.findall(text.lower()) if len(w) >= 3}
    return words | {w[:k] + "*" for w in words for k in range(SHORTEST_STEM, min(LONGEST_STEM, len(w)) + 1)}


def training_sample(docs: DataFrame, labels: DataFrame, folds: int, toxic_docs: int, clean_docs: int) -> DataFrame:
    """``toxic, text`` of the bounded sample; no row whose id is in the held-out fold."""
    labels = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").alias("toxic"))
    labels = labels.where(F.pmod(F.crc32(F.col("labelled").cast("string")), F.lit(folds)) != 0)
    first = lambda kind, n: labels.where(kind).orderBy(F.xxhash64("labelled"), "labelled").limit(n)
    some = first("toxic = 1", toxic_docs).unionByName(first("toxic = 0", clean_docs))  # bounded by the two limits
    joined = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("labelled")).where("text is not null")
    joined = joined.groupBy("labelled").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))  # one text for each id
    return materialise(joined.groupBy(F.xxhash64("text").alias("of")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).drop("of"), "toxicity-sample")


class Evidence:
    """Which of some features each document of the sample holds, as a matrix."""

    def __init__(self, names: list[str], toxic: np.ndarray, held: np.ndarray, support: float, cover: int):
        self.names, self.toxic, self.held, self.support, self.cover = names, toxic.astype(bool), held, support, cover

    def lexicon(self, rows: np.ndarray, odds: float) -> dict[str, float]:
        """Features that tell the toxic ones of these documents apart: a greedy cover of them.

        A feature qualifies if its log odds ratio less two standard errors is ``odds``, and
        more the more features compete (a tenth of the log of the toxic documents); it is
        taken if at least ``support`` of the toxic documents (4 at least) hold it that hold
        fewer than ``cover`` of those taken before, so that the rare words a group of near
        copies shares do not get in. Beginnings and extensions of a feature taken are left out.
        """
        bad, good = rows & self.toxic, rows & ~self.toxic
        n_bad, n_good = int(bad.sum()), int(good.sum())
        least = max(4, math.ceil(self.support * n_bad))
        t, c = (self.held[x].sum(axis=0, dtype=np.int64) for x in (bad, good))
        weight = np.log((t + 0.5) / (n_bad + 1) / ((c + 0.5) / (n_good + 1)))
        doubt = np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        some = np.flatnonzero((t >= least) & (weight - 2 * doubt >= odds + 0.1 * math.log(max(1, n_bad))))
        names, weight, held = [self.names[k] for k in some], weight[some], self.held[np.ix_(bad, some)].astype(np.float32)
        rank = np.array([(not k.endswith("*")) * 100 - len(k) for k in names], float) * 1e-9
        live, times, taken = np.ones(len(some), bool), np.zeros(n_bad, np.int64), {}
        while live.any():
            gain = (times < self.cover).astype(np.float32) @ held
            live &= gain >= least
            if not live.any():
                break
            best = int(np.where(live, gain * weight + rank, -np.inf).argmax())
            taken[names[best]] = float(weight[best])
            times += held[:, best] > 0
            root = names[best].rstrip("*")
            for k in np.flatnonzero(live):
                live[k] = not (names[k].startswith(root) or root.startswith(names[k].rstrip("*")))
        return taken

    def loss(self, folds: np.ndarray, odds: float) -> float:
        """The logistic loss on each fold of what is learned from the others."""
        total = 0.0
        for f in np.unique(folds):
            lexicon = self.lexicon(folds != f, odds)
            own = np.array([lexicon.get(k, 0.0) for k in self.names])
            x = np.zeros((len(self.held), len(ACCOUNTS)))
            x[:, 0] = np.log1p(self.held[:, own > 0] @ own[own > 0])
            w = learn_weights(x[folds != f], self.toxic[folds != f].astype(int))
            z = w[0] + x[folds == f] @ w[1:]
            total += float((np.logaddexp(0, z) - self.toxic[folds == f] * z).sum())
        return total


def learn_lexicon(sample: DataFrame, support: float = 0.004, grid: tuple[float, ...] = (0.4, 0.8, 1.2, 1.6), most: int = 3000, cover: int = 8, folds: int = 4) -> dict[str, float]:
    """The lexicon, by the evidence of the grid that loses least in cross-validation (the clearer of equals)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())
        for b in batches:
            for toxic, text in zip(b["toxic"], b["text"], strict=True):
                seen[int(toxic)].update(features(text))
        keys = [*{*seen[0], *seen[1]}]
        yield pd.DataFrame({"feature": keys, "clean": [seen[0][k] for k in keys], "toxic": [seen[1][k] for k in keys]}).astype({"feature": object, "clean": "int64", "toxic": "int64"})

    size = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = size.get(0, 0), size.get(1, 0)
    if not n_toxic:
        return {}
    least = max(3, math.floor(support * n_toxic * (folds - 1) / folds))
    counts = sample.mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("toxic") >= least)
    ratio = F.log(((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1)))
    doubt = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    told = counts.where(ratio - doubt >= min(grid)).orderBy(F.desc(ratio - 2 * doubt), "feature").limit(most).collect()
    names = sorted(r.feature for r in told)
    place = {k: i for i, k in enumerate(names)}

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = [np.array(sorted(place[k] for k in features(t) if k in place), np.int32) for t in b["text"]]
            yield pd.DataFrame({"toxic": b["toxic"].astype("int64"), "fold": b["fold"].astype("int64"), "held": held})

    numbered = sample.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(folds)))
    rows = numbered.mapInPandas(hold, "toxic long, fold long, held array<int>").toPandas()  # bounded by the sample
    held = np.zeros((len(rows), len(names)), np.uint8)
    for i, h in enumerate(rows["held"]):
        held[i, h] = 1
    evidence, fold = Evidence(names, rows["toxic"].to_numpy(), held, support, cover), rows["fold"].to_numpy()
    losses = {x: evidence.loss(fold, x) for x in grid}
    best = max(grid, key=lambda x: (-round(losses[x], 6), x))
    return evidence.lexicon(np.ones(len(rows), bool), best)


def learn_weights(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """A logistic model held near PRIOR, by Newton's method with step halving."""
    w, x = PRIOR.copy(), np.hstack([np.ones((len(x), 1)), x])
    each = np.full(len(y), min(1.0, 1000 / max(1, len(y))))

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(each @ (np.logaddexp(0, z) - y * z)) + float(HOLD @ (w - PRIOR) ** 2) / 2

    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + HOLD * (w - PRIOR)
        step = np.linalg.solve(x.T @ (x * (each * p * (1 - p))[:, None]) + np.diag(HOLD), grad)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return np.round(w, 9)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, toxic_docs: int = 2000, clean_docs: int = 4000) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the score's weights."""
    sample = training_sample(docs, labels, folds, toxic_docs, clean_docs)
    lexicon = learn_lexicon(sample)

    def account(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(lexicon, PRIOR)
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"].astype("int64"), "x": [grammar.accounts(t) for t in b["text"]]})

    rows = sample.mapInPandas(account, "toxic long, x array<double>").toPandas()  # bounded by the sample
    order = sorted(range(len(rows)), key=lambda i: (rows["toxic"][i], tuple(rows["x"][i])))
    x = np.array([rows["x"][i] for i in order]).reshape(-1, len(ACCOUNTS))
    return lexicon, learn_weights(x, rows["toxic"].to_numpy()[order])


def score_column(text, lexicon: dict[str, float], weights: np.ndarray):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        grammar = Grammar(lexicon, weights)
        for texts in batches:
            yield pd.Series([grammar.score(t) for t in texts], dtype="float64")

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text)``.

    A null or empty text has no clause and gets the lowest score. A null doc_id is not
    held out. Repeated rows score alike; without labels the fixed words alone count.
    """
    lexicon, weights = fit(docs, labels, folds)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(F.col("text"), lexicon, weights).alias("score"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, folds: int = 5, cut: float = 0.5) -> DataFrame:
    """``docs`` scored below ``cut``; all columns stay, whatever their names."""
    lexicon, weights = fit(docs, labels, folds)
    return docs.select(whole_row(docs)).where(score_column(F.col("row.text"), lexicon, weights) < cut).select("row.*")
