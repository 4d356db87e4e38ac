import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraflux.llm import quality, toxicity


def brute_model(texts, order=quality.ORDER):
    """Interpolated modified Kneser-Ney with dictionaries: the probability of a gram."""
    from collections import Counter

    top = Counter()
    for t in texts:
        x = quality.START * (order - 1) + t
        top.update(x[i : i + order] for i in range(len(t)))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cuts = {n: quality.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))) for n, c in counts.items()}
    after = {n: {} for n in counts}
    for n, c in counts.items():
        for g, v in c.items():
            after[n].setdefault(g[:-1], []).append(v)

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        n, d = len(gram), cuts[len(gram)]
        of = after[n].get(gram[:-1])
        if not of:
            return p(gram[1:])
        cut = lambda v: d[min(v, 3) - 1] if v else 0.0
        v = counts[n].get(gram, 0)
        return (max(v - cut(v), 0) + sum(map(cut, of)) * p(gram[1:])) / sum(of)

    return p


def brute_low(p, text, margin=2.0, order=quality.ORDER):
    x = quality.START * (order - 1) + text
    s = np.array([-math.log2(p(x[i : i + order])) for i in range(len(text))])
    return round(max(0.0, s.mean() - margin * s.std() / len(s) ** 0.5), 6)


TRUSTED = ["the cat sat on the mat. the the dog!", "a cat, a hat", "dogs and cats and hats and mats", "Кот сидел на ковре", "猫在垫子上", ""]


def test_language_model_against_brute_force(spark):
    model = quality.train(spark.createDataFrame([(t,) for t in [*TRUSTED, None]], "text string"))
    p = brute_model(TRUSTED)
    texts = [*TRUSTED, "zebra xylophone |", "the the the", "\x02odd", "Кот и 犬"]
    grams = {x[i : i + 5] for t in texts for x in ["\x02" * 4 + t] for i in range(len(t))}
    got = {r.gram: r.p for r in model.probabilities(spark.createDataFrame([(g,) for g in grams], "gram string")).collect()}
    assert got == pytest.approx({g: p(g) for g in grams})


def test_probabilities_sum_to_one(spark):
    text = "some words and some more words"
    model = quality.train(spark.createDataFrame([(text,)], "text string"))
    alphabet = [*sorted(set(text)), "?"]  # one symbol stands for all that were never seen
    for context in ("some", " wor", "zzzz"):
        rows = model.probabilities(spark.createDataFrame([(context + c,) for c in alphabet], "gram string")).collect()
        assert sum(r.p for r in rows) == pytest.approx(1)


def test_scores_and_thresholds_against_brute_force(spark, make, monkeypatch):
    """Perplexities, thresholds and rejections, with texts that go over pieces, blocks and chunks."""
    monkeypatch.setattr(quality, "PIECE", 40)
    monkeypatch.setattr(quality, "BLOCK", 60)
    monkeypatch.setattr(quality, "CHUNK", 150)
    texts = {k: TRUSTED[k % 5] * (1 + k % 4) for k in range(24)} | {100: "%% ## @@ 99", 101: "猫猫猫 ## dog", 102: "the cat and the dog " * 30}
    docs = make(list(texts.items()))
    labels = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    out = {r.doc_id for r in labels.where(quality.held_out()).collect()}
    assert 2 <= len(out) < 10
    p = brute_model([texts[k] for k in range(20) if k not in out])
    lows = {k: brute_low(p, t) for k, t in texts.items()}
    bits = sorted(math.ceil(round(lows[k], 6) * 1000) for k in out)
    limit = next(b for k, b in enumerate(bits) if k + 1 >= 0.99 * len(bits)) / 1000 + 0.15
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    assert {k: math.log2(r.perplexity_low) for k, r in got.items()} == pytest.approx(lows, abs=1e-4)
    assert math.log2(got[0].threshold) == pytest.approx(limit, abs=1.1e-3)
    assert {k for k, r in got.items() if r.rejected} == {k for k, v in lows.items() if v > math.log2(got[0].threshold)} != set()


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_quality_on_labels_it_never_saw(spark, size):
    """A third of the labels is taken away before training and thresholds: of their good documents 1 % at most is lost."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    unseen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    got = quality.report(docs, labels.where(~unseen)).join(labels.where(unseen), "doc_id")
    counts = {(r.quality, r.rejected): r["count"] for r in got.groupBy("quality", "rejected").count().collect()}
    good, bad = (counts.get((q, False), 0) + counts.get((q, True), 0) for q in (1, 0))
    assert good > 100 and counts.get((1, True), 0) <= 0.01 * good
    assert counts[0, True] >= 0.85 * bad


def test_quality_edges(spark, make):
    good, bad = "plain words in a plain sentence. ", "@@## || %% ^^ "
    rows = [(k, good * 5 + str(k)) for k in range(30)] + [(100, bad * 40), (101, None), (102, ""), (None, good), (103, good * 20000), (103, good * 20000)]
    docs = make(rows)
    labels = spark.createDataFrame([(k, 1, 0, "x") for k in range(20)] + [(20, 1, 0, "x"), (20, 0, 0, "x"), (None, 1, 1, "x"), (21, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    out = quality.accept(docs, labels)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == sorted((i is None, i or 0) for i, _ in rows if i != 100)
    assert quality.report(docs, labels).where("doc_id in (101, 102)").where("perplexity is null and not rejected").count() == 2
    assert quality.accept(make([]), labels).count() == 0
    assert quality.accept(docs, labels.limit(0)).count() == len(rows)  # nothing is trusted, nothing rejected
    other = docs.withColumn("lang", F.when(F.col("doc_id") == 100, F.lit(None)).otherwise(F.col("lang")))
    assert quality.accept(other, labels).where("doc_id = 100").count() == 1  # no trusted text in its language


LEXICON = {"moron": 7.0, "vequ*": 6.0}


def test_machine():
    g = toxicity.Grammar(LEXICON, toxicity.PRIOR)
    account = lambda text: {k: round(math.expm1(v)) for k, v in zip(toxicity.ACCOUNTS, g.accounts(text), strict=True) if v}
    assert account("a Moron here") == {"insult": 7}
    assert account("oxymoron morons vequelle Vequ") == {"insult": 12}
    assert account("you are a moron") == {"aimed": 7}
    assert account("you are not a moron") == {"negated": 7}
    assert account("he said that you are a moron") == {"reported": 7}
    assert account("he said so. you moron") == {"aimed": 7}  # a new clause
    assert account("not at all so bad. moron") == {"insult": 7}
    assert account("i will kill you") == {"threat": 2} and account("you, i will kill") == {"threat": 2}
    assert account("i will kill time") == {"threat": 1} and account("kill and one two three four you") == {"threat": 1}
    for text in ("i am killing you now", "he kills you", "they killed him", "ich töte dich", "er wird dich umbringen", "te voy a matar"):
        assert account(text) == {"threat": 2}, text
    assert account("what a moron you are") == {"aimed": 7}
    assert account("i will not kill you") == {"negated": 1}
    assert account("she said i will kill you") == {"reported": 1}
    assert account("you aren’t a moron") == account("you aren't a moron") == {"negated": 7}
    assert account("moron moron\nmoron") == {"insult": 21}
    assert account("you not") == {} and account(None) == {} and account("") == {}
    assert 0 <= g.score("") < g.score("a moron") < g.score("a moron, a moron") <= 1


def test_composed_machine_equals_its_parts_in_turn():
    """Every sequence of three kinds after each state that random sequences lead to."""
    table, start = toxicity.MACHINE
    rng = np.random.default_rng(0)
    for _ in range(300):
        kinds = rng.choice(6, rng.integers(1, 30), p=[0.25, 0.2, 0.2, 0.1, 0.05, 0.2]).tolist()
        state, got = start, []
        for k in kinds:
            state, mark = table[state][k]
            got.append(mark)
        marks = [""] * len(kinds)
        for m in toxicity.MACHINES:  # each transducer over the whole sequence, then the next one
            s = m.start
            for i, k in enumerate(kinds):
                s, marks[i] = m.step(s, k, marks[i])
        assert got == marks


def test_lexicon_against_brute_force():
    """The greedy cover, by sets."""
    rng = np.random.default_rng(1)
    names = sorted({"zork", "zork*", "zorkel", "blip", "blip*", "plain", "rare", *[f"w{i}" for i in range(20)]})
    toxic = np.arange(400) < 120
    held = (rng.random((400, len(names))) < 0.1).astype(np.float32)
    for k, share in (("zork", 0.5), ("blip*", 0.4), ("blip", 0.3)):
        held[:, names.index(k)] = rng.random(400) < np.where(toxic, share, 0.01)
    e = toxicity.Evidence(names, toxic.astype(int), held, 0.05, 8)
    weight, sets = {}, {}
    for k, n in enumerate(names):
        t, c = int(held[toxic, k].sum()), int(held[~toxic, k].sum())
        w = math.log((t + 0.5) / 121 / ((c + 0.5) / 281))
        if t >= 6 and w - 2 * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) >= 0.8 + 0.1 * math.log(120):
            weight[n], sets[n] = w, set(np.flatnonzero(held[toxic, k]).tolist())
    times, wanted = [0] * 120, {}
    while sets:
        gain = {k: sum(times[i] < 8 for i in v) for k, v in sets.items()}
        best = max(sorted(sets), key=lambda k: (round(gain[k] * weight[k], 6), not k.endswith("*"), -len(k)))
        if gain[best] < 6:
            sets.pop(best)
            continue
        wanted[best] = weight[best]
        for i in sets[best]:
            times[i] += 1
        root = best.rstrip("*")
        sets = {k: v for k, v in sets.items() if not (k.startswith(root) or root.startswith(k.rstrip("*")))}
    assert e.lexicon(np.ones(400, bool), 0.8) == pytest.approx(wanted) and {"zork", "blip*"} <= set(wanted)


def test_clauses_in_long_texts_are_read_once():
    g = toxicity.Grammar(LEXICON, toxicity.PRIOR)
    text = "filler words " * 3000 + "moron " * 50 + "x. " + "tail " * 2000 + "vequx"
    assert round(math.expm1(g.accounts(text)[0])) == 50 * 7 + 6
    assert len(list(g.clauses(text))) == 2


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scored(docs, labels)
    held = {r.doc_id: r.held_out for r in got.limit(200).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in held}
    rows = got.where("held_out").join(labels, "doc_id").collect()
    hit = sum(r.predicted for r in rows if r.toxic == 1) / sum(r.toxic for r in rows)
    false = sum(r.predicted for r in rows if r.toxic == 0) / sum(1 - r.toxic for r in rows)
    assert hit >= 0.93 and false < 0.01


def test_learning_ignores_the_held_out_fold(spark, make):
    docs = make([(k, f"plain text {k}" + (" zork" if k % 2 else "")) for k in range(400)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    held = labels.where("pmod(crc32(cast(doc_id as string)), 5) = 0")
    flipped = labels.join(held.select("doc_id"), "doc_id", "left_anti").unionByName(held.withColumn("toxic", 1 - F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a[0] == b[0] and set(a[0]) == {"zork"} and a[1].tolist() == b[1].tolist()


def test_toxicity_edges(spark, make):
    docs = make([(1, None), (2, ""), (None, "kill you all"), (3, "x " * 50000), (3, "x"), (4, "moron")])
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None), (3, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.scored(make([]), labels).count() == 0
    assert toxicity.scored(docs, labels.limit(0)).count() == 6
    kept = toxicity.accept(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 6  # with columns whose names clash with the operator's
    assert toxicity.Grammar(LEXICON, toxicity.PRIOR).score("word " * 200000 + "you moron") > 0.5
