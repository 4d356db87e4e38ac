import hashlib
import random

import pytest

from terraflux.llm import substrings


def brute(rows, words, span):
    """Kept words of each row (None: unchanged id order can't be told)."""
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - span + 1):
            if i is not None:
                k = tuple(w[s : s + span])
                first[k] = min(i, first.get(k, i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - span + 1):
            if i is not None and first[tuple(w[s : s + span])] < i:
                gone.update(range(s, s + span))
        out.append((i, [x for k, x in enumerate(w) if k not in gone], len(w)))
    return out


def digests(rows, words, span):
    return sorted(((i, n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for i, k, n in brute(rows, words, span)), key=str)


def found(df, span, seed):
    return sorted((tuple(r) for r in substrings.digest(df, span, seed).collect()), key=str)


def corpus(seed):
    """Few distinct words, so that windows repeat by chance and within texts, too."""
    rng = random.Random(seed)
    line = [rng.choice("abcdefgh") for _ in range(40)]
    rows = []
    for i in range(120):
        w = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 30)
            at = rng.randint(0, len(w))
            w[at:at] = line[a : a + rng.randint(1, 30)]
        if rng.random() < 0.2 and rows:
            w = list(rng.choice(rows)[1].split())
            if w:
                w[rng.randrange(len(w))] = "changed"
        rows.append((rng.randint(0, 90), rng.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize("span, seed", [(5, 2), (8, 3), (10, 10), (12, 1)])
def test_against_brute_force(spark, make, words, span, seed):
    rows = corpus(span)
    assert found(make(rows), span, seed) == digests(rows, words, span)


def test_small_tables(spark, tables, words):
    docs = tables("documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs, 50, 8) == digests(rows, words, 50)


def test_edges(spark, make, words):
    p = " ".join(f"w{k}" for k in range(60))
    long = " ".join(f"v{k % 997} {k}" for k in range(60000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, p), (4, p), (5, "x " + p + " y"), (None, p), (6, long), (7, long), (8, "w1 w2"), (9, p.replace(" ", " "))]
    assert found(make(rows), 50, 8) == digests(rows, words, 50)
    out = substrings.deduplicate(make(rows))
    assert out.columns == make(rows).columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    wanted = [(i, t if n == len(k) else b" ".join(k).decode()) for (i, t), (_, k, n) in zip(rows, brute(rows, words, 50), strict=True)]
    assert got == sorted(wanted, key=str)
    assert found(make([]), 50, 8) == [] and substrings.deduplicate(make([])).count() == 0
    with pytest.raises(ValueError):
        substrings.digest(make(rows), 5, 8)


def test_n_chars_follow(spark, tables):
    docs = tables("documents")
    out = substrings.deduplicate(docs)
    assert out.columns == docs.columns and out.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()


def test_copies_within_a_document_are_one_span(spark, make, words):
    """Spans, and what is moved for them, do not grow with how often a document says a line; all copies are cut."""
    def rows(times):
        said = [(i, f"head{i} " + " ".join(["alpha beta"] * (times + i)) + f" mid{i} " + " ".join(f"w{k}" for k in range(40)) + f" alpha beta tail{i}") for i in range(12)]
        line = " ".join(f"v{k}" for k in range(17))
        return said + [(20 + i, f"top{i} " + " ".join([line] * (times // 8 + i)) + f" end{i}") for i in range(6)] + [(30, said[3][1]), (31, said[3][1] + " more")]

    counts = []
    for times in (80, 320):
        docs = make(rows(times))
        assert found(docs, 50, 8) == digests(rows(times), words, 50)
        docs = substrings._identified(docs)
        counts.append((substrings.path_table(docs).count(), substrings.repeated_spans(docs).count()))
    assert counts[0] == counts[1]
