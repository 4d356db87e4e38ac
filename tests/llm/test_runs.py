"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from terraflux.llm import queries, runs


def brute(words, least=24, times=3):
    """All runs: for each period the longest stretches of equal words that far apart; a period that a smaller one explains is left out."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, times * q) and not any(all(words[k] == words[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out)


def odd_texts(seed, count):
    draw = random.Random(seed)
    for _ in range(count):
        words = []
        while len(words) < draw.choice((0, 5, 60, 200)):
            unit = [bytes([97 + draw.randrange(draw.choice((1, 2, 3, 20)))]) for _ in range(draw.randrange(1, 9))]
            words += unit * draw.choice((1, 1, 2, 4, 9))
        yield words


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (4, 2), (10, 4), (1, 2)])
def test_equals_brute_force(least, times):
    texts = list(odd_texts(least, 150))
    assert runs.batch_runs(texts, least, times) == [brute(w, least, times) for w in texts]


def test_runs_of_runs_and_unary_texts():
    nested = ([b"x"] * 30 + [b"y"]) * 4
    for words in (nested, [b"a"] * 3000, [b"a", b"b"] * 700 + [b"c"] * 25 + [b"a", b"b"] * 12):
        assert runs.batch_runs([words]) == [brute(words)]


def test_a_text_of_many_words():
    unit = [b"%d" % k for k in range(9000)]
    found = runs.batch_runs([[b"q"] + unit * 4 + [b"r"]])
    assert found == [[(1, 36000, 9000)]]


def test_ordered_sets_split():
    draw = list(range(5000))
    random.Random(1).shuffle(draw)
    held = runs.Ends(draw[0])
    known = {draw[0]}
    for x in draw[1:]:
        assert held.add(x) == (max((y for y in known if y < x), default=None), min((y for y in known if y > x), default=None)) if len(known) % 97 == 0 else held.add(x)
        known.add(x)
    assert list(held) == sorted(known)


def expected(doc_id, text, words):
    found = words(text)
    n, h = len(found), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        found = found[:a] + [found[a + (i - a) % p] for i in range(a, n)]
    listed = brute(found)
    best = None
    for r in listed:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    kept = [w for i, w in enumerate(found) if not any(s + q <= i < s + length for s, length, q in listed)]
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(listed), *first, sha("".join("%d,%d,%d\n" % r for r in listed).encode()), sha(b" ".join(kept)))


def test_query_against_brute_force(spark, sf, words):
    small = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").collect()
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in small], "doc_id long, text string")
    got = sorted(tuple(r) for r in runs.digest(runs.planted(docs)).collect())
    assert got == sorted(expected(r.doc_id, r.text, words) for r in small)
    assert sum(r[1] > 0 for r in got) > len(got) // 20


def test_query_reads_the_whole_table(spark, sf):
    got = queries.op12_runs(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}


def test_odd_rows(spark, make):
    line = " ".join(["a b c"] * 20)
    docs = make([(1, None), (2, ""), (3, " \t\n"), (4, line), (4, line), (None, line), (5, "a " * 100_000)])
    got = {r.doc_id: r for r in runs.digest(docs).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    for k in (1, 2, 3):
        assert (got[k].n_runs, got[k].start, got[k].exponent_milli, got[k].runs_sha256, got[k].collapsed_sha256) == (0, None, None, nothing, nothing)
    assert (got[4].start, got[4].length, got[4].period, got[4].exponent_milli) == (0, 60, 3, 20_000)
    assert got[4].collapsed_sha256 == got[None].collapsed_sha256 == hashlib.sha256(b"a b c").hexdigest()
    assert (got[5].length, got[5].period) == (100_000, 1)
    assert runs.digest(docs).count() == 7
    short = runs.collapse(docs)
    assert short.columns == docs.columns and short.count() == 7
    assert [r.text for r in short.where("doc_id = 4").collect()] == ["a b c"] * 2
    assert [r.text for r in short.where("doc_id in (1, 2, 3)").orderBy("doc_id").collect()] == [None, "", " \t\n"]
    assert runs.digest(docs.limit(0)).collect() == [] and runs.collapse(docs.limit(0)).count() == 0
    assert runs.collapse(docs.withColumn("n_chars", F.length("text"))).where("doc_id = 4").first().n_chars == 5


def test_parameters():
    with pytest.raises(ValueError):
        runs.found_in("text", times=1)
