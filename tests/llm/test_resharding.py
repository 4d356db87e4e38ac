"""Resharding: the flow against brute force, the layouts against what they must hold."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraflux.llm import queries, resharding


def cheapest(sizes, capacities, price):
    """Least cost over all integer flows, column by column."""
    best = {tuple(sizes): 0}
    for j, wanted in enumerate(capacities):
        after = {}
        for left, cost in best.items():
            for take in product(*[range(min(x, wanted) + 1) for x in left]):
                if sum(take) == wanted:
                    key = tuple(a - b for a, b in zip(left, take, strict=True))
                    more = cost + sum(t * int(price[i][j]) for i, t in enumerate(take))
                    after[key] = min(after.get(key, more), more)
        best = after
    return min(best.values())


@pytest.mark.parametrize("seed", range(25))
def test_flow_is_cheapest(seed):
    draw = random.Random(seed)
    n, m = draw.randrange(1, 4), draw.randrange(1, 4)
    sizes = [draw.randrange(6) for _ in range(n)]
    capacities = list(np.bincount([draw.randrange(m) for _ in range(sum(sizes))], minlength=m))
    price = np.array([[draw.randrange(5) for _ in range(m)] for _ in range(n)])
    found = resharding.transfers(sizes, [int(x) for x in capacities], price)
    assert [sum(x for i, _, x in found if i == k) for k in range(n)] == sizes
    assert [sum(x for _, j, x in found if j == k) for k in range(m)] == list(capacities)
    assert sum(x * price[i][j] for i, j, x in found) == cheapest(sizes, capacities, price)


def test_only_the_surplus_moves():
    sizes = [10**13, 3, 0, 7]
    capacities = resharding.even(sum(sizes), 6)
    moved = sum(x for i, j, x in resharding.transfers(sizes, capacities) if i != j)
    assert moved == sum(max(0, s - c) for s, c in zip(sizes, capacities, strict=False))
    with pytest.raises(ValueError):
        resharding.transfers([1], [2])


def check(rows, docs, law, shards=24):
    """Every row once, sizes and checksums right, slots gapless, the law kept."""
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == law and r.grown_shard is None and 0 <= r.shard < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    if law == "rows":
        counts = [len(slots[k]) for k in range(shards)]
        assert max(counts) - min(counts) <= 1
    total = Counter()
    for r in rows:
        total[r.shard] += r.size
    return [total[k] for k in range(shards)]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op11_resharding(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int", "old_shard": "int", "rewritten": "boolean"}
    rows = out.collect()
    sizes = check(rows, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], "bytes")
    mean = sum(sizes) / 24
    assert max(abs(s - mean) for s in sizes) < 0.02 * mean
    before = Counter()
    for r in rows:
        before[r.old_shard] += r.size
    surplus = sum(max(0, before[k] - mean) for k in range(24))
    assert sum(r.size for r in rows if r.shard != r.old_shard) < 1.05 * surplus
    assert all(r.rewritten for r in rows if r.shard != r.old_shard) and not all(r.rewritten for r in rows)


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_hot_and_odd_rows(spark, make, law):
    rows = [(k, "copied text " * 20) for k in range(900)] + [(k + 900, f"text {k} " * (k % 9)) for k in range(900)]
    rows += [(None, None), (None, None), (5000, None), (5001, ""), (5001, ""), (5002, "long " * 40_000)]
    docs = make(rows).withColumns({c: F.lit("z") for c in ("size", "block", "shard", "old_shard", "file", "at", "fingerprint", "slot")})
    got = resharding.digest(docs, 24, law).collect()
    sizes = check(got, rows, law)
    if law == "bytes":
        rest = sorted(sizes)[:-1]  # one holds the long text alone
        assert max(sizes) < 201_000 and max(rest) - min(rest) < 700


def test_equal_texts_stay_together(spark, make):
    rows = [(k, f"passage number {k % 400} of some length") for k in range(2000)]
    at = defaultdict(set)
    texts = dict(rows)
    for r in resharding.digest(make(rows), 8).collect():
        at[texts[r.doc_id]].add(r.shard)
    assert sum(len(x) > 1 for x in at.values()) <= 16 and len(at) == 400


def test_other_shards_and_nothing(spark, make):
    docs = make([(k, "word " * (k % 50)) for k in range(600)])
    layout = resharding.lay_out(docs, 6)
    for shards, weights in ((9, None), (4, [1, 2, 3, 4])):
        out = resharding.reshard(layout, shards, weights=weights)
        assert out.count() == 600 and out.select("row.doc_id").distinct().count() == 600
        got = {r.shard: r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
        wanted = [sum(got.values()) * w / sum(weights or [1] * shards) for w in weights or [1] * shards]
        assert max(abs(got[k] - w) for k, w in enumerate(wanted)) < 400
    assert set(out.select("row.*").columns) == set(docs.columns)
    assert resharding.digest(docs.where("false")).collect() == []
    assert [(r.shard, r.slot) for r in resharding.digest(docs.where("doc_id = 3")).collect()][0][1] == 0
    with pytest.raises(ValueError):
        resharding.reshard(layout, 3, law="key")
