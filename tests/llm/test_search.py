import numpy as np
import pytest

from terraflux.llm import neighbours, topk


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string")


ODD = [(1000, [0.5] * 8), (1000, [0.5] * 8), (1001, [float("nan")] * 8), (1002, None), (None, [0.1] * 8), (1003, [-30000.5] + [0.0] * 7), (1050, [1.0, None]), (1100, [1.0, 2.0]), (1101, [-1.0, 2.5]), (1150, []), (1200, [0.0] * 8), (1201, [float("inf")] * 8)]


def vectors(seed, n=900, d=8):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 0.3, (6, d))
    x = centre[rng.integers(0, 6, n)] + rng.normal(0, 0.1, (n, d))
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third of all rows the same
    x = np.vstack([x, np.round(x[:50], 1)])
    return [(int(i), [float(np.float32(v)) for v in row]) for i, row in zip(rng.permutation(len(x)), x, strict=True)]


def usable(rows, zero):
    keep = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    return [(i, v) for i, v in keep if zero or v.any()]


@pytest.mark.parametrize("seed, files", [(1, 1), (2, 5)])
def test_top_k_against_brute_force(spark, seed, files):
    rows = vectors(seed) + ODD
    got = sorted(tuple(r) for r in topk.top_k(table(spark, rows).repartition(files), "vec_id", "embedding", 50, 5).collect())
    q = [(i, np.floor(256 * v).astype(np.int64)) for i, v in usable(rows, True)]
    wanted = []
    for a, (i, v) in enumerate(q):
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for b, (j, w) in enumerate(q) if b != a and len(w) == len(v))[:5]
            wanted += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(wanted)


def test_top_k_in_small_blocks(spark, monkeypatch):
    """Many groups and slots of queries give the same rows."""
    rows = vectors(5, 400)
    wanted = sorted(tuple(r) for r in topk.top_k(table(spark, rows), "vec_id", "embedding", 20, 5).collect())
    for name in ("GROUP", "QUERIES", "ASKED"):
        monkeypatch.setattr(topk, name, 2)
    assert sorted(tuple(r) for r in topk.top_k(table(spark, rows).repartition(7), "vec_id", "embedding", 20, 5).collect()) == wanted


def test_large_components_take_part(spark):
    rows = [(0, [1.0, 0.5]), (1, [1e6, -3.0]), (2, [-1.0, 2.0]), (50, [6e5, 1e5]), (100, [1e8, 0.0]), (101, [2.0**20, 2.0**21])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 50, 5).collect())
    q = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    wanted = []
    for i in (0, 50, 100):
        best = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i)[:5]
        wanted += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(wanted)
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(spark.createDataFrame([(50, [1e14]), (1, [1e14])], "vec_id long, embedding array<double>"), "vec_id", "embedding", 50, 5).collect()
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(spark.createDataFrame([(50, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding", 50, 5).collect()


def test_bit_slices():
    rng = np.random.default_rng(0)
    for low, high in ((-256, 256), (0, 1), (-5, 0), (-(1 << 26), 1 << 26), (0, 0)):
        x = rng.integers(low, high + 1, (130, 6))
        cut = topk.slices(x).copy()
        cut[:, -1] ^= np.uint64(0xFFFFFFFFFFFFFFFF)
        query = rng.integers(low, high + 1, 6)
        constant, sums = topk.added(cut, query)
        live = np.packbits(np.arange(192) < 130, bitorder="little").view(np.uint64)
        rows, total = topk.select(sums, live, np.arange(192), 130)
        assert sorted(rows.tolist()) == list(range(130))
        assert (total + constant == (x @ query)[rows]).all()


def test_top_k_edges(spark):
    assert topk.top_k(table(spark, []), "vec_id", "embedding", 50, 5).count() == 0
    assert topk.top_k(table(spark, [(50, [1.0])]), "vec_id", "embedding", 50, 5).count() == 0


def nearest(rows, every, k):
    rows = [(i, tuple(v)) for i, v in usable(rows, False)]
    out = {}
    for a, (i, v) in enumerate(rows):
        if i % every == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for b, (j, w) in enumerate(rows) if len(w) == len(v) and a != b)[:k]
            out[i, v] = near
    return out


@pytest.mark.parametrize("piece, asked", [(4096, 1024), (100, 2)])
def test_neighbours_recall(spark, monkeypatch, piece, asked):
    monkeypatch.setattr(neighbours, "PIECE", piece)
    monkeypatch.setattr(neighbours, "ASKED", asked)
    rows = vectors(3) + ODD
    got = neighbours.nearest(table(spark, rows), "vec_id", "embedding", 25, 10).collect()
    wanted = nearest(rows, 25, 10)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for (i, _), near in wanted.items():
        times = sum(j == i for j, _ in usable(rows, False))
        mine = sorted(found[i])[::times]
        assert len(mine) * times == len(found[i])
        assert [x[0] for x in mine] == list(range(1, len(near) + 1))
        assert [x[2] for x in mine] == sorted(x[2] for x in mine)
        hits += len({x[1] for x in mine} & {j for _, j in near})
        total += len(near)
        for _, j, d in mine:
            assert j != i or d > 0 or times > 1
    assert hits / total >= 0.95


def test_neighbours_recall_on_embeddings(spark):
    """Recall against all rows of the table itself."""
    docs = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in docs.collect() if r.embedding is not None and None not in r.embedding]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = {}
    for r in neighbours.nearest(docs, "vec_id", "embedding", 100, 10).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != k][:10]
        hits, total = hits + len({int(ids[j]) for j in order} & found[int(ids[k])]), total + 10
    assert hits / total >= 0.9, hits / total


def test_neighbours_edges(spark):
    assert neighbours.nearest(table(spark, []), "vec_id", "embedding", 100, 10).count() == 0
    few = [(0, [1.0, 0.0]), (7, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 2.0])]
    got = [tuple(r) for r in neighbours.nearest(table(spark, few), "vec_id", "embedding", 100, 10).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 0.0), (0, 2, 7, 0.0), (0, 3, 9, pytest.approx(5**0.5))]


def test_chi_square():
    assert neighbours.chi_square_cdf(15.507) == pytest.approx(0.95, abs=1e-4)
    assert neighbours.stop_ratio(0.99) == pytest.approx(20.09, abs=0.01)
