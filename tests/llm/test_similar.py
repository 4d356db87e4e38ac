import math
import random

import numpy as np
import pytest

import corpus_pipeline
from terraflux.llm import common, simhash, similar


def jaccard(a, b):
    a, b = (frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def smallest(texts, similarity=0.8):
    label = {i: i for i in texts}
    near = {i: [j for j in texts if jaccard(texts[i], texts[j]) >= similarity] for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            m = min(label[j] for j in near[i])
            changed, label[i] = changed or m < label[i], min(m, label[i])
    return sorted(i for i in texts if label[i] == i)


def test_stage_drops_copies_many_bits_apart(spark, make):
    """Similarity at or just over 0.8 counts, though the fingerprints are more than four bits apart."""
    texts = {}
    for k in range(30):
        w = [f"w{k}x{j}" for j in range(94)]
        texts[10 * k + 2] = " ".join(w)
        texts[10 * k + 1] = " ".join([*w[:40], "other", *w[41:70], *w[71:]])
        texts[10 * k + 5] = " ".join([*w[:30], "one", *w[31:50], "two", *w[51:80], "three", *w[81:]])
    apart = [(simhash.simhash(texts[10 * k + 1]) ^ simhash.simhash(texts[10 * k + 2])).bit_count() for k in range(30)]
    assert max(apart) > 4 and all(jaccard(texts[10 * k + 1], texts[10 * k + 2]) >= 0.8 for k in range(30))
    docs = make(list(texts.items()))
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == smallest(texts)


def test_against_all_pairs(spark, tables):
    rows = {r.doc_id: r.text or "" for r in tables("documents").collect()}
    assert sorted(r.doc_id for r in similar.deduplicate(tables("documents")).collect()) == smallest(rows)


def test_ball_of_copies_and_edges(spark, make):
    w = [f"v{j}" for j in range(200)]
    ball = {i: " ".join([*w[: 5 + i], f"z{i}", *w[6 + i :]]) for i in range(90)}
    assert smallest(ball) == [0]
    rows = [*ball.items(), (None, ball[3]), (500, None), (501, ""), (502, "a b"), (503, "A  b"), (503, "a b"), (504, "b a")]
    got = similar.deduplicate(make(rows))
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in got.collect()) == [-1, 0, 500, 502, 504]
    assert similar.deduplicate(make([])).count() == 0


def test_forests_and_tiles_lose_no_link(spark, make, monkeypatch):
    """Nodes that propose forests, and nodes dealt as tiles, give the same groups."""
    w = [f"v{j}" for j in range(60)]
    texts = {i: " ".join([*w[: 2 + i % 50], f"z{i}", *w[3 + i % 50 :]]) for i in range(40)} | {100 + i: " ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)}
    wanted = smallest(texts)
    for name, value in (("MANY", -4), ("NODE_ROWS", 3), ("TEXTS", 5)):
        monkeypatch.setattr(similar, name, value)
        assert sorted(r.doc_id for r in similar.deduplicate(make(list(texts.items()))).collect()) == wanted


def test_ball_of_texts_not_quite_alike_moves_its_rows_not_its_pairs(spark, make):
    """No intermediate table has more rows than documents times tables."""
    draw = random.Random(7)
    texts = {}
    for i in range(110):
        w = [f"v{j}" for j in range(200)]
        for at in draw.sample(range(10, 190), 4):
            w[at] = f"z{i}x{at}"
        texts[i] = " ".join(w)
    assert smallest(texts) == sorted(texts)
    with common.recorded() as made:
        kept = [r.doc_id for r in similar.deduplicate(make(list(texts.items()))).collect()]
    assert sorted(kept) == sorted(texts)
    assert max(spark.read.parquet(t.path).count() for t in made) <= similar.TABLES * len(texts)


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_most_bits_bounds_small_sets(similarity):
    """The exact chance that the majority bits of two sets differ is below the bound's."""
    chances = [np.array([math.comb(n, k) for k in range(n + 1)], float) / 2.0**n for n in range(121)]
    more = lambda n, k: chances[n][max(0, k) :].sum()
    bits = 1 << 40  # so that deviations don't count
    for a in range(1, 121):
        for b in range(math.ceil(similarity * a - 1e-9), a + 1):
            c = math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)
            if c <= b:
                one, two = (np.array([more(n - c, n // 2 + 1 - k) for k in range(c + 1)]) for n in (a, b))
                p = (chances[c] * (one * (1 - two) + two * (1 - one))).sum()
                assert p <= similar.most_bits(similarity, np.array([a]), bits)[0] / bits + 1e-9, (a, b, c)
