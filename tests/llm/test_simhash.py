import numpy as np
import pytest
import xxhash

from terraflux.llm import simhash
from terraflux.llm.common import components, slot_filter


def brute_print(text):
    w = [x for x in bytes(text or "", "utf8").lower().split()]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, errors):
    label = {p: p for p in prints}
    near = {p: [q for q in prints if (p ^ q).bit_count() <= errors] for p in prints}
    changed = True
    while changed:
        changed = False
        for p in prints:
            m = min(label[q] for q in near[p])
            if m < label[p]:
                label[p], changed = m, True
    return label


@pytest.mark.parametrize("text", ["", None, "one", "a b c", "a b c d", "A b C d e f É x", "x " * 70000, " nbsp  \x1f sep"])
def test_fingerprint(text):
    assert simhash.simhash(text) == brute_print(text)


@pytest.mark.parametrize("errors", [0, 1, 2, 4, 6])
def test_trie_join_against_all_pairs(spark, errors):
    rng = np.random.default_rng(errors)
    base = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    x = [base, np.array([0, 1, 3, 7, (1 << 64) - 1], np.uint64)]
    for _ in range(5):
        y = base.copy()
        for _ in range(int(rng.integers(1, 8))):
            y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
        x.append(y)
    ball = base[:1] ^ np.array([np.uint64(1) << np.uint64(a) | np.uint64(1) << np.uint64(b) for a in range(20) for b in range(a)], np.uint64)
    prints = np.unique(np.concatenate([*x, ball]))
    df = spark.createDataFrame([(int(v),) for v in prints.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df, errors)).collect()}
    wanted = brute_components([int(v) for v in prints], errors)
    groups = {}
    for p in prints:
        groups.setdefault(wanted[int(p)], set()).add(int(p.view(np.int64)))
    assert {v: min(g) for g in groups.values() if len(g) > 1 for v in g if v != min(g)} == roots


def test_query_on_the_small_tables(spark, tables):
    docs = tables("documents")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {r.doc_id: brute_print(r.text) for r in docs.collect()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    label = brute_components(sorted(set(prints.values())), 4)
    first = {}
    for i, p in prints.items():
        first[label[p]] = min(i, first.get(label[p], i))
    assert {i: r.component_id for i, r in got.items()} == {i: first[label[p]] for i, p in prints.items()}


def test_edges(spark, make):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text), (3, text.upper()), (5, text), (None, text), (9, None), (8, ""), (7, "other words entirely here today")]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id, r.fingerprint) for r in simhash.near_duplicates(make(rows)).collect()))
    assert len(got) == 7
    assert {c for _, i, c, _ in got if i in (0, 3, 5)} == {3} and {c for _, i, c, _ in got if i in (8, 9)} == {8}
    assert [f for _, i, _, f in got if i == 9] == ["0" * 16]
    kept = simhash.deduplicate(make(rows))
    assert kept.columns == make(rows).columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 7, 8]
    empty = make([])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def test_slot_filter_loses_no_key(spark):
    got = slot_filter(spark.range(2000).selectExpr("nullif(id, 5) AS id"), "id", spark.range(0, 2000, 7).toDF("k"), bits=16).collect()
    assert len(got) == 2000 and all(r.slot_hit for r in got if r.id is not None and r.id % 7 == 0)
    assert sum(r.slot_hit for r in got) < 400 and not any(r.slot_hit for r in got if r.id is None)


def test_components_of_a_chain(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1000), (500, 501)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}
