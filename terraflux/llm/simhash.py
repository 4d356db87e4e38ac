"""Operator 2. SimHash near-duplicates by a binary trie self-join.

Fingerprints are the majority bits of XXH64 over word shingles. Distinct fingerprints
are the leaves of a binary trie; pairs of nodes are traversed together, the differing
bits of their prefixes are added up, and a pair is dropped as soon as the error budget
is exceeded. Two tries are used, one with the upper and one with the lower half of the
bits on top: a pair within e bits has at most e // 2 differing bits in one half, so the
budget of the upper half of either trie is e // 2 and no link is lost.

The top ``cut`` levels are dealt out: a node pair at that depth is one group, and each
fingerprint goes to the pairs its node takes part in. A group returns a spanning forest
of its links, never all pairs; the forests are joined by ``common.components``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, whole_row

CHUNK = 1 << 15
#: Node pairs expanded at a time (each level of the trie may hold four times as many), leaf pairs compared at a time;
#: node pairs with at most LEAVES leaf pairs are compared leaf by leaf.
WIDTH, COMPARED, LEAVES = 1 << 14, 1 << 17, 48
#: The most fingerprints under one dealt node, and the depths to choose from, tried some at a time.
NODE_ROWS, CUTS = 1 << 18, ((4, 6, 8, 10), (12, 14, 16), (20, 24), (28, 32))


def simhash(text: str | None, words_per_shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint as an unsigned 64-bit integer; 0 for a text that is null or has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    shingles = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(islice(words, j, None) for j in range(words_per_shingle)), strict=False)), repeat(seed))
    total = len(words) - words_per_shingle + 1
    ones = np.zeros(64, np.int64)
    for done in range(0, total, CHUNK):
        h = np.fromiter(shingles if total <= CHUNK else islice(shingles, CHUNK), np.uint64, min(CHUNK, total - done))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text, words_per_shingle: int = 4, seed: int = 42):
    """A column with the fingerprint's bits as a signed long."""
    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash(t, words_per_shingle, seed) for t in texts], np.uint64).view(np.int64))

    return fingerprint(text)


def _settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least labels after joining a[i] with b[i], and those of the links that joined two labels."""
    links = []
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label, *(np.concatenate([a[:0], *(x[k] for x in links)]) for k in (0, 1))
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        high, low = np.maximum(x, y), np.minimum(x, y)
        label = label.copy()
        np.minimum.at(label, high, low)
        hooked = np.flatnonzero(low == label[high])
        first = hooked[np.unique(high[hooked], return_index=True)[1]]
        links.append((a[first], b[first]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def trie_join(leaf: np.ndarray, label: np.ndarray, left: int | None, depth: int, apart: int, budgets: list[int], allowed: Callable[[int, int], int], every: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of the leaves of a binary trie, as pairs of positions, some at a time.

    ``leaf`` (uint64) holds the leaves below two nodes at ``depth`` whose prefixes differ in
    ``apart`` bits, each node's sorted, ``left`` of them below the first node; None joins
    one node with itself. Node pairs are traversed together and dropped once their bits
    differ by more than ``allowed(depth, budget)``. Leaves under one label hang together
    already, and a node pair of which this is true of all leaves is pruned.

    ``every`` False: a spanning forest of the links between labels, sought with growing
    budgets so that a dense ball of near copies does not cost its pairs. True: all links
    between leaves under different labels, for the last budget.
    """
    n = len(leaf) if left is None else left
    label = np.unique(label, return_index=True, return_inverse=True)
    label = label[1][label[2]].astype(np.int64)  # the first leaf under the same label
    if not n or left == len(leaf):
        return
    for budget in budgets[-1:] if every else budgets:
        if apart > allowed(depth, budget):
            continue
        seam = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        start = np.array([[0, n, 0, n, apart] if left is None else [0, n, n, len(leaf), apart]], np.int64)
        stack, found = [(depth, start)], []
        while stack:
            at, pairs = stack.pop()
            if len(pairs) > WIDTH:
                stack += [(at, pairs[WIDTH:]), (at, pairs[:WIDTH])]
                continue
            a0, a1, b0, b1, d = pairs.T
            whole = (seam[a1 - 1] == seam[a0]) & (seam[b1 - 1] == seam[b0]) & (label[a0] == label[b0])
            few = ~whole & (((a1 - a0) * (b1 - b0) <= LEAVES) | (at == 64))
            for x in _blocks(pairs[few]):
                a0, a1, b0, b1, d = x.T
                wide = b1 - b0
                count = (a1 - a0) * wide
                of = np.repeat(np.arange(len(count)), count)
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                i, j = a0[of] + k // wide[of], b0[of] + k % wide[of]
                near = (i < j) & (label[i] != label[j])
                i, j = i[near], j[near]
                near = np.bitwise_count(leaf[i] ^ leaf[j]) <= budget
                if every and near.any():
                    yield i[near], j[near]
                elif near.any():
                    found.append((i[near], j[near]))
                    if sum(len(x) for x, _ in found) > COMPARED:
                        label, *links = _settle(label, *map(np.concatenate, zip(*found, strict=True)))
                        yield tuple(links)
                        seam, found = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])]), []
            pairs = pairs[~whole & ~few]
            if not len(pairs) or at == 64:
                continue
            a0, a1, b0, b1, d = pairs.T
            bit = np.uint64(1 << (63 - at))
            above = np.uint64((0xFFFFFFFFFFFFFFFF << (64 - at)) & 0xFFFFFFFFFFFFFFFF)
            am, bm = _middle(leaf, a0, a1, bit, above, n, left is None), _middle(leaf, b0, b1, bit, above, n, left is None)
            own = (a0 == b0) & (a1 == b1)
            children = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1)]
            children = [np.stack(x, 1) for x in children] + [np.stack((am, a1, b0, bm, d + 1), 1)[~own]]
            down = np.concatenate(children)
            down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= allowed(at, budget))]
            if len(down):
                stack.append((at + 1, down))
        if found:
            label, *links = _settle(label, *map(np.concatenate, zip(*found, strict=True)))
            yield tuple(links)


def _blocks(pairs: np.ndarray) -> Iterator[np.ndarray]:
    """Node pairs, some at a time: about COMPARED leaf pairs. A node pair with more (of equal leaves) is taken in strips."""
    large = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) > COMPARED
    for a0, a1, b0, b1, d in pairs[large].tolist():
        wide = max(1, min(b1 - b0, COMPARED))
        tall = max(1, COMPARED // wide)
        for a in range(a0, a1, tall):
            for b in range(b0, b1, wide):
                yield np.array([[a, min(a + tall, a1), b, min(b + wide, b1), d]])
    pairs = pairs[~large]
    total = np.cumsum((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]))
    at = 0
    while at < len(pairs):
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + COMPARED, "right")))
        yield pairs[at:stop]
        at = stop


def trie_forest(left: np.ndarray, right: np.ndarray | None, depth: int, apart: int, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``errors`` bits, as pairs of fingerprints.

    ``left`` and ``right`` are the leaves (uint64, distinct, any order) below two nodes at
    ``depth`` whose prefixes differ in ``apart`` bits; ``right`` None joins a node with itself.
    """
    leaf = np.sort(left) if right is None else np.concatenate([np.sort(left), np.sort(right)])
    budgets = sorted({e for e in (1, 2, errors) if apart <= e <= errors} | {errors})
    found = [*trie_join(leaf, np.arange(len(leaf)), None if right is None else len(left), depth, apart, budgets, lambda at, budget: budget // 2 if at < 32 else budget)]
    a, b = (np.concatenate([leaf[:0], *(leaf[x[k]] for x in found)]) for k in (0, 1))
    return b, a


def _middle(leaf, lo, hi, bit, above, n, one_side):
    """Where the leaves with the next bit set begin below each node [lo, hi)."""
    key = (leaf[lo] & above) | bit
    if one_side:
        return np.clip(np.searchsorted(leaf, key), lo, hi)
    at = np.where(lo < n, np.searchsorted(leaf[:n], key), n + np.searchsorted(leaf[n:], key))
    return np.clip(at, lo, hi)


def links(fingerprints: DataFrame, errors: int = 4) -> DataFrame:
    """Spanning links ``(a, b)`` of a table of distinct fingerprints ``fp`` (signed longs)."""
    if not 0 <= errors <= 31:
        raise ValueError("errors must be 0 to 31")
    if not errors:
        return fingerprints.where("false").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    half = errors // 2
    turned = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    tries = fingerprints.select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("fp").alias("v")), F.struct(F.lit(1).alias("turn"), turned.alias("v")))).alias("x")).select("x.*")
    cut = next((c for cuts in CUTS for c, most in _largest(tries, cuts) if most <= NODE_ROWS), CUTS[-1][-1])
    masks = [sum(1 << b for b in bits) for e in range(half + 1) for bits in combinations(range(cut), e)]
    prefix = F.shiftrightunsigned("v", 64 - cut)
    dealt = (
        tries.withColumn("prefix", prefix).withColumn("mask", F.explode(F.array(*[F.lit(m) for m in masks])))
        .select("turn", F.least("prefix", F.col("prefix").bitwiseXOR(F.col("mask"))).alias("low"), "mask", "v")
    )

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        turn, low, mask = (int(x) for x in key)
        v = rows["v"].to_numpy().view(np.uint64)
        if mask:
            first = (v >> np.uint64(64 - cut)) == low
            a, b = trie_forest(v[first], v[~first], cut, mask.bit_count(), errors)
        else:
            a, b = trie_forest(v, None, cut, 0, errors)
        if turn:
            a, b = ((x << np.uint64(32)) | (x >> np.uint64(32)) for x in (a, b))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("turn", "low", "mask").applyInPandas(join, "a long, b long")


def _largest(tries: DataFrame, cuts: tuple[int, ...]) -> list[tuple[int, int]]:
    """The most rows under one node at each depth."""
    prefix = F.expr("shiftrightunsigned(v, 64 - cut)")
    nodes = tries.withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts]))).groupBy("turn", "cut", prefix.alias("node")).count()
    return sorted((r.cut, r.most) for r in nodes.groupBy("cut").agg(F.max("count").alias("most")).collect()) or [(cuts[0], 0)]


def near_duplicates(docs: DataFrame, errors: int = 4, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs(doc_id, text)``.

    Null and wordless texts have fingerprint zero and are linked like any other; repeated
    rows and repeated doc_ids stay as rows of their own. ``component_id`` is the smallest
    doc_id reachable, null only if every row reachable has a null doc_id. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(F.col("text"), words_per_shingle, seed).alias("fp")), "simhash-rows")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(least.select("fp"), errors), "simhash")
    classes = materialise(least.join(roots, least["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-classes")
    # Written, so that both sides of the next join are dealt anew and a large component can be split.
    ids = materialise(classes.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-ids")
    by_print = classes.join(ids, "root").select("fp", "component_id")
    return rows.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, errors: int = 4, words_per_shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id.

    Rows with a null doc_id have no order and are all kept, as their copies can't be told;
    of rows that share a doc_id one is kept. All columns stay, whatever their names.
    """
    found = near_duplicates(docs.select("doc_id", "text"), errors, words_per_shingle, seed)
    firsts = found.where("doc_id = component_id").select(F.col("doc_id").alias("first_doc"), F.col("fingerprint").alias("first_print")).distinct()
    firsts = firsts.groupBy("first_doc").agg(F.min("first_print").alias("first_print"))
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), whole_row(docs))
    kept = rows.where("key is not null").join(firsts.hint("shuffle_hash"), F.col("key") == F.col("first_doc"), "left_semi")
    return kept.dropDuplicates(["key"]).unionByName(rows.where("key is null")).select("row.*")
