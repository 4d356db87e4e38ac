"""Operator 2 for near copies by shingle similarity: SimHash tries propose, the shingle sets decide.

A text's set is that of its word 5-grams. A set has ``TABLES`` fingerprints of 64 bits,
each the majority bits of its shingles' hashes under another seed. The fingerprints of a
table are joined with themselves over their binary trie (``simhash.trie_join``): no error
is allowed in the first ``EXACT`` levels and ``APART`` in all. Two sets of Jaccard
similarity J of equal size differ in a bit with a chance of acos(2J / (1 + J)) / pi, 0.15
at 0.8; so one table misses a pair of that similarity with a chance of 0.907, and all
tables with one of 0.009 (0.0006 at 0.85).

Every link is verified on the sets. A node proposes its members that are near another one
they don't hang together with yet, not the pairs of them, so that what is moved grows with
the rows and tables, whatever a group's size. The members' texts meet again by node (in
blocks); of their pairs, those whose fingerprints in all tables differ too much for the
similarity are passed over (``most_bits``), the others are verified, and a forest of links
is returned. A first round over a few tables joins most of what is alike, a second one
takes all tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, slot_filter, trimmed, trimming_groups, whole_row
from .simhash import trie_join

TABLES, EXACT, APART = 48, 14, 11
#: Tables of the first round, and the near pairs a row from which on all rows of a node are taken for members.
ROUND, MANY = 4, 64
#: Rows that a dealt node has on average.
NODE = 1 << 10
#: The most rows of a dealt node, or of one side of a tile of a larger one; texts of one side of a tile that is verified in place.
NODE_ROWS, TEXTS = 1 << 16, 1 << 12
#: Shingles worked on at a time, and pairs whose fingerprints in all tables are compared at a time.
STEP, PAIRS = 1 << 11, 1 << 12


def shingles(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the word n-grams; of all words where there are fewer, none without words."""
    words = (text or "").encode().lower().split()
    grams = map(b" ".join, zip(*(islice(words, j, None) for j in range(min(words_per_shingle, len(words)))), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64))


@cache
def _seeds(tables: int) -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 63, tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprints(grams: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """The majority bits under each seed, counted in bit slices: full adders reduce the rows of one weight."""
    level: list[np.ndarray] = []
    for at in range(0, len(grams), STEP):
        carry = grams[at : at + STEP, None] * _seeds(tables)
        carry ^= carry >> np.uint64(32)
        carry *= np.uint64(0xD6E8FEB86659FD93)
        carry ^= carry >> np.uint64(29)
        w = 0
        while len(carry):
            layer = np.concatenate([level[w], carry]) if w < len(level) else carry
            out = [carry[:0]]
            while (n := len(layer) // 3) or len(layer) == 2:
                if n:
                    a, b, c = layer[:n], layer[n : 2 * n], layer[2 * n : 3 * n]
                    x = a ^ b
                    out.append((a & b) | (c & x))
                    layer = np.concatenate([x ^ c, layer[3 * n :]])
                else:
                    out.append(layer[:1] & layer[1:])
                    layer = layer[:1] ^ layer[1:]
            level[w : w + 1] = [layer]
            carry, w = np.concatenate(out), w + 1
    more, even = np.zeros(tables, np.uint64), np.full(tables, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for w in reversed(range(len(level))):
        if len(grams) // 2 >> w & 1:
            even = even & level[w][0]
        else:
            more, even = more | (even & level[w][0]), even & ~level[w][0]
    return more


def _sketches(words_per_shingle: int):
    @F.pandas_udf("fp long, prints array<long>, size int, block binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=3)
        for texts in trimmed(batches):
            sets = [shingles(t, words_per_shingle) for t in texts]
            own = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"fp": own, "prints": [fingerprints(s).view(np.int64) for s in sets], "size": np.array([len(s) for s in sets], np.int32), "block": [press.compress((t or "").encode()) for t in texts]})

    return sketch


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets have the Jaccard similarity."""
    both = len(a) + len(b)
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (both - common) - 1e-9


def most_bits(similarity: float, size: np.ndarray, bits: int) -> np.ndarray:
    """The most of ``bits`` bits in which two sets of the similarity, ``size`` the larger one's, differ.

    More is five standard deviations off, a chance of some 3e-7. Majorities of small sets
    differ more often than the angle says, by less than 0.5 / size (tested to 0.95).
    """
    p = np.minimum(0.5, math.acos(2 * similarity / (1 + similarity)) / math.pi + 0.5 / np.maximum(size, 1))
    return bits * p + 5 * np.sqrt(bits * p * (1 - p))


def _likely(prints: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose sizes and fingerprints allow the similarity, the nearest first."""
    small, large = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
    fits = small >= similarity * large - 1e-9
    a, b, large = a[fits], b[fits], large[fits]
    differ = np.concatenate([np.zeros(0, np.int64), *[np.bitwise_count(prints[a[k : k + PAIRS]] ^ prints[b[k : k + PAIRS]]).sum(1, dtype=np.int64) for k in range(0, len(a), PAIRS)]])
    order = np.argsort(differ, kind="stable")
    order = order[(differ <= most_bits(similarity, large, 64 * prints.shape[1]))[order]]
    return a[order], b[order]


def _tiled(rows: DataFrame, keys: list[str], many: DataFrame, names: tuple[str, str]) -> DataFrame:
    """``rows`` dealt as tiles: the rows of a key are split into ``blocks``, and each pair of blocks is one.

    ``many`` has the keys and ``blocks``; other keys have one block. Columns ``names`` are the
    tile, ``first`` whether a row is of its first block.
    """
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    rows = rows.join(many, keys, "left").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return rows.withColumns({names[0]: F.least("own", "other"), names[1]: F.greatest("own", "other"), "first": F.col("own") <= F.col("other")}).drop("own", "other", "blocks")


def _dealt(prints: DataFrame, labels: DataFrame | None, size: int, tables: int) -> tuple[DataFrame, int]:
    """The nodes of the first ``tables``: ``t, tip, i, j, v, fp, root, first``; and their depth."""
    rows = prints.withColumn("root", F.col("fp"))
    if labels is not None:
        rows = prints.join(labels, prints["fp"] == labels["node"], "left").select("fp", "prints", F.coalesce("root", "fp").alias("root"))
    cut = min(EXACT, max(4, (size // NODE).bit_length()))
    some = F.array(*[F.struct(F.lit(t).alias("t"), F.get("prints", F.lit(t)).alias("v")) for t in range(tables)])
    rows = rows.select("fp", "root", F.explode(some).alias("x")).select("x.t", F.shiftrightunsigned("x.v", 64 - cut).alias("tip"), "x.v", "fp", "root")
    large = materialise(rows.groupBy("t", "tip").count().where(F.col("count") > NODE_ROWS).select("t", "tip", F.ceil(F.col("count") / NODE_ROWS).cast("int").alias("blocks")), "similar-large")
    if large.isEmpty():
        return rows.withColumns({"i": F.lit(0), "j": F.lit(0), "first": F.lit(True)}), cut
    return _tiled(rows, ["t", "tip"], large, ("i", "j")), cut


def _leaves(held: pa.Table, tile: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None]:
    """Leaves in the order of a trie (those of the first block first), their labels, the order, and the rows of the first block."""
    v, fp, root, first = (held.column(c).to_numpy() for c in ("v", "fp", "root", "first"))
    order = np.lexsort((fp, root, v.view(np.uint64), ~first))
    return v[order].view(np.uint64), root[order], order, int(first.sum()) if tile else None


def _near(leaf: np.ndarray, label: np.ndarray, left: int | None, cut: int, exact: int, apart: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return trie_join(leaf, label, left, cut, 0, [apart], lambda at, budget: budget if at >= exact else 0, every=True)


def _members(rows: DataFrame, cut: int) -> DataFrame:
    """The rows of each node that are near another one under a different label, or all of them where near pairs are very many."""
    exact, apart, many = EXACT, APART, MANY

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        leaf, label, order, left = _leaves(table, key[2].as_py() != key[3].as_py())
        met, count = np.zeros(len(leaf), bool), 0
        for a, b in _near(leaf, label, left, cut, exact, apart):
            met[a] = met[b] = True
            count += len(a)
            if count > many * len(leaf):
                met[:] = True
                break
        yield from table.take(order[met]).to_batches()

    ddl = "t int, tip long, i int, j int, v long, fp long, root long, first boolean"
    return rows.select(*[x.split()[0] for x in ddl.split(", ")]).groupBy("t", "tip", "i", "j").applyInArrow(trimming_groups(join), ddl)


def _forests(members: DataFrame, cut: int, texts: DataFrame, similarity: float, words_per_shingle: int) -> DataFrame:
    """Verified links ``a, b`` inside the nodes of ``members``: what joins them to one another as far as they are alike.

    ``texts`` has ``fp, prints, size, block``. Texts are dealt in tiles of at most TEXTS a side.
    """
    exact, apart, key = EXACT, APART, ["t", "tip", "i", "j"]
    blocks = members.groupBy(*key).agg(F.ceil(F.count("*") / TEXTS).cast("int").alias("blocks")).where("blocks > 1")
    dealt = _tiled(members.withColumnRenamed("first", "upper"), key, blocks, ("x", "y")).join(texts, "fp")

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        leaf, label, order, left = _leaves(table, key[4].as_py() != key[5].as_py())
        fp, upper, size = (table.column(c).to_numpy()[order] for c in ("fp", "upper", "size"))
        prints = table.column("prints").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(fp), -1)[order]
        press, tile, blocks = zstandard.ZstdDecompressor(), key[2].as_py() != key[3].as_py(), table.column("block")
        sets: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingles(press.decompress(blocks[order[i]].as_py()).decode(), words_per_shingle)
            return sets[i]

        top = {int(x): int(x) for x in np.unique(label)}

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        label, found = label.tolist(), []
        for a, b in _near(leaf, np.array(label), left, cut, exact, apart):
            if tile:  # rows of one block of the larger tile meet elsewhere
                a, b = a[keep := upper[a] != upper[b]], b[keep]
            for i, j in zip(*(x.tolist() for x in _likely(prints, size, a, b, similarity)), strict=True):
                x, y = root(label[i]), root(label[j])
                if x != y and alike(of(i), of(j), similarity):
                    top[max(x, y)] = min(x, y)
                    found.append((min(fp[i], fp[j]), max(fp[i], fp[j])))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.groupBy(*key, "x", "y").applyInArrow(trimming_groups(join), "a long, b long")


def links(rows: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5) -> DataFrame | None:
    """``node, root`` over ``rows(fp, prints, size, block)``; None if no two texts are alike."""
    prints = materialise(rows.groupBy("fp").agg(F.first("prints").alias("prints")), "similar-prints")
    size, labels, found = prints.count(), None, None

    def texts(met: DataFrame) -> DataFrame:
        met = materialise(met.distinct(), "similar-met")
        some = slot_filter(rows, "fp", met).where("slot_hit").groupBy("fp").agg(*[F.first(c).alias(c) for c in ("prints", "size", "block")])
        return materialise(some.join(met.hint("shuffle_hash"), "fp", "left_semi"), "similar-texts")

    for tables in (ROUND, TABLES):
        dealt, cut = _dealt(prints, labels, size, tables)
        members = materialise(_members(dealt, cut), "similar-members")
        if members.isEmpty():
            continue
        new = materialise(_forests(members, cut, texts(members.select("fp")), similarity, words_per_shingle), "similar-links")
        if not new.isEmpty():
            found = new if found is None else found.union(new)
            labels = components(found, "similar")
    return labels


def deduplicate(docs: DataFrame, similarity: float = 0.8, words_per_shingle: int = 5) -> DataFrame:
    """``docs`` with one row, that with the smallest doc_id, of each group linked by ``similarity`` or more.

    Texts without words (null, empty) are copies of each other. Very long texts are read
    whole. Rows with a null doc_id are all kept; of rows that share a doc_id one is kept.
    All columns stay, whatever their names. An empty table gives an empty result.
    """
    sketched = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _sketches(words_per_shingle)("text").alias("s"))
    rows = materialise(sketched.select("doc_id", "s.*"), "similar-rows")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = links(rows.select("fp", "prints", "size", "block"), similarity, words_per_shingle)
    if roots is not None:
        least = least.join(roots, least["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first_id").alias("first_id"))
    firsts = materialise(least.where("first_id is not null").select(F.col("first_id").alias("first_doc")).distinct(), "similar-first")
    whole = docs.select(F.col("doc_id").cast("long").alias("key"), whole_row(docs))
    kept = whole.where("key is not null").join(firsts.hint("shuffle_hash"), F.col("key") == F.col("first_doc"), "left_semi")
    return kept.dropDuplicates(["key"]).unionByName(whole.where("key is null")).select("row.*")
