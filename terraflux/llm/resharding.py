"""Operator 11. Resharding by minimum-cost flow.

``lay_out`` writes documents into shards by a hash of their text, so that equal texts lie
together, as one file a block: a block holds texts of like size and hash, larger blocks
first in a shard's order. Shards so made are uneven. ``reshard`` takes the shards' sizes
and new capacities, solves the flow from old shards to new ones that moves the fewest
bytes (or costs least, with a price for each pair of shards), and turns it into
transfers: a shard's blocks stay or go in order, whole but for those on a bound between
two destinations, whose rows are dealt, largest first, to the destination that lacks
most. Only files of blocks that go or are cut are rewritten; the others stay as they are.

The flow is solved on the driver over shards, not rows: what is collected are sizes of
shards, of at most ``CLASSES * SLOTS`` buckets a shard, and of the blocks on a bound, fewer
than old and new shards together. Blocks and files are placed by joins and running sums
over one row each. Blocks are bounded in bytes and in rows, so a text of which a third of
all rows are copies fills many blocks, dealt by doc_id.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir, whole_row

#: Buckets of a shard: 40 classes of size by 128 slots of the text's hash. Bytes and rows of a block at most, and rows of a table that is broadcast.
CLASSES, SLOTS = 40, 128
BLOCK_BYTES, BLOCK_ROWS, BROADCAST_ROWS = 256 << 20, 1 << 20, 1 << 17


def transfers(sizes: list[int], capacities: list[int], price: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """``(from, to, amount)``: the cheapest flow from shards of ``sizes`` into ``capacities`` of the same sum.

    ``price[i, j]`` (integers) is for a unit moved from i to j; without it 0 where i = j,
    else 1. Shortest augmenting paths: sources are relaxed against all sinks, and back
    over arcs in use, until nothing gets nearer; then as much as the path bears is sent.
    """
    if sum(sizes) != sum(capacities):
        raise ValueError("capacities must add up to the sizes")
    n, m = len(sizes), len(capacities)
    cost = (1 - np.eye(n, m, dtype=np.int64)) if price is None else np.asarray(price, np.int64)
    supply, demand = np.array(sizes, np.int64), np.array(capacities, np.int64)
    flow, far = np.zeros((n, m), np.int64), np.int64(1) << 60
    while supply.any():
        to_source, entered = np.where(supply > 0, 0, far), np.full(n, -1)
        to_sink, left = np.full(m, far), np.full(m, -1)
        while True:
            through = to_source[:, None] + cost
            nearer = through.min(axis=0) < to_sink
            to_sink, left = np.where(nearer, through.min(axis=0), to_sink), np.where(nearer, through.argmin(axis=0), left)
            back = np.where(flow > 0, to_sink[None, :] - cost, far)
            nearer = back.min(axis=1) < to_source
            if not nearer.any():
                break
            to_source, entered = np.where(nearer, back.min(axis=1), to_source), np.where(nearer, back.argmin(axis=1), entered)
        sink = last = int(np.where(demand > 0, to_sink, far + far).argmin())
        forward, reverse = [], []
        while True:
            source = int(left[sink])
            forward.append((source, sink))
            if entered[source] < 0:
                break
            sink = int(entered[source])
            reverse.append((source, sink))
        amount = min([int(supply[source]), int(demand[last]), *(int(flow[x]) for x in reverse)])
        for sign, arcs in ((1, forward), (-1, reverse)):
            for x in arcs:
                flow[x] += sign * amount
        supply[source] -= amount
        demand[last] -= amount
    return [(int(i), int(j), int(flow[i, j])) for i, j in zip(*np.nonzero(flow), strict=True)]


def even(total: int, shards: int) -> list[int]:
    """Capacities that differ by one at most."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def around(total: int, shards: int, largest: list[tuple[int, int]]) -> list[int]:
    """Even capacities, but for rows that no even share could hold: each gets a shard of its size, and the others share the rest.

    ``largest`` are the ``(size, old shard)`` of the largest rows, as many as shards. Such a row's
    shard is the one it lies in, if that is one of the new ones and not taken by a larger row.
    """
    alone: dict[int, int] = {}
    rest = total
    for size, old in sorted(largest, reverse=True):
        if len(alone) + 1 >= shards or size * (shards - len(alone)) <= rest:
            break
        alone[old if old < shards and old not in alone else next(k for k in range(shards) if k not in alone)] = size
        rest -= size
    others = iter(even(rest, shards - len(alone)))
    return [alone[k] if k in alone else next(others) for k in range(shards)]


def _blocks(sums: list, shards: int, files: int) -> list[tuple[int, int, int, int]]:
    """``(old_shard, bucket, first, parts)``: light buckets share a block, heavy ones get several."""
    total = sum(r.bytes for r in sums)
    most = max(1, min(BLOCK_BYTES, total // (shards * files)))
    out, block, held, rows, before = [], 0, 0, 0, None
    for r in sorted(sums, key=lambda r: (r.old_shard, r.bucket)):
        parts = max(-(-r.bytes // (2 * most)), -(-r.rows // BLOCK_ROWS)) if r.bytes > 2 * most or r.rows > BLOCK_ROWS else 1
        if before is not None and (r.old_shard != before or parts > 1 or held + r.bytes > most or rows + r.rows > BLOCK_ROWS):
            block, held, rows = block + 1, 0, 0
        out.append((r.old_shard, r.bucket, block, parts))
        before, held, rows = r.old_shard, held + r.bytes, rows + r.rows
        if parts > 1:
            block, held, rows, before = block + parts, 0, 0, None
    return out


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))


def _bounded(df: DataFrame) -> DataFrame:
    """A hint to broadcast, if the rows were counted and are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def lay_out(docs: DataFrame, shards: int, files: int = 16) -> DataFrame:
    """Writes ``docs`` into shards by hash of the text, a file a block, about ``files`` or more to a shard.

    The layout that is read back has each document as ``row``, its ``size`` and text's
    ``fingerprint``, ``old_shard``, ``block``, and ``file`` and ``at`` (its place there).
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(whole_row(docs), size_of(text).alias("size"), F.xxhash64(text).alias("fingerprint"), F.col("doc_id").alias("dealt"))
    level = F.least(F.floor(F.log2("size")), F.lit(CLASSES - 1))
    rows = rows.withColumn("old_shard", F.pmod("fingerprint", F.lit(shards)).cast("int"))
    rows = rows.withColumn("bucket", ((CLASSES - 1 - level) * SLOTS + F.pmod(F.shiftright("fingerprint", 20), F.lit(SLOTS))).cast("int"))
    sums = rows.groupBy("old_shard", "bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    placed = _blocks(sums, shards, files)
    table = F.broadcast(spark.createDataFrame(placed, "old_shard int, bucket int, first long, parts long"))  # CLASSES * SLOTS rows a shard at most
    dealt = rows.join(table, ["old_shard", "bucket"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64(F.lit(5), "dealt"), F.col("parts")))
    kept = dealt.select("row", "size", "fingerprint", "old_shard", "block")
    blocks = len({(first, k) for *_, first, parts in placed for k in range(parts)})
    path = f"{shared_dir(spark)}/terraflux/shards-{uuid.uuid4().hex}"
    kept.repartition(max(1, blocks // 2), "block").sortWithinPartitions("old_shard", "block", "fingerprint").write.partitionBy("old_shard", "block").option("compression", "zstd").parquet(path)
    return _read(spark, path, kept.schema)


def reshard(layout: DataFrame, shards: int, law: str = "bytes", weights: list[float] | None = None, price: np.ndarray | None = None) -> DataFrame:
    """A layout with other shards: ``row, size, old_shard, shard, slot, rewritten``.

    ``law``: ``bytes`` (sizes near equal) or ``rows`` (counts at most one apart); with
    ``weights`` capacities are in proportion to them instead. ``slot`` numbers a shard's
    rows from 0 by their files. With ``bytes`` a shard differs from its capacity by what
    whole rows on its bounds leave, so a document longer than an even share has a shard to itself.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    spark = layout.sparkSession
    weight = F.col("size") if law == "bytes" else F.lit(1).cast("long")
    blocks = materialise(layout.groupBy("old_shard", "block").agg(F.sum(weight).alias("weight")), "shard-blocks")
    known = {r.old_shard: r.weight for r in blocks.groupBy("old_shard").agg(F.sum("weight").alias("weight")).collect()}
    sizes = [known.get(k, 0) for k in range(max([0, *known]) + 1)]
    total = sum(sizes)
    if weights is None:
        top = layout.select("size", "old_shard").orderBy(F.desc("size"), "old_shard").limit(shards).collect() if law == "bytes" else []
        capacities = around(total, shards, [(r.size, r.old_shard) for r in top])
    else:
        bounds = [round(total * x / sum(weights)) for x in np.cumsum([0, *weights])]
        capacities = list(np.diff(bounds))
    pieces, end = [], {}
    for i, j, amount in sorted(transfers(sizes, capacities, price), key=lambda x: (x[0], x[0] != x[1], x[1])):
        lo = end.get(i, 0)
        end[i] = lo + amount
        pieces.append((i, j, lo, lo + amount))
    table = F.broadcast(spark.createDataFrame(pieces, "old_shard int, shard int, lo long, hi long"))  # fewer than old and new shards together
    running = F.sum("weight").over(Window.partitionBy("old_shard").orderBy("block"))
    spans = blocks.withColumn("upto", running).withColumn("since", F.col("upto") - F.col("weight"))
    met = spans.join(table, "old_shard").where("lo < upto and since < hi").select("old_shard", "block", "shard", (F.least("hi", "upto") - F.greatest("lo", "since")).alias("share"), (F.col("upto") - F.col("since")).alias("weight"))
    met = materialise(met.withColumn("cut", F.col("share") < F.col("weight")), "shard-moves")
    cut: dict[int, list[tuple[int, int]]] = {}
    for r in met.where("cut").collect():  # each holds a bound between two pieces
        cut.setdefault(r.block, []).append((r.shard, r.share))

    def deal(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shares = sorted(cut[key[0]])
        lacks, to = np.array([x for _, x in shares], np.int64), np.empty(len(rows), np.int32)
        rows = rows.sort_values(["size", "at"], ascending=[False, True])
        for k, size in enumerate(rows["size"] if law == "bytes" else np.ones(len(rows), np.int64)):
            taken = int(lacks.argmax())
            lacks[taken] -= size
            to[k] = shares[taken][0]
        return pd.DataFrame({"block": rows["block"], "file": rows["file"], "at": rows["at"], "shard": to})

    bound = F.broadcast(spark.createDataFrame([(b,) for b in cut], "block long"))  # fewer than old and new shards together
    cut_rows = layout.join(bound, "block", "left_semi").select("block", "file", "at", "size", "row", "old_shard")
    dealt = cut_rows.select("block", "file", "at", "size").groupBy("block").applyInPandas(deal, "block long, file string, at long, shard int")
    gone = _bounded(met.where("not cut and shard <> old_shard").select("block", "shard"))
    columns = ["row", "size", "old_shard", "shard", "block"]
    moved = layout.join(gone, "block").select(*columns).unionByName(cut_rows.join(dealt, ["block", "file", "at"]).select(*columns))
    path = f"{shared_dir(spark)}/terraflux/shards-{uuid.uuid4().hex}"
    moved.write.partitionBy("shard", "block").option("compression", "zstd").parquet(path)
    touched = _bounded(met.where("cut or shard <> old_shard").select("block").distinct())
    stays = layout.join(touched, "block", "left_anti").withColumn("shard", F.col("old_shard"))
    rewritten = _read(spark, path, moved.schema)
    return _slots(stays.select(*columns, "file", "at", F.lit(False).alias("rewritten")).unionByName(rewritten.withColumn("rewritten", F.lit(True))))


def _slots(rows: DataFrame) -> DataFrame:
    """Numbers a shard's rows: those of the files before, and the place in the file."""
    key = ["shard", "rewritten", "block", "file"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("rewritten", "block", "file")) - F.col("n")
    files = _bounded(materialise(counts.withColumn("before", before).drop("n"), "shard-files"))
    return rows.join(files, key).select("row", "size", "old_shard", "shard", (F.col("before") + F.col("at")).alias("slot"), "rewritten")


def digest(docs: DataFrame, shards: int = 24, law: str = "bytes") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, rewritten`` of ``docs(doc_id, text)``, read back from the shards' files.

    A null text has 8 bytes and the crc32 of nothing. Null and repeated doc_ids and
    repeated rows are rows like any other; equal texts stay together but for those on a
    bound of a transfer, or of a text that fills blocks by itself. Very long texts are moved
    whole. Extra columns stay in the files, whatever their names; an empty table gives an
    empty result. ``grown_shard`` is null, as this law does not follow from a key.
    """
    done = reshard(lay_out(docs, shards), shards, law)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary")
    return done.select(F.col("row.doc_id").cast("long").alias("doc_id"), "size", F.crc32(text).alias("text_crc32"), F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard", "rewritten")
