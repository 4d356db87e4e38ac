"""Shared helpers: durable intermediate tables, bounded semi-join filters, components."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and runs on one machine (tests), a folder of
    our own is named, and set as the checkpoint folder too; on a cluster this raises.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file:///tmp/checkpoints/terraflux")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Written(NamedTuple):
    """A written table, and a weak reference to what every plan that reads it holds."""

    path: str
    reader: JavaObject

    def unread(self) -> bool:
        return self.reader.get() is None


#: Lists of the tables written since ``recorded`` was entered.
_RECORDS: list[list[Written]] = []


@contextmanager
def recorded() -> Iterator[list[Written]]:
    """The tables that are written inside."""
    _RECORDS.append([])
    try:
        yield _RECORDS[-1]
    finally:
        _RECORDS.pop()


def remove(spark: SparkSession, tables: list[Written]) -> None:
    """Deletes written tables."""
    for table in tables:
        place = spark._jvm.org.apache.hadoop.fs.Path(table.path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Bounds the bytes of a batch that goes to Python, for the jobs run inside: rows with long texts are many MB otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage: what follows re-reads replicated files after the loss of an
    executor, and a plan used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terraflux/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _RECORDS:
        files = table._jdf.queryExecution().analyzed().relation().location()
        _RECORDS[-1].append(Written(path, spark._jvm.java.lang.ref.WeakReference(files)))
    return table


@cache
def _libc():
    return ctypes.CDLL(ctypes.util.find_library("c")) if sys.platform == "linux" else None


def trimmed(batches: Iterable) -> Iterator:
    """The batches; after the last one the Python worker gives unused memory back to the system.

    Workers are kept from task to task, and the most that any of them took would stay.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def trimming(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The generator function over batches, with what it yields ``trimmed``."""
    def run(batches: Iterator) -> Iterator:
        return trimmed(f(batches))

    return run


def trimming_groups(f: Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same for a function over a group's key and batches."""
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return trimmed(f(key, batches))

    return run


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct ``row``, so that no name of theirs meets one of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def slot_filter(df: DataFrame, key: str, keys: DataFrame, bits: int = 22) -> DataFrame:
    """``df`` with a boolean column ``slot_hit``: false only where ``key`` is not in ``keys``.

    A Bloom filter of one hash: ``keys`` (one column) sets bits of a bitmap of 2**bits
    bits, at most 2**bits / 32768 rows of 4 KB (512 KB at 22 bits), which is broadcast.
    Its size does not depend on the data. With more keys than bits it lets more rows
    pass, so an exact join must follow. A null key is never a hit.
    """
    slot = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    maps = (
        keys.toDF("k").where("k is not null")
        .select(slot(F.col("k")).alias("slot"))
        .groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("slot_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("slot_map"))
    )
    at = F.bitmap_bit_position(slot(F.col(key)) + 1)
    byte = F.conv(F.hex(F.substring(F.col("slot_map"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8).cast("int") + 1)
    hit = F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
    bucket = F.bitmap_bucket_number(slot(F.col(key)) + 1)
    return (
        df.withColumn("slot_bucket", F.when(F.col(key).isNotNull(), bucket))
        .join(F.broadcast(maps), "slot_bucket", "left")
        .withColumn("slot_hit", hit & F.col(key).isNotNull())
        .drop("slot_bucket", "slot_map")
    )


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): ``(node, root)``, root the least node.

    Alternating large-star and small-star rounds. Each round is two aggregations with
    map-side combining and two joins against one row per node, which adaptive execution
    splits where a node has very many edges. The edge table of each round is written to
    the shared folder. A node without an edge to another node has no row.
    """
    def star(table: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        table = materialise(table.distinct(), name)
        seen = table.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return table, tuple(seen)

    pairs, state = star(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{name}-0")
    for k in range(1, max_rounds + 1):
        if not state[0]:
            break
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a")
        after = small.select("a", F.col("m").alias("b")).union(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        pairs, now = star(after, f"{name}-{k}")
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
