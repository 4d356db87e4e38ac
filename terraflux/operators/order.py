"""Ranks, running sums and quantiles of groups of any size.

A window by group sorts a group in one task. Here rows are dealt by ranges of group and
order, so that a large group fills many tasks; each range's count and sum are added up
over ranges, one row each, and brought back to its rows, which are then numbered inside
their range only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import written


def running(table: DataFrame, order: Sequence[Column], by: Sequence[str] = (), value: str | None = None) -> DataFrame:
    """``table`` with ``_rank`` (from 0), ``_before`` (sum of ``value`` over the rows before), ``_count`` and ``_total`` of the group.

    ``order`` should tell the rows of a group apart, as rows that it doesn't lie in one
    range. Null values add nothing. The table is written once, dealt by ranges.
    """
    amount = F.coalesce(F.col(value).cast("double"), F.lit(0.0)) if value else F.lit(1.0)
    dealt = table.repartitionByRange(*[F.col(b) for b in by], *order).withColumns({"_part": F.spark_partition_id(), "_amount": amount})
    rows = written(dealt, "ranges")
    parts = rows.groupBy(*by, "_part").agg(F.count("*").alias("_k"), F.sum("_amount").alias("_s"))
    over = Window.partitionBy(*by)  # a row a range
    earlier = over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    offsets = parts.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_part").alias("_of"), F.coalesce(F.sum("_k").over(earlier), none).alias("_rank0"), F.coalesce(F.sum("_s").over(earlier), none).alias("_sum0"), F.sum("_k").over(over).alias("_count"), F.sum("_s").over(over).alias("_total"))
    same = F.col("_part") == F.col("_of")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order)
    local = rows.withColumns({"_rank": F.row_number().over(inside) - 1, "_before": F.coalesce(F.sum("_amount").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    met = local.join(offsets, same).withColumns({"_rank": F.col("_rank") + F.col("_rank0"), "_before": F.col("_before") + F.col("_sum0")})
    return met.drop("_part", "_amount", "_of", "_rank0", "_sum0", *[f"_by_{b}" for b in by])


def _counted(table: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Distinct values with their ``_n``, ``_before`` and ``_total`` counts."""
    counts = table.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    return running(counts, [F.col(column)], by, "_n")


def average_ranks(table: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, column`` and ``rank`` of its distinct values: ties share the mean of their ranks, from 1."""
    return _counted(table, column, by).select(*by, column, (F.col("_before") + (F.col("_n") + 1) / 2.0).alias("rank"))


def quantiles(table: DataFrame, column: str, points: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``by`` and one exact, linearly interpolated quantile for each name; a group without values has no row."""
    rows = _counted(table, column, by)
    at = {name: F.lit(p) * (F.col("_total") - 1) for name, p in points.items()}
    holds = lambda i: (F.col("_before") <= i) & (i < F.col("_before") + F.col("_n"))
    picked = {}
    for name, h in at.items():
        picked |= {f"_lo_{name}": F.max(F.when(holds(F.floor(h)), F.col(column))), f"_hi_{name}": F.max(F.when(holds(F.ceil(h)), F.col(column))), f"_f_{name}": F.max(h - F.floor(h))}
    sums = rows.groupBy(*by).agg(*[c.alias(n) for n, c in picked.items()])
    return sums.select(*by, *[(F.col(f"_lo_{n}") + F.col(f"_f_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n in points])
