"""Statistics of panels: correlations, quantiles, slopes, pivots, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import order
from .components import written


def average_rank(table: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rank_<column>``, ties sharing the mean of their ranks; null for a null."""
    return _ranked(written(table, "ranked"), column, by, f"rank_{column}")


def _ranked(table: DataFrame, column: str, by: tuple[str, ...], name: str) -> DataFrame:
    """``table`` must be written: its values are met by equality, and sums computed twice may differ in their last digits."""
    ranks = order.average_ranks(table, column, by)
    right = ranks.select(*[F.col(c).alias(f"_to_{c}") for c in (*by, column)], F.col("rank").alias(name))
    same = F.col(column) == F.col(f"_to_{column}")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_to_{b}"))
    return table.join(right, same, "left").drop(*[f"_to_{c}" for c in (*by, column)])


def correlations(table: DataFrame, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Pearson and Spearman correlation, and the number of rows with both values.

    Ranks come from counts of distinct values, so ties are counted once; a group may be of any size.
    """
    rows = written(table.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y), "correlated")
    for c in (x, y):
        rows = _ranked(rows, c, by, f"_r_{c}")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("pearson"), F.corr(f"_r_{x}", f"_r_{y}").alias("spearman"))


def summary(table: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, median, tenth and ninetieth percentile (linear), least and greatest."""
    sums = table.groupBy(*by).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("greatest"))
    points = {"median": 0.5, "p10": 0.1, "p90": 0.9}
    found = order.quantiles(table, column, points, by)
    same = F.lit(True)
    for b in by:
        same = same & sums[b].eqNullSafe(found[b])
    met = sums.join(F.broadcast(found), how="left") if not by else sums.join(found, same, "left")  # one row without keys
    return met.select(*[sums[b] for b in by], "n", "mean", *points, "least", "greatest")


def slope(table: DataFrame, y: str, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    return table.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def within_std(table: DataFrame, group: tuple[str, ...], column: str) -> DataFrame:
    """The largest standard deviation within a group; under 1e-6 the group's effect swallows the column."""
    each = table.groupBy(*group).agg(F.stddev_samp(column).alias("sd"))
    return each.agg(F.max("sd").alias("max_sd"), F.count("*").alias("n_groups")).withColumn("identified", F.coalesce(F.col("max_sd") >= 1e-6, F.lit(False)))


def sample_counts(panel: DataFrame, flow: str = "X_ij_usd") -> DataFrame:
    return panel.agg(F.count("*").alias("n_obs"), F.sum(F.when(F.col("home") == 1, 1).otherwise(0)).alias("n_intra"), F.sum(F.when(F.col(flow) == 0, 1).otherwise(0)).alias("n_zero"))


def pivoted(table: DataFrame, index: str, column: str, values: list, value: str, how: str = "mean") -> DataFrame:
    """A pivot over known values; ``how`` is mean, or first (the least, for one answer)."""
    return table.groupBy(index).pivot(column, values).agg(F.avg(value) if how == "mean" else F.min(value))


def percent_change(table: DataFrame, before: str, after: str, name: str = "pct_change") -> DataFrame:
    return table.withColumn(name, (F.col(after) / F.col(before) - 1) * 100)


def seeds_mean(table: DataFrame, by: tuple[str, ...], column: str) -> DataFrame:
    """Mean and standard error over seeds."""
    return table.groupBy(*by).agg(F.avg(column).alias("mean"), (F.stddev_pop(column) / F.sqrt(F.count(column))).alias("se"))


def extreme(table: DataFrame, row: str, by: str, greatest: bool = False) -> DataFrame:
    """The row label with the least (greatest) value."""
    pick = F.max_by if greatest else F.min_by
    return table.agg(pick(row, F.struct(F.col(by), F.col(row))).alias(row), (F.max if greatest else F.min)(by).alias(by))


def worst(table: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """The n rows with the largest relative difference of two columns."""
    return table.withColumn("rel_diff", F.abs(F.col(a) - F.col(b)) / F.abs(F.col(b))).orderBy(F.desc("rel_diff"), *[c for c in table.columns if c not in (a, b)]).limit(n)


def verdict(table: DataFrame, value: str, rules: list[tuple[float, str]], other: str) -> DataFrame:
    """A label by the first threshold that the value reaches."""
    out = F.lit(other)
    for bound, label in reversed(rules):
        out = F.when(F.col(value) >= bound, label).otherwise(out)
    return table.withColumn("verdict", out)
