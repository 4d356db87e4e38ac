"""Writers: partitioned Parquet, small CSV reports, writes that never overwrite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def agglomerations(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("year").parquet(path)


def atom_cache(df: DataFrame, path: str) -> None:
    """Clouds by layer and region; an empty table writes no partition."""
    df.write.mode("append").partitionBy("layer", "region").parquet(path)


def report(df: DataFrame, path: str, append: bool = False) -> None:
    """A small result as one CSV file; append keeps what a broken-off sweep has written."""
    df.coalesce(1).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def no_clobber(df: DataFrame, path: str) -> None:
    """Fails if the output exists."""
    df.write.mode("errorifexists").parquet(path)


def arrays(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def pivot_report(df: DataFrame, index: str, column: str, values: list, value: str) -> DataFrame:
    return df.groupBy(index).pivot(column, values).agg(F.first(value, True)).orderBy(index)
