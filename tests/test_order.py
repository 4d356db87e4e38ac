import numpy as np
import pytest
from pyspark.sql import functions as F

from terraflux.operators import components, order, stats


@pytest.fixture(scope="module")
def frame(spark):
    """A group that holds most rows, with ties and nulls, a small one, and rows without a group."""
    rng = np.random.default_rng(0)
    rows = [(k, "big" if k % 10 else None if k % 20 else "small", float(v) if k % 17 else None) for k, v in enumerate(rng.integers(0, 300, 6000))]
    return spark.createDataFrame(rows, "id long, g string, v double")


def test_running_sums_and_ranks(frame):
    rows = order.running(frame, [F.col("v"), F.col("id")], ["g"], "v").collect()
    assert len(rows) == 6000
    for g in ("big", "small", None):
        own = sorted((r for r in rows if r.g == g), key=lambda r: r._rank)
        assert [r._rank for r in own] == list(range(len(own)))
        assert [(r.v is not None, r.v or 0, r.id) for r in own] == sorted((r.v is not None, r.v or 0, r.id) for r in own)
        before = np.concatenate([[0.0], np.cumsum([r.v or 0.0 for r in own])])
        assert np.allclose([r._before for r in own], before[:-1]) and all(r._count == len(own) and r._total == pytest.approx(before[-1]) for r in own)


def test_a_group_fills_many_ranges(frame, spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = frame.repartitionByRange(F.col("g"), F.col("v"), F.col("id")).withColumn("part", F.spark_partition_id())
        assert dealt.where("g = 'big'").select("part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_and_ranks(frame):
    points = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.901, "e": 1.0}
    values = {g: [r.v for r in frame.collect() if r.g == g and r.v is not None] for g in ("big", "small", None)}
    got = {r.g: r for r in order.quantiles(frame, "v", points, ["g"]).collect()}
    for g, own in values.items():
        assert [got[g][n] for n in points] == pytest.approx(list(np.quantile(own, list(points.values()))))
    whole = order.quantiles(frame, "v", points).first()
    assert [whole[n] for n in points] == pytest.approx(list(np.quantile(sum(values.values(), []), list(points.values()))))
    assert order.quantiles(frame.where("v < 0"), "v", points, ["g"]).collect() == []
    ranks = {r.v: r["rank"] for r in order.average_ranks(frame.where("g = 'small'"), "v").collect()}
    own = np.sort(values["small"])
    assert all(ranks[v] == pytest.approx(np.flatnonzero(own == v).mean() + 1) for v in ranks)
    assert stats.average_rank(frame, "v", ("g",)).where("v is null and rank_v is not null").count() == 0


def test_summary_of_nothing_and_of_nulls(frame):
    empty = stats.summary(frame.where("v < 0"), "v").first()
    assert empty.n == 0 and empty["median"] is None
    assert stats.summary(frame.where("v is null"), "v", ("g",)).where("n = 0 and median is null").count() == 3


def test_coverage_of_a_large_region(frame):
    points = frame.where("g = 'big' and v is not null").select(F.col("g").alias("region"), "id", "v")
    kept = components.coverage_cut(points, 0.8, 10_000, weight="v").collect()
    own = np.sort([r.v for r in points.collect()])[::-1]
    before = np.concatenate([[0.0], np.cumsum(own)[:-1]]) / own.sum()
    assert len(kept) == (before < 0.8).sum() and sorted(r.agglom_id for r in kept) == list(range(len(kept)))
    assert kept[0].coverage_share == pytest.approx(own[: len(kept)].sum() / own.sum())


def test_ranks_of_values_that_differ_by_evaluation(spark):
    """Sums of a distributed plan may differ in their last digits each time; all rows keep their rank."""
    import random

    noise = F.udf(lambda k: k + random.random() / 2, "double").asNondeterministic()
    table = spark.range(200).select(noise("id").alias("x"), F.lit(1).alias("g")).withColumn("y", F.col("x") * 2)
    got = stats.correlations(table, "x", "y", ("g",)).first()
    assert got.n == 200 and got.spearman == pytest.approx(1.0)
    assert stats.average_rank(table, "x").where("rank_x is null").count() == 0
