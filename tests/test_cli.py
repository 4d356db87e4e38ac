"""The three commands, one after the other, on cells and borders made from the given tables."""

import pytest

from terraflux import cli
from terraflux.plans import fixtures as X


def test_cells_to_panel(spark, sf, tmp_path):
    at = lambda name: str(tmp_path / name)
    cells = X.cells(spark, sf).withColumn("area_km2", X.F.col("area_km2") / 1000)
    cells.drop("region").write.parquet(at("cells"))
    X.borders(spark, sf, 0.0).write.parquet(at("borders"))
    X.hubs(spark, sf).write.parquet(at("hubs"))
    for year in ("2021", "2024"):
        cli.main(["agglomerate", "--year", year, "--cells", at("cells"), "--borders", at("borders"), "--out", at(f"a/year={year}/x")], spark)
    both = spark.read.parquet(at("a/year=2021/x"), at("a/year=2024/x"))
    both.withColumn("iso3", X.F.col("iso3").cast("string")).write.parquet(at("agglomerations"))
    assert both.select("iso3").distinct().count() > 10
    cli.main(["compute-lcp", "--agglomerations", at("agglomerations"), "--ports", at("hubs"), "--airports", at("hubs"), "--out", at("lcp")], spark)
    lcp = spark.read.parquet(at("lcp"))
    assert lcp.where("d_lcp_multi_t > 0").count() == lcp.count() > 100 and {r.year for r in lcp.select("year").distinct().collect()} == {2021, 2024}
    lcp.where("year = 2021").select("iso_o", "iso_d", X.F.lit(1.0).alias("d_cepii_distw")).write.parquet(at("distances"))
    cli.main(["assemble-panel", "--agglomerations", at("agglomerations"), "--distances", at("distances"), "--ports", at("hubs"), "--out", at("panel")], spark)
    panel = spark.read.parquet(at("panel"))
    assert panel.count() == lcp.count() and panel.columns[:4] == ["iso_o", "iso_d", "year", "d_cepii_distw"]
    assert panel.where("d_cepii_distw is null or d_ovdl is null or d_lcp_multi_t is null").count() == 0


def test_arguments():
    assert cli.parser().parse_args(["compute-lcp", "--agglomerations", "a", "--out", "b"]).theta == -1.0
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["agglomerate", "--out", "b"])
