"""Commands over Parquet tables: ``python -m terraflux.cli COMMAND ...``, or through spark-submit.

``agglomerate``: population cells to urban nodes. ``compute-lcp``: least costs between
countries by year. ``assemble-panel``: the eleven-column distance panel. Paths are whatever
Spark reads and writes; results are written without replacing what is there.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.geo import Scenario
from .operators import components, polygons, routing
from .session import session, ship


def graphs(spark: SparkSession, ports: str | None, airports: str | None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Sea and air graphs of the hub tables that are given."""
    out = {}
    if ports:
        nodes = spark.read.parquet(ports)
        out["maritime"] = nodes, routing.maritime_edges(nodes)
    if airports:
        nodes = routing.scheduled_airports(spark.read.parquet(airports))
        out["air"] = nodes, routing.air_edges(nodes)
    return out


def scenarios(spark: SparkSession, table: DataFrame) -> dict[int, Scenario]:
    """The scenario of each year in a table of agglomerations."""
    return {r.year: Scenario.for_year(r.year) for r in table.select("year").distinct().collect()}  # a row a year


def agglomerate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Urban nodes of the cells ``row, col, lat, lon, value, area_km2``, which carry ``region`` or get it from borders."""
    cells = spark.read.parquet(args.cells)
    if args.borders:
        cells = polygons.containing(cells.drop("region"), spark.read.parquet(args.borders))
    if args.regions:
        cells = cells.where(F.col("region").isin(*args.regions.split(",")))
    lights = spark.read.parquet(args.lights) if args.lights else None
    return components.agglomerations(cells, lights).withColumnRenamed("region", "iso3").withColumn("year", F.lit(args.year))


def compute_lcp(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    table = spark.read.parquet(args.agglomerations)
    return routing.lcp_by_year(table, graphs(spark, args.ports, args.airports), scenarios(spark, table), args.theta)


def assemble_panel(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    table = spark.read.parquet(args.agglomerations)
    weighted = spark.read.parquet(args.distances).select("iso_o", "iso_d", "d_cepii_distw")
    central = spark.read.parquet(args.centrality) if args.centrality else None
    return routing.all_variants(table, graphs(spark, args.ports, args.airports), scenarios(spark, table), weighted, central, args.theta)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m terraflux.cli", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple[str, dict]) -> None:
        c = commands.add_parser(name, help=(run.__doc__ or "").split("\n")[0])
        for option, more in (*options, ("--out", {"required": True})):
            c.add_argument(option, **more)
        c.set_defaults(run=run)

    needed, hubs = {"required": True}, (("--ports", {}), ("--airports", {}), ("--theta", {"type": float, "default": -1.0}))
    command("agglomerate", agglomerate, ("--year", {"type": int, "required": True}), ("--cells", needed), ("--lights", {}), ("--borders", {}), ("--regions", {"help": "comma-separated"}))
    command("compute-lcp", compute_lcp, ("--agglomerations", needed), *hubs)
    command("assemble-panel", assemble_panel, ("--agglomerations", needed), ("--distances", needed), ("--centrality", {}), *hubs)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or session()
    ship(spark)
    args.run(spark, args).write.parquet(args.out)


if __name__ == "__main__":
    main()
