"""Bilateral flow panels: crosswalks, zero flows, domestic flows, logs, variants of distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import THOUSAND
from ..functions.geo import head_mayer

#: Covariates kept where a source has them.
COVARIATES = ("year", "iso3_o", "iso3_d", "iso3num_o", "iso3num_d", "gdp_o", "gdp_d", "pop_o", "pop_d", "dist", "distcap", "distw_arithmetic", "distw_harmonic", "contig", "comlang_off", "comlang_ethno", "col_dep_ever", "gatt_o", "gatt_d", "rta")


def aggregate_flows(flows: DataFrame, level: str = "raw") -> DataFrame:
    """Flows ``t, i, j, k, v``: as they are, by pair and year, or by pair, year and two-digit product."""
    if level == "raw":
        return flows
    if level == "pair-year":
        return flows.groupBy("t", "i", "j").agg(F.sum("v").alias("v"))
    if level == "pair-year-hs2":
        return flows.groupBy("t", "i", "j", F.substring("k", 1, 2).alias("hs2")).agg(F.sum("v").alias("v"))
    raise ValueError(f"unknown aggregation {level!r}")


def yearly_flows(flows: DataFrame, year: int, unit: float = THOUSAND) -> DataFrame:
    """``i, j, X_ij_usd, year``: values that are no numbers are left out, thousands become dollars."""
    v = F.expr("try_cast(v AS DOUBLE)")
    return flows.where(F.col("t") == year).select("i", "j", v.alias("v")).dropna().groupBy("i", "j").agg((F.sum("v") * unit).alias("X_ij_usd")).withColumn("year", F.lit(year))


def crosswalk(covariates: DataFrame) -> DataFrame:
    """``iso3num, iso3``, one row a code; a destination's name goes before an origin's."""
    side = lambda s, rank: covariates.select(F.col(f"iso3num_{s}").cast("int").alias("iso3num"), F.col(f"iso3_{s}").alias("iso3"), F.lit(rank).alias("rank"))
    both = side("o", 1).unionByName(side("d", 0)).where("iso3num is not null and iso3 is not null")
    return both.groupBy("iso3num").agg(F.min_by("iso3", F.struct("rank", "iso3")).alias("iso3"))


def with_names(flows: DataFrame, names: DataFrame, drop_unknown: bool = True) -> DataFrame:
    """Adds ``iso3_o, iso3_d`` by the numeric codes ``i, j``."""
    side = lambda key, name: names.select(F.col("iso3num").alias(key), F.col("iso3").alias(name))
    how = "inner" if drop_unknown else "left"
    return flows.join(side("i", "iso3_o"), "i", how).join(side("j", "iso3_d"), "j", how)


def wei_proxy(gdp: DataFrame, flows: DataFrame, keys: tuple[str, ...] = ("iso3_o",)) -> DataFrame:
    """Domestic flow ``max(0, gdp - exports)`` of origins whose gdp is finite and positive."""
    exports = flows.groupBy(*keys).agg(F.sum("X_ij_usd").alias("exports_usd"))
    known = gdp.where("gdp > 0 and not isnan(gdp) and gdp < double('infinity')")
    return known.join(exports, list(keys), "left").select(*keys, "gdp", F.coalesce("exports_usd", F.lit(0.0)).alias("exports_usd"), F.greatest(F.lit(0.0), F.col("gdp") - F.coalesce("exports_usd", F.lit(0.0))).alias("X_ij_usd"))


def gravity_panel(covariates: DataFrame, flows: DataFrame, areas: DataFrame, include_intra: bool = True, intra_distance: str = "head_mayer", gdp_scale: float = THOUSAND) -> DataFrame:
    """The estimation panel: pairs of countries with zero-filled flows, and domestic rows.

    ``covariates`` holds the pairs of ``year, iso3_o, iso3_d``; ``flows`` has ``iso3_o,
    iso3_d, year, X_ij_usd``; ``areas`` has ``iso3, area_km2``. ``gdp_scale`` brings gdp to
    the unit of the flows. Domestic rows carry the disk's distance, or none.
    """
    if intra_distance not in ("head_mayer", "cepii_self", "none"):
        raise ValueError(f"unknown intra distance {intra_distance!r}")
    scaled = covariates.withColumns({c: F.col(c) * gdp_scale for c in ("gdp_o", "gdp_d")})
    inter = scaled.where("iso3_o <> iso3_d").join(flows.select("iso3_o", "iso3_d", "year", "X_ij_usd"), ["iso3_o", "iso3_d", "year"], "left")
    inter = inter.withColumn("X_ij_usd", F.coalesce("X_ij_usd", F.lit(0.0))).withColumn("home", F.lit(0))
    if not include_intra:
        return inter
    gdp = scaled.groupBy("iso3_o", "year").agg(F.max("gdp_o").alias("gdp"))
    own = wei_proxy(gdp, flows, ("iso3_o", "year")).join(areas.select(F.col("iso3").alias("iso3_o"), "area_km2"), "iso3_o", "left")
    d = head_mayer("area_km2") if intra_distance == "head_mayer" else F.lit(None).cast("double")
    intra = own.select("iso3_o", F.col("iso3_o").alias("iso3_d"), "year", "X_ij_usd", F.lit(1).alias("home"), F.col("gdp").alias("gdp_o"), F.col("gdp").alias("gdp_d"), F.lit(0).alias("contig"), F.lit(1).alias("comlang_off"), F.lit(0).alias("col_dep_ever"), d.alias("dist"), d.alias("distw_arithmetic"), d.alias("distw_harmonic"), "area_km2")
    if intra_distance == "cepii_self":
        self_d = scaled.where("iso3_o = iso3_d").select("iso3_o", "year", F.col("distw_harmonic").alias("self_d"))
        intra = intra.join(self_d, ["iso3_o", "year"], "left").withColumns({c: F.col("self_d") for c in ("dist", "distw_arithmetic", "distw_harmonic")}).drop("self_d")
    return inter.unionByName(intra, allowMissingColumns=True)


def add_logs(panel: DataFrame) -> DataFrame:
    """Logs of flow, distance and gdp; null unless positive (both gdps), values under 1 count as 1."""
    log = lambda c, ok: F.when(ok, F.log(F.greatest(F.col(c), F.lit(1.0))))
    both = (F.col("gdp_o") > 0) & (F.col("gdp_d") > 0)
    return panel.withColumns({"log_X": log("X_ij_usd", F.col("X_ij_usd") > 0), "log_d": log("distw_harmonic", F.col("distw_harmonic") > 0), "log_gdp_o": log("gdp_o", both), "log_gdp_d": log("gdp_d", both)})


def swap_intra_distance(panel: DataFrame, lookup: DataFrame, column: str = "distw_harmonic") -> DataFrame:
    """Domestic rows take the distance of ``lookup(iso3, d_new)`` where there is one."""
    new = lookup.select(F.col("iso3").alias("iso3_o"), F.col("d_new").cast("double").alias("d_new"))
    return panel.join(new, "iso3_o", "left").withColumn(column, F.when(F.col("home") == 1, F.coalesce("d_new", column)).otherwise(F.col(column))).drop("d_new")


def estimation_sample(panel: DataFrame, needed: tuple[str, ...], positive: tuple[str, ...]) -> DataFrame:
    """Rows with all ``needed`` columns, ``positive`` ones above zero and finite; home is 0 where unknown."""
    out = panel.withColumn("home", F.coalesce(F.col("home").cast("int"), F.lit(0))).dropna(subset=list(needed))
    for c in positive:
        out = out.where((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf")))
    return out


def contiguity_regime(panel: DataFrame) -> DataFrame:
    return panel.withColumn("regime", F.when(F.col("contig") == 1, "touching").otherwise("separated"))


def distance_variants(panel: DataFrame, pilot: DataFrame) -> DataFrame:
    """Specifications A to D stacked: baseline; pilot distances; those of touching pairs only; no touching pairs."""
    p = panel.join(pilot.select("iso3_o", "iso3_d", "d_pilot"), ["iso3_o", "iso3_d"], "left")
    a = p.withColumn("spec", F.lit("A")).withColumn("d", F.col("distw_harmonic"))
    b = p.withColumn("spec", F.lit("B")).withColumn("d", F.coalesce("d_pilot", "distw_harmonic"))
    c = p.withColumn("spec", F.lit("C")).withColumn("d", F.when(F.col("contig") == 1, F.coalesce("d_pilot", "distw_harmonic")).otherwise(F.col("distw_harmonic")))
    d = a.where(~F.col("contig").eqNullSafe(1)).withColumn("spec", F.lit("D"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def composite_keys(panel: DataFrame) -> DataFrame:
    return panel.withColumns({"pair_id": F.concat_ws("_", "iso3_o", "iso3_d"), "oy": F.concat_ws("_", "iso3_o", "year"), "dy": F.concat_ws("_", "iso3_d", "year")})


def floor_column(floor_km: float) -> str:
    """``dist_dmin_0p5`` for 0.5."""
    return "dist_dmin_" + f"{floor_km:g}".replace(".", "p")


def drop_singletons(panel: DataFrame, *groups: str) -> DataFrame:
    """Drops groups of one row, group column by group column, once each in the order given."""
    for g in groups:
        panel = panel.withColumn("_n", F.count("*").over(Window.partitionBy(g))).where("_n > 1").drop("_n")
    return panel


def profile(table: DataFrame, rows: int = 1000) -> DataFrame:
    """Name, type, distinct values and an example of each column over the first ``rows`` rows."""
    head = table.limit(rows)
    cells = [F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.countDistinct(n).alias("n_unique"), F.first(F.col(n).cast("string"), True).alias("example")) for n, t in head.dtypes]
    return head.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def boundary_codes(attributes: DataFrame) -> DataFrame:
    """Country code of boundary rows: the sovereign's where the own one is missing (-99)."""
    return attributes.withColumn("iso3", F.when(F.col("ISO_A3") == "-99", F.col("ADM0_A3")).otherwise(F.col("ISO_A3")))
