"""Studies composed of the other operators: tables that compare distances and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import country_d_eff, head_mayer, planar_km
from . import gravity, measures
from .atoms import capped
from .panel import contiguity_regime, distance_variants
from .stats import summary, worst


def symmetric_matrix(clouds: DataFrame, theta: float = -5.0, floor_km: float = 0.5) -> DataFrame:
    """``o, d, d_eff`` of all pairs of one set of clouds: half is computed, and mirrored."""
    pairs = measures.pairs_of(clouds, clouds).where("o <= d")
    half = measures.effective_distance(measures.place_pairs(pairs, clouds, clouds), theta=theta, floor_km=floor_km)
    return half.unionByName(half.where("o <> d").select(F.col("d").alias("o"), F.col("o").alias("d"), "d_eff"))


def internal_distances(clouds: DataFrame, areas: DataFrame, thetas: tuple[float, ...] = (-7.0, -5.0, -3.0, -1.0, 1.0)) -> DataFrame:
    """``region, theta, d_eff, d_hm, ratio``: a region's distance to itself against the disk formula."""
    own = clouds.select("region").distinct().select(F.col("region").alias("o"), F.col("region").alias("d"))
    table = measures.theta_sweep(measures.place_pairs(own, clouds, clouds), thetas)
    met = table.join(areas.select(F.col("region").alias("o"), head_mayer("area_km2").alias("d_hm")), "o")
    return met.select(F.col("o").alias("region"), "theta", "d_eff", "d_hm", (F.col("d_eff") / F.col("d_hm")).alias("ratio"))


def sampling_bias(clouds: DataFrame, most: int, theta: float = -5.0) -> DataFrame:
    """``region`` and its internal distance from all atoms, the heaviest, and a weighted sample."""
    def internal(c: DataFrame, name: str) -> DataFrame:
        own = c.select("region").distinct().select(F.col("region").alias("o"), F.col("region").alias("d"))
        return measures.effective_distance(measures.place_pairs(own, c, c), theta=theta).select(F.col("o").alias("region"), F.col("d_eff").alias(name))

    return internal(clouds, "base").join(internal(capped(clouds, most), "top"), "region").join(internal(capped(clouds, most, "stratified"), "sampled"), "region")


def floor_sweep(points: DataFrame, floors: tuple[float, ...], theta: float = -5.0, weight: str | None = None) -> DataFrame:
    """``region, floor_km, d_eff`` of equally weighted points on a plane, self pairs included."""
    p = points.groupBy("region", "lat", "lon").agg(F.sum(F.col(weight) if weight else F.lit(1.0)).alias("w"))  # points of one place are one
    side = lambda t, s: t.select("region", *[F.col(c).alias(f"{c}_{s}") for c in ("lat", "lon", "w")])
    a, b = side(p.repartition(measures.tasks(p.sparkSession), "region", "lat", "lon"), "o"), side(p, "d")
    met = a.join(b, "region").select("region", (F.col("w_o") * F.col("w_d")).alias("w"), planar_km("lat_o", "lon_o", "lat_d", "lon_d").alias("km"))
    scaled = [F.sum(F.col("w") * F.pow(F.greatest(F.col("km"), F.lit(f)) / f, F.lit(float(theta)))).alias(f"s{k}") for k, f in enumerate(floors)]
    sums = met.groupBy("region").agg(F.sum("w").alias("mass"), *scaled)  # one pass over the pairs for all floors
    rows = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("floor_km"), (F.pow(F.col(f"s{k}") / F.col("mass"), F.lit(1.0 / theta)) * f).alias("d_eff")) for k, f in enumerate(floors)]))
    return sums.select("region", rows.alias("x")).select("region", "x.*")


def regimes(panel: DataFrame, ratio: str) -> DataFrame:
    """Summary of a ratio for touching and separated pairs."""
    return summary(contiguity_regime(panel), ratio, ("regime",))


def country_table(areas: DataFrame, floors: tuple[float, ...] = (1.0, 5.0, 10.0, 50.0, 100.0, 200.0), theta: float = -5.0) -> DataFrame:
    """One row a region: area, disk distance, and the effective distance at each floor."""
    wide = [country_d_eff("area_km2", F.lit(f), F.lit(float(theta))).alias(f"d_eff_t{theta:g}_dmin{f:g}") for f in floors]
    return areas.select("region", "area_km2", head_mayer("area_km2").alias("d_HM"), *wide)


def against_published(ours: DataFrame, published: DataFrame, n: int = 15) -> tuple[DataFrame, DataFrame]:
    """Summary of ``d_eff / distw`` over pairs that both tables have, and the n most different pairs."""
    met = ours.join(published, ["o", "d"]).where("o <> d and distw > 0")
    return summary(met.withColumn("ratio", F.col("d_eff") / F.col("distw")), "ratio"), worst(met, "d_eff", "distw", n)


def border_experiment(panel: DataFrame, pilot: DataFrame) -> DataFrame:
    """OLS of log flows under the four specifications: home coefficient, multiplier, change against A."""
    rows = distance_variants(panel, pilot).where("X_ij_usd > 0 and d > 0")
    rows = rows.withColumns({"log_X": F.log("X_ij_usd"), "log_d": F.log("d")})
    fit = gravity.estimate(rows, gravity.GravitySpec(flow="log_X"), "pair", "ols", ("spec",))
    base = fit.where("spec = 'A'").select(F.col("coef_home").alias("base"))
    return fit.join(F.broadcast(base)).withColumn("delta_coef", F.col("coef_home") - F.col("base")).drop("base")  # one row
