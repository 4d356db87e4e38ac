"""What is in the folder is not computed again; what changed is, and nothing else."""

from pyspark.sql import functions as F

from terraflux.operators import atoms
from terraflux.sources import cloud_cache

GRID = (0.5, 0.0, 0.0, 0.0, -0.5, 10.0)
CELLS = "layer string, row int, col int, value double"


def test_only_what_changed_is_computed(spark, tmp_path):
    values = [(y, r, c, float(1 + r * c + len(y))) for y in ("a", "bb") for r in range(4) for c in range(4)] + [("a", 9, 9, 5.0), ("bb", 0, 7, None)]
    cells = spark.createDataFrame(values, CELLS)
    members = spark.createDataFrame([(1, r, c) for r in range(4) for c in range(2)] + [(2, r, c) for r in range(4) for c in range(2, 4)] + [(3, 9, 9)], "region long, row int, col int")
    path = str(tmp_path / "clouds")
    rows = lambda t: sorted((r.layer, r.region, r.lat, r.lon, round(r.weight, 12), round(r.total_mass, 9)) for r in t.collect())

    def plain(table):
        out = []
        for layer in ("a", "bb"):
            own = atoms.masked(table.where(F.col("layer") == layer).drop("layer"), members, GRID)
            mass = {r.region: r.total_mass for r in atoms.mass(own).collect()}
            out += [(layer, str(r.region), r.lat, r.lon, round(r.weight, 12), round(mass[r.region], 9)) for r in atoms.to_atoms(own).collect()]
        return sorted(out)

    first, computed = cloud_cache.through(cells, members, GRID, path)
    assert computed == 5 and rows(first) == plain(cells)
    again, computed = cloud_cache.through(cells.orderBy("value"), members, GRID, path)
    assert computed == 0 and rows(again) == plain(cells)
    changed = cells.withColumn("value", F.when((F.col("layer") == "bb") & (F.col("row") == 1) & (F.col("col") == 3), 99.0).otherwise(F.col("value")))
    third, computed = cloud_cache.through(changed, members, GRID, path)
    assert computed == 1 and rows(third) == plain(changed)
    back, computed = cloud_cache.through(cells, members, GRID, path)
    assert computed == 1 and rows(back) == plain(cells)
    empty = cells.withColumn("value", F.when((F.col("layer") == "a") & (F.col("row") == 9), 0.0).otherwise(F.col("value")))
    gone, computed = cloud_cache.through(empty, members, GRID, path)
    assert computed == 1 and rows(gone) == plain(empty) and len(rows(gone)) == len(rows(back)) - 1
    cloud_cache.through(cells, members, GRID, path)
    part, computed = cloud_cache.through(cells.where("layer = 'a'"), members, GRID, path)
    assert computed == 0 and {r[0] for r in rows(part)} == {"a"}
    none, computed = cloud_cache.through(cells.limit(0), members, GRID, str(tmp_path / "none"))
    assert computed == 0 and none.count() == 0
