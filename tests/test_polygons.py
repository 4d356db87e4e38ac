import math
import random

import pytest

from terraflux.operators import atoms, polygons

DDL = "region string, ring int, hole boolean, seq int, lon double, lat double"


def rings(spark, table):
    rows = []
    for (region, ring, hole), points in table.items():
        rows += [(region, ring, hole, k, float(x), float(y)) for k, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, DDL)


def inside(x, y, own):
    """Even-odd by a ray to the east, around the ring's first point."""
    odd = False
    for points in own:
        x0 = points[0][0]
        near = lambda v: (v - x0 + 180) % 360 - 180
        p = [(near(a), b) for a, b in points]
        q = near(x)
        for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True):
            if (y1 > y) != (y2 > y) and q < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def star(draw, cx, cy, r, n):
    cut = sorted(draw.uniform(0, 2 * math.pi) for _ in range(n))
    return [((cx + draw.uniform(0.3, 1) * r * math.cos(a) + 180) % 360 - 180, cy + draw.uniform(0.3, 1) * r * math.sin(a)) for a in cut]


@pytest.mark.parametrize("strips", [None, 7, 5000])
def test_against_brute_force(spark, strips):
    draw = random.Random(3)
    table = {}
    for k, (cx, cy) in enumerate([(0, 0), (178, 10), (-179, -40), (60, 30), (62, 31)]):
        table[f"r{k}", 0, False] = star(draw, cx, cy, 12, 17)
        table[f"r{k}", 1, True] = star(draw, cx, cy, 3, 6)
        table[f"r{k}", 2, False] = star(draw, cx + 20, cy, 4, 9)
    points = [(k, draw.choice([0, 178, -179, 60, 185, 21]) + draw.uniform(-14, 14), draw.uniform(-55, 45)) for k in range(3000)]
    wanted = {(k, r) for k, x, y in points for r in {n[0] for n in table} if inside(x, y, [p for n, p in table.items() if n[0] == r])}
    got = polygons.containing(spark.createDataFrame(points, "id int, lon double, lat double"), rings(spark, table), strips)
    assert got.columns == ["id", "lon", "lat", "region"]
    found = [(r.id, r.region) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and len(wanted) > 200


def test_rings_around_a_pole(spark):
    north = [(x, 60 + 5 * (x % 40 == 0)) for x in range(-180, 180, 20)]
    south = [(x, -70) for x in range(170, -190, -10)]
    shape = rings(spark, {("n", 0, False): north, ("s", 0, False): south})
    points = spark.createDataFrame([(1, 5.0, 89.0), (2, -180.0, 70.0), (3, 180.0, 70.0), (4, 30.0, 50.0), (5, 12.0, -71.0), (6, 12.0, -69.0), (7, 179.99, -90.0 + 1e-9)], "id int, lon double, lat double")
    assert sorted((r.id, r.region) for r in polygons.containing(points, shape).collect()) == [(1, "n"), (2, "n"), (3, "n"), (5, "s"), (7, "s")]
    area = {r.region: r.area_km2 for r in polygons.areas(shape).collect()}
    assert area["s"] == pytest.approx(polygons.globe_area() / 2 * (1 - math.sin(math.radians(70))))
    assert area["n"] < polygons.globe_area() / 2 * (1 - math.sin(math.radians(60)))


def test_areas(spark):
    box = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d)]
    across = [(175, 0), (-175, 0), (-175, 10), (175, 10)]
    got = {r.region: r.area_km2 for r in polygons.areas(rings(spark, {("a", 0, False): box(0, 0, 10), ("a", 1, True): box(2, 2, 1)[::-1], ("b", 0, False): across, ("c", 0, False): [(0, 0), (1, 1)]})).collect()}
    lune = lambda lo, hi, d: polygons.EQUAL_AREA_KM**2 * math.radians(d) * (math.sin(math.radians(hi)) - math.sin(math.radians(lo)))
    assert got == pytest.approx({"a": lune(0, 10, 10) - lune(2, 3, 1), "b": lune(0, 10, 10)})


def test_masks_and_odd_points(spark):
    shape = rings(spark, {("a", 0, False): [(0, 0), (4, 0), (4, -4), (0, -4)], ("a", 1, True): [(1, -1), (2, -1), (2, -2), (1, -2)]})
    cells = spark.createDataFrame([(r, c, 1.0 + r + c) for r in range(6) for c in range(6)], "row int, col int, value double")
    affine = (1.0, 0.0, -1.0, 0.0, -1.0, 1.0)  # row 0, col 0 is centred on (-0.5, 0.5)
    own = polygons.members(cells, affine, shape)
    assert sorted((r.row, r.col) for r in own.collect()) == [(r, c) for r in range(1, 5) for c in range(1, 5) if (r, c) != (2, 2)]
    assert atoms.masked(cells, own, affine).count() == 15
    odd = spark.createDataFrame([(1, None, -3.5), (2, 3.5, None), (3, float("nan"), -3.5), (4, float("inf"), -3.5), (5, 363.5, -3.5), (5, 363.5, -3.5)], "id int, lon double, lat double")
    assert [r.id for r in polygons.containing(odd, shape).collect()] == [5, 5]
    assert polygons.containing(odd, shape.where("false")).collect() == [] and polygons.areas(shape.where("false")).collect() == []


def test_no_cross_join_and_no_python(spark):
    shape = rings(spark, {("a", 0, False): [(0, 0), (4, 0), (4, -4)]})
    points = spark.createDataFrame([(1.0, -1.0)], "lon double, lat double")
    plan = polygons.containing(points, shape, 360)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Python" not in plan and "strip" in plan
