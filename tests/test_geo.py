import math

import pytest
from pyspark.sql import functions as F

from terraflux.functions import geo
from terraflux.functions import constants as K


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("a, b, low, high", [((33.749, -84.388), (51.507, -0.128), 6720, 6820), ((51.5074, -0.1278), (40.7128, -74.0060), 5500, 5650), ((0, 0), (0, 90), 10007, 10008), ((90, 0), (-90, 0), 20015, 20016)])
def test_great_circle(spark, a, b, low, high):
    assert low < value(spark, geo.haversine_km(*map(float, (*a, *b)))) < high
    assert value(spark, geo.great_circle_km(float(a[1]), float(a[0]), float(b[1]), float(b[0]))) == pytest.approx(value(spark, geo.haversine_km(*map(float, (*a, *b)))))


def test_planar_wraps_the_date_line(spark):
    flat, round_ = value(spark, geo.planar_km(60.0, 179.9, 60.0, -179.9)), value(spark, geo.haversine_km(60.0, 179.9, 60.0, -179.9))
    assert flat == pytest.approx(round_, rel=0.02)


@pytest.mark.parametrize("theta, km", [(1, 666.7), (-0.5, 562.5), (-1, 500.0), (0, 606.5), (-1.5, 396.9), (-1.9, 206.7), (-1.99, 69.8)])
def test_disk_closed_form(spark, theta, km):
    assert value(spark, geo.disk_closed_form(float(theta), 1000.0)) == pytest.approx(km, abs=0.06)


def test_disk_closed_form_has_no_value_from_minus_two(spark):
    assert value(spark, geo.disk_closed_form(-2.0, 1000.0)) is None


#: Published values for floors 1, 5, 10, 50, 100, 200 at theta -5: name, area, then the values.
GOLDEN = [
    (9469009.104998708, (6.289799380899985, 29.81539893575921, 57.03942532305792, 169.8990942393335, 280.97636456159927, 430.77387971214023)),
    (16923965.72327555, (6.291229124066943, 30.10653038813141, 59.05778038813141, 185.9154183843286, 308.27416838432856, 481.2133857181489)),
    (9916643.681172984, (6.289898533155605, 29.835588813809782, 57.32510550610196, 171.00982146811964, 283.82115995526834, 435.0663836693511)),
]


@pytest.mark.parametrize("area, wanted", GOLDEN)
def test_country_distance_against_published_values(spark, area, wanted):
    for floor, w in zip((1.0, 5.0, 10.0, 50.0, 100.0, 200.0), wanted, strict=True):
        assert value(spark, geo.country_d_eff(F.lit(area), F.lit(floor), F.lit(-5.0))) == pytest.approx(w, rel=1e-9)


def test_country_distance_edges(spark):
    assert value(spark, geo.country_d_eff(F.lit(None).cast("double"), F.lit(1.0), F.lit(-5.0))) is None
    assert value(spark, geo.country_d_eff(F.lit(0.0), F.lit(1.0), F.lit(-5.0))) is None
    r = math.sqrt(1.0 / math.pi)
    assert value(spark, geo.country_d_eff(F.lit(1.0), F.lit(500.0), F.lit(-3.0))) == pytest.approx(0.9 * r)
    assert value(spark, geo.country_d_eff(F.lit(1.0), F.lit(500.0), F.lit(-3.0), early=True)) == pytest.approx(min(0.640413 * r, 0.67 * r))


SEA = K.SUEZ | K.RED_SEA


@pytest.mark.parametrize("a, b, has, hasnt", [
    ((72.8, 19.0), (10.0, 53.5), SEA, K.PANAMA), ((72.8, 19.0), (37.8, 44.7), SEA, 0), ((-118.2, 33.7), (4.5, 51.9), K.PANAMA, SEA),
    ((72.8, 19.0), (18.4, -33.9), 0, K.RED_SEA), ((18.4, -33.9), (10.0, 53.5), 0, K.RED_SEA), ((151.2, -33.9), (-118.2, 33.7), 0, SEA)])
def test_chokepoints(spark, a, b, has, hasnt):
    flags = value(spark, geo.arc_flags(*map(float, (*a, *b))))
    assert flags & has == has and flags & hasnt == 0
    assert value(spark, geo.arc_flags(*map(float, (*b, *a)))) == flags


def test_scenarios(spark):
    price = lambda s, flags: value(spark, s.multiplier(F.lit(flags)))
    assert price(geo.Scenario.preset("suez_closed"), K.SUEZ) == 1e6
    assert price(geo.Scenario.preset("panama_drought"), K.PANAMA | K.HORMUZ) == 1.8
    assert price(geo.Scenario.for_year(2024), SEA) == 2.5
    for flags, factor in ((K.RED_SEA, 2.5), (K.BAB_EL_MANDEB, 2.5), (K.RED_SEA | K.BAB_EL_MANDEB, 2.5), (K.SUEZ, 1.0), (K.PANAMA, 1.0), (K.HORMUZ, 1.0), (K.MALACCA, 1.0)):
        assert price(geo.Scenario.for_year(2024), flags) == factor
    assert price(geo.Scenario.for_year(2021), SEA | K.PANAMA) == 1.0  # capacity prices nothing
    assert price(geo.Scenario(global_risk=2.0), 0) == 2.0
    with pytest.raises(ValueError):
        geo.Scenario.preset("none such")


def test_costs(spark):
    assert value(spark, geo.freight_cost(65.0, "road")) == pytest.approx(30.0)
    assert value(spark, geo.freight_cost(65.0, "transfer")) == 5.0
    assert value(spark, geo.ground_cost(3.0, "squared")) == 9.0
    with pytest.raises(ValueError):
        geo.ground_cost(3.0, "none such")
