"""Column builders: distances, costs, cell geometry, disks, chokepoints."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x) if isinstance(x, (int, float)) else F.col(x)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance, latitude first; the root is clamped to 1 for antipodes."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    up, over = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * over * over
    return F.lit(2 * K.EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def great_circle_km(lon1, lat1, lon2, lat2) -> Column:
    """The same with longitude first."""
    return haversine_km(lat1, lon1, lat2, lon2)


def planar_km(lat1, lon1, lat2, lon2) -> Column:
    """Flat distance with the longitude difference wrapped and scaled at the middle latitude."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dx = (F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180) * F.cos(F.radians((lat1 + lat2) / 2))
    dy = lat2 - lat1
    return F.lit(K.KM_PER_DEGREE) * F.sqrt(dx * dx + dy * dy)


def ground_cost(km, kind: str = "gc_km", theta: float = 1.0) -> Column:
    if kind == "gc_km":
        return _c(km)
    if kind == "iceberg":
        return F.pow(_c(km), F.lit(float(theta)))
    if kind == "squared":
        return _c(km) * _c(km)
    raise ValueError(f"unknown ground cost {kind!r}")


def freight_cost(km, mode: str) -> Column:
    """Kilometres to dollars; a mode without a speed costs its flat rate."""
    return _c(km) / K.SPEED[mode] * K.RATE[mode] if K.SPEED[mode] else F.lit(K.RATE[mode])


def head_mayer(area) -> Column:
    return F.lit(K.HEAD_MAYER) * F.sqrt(_c(area) / math.pi)


def disk_closed_form(theta, radius) -> Column:
    """Power-mean distance from a disk's centre; null at theta of -2 or less."""
    theta, radius = _c(theta), _c(radius)
    return F.when(theta <= -2, None).when(F.abs(theta) < 1e-8, radius * math.exp(-0.5)).otherwise(F.pow(2.0 / (theta + 2), 1.0 / theta) * radius)


def segment_closed_form(gap, radius, theta) -> Column:
    """Power mean of the distance between two segments of half-length ``radius``, ``gap`` between centres."""
    gap, r, theta = _c(gap), _c(radius), _c(theta)
    top = F.pow(gap + 2 * r, theta + 2) + F.pow(gap - 2 * r, theta + 2) - 2 * F.pow(gap, theta + 2)
    return F.when((gap < 2 * r) | theta.isin(0.0, -1.0, -2.0), None).otherwise(F.pow(top / (4 * r * r * (theta + 1) * (theta + 2)), 1 / theta))


def cell_area_km2(lat, lon_res, lat_res=None) -> Column:
    lat_res = lon_res if lat_res is None else lat_res
    return F.abs(_c(lon_res) * K.KM_PER_DEGREE * F.cos(F.radians(_c(lat))) * _c(lat_res) * K.KM_PER_DEGREE)


def cell_centre(row, col, affine: tuple[float, float, float, float, float, float]) -> tuple[Column, Column]:
    """Longitude and latitude of a raster cell's centre under (a, b, c, d, e, f)."""
    a, b, c, d, e, f = affine
    row, col = _c(row) + 0.5, _c(col) + 0.5
    return col * a + row * b + c, col * d + row * e + f


def density(people, area) -> Column:
    return _c(people) / _c(area)


def degrees_lat(km) -> Column:
    return _c(km) / K.KM_PER_DEGREE


def degrees_lon(km, lat) -> Column:
    return _c(km) / (K.KM_PER_DEGREE * F.cos(F.radians(_c(lat))))


def interpolated(x, knots: tuple[tuple[float, float], ...] = K.DISK_CURVE) -> Column:
    """Piecewise-linear interpolation, flat beyond the ends."""
    x = _c(x)
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(knots[-1][1]))


def country_d_eff(area, floor_km, theta, early: bool = False) -> Column:
    """Internal effective distance of a country: the disk curve at its size, scaled and capped.

    ``early``: the first variant, without a scale for theta and with the lower cap.
    """
    area, theta = _c(area), _c(theta)
    radius = F.sqrt(area / math.pi)
    on_disk = interpolated(F.least(F.greatest(_c(floor_km) * (K.DISK_RADIUS / radius), F.lit(K.DISK_CURVE[0][0])), F.lit(K.DISK_CURVE[-1][0])))
    scale = F.lit(1.0) if early else reduce(lambda w, kv: w.when(theta == kv[0], kv[1]), list(K.THETA_SCALE.items())[1:], F.when(theta == -3.0, K.THETA_SCALE[-3.0])).otherwise(1.0)
    cap = K.DISK_CAP_EARLY if early else K.DISK_CAP
    return F.when((area > 0) & ~F.isnan(area), F.least(on_disk * scale * (radius / K.DISK_RADIUS), cap * radius))


def arc_flags(lon1, lat1, lon2, lat2) -> Column:
    """Chokepoints a sea arc passes, as bits: by the basins of its ends, and boxes around its middle."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    ends = ((lon1, lat1, lon2, lat2), (lon2, lat2, lon1, lat1))
    panama = reduce(lambda a, b: a | b, [(x < -90) & (z > -75) for x, _, z, _ in ends])
    suez = reduce(lambda a, b: a | b, [(x > 43) & z.between(-80, 42) & (w > -10) for x, _, z, w in ends])
    lon, lat = (lon1 + lon2) / 2, (lat1 + lat2) / 2
    corridor = lat.between(10, 32) & lon.between(32, 45)
    canal = lat.between(29, 32) & lon.between(31, 33)
    bits = lambda cond, value: F.when(cond, value).otherwise(0)
    return bits(panama, K.PANAMA).bitwiseOR(bits(suez | canal, K.SUEZ | K.RED_SEA)).bitwiseOR(bits(corridor, K.RED_SEA))


@dataclass(frozen=True)
class Scenario:
    """Prices of passing chokepoints. ``suez_capacity`` is carried but prices nothing."""

    suez_open: bool = True
    panama: float = 1.0
    red_sea: float = 1.0
    global_risk: float = 1.0
    suez_capacity: float = 1.0

    @classmethod
    def preset(cls, name: str) -> Scenario:
        known = {"normal": cls(), "suez_closed": cls(suez_open=False), "panama_drought": cls(panama=K.PANAMA_SLOW), "red_sea_crisis": cls(red_sea=K.RED_SEA_RISK)}
        if name not in known:
            raise ValueError(f"unknown scenario {name!r}")
        return known[name]

    @classmethod
    def for_year(cls, year: int) -> Scenario:
        return {2021: cls(suez_capacity=1.05), 2023: cls(panama=K.PANAMA_SLOW), 2024: cls(red_sea=K.RED_SEA_RISK)}.get(year, cls())

    def multiplier(self, flags) -> Column:
        """Applied once; a closed canal counts with the other factors, and the strait of Bab el-Mandeb with the Red Sea."""
        flags = _c(flags)
        hit = lambda bit, factor: F.when(flags.bitwiseAND(bit) != 0, F.lit(float(factor))).otherwise(1.0)
        return F.lit(float(self.global_risk)) * hit(K.SUEZ, 1.0 if self.suez_open else K.SUEZ_CLOSED) * hit(K.PANAMA, self.panama) * hit(K.RED_SEA | K.BAB_EL_MANDEB, self.red_sea)


def edge_cost(mode, hours, flags, scenario: Scenario) -> Column:
    """Rate of the mode (an unknown one is a transfer) times hours times the scenario's factor."""
    mode = _c(mode)
    rate = F.when(mode == "road", K.RATE["road"]).when(mode == "maritime", K.RATE["maritime"]).when(mode == "air", K.RATE["air"]).otherwise(K.RATE["transfer"])
    return rate * _c(hours) * scenario.multiplier(flags)
