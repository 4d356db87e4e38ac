"""Rasters in files: round trips, boxes that touch few tiles, other writers' layouts."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraflux.plans import fixtures as X
from terraflux.sources import raster

GRID = (0.25, 0.0, -180.0, 0.0, 0.25, -90.0)


@pytest.fixture(scope="module")
def lights(spark, sf):
    return X.cells(spark, sf).groupBy(F.lit("people").alias("layer"), "row", "col").agg(F.sum("value").alias("value"))


def rows(table):
    return sorted(map(tuple, table.select("layer", "row", "col", "value").collect()))


def test_round_trip_and_box(spark, lights, tmp_path):
    raster.write(lights.unionByName(lights.where("row % 2 = 0").withColumn("layer", F.lit("even"))), str(tmp_path / "r"), GRID, tile=32)
    a, _, west, _, e, south = raster.affine(str(tmp_path / "r"))
    down, right = round((south + 90) / e), round((west + 180) / a)
    back = raster.read(spark, f"file:{tmp_path}/r").withColumns({"row": F.col("row") + down, "col": F.col("col") + right})
    assert rows(back.where("layer = 'people'")) == rows(lights)
    assert back.where("layer = 'even'").count() == lights.where("row % 2 = 0").count()
    tiles = len(list((tmp_path / "r" / "people").glob("*.tif"))) + len(list((tmp_path / "r" / "even").glob("*.tif")))
    whole, box = raster.read(spark, str(tmp_path / "r"), cells=1), (-100.0, -30.0, 0.0, 30.0)
    part = raster.read(spark, str(tmp_path / "r"), box, cells=1)
    assert whole.rdd.getNumPartitions() == tiles > part.rdd.getNumPartitions() > 0
    lon, lat = west + (F.col("col") + 0.5) * a, south + (F.col("row") + 0.5) * e
    assert rows(part) == rows(whole.where(lon.between(box[0], box[2]) & lat.between(box[1], box[3])))
    assert not raster.read(spark, str(tmp_path / "r"), (170.0, 88.0, 171.0, 89.0)).count()


def test_odd_rows(spark, tmp_path):
    odd = spark.createDataFrame([("a", 1, 1, 2.0), ("a", 1, 1, 3.0), ("a", 2, 2, None), ("a", 3, 3, float("nan")), (None, 1, 1, 1.0), ("a", -40, 70, 0.0)], raster.SCHEMA)
    raster.write(odd, str(tmp_path / "r"), GRID, tile=16)
    assert [r[3] for r in rows(raster.read(spark, str(tmp_path / "r")))] == [0.0, 5.0]
    raster.write(odd.where("row = 1").withColumn("value", F.lit(7.0)), str(tmp_path / "r"), GRID, tile=16)
    assert [r[3] for r in rows(raster.read(spark, str(tmp_path / "r")))] == [0.0, 14.0]
    with pytest.raises(Exception):
        raster.read(spark, str(tmp_path / "none")).count()


def strips(values, order, kind, predictor, compress, each, big=False):
    """A file of strips with a pixel scale, as other programs write them."""
    h, w = values.shape
    own = values.astype(order + kind)
    moved = np.concatenate([own[:, :1], (own[:, 1:] - own[:, :-1]).astype(own.dtype)], axis=1) if predictor == 2 else own
    parts = [moved[k : k + each].astype(order + kind).tobytes() for k in range(0, h, each)]
    parts = [zlib.compress(p) for p in parts] if compress else parts
    start, pointer, many = (16, "Q", "Q") if big else (8, "I", "I")
    offsets, at = [], start
    for p in parts:
        offsets.append(at)
        at += len(p)
    extra, entries = b"", []

    def field(tag, code, t, *v):
        nonlocal extra
        data = struct.pack(order + t * len(v), *v) if t != "s" else v[0]
        count = len(v) if t != "s" else len(v[0])
        room = struct.calcsize(order + pointer)
        if len(data) > room:
            data, extra = struct.pack(order + pointer, at + len(extra)), extra + data
        entries.append(struct.pack(order + "HH" + many, tag, code, count) + data.ljust(room, b"\0"))

    field(256, 4, "I", w), field(257, 4, "I", h), field(258, 3, "H", own.itemsize * 8), field(259, 3, "H", 8 if compress else 1)
    field(273, 4, "I", *offsets), field(277, 3, "H", 1), field(278, 4, "I", each), field(279, 4, "I", *map(len, parts)), field(317, 3, "H", predictor)
    field(339, 3, "H", {"u": 1, "i": 2, "f": 3}[kind[0]]), field(33550, 12, "d", 0.5, 0.5, 0.0), field(33922, 12, "d", 0.0, 0.0, 0.0, -10.0, 20.0, 0.0), field(42113, 2, "s", b"9\0")
    table = struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries) + b"\0" * 8
    mark = b"II" if order == "<" else b"MM"
    head = struct.pack(order + "HHHQ", 43, 8, 0, at + len(extra)) if big else struct.pack(order + "HI", 42, at + len(extra))
    return mark + head + b"".join(parts) + extra + table


@pytest.mark.parametrize("order,kind,predictor,compress,big", [("<", "u1", 1, False, False), (">", "i2", 2, True, False), ("<", "u2", 2, True, True), (">", "f4", 1, True, True)])
def test_strips_of_others(spark, tmp_path, order, kind, predictor, compress, big):
    values = np.random.default_rng(3).integers(0, 200, (11, 7))
    values[0, 0], values[3, 2] = 9, 9
    (tmp_path / "night.tif").write_bytes(strips(values, order, kind, predictor, compress, 4, big))
    got = rows(raster.read(spark, str(tmp_path / "night.tif"), cells=1))
    assert got == [("night", r, c, float(values[r, c])) for r in range(11) for c in range(7) if values[r, c] != 9]
    assert raster.affine(str(tmp_path)) == (0.5, 0.0, -10.0, 0.0, -0.5, 20.0)
    box = raster.read(spark, str(tmp_path), (-9.5, 16.6, -8.0, 18.1), cells=1)
    assert {(r, c) for _, r, c, _ in rows(box)} == {(r, c) for r in range(4, 7) for c in range(1, 4) if values[r, c] != 9} and box.rdd.getNumPartitions() == 1
