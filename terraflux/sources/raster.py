"""GeoTIFF rasters as tables of cells, by a Spark data source.

    spark.dataSource.register(raster.GeoTiff)
    spark.read.format("geotiff").option("bbox", "-10,35,5,45").load("/data/lights")

A file in a subfolder belongs to the layer of that name; a file by itself is a layer. All
files share one cell size, and ``row`` and ``col`` count from the corner of all of them, so
tiles of one layer make one grid (``affine`` returns it). The driver reads headers; tasks
read the tiles or strips that a box of longitude and latitude touches, a run of them a
partition. Cells that are nodata or not finite have no row.

Read: one band; integers and floats; raw or deflate; horizontal differencing; classic and
large files of both byte orders. Anything else is an error. Paths are those pyarrow opens.
"""

from __future__ import annotations

import math
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "layer string, row int, col int, value double"
ARROW = pa.schema([("layer", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.float64())])
#: Fixed values of the format: bytes of the field types, and numbers of the fields.
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, BANDS, STRIP_ROWS, STRIP_BYTES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT, PIXEL_SCALE, TIEPOINT, TRANSFORM, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 42113
RAW, DEFLATE, OLD_DEFLATE = 1, 8, 32946


def opened(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@dataclass
class Header:
    """Where a file's blocks are and what they mean."""

    layer: str
    path: str
    width: int
    height: int
    block: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    dtype: str
    deflated: bool
    differenced: bool
    affine: tuple[float, ...]
    nodata: float | None


@dataclass
class Blocks(InputPartition):
    """Runs of blocks: a file, its blocks (block row, block column, offset, bytes), and its place in the grid."""

    runs: list[tuple[Header, list[tuple[int, int, int, int]], tuple[int, int]]]


def _fields(f: pa.NativeFile) -> tuple[str, dict[int, tuple]]:
    start = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    version = struct.unpack(order + "H", start[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at, count, entry = (struct.unpack(order + "Q", start[8:16])[0], "Q", 20) if big else (struct.unpack(order + "I", start[4:8])[0], "H", 12)
    f.seek(at)
    n = struct.unpack(order + count, f.read(struct.calcsize(count)))[0]
    table, found = f.read(n * entry), {}
    inline = 8 if big else 4
    for k in range(n):
        tag, kind, many = struct.unpack_from(order + ("HHQ" if big else "HHI"), table, k * entry)
        if kind not in FIELD:
            continue
        code = order + FIELD[kind] * many if kind != 2 else f"{many}s"
        size, own = struct.calcsize(code), table[(k + 1) * entry - inline : (k + 1) * entry]
        if size > inline:
            f.seek(struct.unpack(order + ("Q" if big else "I"), own)[0])
            own = f.read(size)
        found[tag] = struct.unpack_from(code, own)
    return order, found


def header(path: str, layer: str) -> Header:
    """The first image of a file."""
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        order, t = _fields(f)
    one = lambda tag, default: t.get(tag, (default,))[0]
    width, height, compression, predictor = t[WIDTH][0], t[HEIGHT][0], one(COMPRESSION, RAW), one(PREDICTOR, 1)
    if one(BANDS, 1) != 1 or compression not in (RAW, DEFLATE, OLD_DEFLATE) or predictor not in (1, 2) or one(BITS, 1) % 8:
        raise ValueError(f"{path}: one band of whole bytes, raw or deflate, is read")
    if TILE_OFFSETS in t:
        block, offsets, sizes = (t[TILE_HEIGHT][0], t[TILE_WIDTH][0]), t[TILE_OFFSETS], t[TILE_BYTES]
    else:
        block, offsets, sizes = (min(one(STRIP_ROWS, height), height), width), t[STRIP_OFFSETS], t[STRIP_BYTES]
    if TRANSFORM in t:
        m = t[TRANSFORM]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    else:
        (sx, sy, _), p = t[PIXEL_SCALE], t[TIEPOINT]
        affine = (sx, 0.0, p[3] - p[0] * sx, 0.0, -sy, p[4] + p[1] * sy)
    if affine[1] or affine[3]:
        raise ValueError(f"{path}: the grid is turned")
    text = one(NODATA, b"").split(b"\0")[0].strip()
    dtype = order + {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)] + str(t[BITS][0] // 8)
    if predictor == 2 and "f" in dtype:
        raise ValueError(f"{path}: differenced floats are not read")
    return Header(layer, path, width, height, block, tuple(offsets), tuple(sizes), dtype, compression != RAW, predictor == 2, affine, float(text) if text else None)


def headers(path: str) -> list[Header]:
    """Headers of a file, or of all files under a folder, in the order of their names."""
    system, inner = opened(path)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = system.get_file_info(inner)
    if info.type == files.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == files.FileType.File:
        names = [inner]
    else:
        names = sorted(i.path for i in system.get_file_info(files.FileSelector(inner, recursive=True)) if i.type == files.FileType.File and re.search(r"\.tiff?$", i.path, re.I) and not posixpath.basename(i.path).startswith("_"))
    stem = lambda n: re.sub(r"\.tiff?$", "", posixpath.basename(n), flags=re.I)
    layer = lambda n: stem(n) if posixpath.dirname(n) in (inner.rstrip("/"), posixpath.dirname(inner)) else posixpath.basename(posixpath.dirname(n))
    with ThreadPoolExecutor(16) as pool:
        found = list(pool.map(lambda n: header(scheme + n, layer(n)), names))
    for h in found:
        if not np.allclose([h.affine[0], h.affine[4]], [found[0].affine[0], found[0].affine[4]], rtol=1e-9, atol=0):
            raise ValueError(f"{h.path}: its cells are not of the size of {found[0].path}'s")
    return found


def _corner(found: list[Header]) -> tuple[float, ...]:
    a, e = found[0].affine[0], found[0].affine[4]
    west = (min if a > 0 else max)(h.affine[2] for h in found)
    top = (min if e > 0 else max)(h.affine[5] for h in found)
    return a, 0.0, west, 0.0, e, top


def affine(path: str) -> tuple[float, ...]:
    """The six coefficients that ``row`` and ``col`` of ``path`` refer to."""
    return _corner(headers(path))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.cells = int(options.get("cells", 1 << 20))
        self.box = tuple(map(float, options["bbox"].split(","))) if options.get("bbox") else None
        if self.box and len(self.box) != 4:
            raise ValueError("bbox is west,south,east,north")

    def _span(self, low: float, high: float, start: float, step: float, count: int) -> range:
        """The cells of an axis whose centres lie between two coordinates."""
        at = sorted(((low - start) / step - 0.5, (high - start) / step - 0.5))
        return range(max(0, math.ceil(at[0] - 1e-9)), min(count, math.floor(at[1] + 1e-9) + 1))

    def _window(self, h: Header) -> tuple[range, range]:
        if self.box is None:
            return range(h.height), range(h.width)
        west, south, east, north = self.box
        return self._span(south, north, h.affine[5], h.affine[4], h.height), self._span(west, east, h.affine[2], h.affine[0], h.width)

    def partitions(self) -> list[Blocks]:
        """Blocks in the order of files, as many a partition as hold about ``cells`` cells; small files share one."""
        found = headers(self.path)
        if not found:
            return []
        a, _, west, _, e, top = _corner(found)
        out: list[Blocks] = []
        room = 0
        for h in found:
            shift = round((h.affine[5] - top) / e), round((h.affine[2] - west) / a)
            rows, cols = self._window(h)
            if not len(rows) or not len(cols):
                continue
            across, lean = -(-h.width // h.block[1]), replace(h, offsets=(), sizes=())
            for r in range(rows[0] // h.block[0], rows[-1] // h.block[0] + 1):
                for c in range(cols[0] // h.block[1], cols[-1] // h.block[1] + 1):
                    offset, size = h.offsets[r * across + c], h.sizes[r * across + c]
                    if not size:  # a block that was never written holds nothing
                        continue
                    if room <= 0:
                        out.append(Blocks([]))
                        room = self.cells
                    if not out[-1].runs or out[-1].runs[-1][0] is not lean:
                        out[-1].runs.append((lean, [], shift))
                    out[-1].runs[-1][1].append((r, c, offset, size))
                    room -= h.block[0] * h.block[1]
        return out

    def read(self, partition: Blocks | None) -> Iterator[pa.RecordBatch]:
        for run in partition.runs if partition else ():  # none where nothing is touched
            yield from self._cells(*run)

    def _cells(self, h: Header, blocks: list[tuple[int, int, int, int]], shift: tuple[int, int]) -> Iterator[pa.RecordBatch]:
        rows, cols = self._window(h)
        system, inner = opened(h.path)
        with system.open_input_file(inner) as f:
            for r, c, offset, size in blocks:
                f.seek(offset)
                data = f.read(size)
                data = zlib.decompress(data) if h.deflated else data
                values = np.frombuffer(data, h.dtype)
                values = values[: len(values) // h.block[1] * h.block[1]].reshape(-1, h.block[1])  # the last strip may be short
                if h.differenced:
                    values = np.cumsum(values, axis=1, dtype=values.dtype.newbyteorder("="))
                y, x = np.arange(len(values)) + r * h.block[0], np.arange(h.block[1]) + c * h.block[1]
                keep = ((y >= rows.start) & (y < rows.stop))[:, None] & ((x >= cols.start) & (x < cols.stop))[None]
                values = values.astype(float)
                keep &= np.isfinite(values)
                if h.nodata is not None:
                    keep &= values != h.nodata
                at = np.nonzero(keep)
                if len(at[0]):
                    layer = pa.array([h.layer]).take(pa.array(np.zeros(len(at[0]), np.int32)))
                    yield pa.record_batch([layer, (y[at[0]] + shift[0]).astype(np.int32), (x[at[1]] + shift[1]).astype(np.int32), values[at]], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """A file a tile, under a name of its own until the job commits, so that lost and repeated tasks leave nothing behind."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.tile = options["path"].rstrip("/"), int(options["tile"])
        self.affine = tuple(map(float, options["affine"].split(",")))
        self.epoch = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        names: list[tuple[str, str]] = []
        at, grid = None, None

        def close() -> None:
            layer, r, c = at
            folder = f"{root}/{layer}"
            system.create_dir(folder, recursive=True)
            draft = f"{folder}/_{self.epoch}-{uuid.uuid4().hex}.tif"
            with system.open_output_stream(draft) as f:
                f.write(tile_bytes(grid, r * self.tile, c * self.tile, self.affine))
            names.append((draft, f"{folder}/{r}_{c}.tif"))

        for batch in batches:
            layer, row, col, value = (batch.column(k).to_pylist() if k == 0 else batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            tr, tc = row // self.tile, col // self.tile
            cut = [0, *[k for k in range(1, len(row)) if (layer[k], tr[k], tc[k]) != (layer[k - 1], tr[k - 1], tc[k - 1])], len(row)]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                here = layer[a], int(tr[a]), int(tc[a])
                if here != at:
                    if at is not None:
                        close()
                    at, grid = here, np.full((self.tile, self.tile), np.nan)
                grid[row[a:b] - here[1] * self.tile, col[a:b] - here[2] * self.tile] = value[a:b]
        if at is not None:
            close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for draft, name in (n for m in messages if m for n in m.names):
            system.move(draft, name)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for draft, _ in (n for m in messages if m for n in m.names):
            system.delete_file(draft)


def tile_bytes(grid: np.ndarray, row: int, col: int, affine: tuple[float, ...]) -> bytes:
    """A file of one deflated tile of doubles, NaN where there is no cell, whose corner is a cell of the grid."""
    a, _, c, _, e, f = affine
    body = zlib.compress(grid.astype("<f8").tobytes(), 6)
    body += b"\0" * (len(body) % 2)
    transform = struct.pack("<16d", a, 0, 0, c + col * a, 0, e, 0, f + row * e, 0, 0, 0, 0, 0, 0, 0, 1)
    short, long = 3, 4
    h, w = grid.shape
    fields = [(WIDTH, long, w), (HEIGHT, long, h), (BITS, short, 64), (COMPRESSION, short, DEFLATE), (262, short, 1), (BANDS, short, 1), (TILE_WIDTH, long, w), (TILE_HEIGHT, long, h), (TILE_OFFSETS, long, 8 + len(transform)), (TILE_BYTES, long, len(body)), (FORMAT, short, 3)]
    entries = [struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in fields]
    entries += [struct.pack("<HHII", TRANSFORM, 12, 16, 8), struct.pack("<HHI4s", NODATA, 2, 4, b"nan\0")]
    table = struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
    return struct.pack("<2sHI", b"II", 42, 8 + len(transform) + len(body)) + transform + body + table


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def read(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None, cells: int = 1 << 20) -> DataFrame:
    """``layer, row, col, value`` of the cells whose centres lie in ``bbox`` (west, south, east, north); about ``cells`` a partition."""
    spark.dataSource.register(GeoTiff)
    source = spark.read.format("geotiff").option("cells", cells)
    return (source.option("bbox", ",".join(map(repr, bbox))) if bbox else source).load(path)


def write(table: DataFrame, path: str, affine: tuple[float, ...], tile: int = 256) -> None:
    """``layer, row, col, value`` as a folder a layer and a file a tile of ``tile`` by ``tile`` cells.

    Cells that repeat are summed; null and infinite values, and rows with a null key, are
    left out. A tile that exists is replaced; others stay.
    """
    table.sparkSession.dataSource.register(GeoTiff)
    block = lambda c: F.floor(F.col(c) / tile)
    known = table.where("layer is not null and row is not null and col is not null and abs(value) < double('infinity')")
    whole = known.groupBy("layer", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.sum("value").cast("double").alias("value"))
    dealt = whole.repartition("layer", block("row"), block("col")).sortWithinPartitions("layer", block("row"), block("col"))
    dealt.select("layer", "row", "col", "value").write.format("geotiff").option("tile", tile).option("affine", ",".join(map(repr, map(float, affine)))).mode("append").save(path)
