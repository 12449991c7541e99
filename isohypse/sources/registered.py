"""Binary formats as data sources of Spark: osm_pbf, vector_tiles and raster.

    load(spark, "osm_pbf", path)       kind, id, x, y, refs, tags
    load(spark, "vector_tiles", path)  archive, z, x, y, data
    load(spark, "raster", path)        field_id, row, col, value, lon, lat

A file is planned from its index alone: the blob headers of a PBF extract, the directory of
an archive, the tag list of a TIFF.  Tasks then read their own ranges of bytes, so a file of
any size is spread over tasks and is never in one piece in memory.

Bounds of columns, given to `load`, leave out partitions and what is in them: groups of
nodes or ways, parts of an archive's directory (its curve numbers a square of tiles in one
stretch), blocks of a raster.  They are options of the reader and filters of the frame, which
Spark applies too.  They aren't taken from the planner's own pushed filters: a relation of a
Python source keeps those of the first query that is planned on it for all later ones.

Paths are files or folders, in any store that pyarrow's file systems reach.  A truncated
extract ends at its last whole blob; an empty folder gives no rows.
"""

from __future__ import annotations

import os
import posixpath
import sqlite3
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import inf

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import binary
from .texts import map_features

_PART = 32 << 20


# ---- files -------------------------------------------------------------------------------


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def found(path: str, endings: Sequence[str], deep: bool = True) -> list[str]:
    """The file, or a folder's files with one of the endings, by name."""
    store, own = _store(path)
    info = store.get_file_info(own)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    inside = store.get_file_info(fs.FileSelector(own, recursive=deep))
    head = path.rstrip("/")
    return sorted(f"{head}/{posixpath.relpath(x.path, own)}" for x in inside if x.type == fs.FileType.File and x.path.lower().endswith(tuple(endings)))


class Ranges:
    """A file read by ranges."""

    def __init__(self, path: str) -> None:
        store, own = _store(path)
        self.file = store.open_input_file(own)
        self.size = self.file.size()

    def __call__(self, at: int, size: int) -> bytes:
        return self.file.read_at(max(0, min(size, self.size - at)), at)


# ---- bounds ------------------------------------------------------------------------------


class _Reader(DataSourceReader):
    endings: tuple[str, ...] = ()

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def range(self, name: str) -> tuple[float, float]:
        return float(self.options.get(f"{name}_from", -inf)), float(self.options.get(f"{name}_to", inf))

    def meets(self, name: str, low: float, high: float) -> bool:
        a, b = self.range(name)
        return low <= b and high >= a

    def files(self) -> list[str]:
        return found(self.options["path"], self.endings)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# ---- OSM PBF -----------------------------------------------------------------------------

_PBF = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("refs", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string()))])


@dataclass
class Blobs(InputPartition):
    path: str
    ranges: list[tuple[int, int]]


class PbfReader(_Reader):
    endings = (".pbf",)

    def partitions(self) -> list[InputPartition]:
        most = int(self.options.get("partition_bytes", _PART))
        out: list[InputPartition] = []
        for path in self.files():
            held: list[tuple[int, int]] = []
            for at, size in binary.blob_ranges(read := Ranges(path), read.size):
                if held and sum(n for _, n in held) + size > most:
                    out.append(Blobs(path, held))
                    held = []
                held.append((at, size))
            if held:
                out.append(Blobs(path, held))
        return out

    def read(self, partition: Blobs | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a source without partitions has one without content
            return
        kinds = {self.options["kind"]} if "kind" in self.options else {"node", "way"}
        (west, east), (south, north) = self.range("x"), self.range("y")
        placed = (west, east, south, north) != (-inf, inf, -inf, inf)  # what has no place can't pass
        read = Ranges(partition.path)
        for at, size in partition.ranges:
            rows = binary.block_rows(binary.inflated(read(at, size)), kinds - {"way"} if placed else kinds)
            yield from _batches((r[:5] + (list(r[5].items()),) for r in rows if not placed or west <= r[2] <= east and south <= r[3] <= north), _PBF)


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return "kind string, id bigint, x double, y double, refs array<bigint>, tags map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return PbfReader(self.options)


def pbf_features(rows: DataFrame, source: str = "osm") -> DataFrame:
    """Features of an extract's rows: tagged nodes, and ways joined to their nodes.

    The rows are read several times: cut or cache them before.
    """
    none = F.lit(None).cast("array<struct<lat:double,lon:double>>")
    nodes = rows.where("kind = 'node'")
    points = nodes.where(F.size("tags") > 0).select(F.lit("node").alias("type"), "id", "tags", F.col("y").alias("lat"), F.col("x").alias("lon"), none.alias("geometry"))
    ways = rows.where("kind = 'way'")
    refs = ways.select("id", F.posexplode("refs").alias("pos", "ref"))
    met = refs.join(nodes.select(F.col("id").alias("ref"), "x", "y"), "ref").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("line"))
    line = F.transform("line", lambda v: F.struct(v.y.alias("lat"), v.x.alias("lon")))
    lines = ways.select("id", "tags").join(met, "id").select(F.lit("way").alias("type"), "id", "tags", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), line.alias("geometry"))
    return map_features(points.unionByName(lines), source)


# ---- vector tiles ------------------------------------------------------------------------

_TILES = pa.schema([("archive", pa.string()), ("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("data", pa.binary())])


def tile_place(number: int) -> tuple[int, int, int]:
    """z, x, y of a tile's number along the curve."""
    z = 0
    while number >= 1 << 2 * z:
        number -= 1 << 2 * z
        z += 1
    x = y = 0
    for k in range(z):
        quarter, side = number >> 2 * k & 3, 1 << k
        right = quarter >> 1
        upper = (quarter ^ right) & 1
        if not upper:
            if right:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y = x + (right << k), y + (upper << k)
    return z, x, y


def stretches(z: int, x0: int, x1: int, y0: int, y1: int, depth: int = 8) -> list[tuple[int, int]]:
    """Number ranges (first, past) that hold all tiles of a rectangle at one zoom, and few others.

    A square of the tile tree is one stretch of the curve; squares are split where the
    rectangle's border runs through them, `depth` levels deep.
    """
    out: list[tuple[int, int]] = []
    squares = [(0, 0, 0)]
    while squares:
        level, x, y = squares.pop()
        rest = z - level
        low_x, low_y = x << rest, y << rest
        high_x, high_y = low_x + (1 << rest) - 1, low_y + (1 << rest) - 1
        if low_x > x1 or high_x < x0 or low_y > y1 or high_y < y0:
            continue
        if not rest or level == depth or x0 <= low_x and high_x <= x1 and y0 <= low_y and high_y <= y1:
            first = binary.hilbert_id(z, low_x, low_y) - ((1 << 2 * z) - 1) // 3
            first = (first >> 2 * rest << 2 * rest) + ((1 << 2 * z) - 1) // 3
            out.append((first, first + (1 << 2 * rest)))
        else:
            squares += [(level + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and merged[-1][1] == a:
            merged[-1] = merged[-1][0], b
        else:
            merged.append((a, b))
    return merged


@dataclass
class Entries(InputPartition):
    """Directory entries of an archive: tiles, or leaves with more entries."""

    path: str
    entries: list[tuple[int, int, int, int]]


@dataclass
class Columns(InputPartition):
    """Columns of one zoom of a database of tiles."""

    path: str
    z: int
    first: int
    last: int


class TileReader(_Reader):
    endings = (".pmtiles", ".mbtiles")

    def partitions(self) -> list[InputPartition]:
        most = int(self.options.get("partition_bytes", _PART >> 2))
        out: list[InputPartition] = []
        for path in self.files():
            out += self._columns(path, int(self.options.get("partition_tiles", 2000))) if path.lower().endswith(".mbtiles") else self._entries(path, most)
        return out

    def _zooms(self, low: int, high: int) -> range:
        a, b = self.range("z")
        return range(int(max(low, a)), int(min(high, b)) + 1)

    def _rectangle(self, z: int) -> tuple[int, int, int, int] | None:
        """x0, x1, y0, y1 of the tiles that the bounds allow at a zoom."""
        side = [(max(0, -int(-a // 1) if a > 0 else 0), int(min((1 << z) - 1, b))) for a, b in (self.range("x"), self.range("y"))]
        return (*side[0], *side[1]) if all(a <= b for a, b in side) else None

    def _wanted(self, archive: binary.PMTiles) -> list[tuple[int, int]]:
        out = []
        for z in self._zooms(archive.min_zoom, archive.max_zoom):
            if box := self._rectangle(z):
                out += stretches(z, *box)
        return out

    def _entries(self, path: str, most: int) -> list[InputPartition]:
        archive = binary.PMTiles(Ranges(path))
        wanted, root = self._wanted(archive), archive.entries()
        out: list[InputPartition] = []
        held: list[tuple[int, int, int, int]] = []
        for k, (tile, run, size, at) in enumerate(root):
            past = tile + run if run else root[k + 1][0] if k + 1 < len(root) else inf
            if not any(a < past and tile < b for a, b in wanted):
                continue
            if held and (not run or sum(n for _, _, n, _ in held) + size > most):
                out.append(Entries(path, held))
                held = []
            held.append((tile, run, size, at))
            if not run:
                out.append(Entries(path, held))
                held = []
        return [*out, Entries(path, held)] if held else out

    def _columns(self, path: str, most: int) -> list[InputPartition]:
        out: list[InputPartition] = []
        with _database(path) as db:
            for z, first, last, n in db.execute("SELECT zoom_level, min(tile_column), max(tile_column), count(*) FROM tiles GROUP BY zoom_level ORDER BY zoom_level"):
                box = self._rectangle(z) if z in self._zooms(z, z) else None
                if box:
                    step = max(1, (last - first + 1) * most // max(1, n))
                    a, b = max(first, box[0]), min(last, box[1])
                    out += [Columns(path, z, c, min(b, c + step - 1)) for c in range(a, b + 1, step)]
        return out

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        rows = self._from_database(partition) if isinstance(partition, Columns) else self._from_archive(partition)
        yield from _batches(rows, _TILES, 256)

    def _from_database(self, p: Columns) -> Iterator[tuple]:
        _, _, y0, y1 = self._rectangle(p.z)
        top = (1 << p.z) - 1  # rows count from the south in the file
        with _database(p.path) as db:
            for x, y, data in db.execute("SELECT tile_column, tile_row, tile_data FROM tiles WHERE zoom_level = ? AND tile_column BETWEEN ? AND ? AND tile_row BETWEEN ? AND ?", (p.z, p.first, p.last, top - y1, top - y0)):
                yield p.path, p.z, x, top - y, data

    def _from_archive(self, p: Entries) -> Iterator[tuple]:
        archive = binary.PMTiles(read := Ranges(p.path))
        wanted, left = self._wanted(archive), list(p.entries)
        while left:
            tile, run, size, at = left.pop()
            if not run:
                inner = archive.entries(at, size)
                pasts = [e[0] for e in inner[1:]] + [inf]
                left += [e for e, past in zip(inner, pasts, strict=True) if any(a < (e[0] + e[1] if e[1] else past) and e[0] < b for a, b in wanted)]
                continue
            data = None
            for number in range(tile, tile + run):
                z, x, y = tile_place(number)
                box = self._rectangle(z) if z in self._zooms(z, z) else None
                if box and box[0] <= x <= box[1] and box[2] <= y <= box[3]:
                    data = data if data is not None else read(archive.data + at, size)
                    yield p.path, z, x, y, data


class _database:  # noqa: N801
    """A database of tiles opened for reading; one of another store is copied for as long."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __enter__(self) -> sqlite3.Connection:
        store, own = _store(self.path)
        self.copy = None
        if not isinstance(store, fs.LocalFileSystem):
            self.copy = tempfile.NamedTemporaryFile(suffix=".mbtiles")  # gone with the task
            with store.open_input_stream(own) as f:
                while block := f.read(1 << 22):
                    self.copy.write(block)
            self.copy.flush()
            own = self.copy.name
        self.db = sqlite3.connect(f"file:{own}?mode=ro", uri=True)
        return self.db

    def __exit__(self, *_) -> None:
        self.db.close()
        if self.copy:
            self.copy.close()


class VectorTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_tiles"

    def schema(self) -> str:
        return "archive string, z int, x int, y int, data binary"

    def reader(self, schema) -> DataSourceReader:
        return TileReader(self.options)


def held_zoom(path: str, preferred: int = 14) -> int | None:
    """The zoom of an archive that is nearest to the preferred one; of two, the lower."""
    if path.lower().endswith(".pmtiles"):
        archive = binary.PMTiles(Ranges(path))
        return min(max(preferred, archive.min_zoom), archive.max_zoom)
    with _database(path) as db:
        zooms = [z for (z,) in db.execute("SELECT DISTINCT zoom_level FROM tiles ORDER BY zoom_level")]
    return min(zooms, key=lambda z: (abs(z - preferred), z), default=None)


# ---- rasters -----------------------------------------------------------------------------

_CELLS = pa.schema([("field_id", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.float64()), ("lon", pa.float64()), ("lat", pa.float64())])


@dataclass
class Blocks(InputPartition):
    path: str
    numbers: list[int]


class RasterReader(_Reader):
    endings = (".tif", ".tiff")

    def partitions(self) -> list[InputPartition]:
        most = int(self.options.get("partition_cells", 4_000_000))
        out: list[InputPartition] = []
        for path in self.files():
            tiff, held, cells = binary.Tiff(Ranges(path)), [], 0
            for k in range(tiff.blocks):
                r, c, height, width = tiff.extent(k)
                lon, lat = tiff.lon(np.array([c, c + width - 1])), tiff.lat(np.array([r, r + height - 1]))
                places = {"row": (r, r + height - 1), "col": (c, c + width - 1), "lon": (lon.min(), lon.max()), "lat": (lat.min(), lat.max())}
                if not all(self.meets(name, *span) for name, span in places.items()):
                    continue
                if held and cells + height * width > most:
                    out.append(Blocks(path, held))
                    held, cells = [], 0
                held.append(k)
                cells += height * width
            if held:
                out.append(Blocks(path, held))
        return out

    def read(self, partition: Blocks | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        tiff = binary.Tiff(Ranges(partition.path))
        for k in partition.numbers:
            r, c, height, width = tiff.extent(k)
            step = max(1, 250_000 // width)
            values = tiff.block(k)
            for a in range(0, height, step):
                part = values[a : a + step]
                row, col = np.repeat(np.arange(r + a, r + a + len(part), dtype=np.int32), width), np.tile(np.arange(c, c + width, dtype=np.int32), len(part))
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * part.size), pa.array(row), pa.array(col), pa.array(part.ravel()), pa.array(tiff.lon(col)), pa.array(tiff.lat(row))], schema=_CELLS)


class Raster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "field_id string, row int, col int, value double, lon double, lat double"

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(self.options)


def load(spark: SparkSession, kind: str, path: str, options: dict | None = None, /, **bounds) -> DataFrame:
    """A source's rows within bounds: a column's name with a closed range (first, last) or with one value."""
    for source in (OsmPbf, VectorTiles, Raster):
        spark.dataSource.register(source)
    read = spark.read.format(kind)
    for name, value in (options or {}).items():
        read = read.option(name, value)
    wanted = F.lit(True)
    for name, value in bounds.items():
        if isinstance(value, tuple):
            read = read.option(f"{name}_from", value[0]).option(f"{name}_to", value[1])
            wanted = wanted & F.col(name).between(*value)
        elif isinstance(value, str):
            read, wanted = read.option(name, value), wanted & (F.col(name) == value)
        else:
            read, wanted = read.option(f"{name}_from", value).option(f"{name}_to", value), wanted & (F.col(name) == value)
    out = read.load(path)
    return out.where(wanted) if bounds else out
