"""Binary formats: shapefile, dBASE, OSM PBF, vector tiles, PMTiles, GeoTIFF, PNG.

Each file, blob or tile is one row of `binaryFile` (or of a listing) and is decoded by a
plain function on bytes inside mapInPandas, so that files are spread over tasks.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import CELLS, FEATURES

Ring = list[tuple[float, float]]


def signed_double_area(ring: Ring) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def _holds(ring: Ring, x: float, y: float) -> bool:
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def nested(outer: list[Ring], inner: list[Ring]) -> list[list[Ring]]:
    """Polygons: each hole in the smallest shell that holds its first vertex; stray holes go."""
    polygons = [[ring] for ring in outer]
    by_size = sorted(range(len(outer)), key=lambda k: abs(signed_double_area(outer[k])))
    for hole in inner:
        home = next((k for k in by_size if _holds(outer[k], *hole[0])), None)
        if home is not None:
            polygons[home].append(hole)
    return polygons


def _geom(kind: str, parts: list[list[Ring]]) -> dict:
    single = kind.replace("Multi", "") if len(parts) == 1 else kind
    return {"kind": single, "parts": [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]}


# ---- shapefile ---------------------------------------------------------------------------


def shape_records(data: bytes) -> Iterator[tuple[int, dict | None]]:
    """(ordinal, geometry) of a .shp file; outer rings run clockwise."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("no shapefile")
    at, ordinal = 100, 0
    while at + 8 <= len(data):
        words = struct.unpack(">i", data[at + 4 : at + 8])[0]
        yield ordinal, _shape(data[at + 8 : at + 8 + 2 * words])
        at += 8 + 2 * words
        ordinal += 1


def _shape(body: bytes) -> dict | None:
    kind = struct.unpack("<i", body[:4])[0] % 10 if len(body) >= 4 else 0
    ok = lambda ps: [(x, y) for x, y in ps if np.isfinite(x) and np.isfinite(y)]
    if kind == 1:
        point = ok([struct.unpack("<2d", body[4:20])])
        return _geom("Point", [[point]]) if point else None
    if kind == 8:
        n = struct.unpack("<i", body[36:40])[0]
        points = ok(struct.iter_unpack("<2d", body[40 : 40 + 16 * n]))
        return _geom("MultiPoint", [[[p]] for p in points]) if points else None
    if kind not in (3, 5):
        return None
    n_parts, n_points = struct.unpack("<2i", body[36:44])
    starts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
    points = list(struct.iter_unpack("<2d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points]))
    rings = [ok(points[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    if kind == 3:
        lines = [r for r in rings if len(r) >= 2]
        return _geom("MultiLineString", [[r] for r in lines]) if lines else None
    rings = [r for r in rings if len(r) >= 4]
    outer, inner = [r for r in rings if signed_double_area(r) < 0], [r for r in rings if signed_double_area(r) >= 0]
    polygons = nested(outer, inner) if outer else [[r] for r in rings]
    return _geom("MultiPolygon", polygons) if polygons else None


def table_records(data: bytes) -> list[dict[str, str]]:
    """The rows of a .dbf file as text maps; deleted rows are empty, blanks are left out."""
    n, header, width = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while at + 32 <= header and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(data[at + 11]), data[at + 16]))
        at += 32
    out = []
    for k in range(n):
        row, place, own = data[header + k * width : header + (k + 1) * width], 1, {}
        if row[:1] != b"*":
            for name, kind, size in fields:
                text = row[place : place + size].decode("utf-8", "replace").strip("\0 ")
                place += size
                if not text:
                    continue
                if kind in "NF":
                    try:
                        v = float(text)
                    except ValueError:
                        continue
                    text = str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)
                elif kind == "L":
                    text = "true" if text[0] in "YyTt" else "false"
                own[name] = text
        out.append(own)
    return out


def read_shapefiles(spark: SparkSession, path: str, source: str = "file", layer: str = "features") -> DataFrame:
    """Shapes with the attributes of the table of the same name; ids by file and ordinal."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{shp,dbf}").load(path)
    pairs = files.withColumn("stem", F.regexp_replace("path", r"\.[^.]*$", "")).groupBy("stem").agg(
        F.max(F.when(F.col("path").endswith(".shp"), F.col("content"))).alias("shp"), F.max(F.when(F.col("path").endswith(".dbf"), F.col("content"))).alias("dbf")
    )

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                if r.shp is None:
                    continue
                attributes = table_records(r.dbf) if r.dbf is not None else []
                name = r.stem.rsplit("/", 1)[-1]
                for k, geom in shape_records(r.shp):
                    if geom is not None:
                        rows.append((f"{source}/{name}/{k}", layer, source, "measured", geom, attributes[k] if k < len(attributes) else {}))
            yield pd.DataFrame(rows, columns=["id", "layer", "source", "provenance", "geom", "props"])

    return pairs.where("shp IS NOT NULL").mapInPandas(decode, FEATURES)


# ---- protocol buffers --------------------------------------------------------------------


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of a message."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield tag >> 3, wire, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append(v)
    return out


def running(deltas: list[int]) -> list[int]:
    total, out = 0, []
    for d in deltas:
        total += zigzag(d)
        out.append(total)
    return out


# ---- OSM PBF -----------------------------------------------------------------------------


def blob_ranges(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int]]:
    """Place and length of the data blobs of a .pbf file, from their headers alone; stops at a truncated one."""
    at = 0
    while at + 4 <= size:
        head = struct.unpack(">I", read(at, 4))[0]
        if head > 1 << 16:
            raise ValueError("blob header too long")
        kind, length = b"", 0
        for number, _, v in fields(read(at + 4, head)):
            kind, length = (v, length) if number == 1 else (kind, v) if number == 3 else (kind, length)
        at += 4 + head
        if at + length > size:
            return
        if kind == b"OSMData":
            yield at, length
        at += length


def inflated(blob: bytes) -> bytes:
    raw = None
    for number, _, v in fields(blob):
        raw = v if number == 1 else zlib.decompress(v) if number == 3 else raw
    if raw is None:
        raise ValueError("blob without data")
    return raw


def blobs(data: bytes) -> Iterator[bytes]:
    """Inflated data blobs of a .pbf file; stops at a truncated one."""
    for at, length in blob_ranges(lambda p, n: data[p : p + n], len(data)):
        yield inflated(data[at : at + length])


def block_rows(block: bytes, kinds: frozenset[str] | set[str] = frozenset(("node", "way"))) -> Iterator[tuple]:
    """(kind, id, lon, lat, refs, tags) of a primitive block's nodes and ways; other kinds aren't decoded."""
    strings, groups, granularity, lat0, lon0 = [], [], 100, 0, 0
    for number, _, v in fields(block):
        if number == 1:
            strings = [s.decode("utf-8", "replace") for n, _, s in fields(v) if n == 1]
        elif number == 2:
            groups.append(v)
        elif number == 17:
            granularity = v
        elif number == 19:
            lat0 = v
        elif number == 20:
            lon0 = v
    degrees = lambda first, v: 1e-9 * (first + granularity * v)
    named = lambda own: {strings[k]: strings[x] for k, x in zip(packed(own.get(2, b"")), packed(own.get(3, b"")), strict=False)}
    for group in groups:
        for number, _, v in fields(group):
            if number not in (1, 2, 3) or ("way" if number == 3 else "node") not in kinds:
                continue
            own = {n: x for n, _, x in fields(v)}
            if number == 1:
                yield "node", zigzag(own[1]), degrees(lon0, zigzag(own[9])), degrees(lat0, zigzag(own[8])), None, named(own)
            elif number == 2:
                ids, lats, lons = (running(packed(own.get(n, b""))) for n in (1, 8, 9))
                pairs, tags = iter(packed(own.get(10, b""))), []
                for _ in ids:
                    t = {}
                    while (k := next(pairs, 0)) != 0:
                        t[strings[k]] = strings[next(pairs)]
                    tags.append(t)
                for i, la, lo, t in zip(ids, lats, lons, tags, strict=True):
                    yield "node", i, degrees(lon0, lo), degrees(lat0, la), None, t
            else:
                yield "way", own[1], None, None, running(packed(own.get(8, b""))), named(own)


def read_pbf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node_id, x, y, tags) and ways (way_id, refs, tags): two DataFrames for relational assembly."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for data in pdf.content:
                for block in blobs(data):
                    yield pd.DataFrame(list(block_rows(block)), columns=["kind", "id", "x", "y", "refs", "tags"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "kind string, id bigint, x double, y double, refs array<bigint>, tags map<string,string>")
    nodes = rows.where("kind = 'node'").select(F.col("id").alias("node_id"), "x", "y", "tags")
    return nodes, rows.where("kind = 'way'").select(F.col("id").alias("way_id"), "refs", "tags")


# ---- vector tiles ------------------------------------------------------------------------


def tile_layers(data: bytes) -> Iterator[dict]:
    """Layers of a vector tile: name, extent and features (kind, rings of local points, props)."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except OSError:
            pass
    for number, _, body in fields(data):
        if number != 3:
            continue
        try:
            name, extent, keys, values, features = "", 4096, [], [], []
            for n, _, v in fields(body):
                if n == 1:
                    name = v.decode()
                elif n == 2:
                    features.append(v)
                elif n == 3:
                    keys.append(v.decode())
                elif n == 4:
                    values.append(_tile_value(v))
                elif n == 5:
                    extent = v
            yield {"name": name, "extent": extent, "features": [f for f in (_tile_feature(x, keys, values) for x in features) if f]}
        except (ValueError, IndexError, struct.error):
            continue  # a broken layer is left out


def _tile_value(data: bytes) -> str:
    for n, _, v in fields(data):
        if n == 1:
            return v.decode("utf-8", "replace")
        if n == 2:
            return repr(struct.unpack("<f", v)[0])
        if n == 3:
            return repr(struct.unpack("<d", v)[0])
        if n == 6:
            return str(zigzag(v))
        if n == 7:
            return "true" if v else "false"
        return str(v - (1 << 64) if n == 4 and v >> 63 else v)
    return ""


def _tile_feature(data: bytes, keys: list[str], values: list[str]) -> dict | None:
    own = {n: v for n, _, v in fields(data)}
    tags = packed(own.get(2, b""))
    props = {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=False) if k < len(keys) and v < len(values)}
    kind = {1: "Point", 2: "LineString", 3: "Polygon"}.get(own.get(3, 0))
    return {"kind": kind, "rings": tile_rings(packed(own.get(4, b""))), "props": props} if kind else None


def tile_rings(commands: list[int]) -> list[Ring]:
    """Moves (1), lines (2) and closings (7) over a cursor that goes on between rings."""
    rings, x, y, at = [], 0, 0, 0
    while at < len(commands):
        command, count = commands[at] & 7, commands[at] >> 3
        at += 1
        if command == 7:
            if rings and rings[-1]:
                rings[-1].append(rings[-1][0])
            continue
        for _ in range(count):
            if at + 1 >= len(commands):
                return rings
            x, y = x + zigzag(commands[at]), y + zigzag(commands[at + 1])
            at += 2
            if command == 1:
                rings.append([])
            rings[-1].append((float(x), float(y)))
    return rings


def tile_geometry(feature: dict, z: int, x: int, y: int, extent: int) -> dict | None:
    """A tile's feature in degrees; of polygons, rings with a positive area are outer ones."""
    size = float(extent << z)

    def place(px: float, py: float) -> tuple[float, float]:
        u, v = (x * extent + px) / size, (y * extent + py) / size
        return u * 360 - 180, float(np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * v)))))

    rings = [r for r in feature["rings"] if r]
    if not rings:
        return None
    if feature["kind"] == "Point":
        return _geom("MultiPoint", [[[place(*p)]] for r in rings for p in r])
    if feature["kind"] == "LineString":
        return _geom("MultiLineString", [[[place(*p) for p in r]] for r in rings if len(r) > 1])
    parts: list[list[Ring]] = []
    for r in rings:
        if len(r) >= 4:
            own = [place(*p) for p in r]
            if signed_double_area(r) > 0 or not parts:
                parts.append([own])
            else:
                parts[-1].append(own)
    return _geom("MultiPolygon", parts) if parts else None


def hilbert_id(z: int, x: int, y: int) -> int:
    """A tile's number along the curve through all lower zooms and its own."""
    total, side = ((1 << 2 * z) - 1) // 3, 1 << z
    d, s = 0, side // 2
    while s:
        rx, ry = int(x & s > 0), int(y & s > 0)
        d += s * s * (3 * rx ^ ry)
        if not ry:
            if rx:
                x, y = s - 1 - (x & (s - 1)), s - 1 - (y & (s - 1))
            x, y = y, x
        s //= 2
    return total + d


def directory(data: bytes) -> list[tuple[int, int, int, int]]:
    """(tile id, run, length, offset) entries; an offset of zero goes on from the last entry."""
    numbers = packed(data)
    n, rest = numbers[0], numbers[1:]
    out, tile = [], 0
    for k in range(n):
        tile += rest[k]
        run, length, offset = rest[n + k], rest[2 * n + k], rest[3 * n + k]
        place = out[-1][3] + out[-1][2] if offset == 0 and k else offset - 1
        out.append((tile, run, length, place))
    return out


class PMTiles:
    """An archive read through a function (offset, length) -> bytes."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        head = read(0, 127)
        if head[:7] != b"PMTiles" or head[7] != 3:
            raise ValueError("no PMTiles archive of version 3")
        self.read = read
        self.root, self.root_size, _, _, self.leaves, _, self.data = (struct.unpack("<Q", head[8 + 8 * k : 16 + 8 * k])[0] for k in range(7))
        self.packed, self.min_zoom, self.max_zoom = head[97] == 2, head[100], head[101]

    def _directory(self, at: int, size: int) -> list[tuple[int, int, int, int]]:
        raw = self.read(at, size)
        return directory(gzip.decompress(raw) if self.packed else raw)

    def entries(self, at: int | None = None, size: int = 0) -> list[tuple[int, int, int, int]]:
        """Entries of the root, or of the leaf at a place among the leaves."""
        return self._directory(self.root, self.root_size) if at is None else self._directory(self.leaves + at, size)

    def tile(self, z: int, x: int, y: int) -> bytes | None:
        wanted, entries = hilbert_id(z, x, y), self.entries()
        for _ in range(4):
            low, high = 0, len(entries)
            while low < high:
                mid = (low + high) // 2
                low, high = (mid + 1, high) if entries[mid][0] <= wanted else (low, mid)
            if not low:
                return None
            tile, run, size, at = entries[low - 1]
            if run:
                return self.read(self.data + at, size) if wanted < tile + run else None
            entries = self.entries(at, size)
        return None


def tile_features(tiles: DataFrame, source: str = "file") -> DataFrame:
    """Features of tiles (z, x, y, data); a tile is decoded by one task."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                for layer in tile_layers(r.data):
                    for k, f in enumerate(layer["features"]):
                        geom = tile_geometry(f, r.z, r.x, r.y, layer["extent"])
                        if geom and geom["parts"]:
                            rows.append((f"{source}/{r.z}/{r.x}/{r.y}/{layer['name']}/{k}", layer["name"], source, "measured", geom, f["props"] | {"layer": layer["name"]}))
            yield pd.DataFrame(rows, columns=["id", "layer", "source", "provenance", "geom", "props"])

    return tiles.select("z", "x", "y", "data").mapInPandas(decode, FEATURES)


def mbtiles(spark: SparkSession, path: str, z: int) -> DataFrame:
    """(z, x, y, data) of one zoom of each archive; rows count from the south in the file."""
    import os
    import sqlite3
    import tempfile

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf.content:
                with tempfile.TemporaryDirectory() as d:
                    with open(os.path.join(d, "a"), "wb") as f:
                        f.write(content)
                    with sqlite3.connect(os.path.join(d, "a")) as db:
                        rows = db.execute("SELECT tile_column, tile_row, tile_data FROM tiles WHERE zoom_level = ?", (z,)).fetchall()
                yield pd.DataFrame([(z, x, (1 << z) - 1 - y, data) for x, y, data in rows], columns=["z", "x", "y", "data"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, "z int, x int, y int, data binary")


# ---- rasters -----------------------------------------------------------------------------

_SAMPLES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


class Tiff:
    """A raster of one band read through a function (offset, length) -> bytes, by its strips or tiles.

    Blocks are uncompressed or deflated, with or without differences along a row.
    """

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        self.read = read
        head = read(0, 8)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
            raise ValueError("no classic TIFF")
        sizes = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d"}
        at = struct.unpack(order + "I", head[4:8])[0]
        tags: dict[int, tuple] = {}
        listed = read(at + 2, 12 * struct.unpack(order + "H", read(at, 2))[0])
        for k in range(0, len(listed), 12):
            tag, kind, count = struct.unpack(order + "HHI", listed[k : k + 8])
            if kind in sizes:
                form = order + (f"{count}s" if kind == 2 else f"{count}{sizes[kind]}")
                size = struct.calcsize(form)
                body = listed[k + 8 : k + 8 + size] if size <= 4 else read(struct.unpack(order + "I", listed[k + 8 : k + 12])[0], size)
                tags[tag] = struct.unpack(form, body)
        one = lambda t, d=None: tags.get(t, (d,))[0]
        self.width, self.height, self.packing, self.predictor = one(256), one(257), one(259, 1), one(317, 1)
        if self.packing not in (1, 8, 32946) or one(277, 1) != 1 or self.predictor not in (1, 2):
            raise ValueError("only uncompressed and deflated files with one band are read")
        self.kind = np.dtype(order + _SAMPLES[one(339, 1), one(258, 1)])
        tiled = 322 in tags
        self.block_width, self.block_height = (one(322), one(323)) if tiled else (self.width, one(278, self.height))
        self.across = -(-self.width // self.block_width)
        self.places = list(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True))
        self.missing = float(one(42113, b"nan").strip(b"\0 ") or b"nan") if 42113 in tags else float("nan")
        if 34264 in tags:
            m = tags[34264]
            if m[1] or m[4]:
                raise ValueError("rotated rasters aren't read")
            self.west, self.north, self.dx, self.dy = m[3], m[7], m[0], -m[5]
        else:
            self.dx, self.dy = tags[33550][:2]
            px, py, _, gx, gy = tags[33922][:5]
            self.west, self.north = gx - px * self.dx, gy + py * self.dy

    @property
    def blocks(self) -> int:
        return len(self.places)

    @property
    def box(self) -> tuple[float, float, float, float]:
        return self.west, self.north - self.height * self.dy, self.west + self.width * self.dx, self.north

    def lon(self, col: np.ndarray) -> np.ndarray:
        """Of the cells' centres."""
        return self.west + (col + 0.5) * self.dx

    def lat(self, row: np.ndarray) -> np.ndarray:
        return self.north - (row + 0.5) * self.dy

    def extent(self, k: int) -> tuple[int, int, int, int]:
        """First row and column, height and width of a block inside the raster."""
        r, c = k // self.across * self.block_height, k % self.across * self.block_width
        return r, c, min(self.block_height, self.height - r), min(self.block_width, self.width - c)

    def block(self, k: int) -> np.ndarray:
        """Values of a block, NaN where missing or out of range."""
        _, _, height, width = self.extent(k)
        at, size = self.places[k]
        raw = self.read(at, size)
        raw = raw if self.packing == 1 else zlib.decompress(raw)
        own = np.frombuffer(raw, self.kind, len(raw) // self.kind.itemsize)
        own = own[: len(own) // self.block_width * self.block_width].reshape(-1, self.block_width)
        if self.predictor == 2:
            own = np.cumsum(own, axis=1, dtype=self.kind)
        out = np.full((height, width), np.nan)
        out[: len(own)] = own[:height, :width]
        out[~np.isfinite(out) | (np.abs(out - self.missing) < 1e-6) | (out < -12000) | (out > 9500)] = np.nan
        return out


def geotiff(data: bytes) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """Values (NaN where missing) and (west, south, east, north) of a single-band file."""
    tiff = Tiff(lambda at, size: data[at : at + size])
    out = np.full((tiff.height, tiff.width), np.nan)
    for k in range(tiff.blocks):
        r, c, height, width = tiff.extent(k)
        out[r : r + height, c : c + width] = tiff.block(k)
    return out, tiff.box


def png_pixels(data: bytes) -> np.ndarray:
    """Rows of 8-bit pixels (height, width, channels) of a PNG without interlacing."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, head = 8, b"", b""
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        head, body = (chunk, body) if kind == b"IHDR" else (head, body + chunk) if kind == b"IDAT" else (head, body)
        at += 12 + size
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or channels is None:
        raise ValueError("only plain 8-bit PNGs are read")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out, last = np.zeros((height, width * channels), np.uint8), np.zeros(width * channels, np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        if kind == 2:
            line = line + last
        elif kind in (1, 3, 4):
            for i in range(len(line)):
                a = line[i - channels] if i >= channels else 0
                b = int(last[i])
                c = int(last[i - channels]) if i >= channels else 0
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    g = a + b - c
                    da, db, dc = abs(g - a), abs(g - b), abs(g - c)
                    p = a if da <= db and da <= dc else b if db <= dc else c
                line[i] = (line[i] + p) & 255
        last = (line & 255).astype(np.uint8)
        out[y] = last
    return out.reshape(height, width, channels)


def terrarium(data: bytes) -> np.ndarray:
    """Metres of a Terrarium tile: red * 256 + green + blue / 256 - 32768."""
    p = png_pixels(data).astype(float)
    return p[..., 0] * 256 + p[..., 1] + p[..., 2] / 256 - 32768


def luminance(data: bytes) -> np.ndarray:
    """Linear luma of an image; transparent pixels are missing."""
    p = png_pixels(data).astype(float)
    grey = p[..., 0] * 0.2126 + p[..., 1] * 0.7152 + p[..., 2] * 0.0722
    return np.where(p[..., 3] > 0, grey, np.nan) if p.shape[2] == 4 else grey


def read_rasters(spark: SparkSession, path: str, kind: str = "geotiff") -> DataFrame:
    """Cells of raster files; each file is one field named by its path."""
    decoder = {"geotiff": lambda b: geotiff(b)[0], "terrarium": terrarium, "luminance": luminance}[kind]

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                grid = decoder(content)
                row, col = np.indices(grid.shape)
                yield pd.DataFrame({"field_id": name, "row": row.ravel(), "col": col.ravel(), "value": grid.ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, CELLS)
