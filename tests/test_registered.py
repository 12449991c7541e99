"""Data sources of binary formats: partitions from the index alone, and fewer of them under filters."""

import gzip
import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohypse.functions.geo import Box
from isohypse.operators.tiles import tile_range
from isohypse.sources import binary, files, registered

from .test_sources import field, packed, tile, zz


def parts(df):
    return df.rdd.getNumPartitions()


# ---- OSM PBF -----------------------------------------------------------------------------


def delta(v):
    return packed([zz(b - a) for a, b in zip([0, *v], v)])


def blob(block, kind=b"OSMData"):
    body = field(3, zlib.compress(block))
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def node_block(first, n):
    strings = b"".join(field(1, s) for s in (b"", b"place", b"town"))
    ids = list(range(first, first + n))
    dense = field(1, delta(ids)) + field(8, delta([10_000_000 * (i % 40) for i in ids])) + field(9, delta([10_000_000 * (i % 50) for i in ids])) + field(10, packed([1, 2, 0] + [0] * (n - 1)))
    return field(1, strings) + field(2, field(2, dense))


@pytest.fixture(scope="module")
def extract(tmp_path_factory):
    """Six blocks of nodes and one of ways, a header, and a blob cut short at the end."""
    ways = field(1, b"".join(field(1, s) for s in (b"", b"building", b"yes", b"highway", b"primary")))
    ring = field(1, 7) + field(2, packed([1])) + field(3, packed([2])) + field(8, delta([1, 2, 51, 1]))
    road = field(1, 8) + field(2, packed([3])) + field(3, packed([4])) + field(8, delta([10, 11, 99_999]))
    lone = field(1, 9) + field(2, packed([3])) + field(3, packed([4])) + field(8, delta([99_999, 10]))
    single = field(1, zz(5000)) + field(8, zz(20_000_000)) + field(9, zz(-30_000_000))  # a node outside of a dense group
    ways += field(2, field(3, ring) + field(3, road) + field(3, lone)) + field(2, field(1, single))
    path = tmp_path_factory.mktemp("pbf") / "m.osm.pbf"
    path.write_bytes(blob(b"x", b"OSMHeader") + b"".join(blob(node_block(1 + 100 * k, 100)) for k in range(6)) + blob(ways) + blob(node_block(1, 9))[:-5])
    return str(path)


def test_extract_by_blobs(spark, extract):
    assert parts(registered.load(spark, "osm_pbf", extract)) == 1
    by_blob = {"partition_bytes": 1}
    df = registered.load(spark, "osm_pbf", extract, by_blob)
    assert parts(df) == 7
    rows = {(r.kind, r.id): r for r in df.collect()}
    assert len(rows) == 604 and rows["node", 1].tags == {"place": "town"} and rows["node", 2].tags == {}
    assert (rows["node", 51].x, rows["node", 51].y) == (pytest.approx(1.0), pytest.approx(11.0)) and rows["node", 51].refs is None
    assert (rows["node", 5000].x, rows["node", 5000].y) == (pytest.approx(-3.0), pytest.approx(2.0))
    assert rows["way", 8].refs == [10, 11, 99_999] and rows["way", 8].x is None
    for bounds, n in (({"kind": "way"}, 3), ({"x": (1.0, 1.5)}, 12), ({"kind": "node", "y": (50.0, 60.0)}, 0)):
        assert registered.load(spark, "osm_pbf", extract, by_blob, **bounds).count() == n
    whole = {(r.node_id, r.x, r.y) for r in binary.read_pbf(spark, extract)[0].collect()}
    assert whole == {(r.id, r.x, r.y) for r in rows.values() if r.kind == "node"}


def test_extract_as_features(spark, extract):
    out = {r.id: r for r in files.read(spark, extract).collect()}
    assert set(out) == {f"node/{1 + 100 * k}" for k in range(6)} | {"way/7", "way/8"}  # one node makes no line
    assert out["way/7"].geom.kind == "Polygon" and out["way/7"].layer == "buildings"
    assert [(round(p.x), round(p.y)) for p in out["way/8"].geom.parts[0][0]] == [(10, 10), (11, 11)]
    assert {r.id for r in files.read(spark, extract, Box(9.5, 9.5, 12, 12)).collect()} == {"way/8"}


def test_reader_leaves_out_what_bounds_exclude(extract):
    reader = registered.PbfReader({"path": extract, "kind": "node", "x_from": "1", "x_to": "2"})
    got = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert 0 < len(got) < 40 and all(r["kind"] == "node" and 1 <= r["x"] <= 2 for r in got)
    assert list(registered.PbfReader({"path": extract, "kind": "relation"}).read(reader.partitions()[0])) == [] and list(reader.read(None)) == []


# ---- vector tiles ------------------------------------------------------------------------


def directory(entries):
    ids = [e[0] for e in entries]
    return gzip.compress(packed([len(entries), *(b - a for a, b in zip([0, *ids], ids)), *(e[1] for e in entries), *(e[2] for e in entries), *(e[3] + 1 for e in entries)]))


def archive(path, zooms=(0, 1, 5), leaf=200, body=lambda z, x, y: b"%d/%d/%d" % (z, x, y)):
    """All tiles of the zooms, in leaves of so many entries; the last two tiles of all are one run."""
    tiles = sorted((binary.hilbert_id(z, x, y), z, x, y) for z in zooms for x in range(1 << z) for y in range(1 << z))
    data, entries = b"", []
    for number, z, x, y in tiles[:-1]:
        entries.append((number, 1, len(body(z, x, y)), len(data)))
        data += body(z, x, y)
    last = entries[-1]
    entries[-1] = (last[0], 2, last[2], last[3])
    leaves, root = b"", []
    for k in range(0, len(entries), leaf):
        own = directory(entries[k : k + leaf])
        root.append((entries[k][0], 0, len(own), len(leaves)))
        leaves += own
    top = directory(root)
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(top), 0, 0, 127 + len(top), len(leaves), 127 + len(top) + len(leaves), len(data))
    head = (head + b"\0" * 25 + bytes([2, 0, 0, min(zooms), max(zooms)])).ljust(127, b"\0")
    path.write_bytes(head + top + leaves + data)
    return str(path)


def test_numbers_and_stretches_of_tiles():
    for number in [*range(400), 10**6, 10**9 + 7]:
        assert binary.hilbert_id(*registered.tile_place(number)) == number
    for box in ((0, 31, 0, 31), (3, 9, 17, 18), (31, 31, 0, 0), (0, 0, 5, 31)):
        inside = {binary.hilbert_id(5, x, y) for x in range(box[0], box[1] + 1) for y in range(box[2], box[3] + 1)}
        assert {n for a, b in registered.stretches(5, *box) for n in range(a, b)} == inside
        assert inside <= {n for a, b in registered.stretches(5, *box, depth=2) for n in range(a, b)}


def test_archive_by_leaves(spark, tmp_path):
    path = archive(tmp_path / "a.pmtiles")
    of = lambda **bounds: registered.load(spark, "vector_tiles", path, **bounds)
    df = of()
    assert parts(df) == 6
    rows = {(r.z, r.x, r.y): bytes(r.data) for r in df.collect()}
    assert len(rows) == 1 + 4 + 1024
    z, x, y = registered.tile_place(max(binary.hilbert_id(*k) for k in rows))
    assert all(v == b"%d/%d/%d" % k for k, v in rows.items() if k != (z, x, y))
    near = of(z=5, x=(3, 4), y=(10, 11))
    assert parts(near) <= 2 and {(r.x, r.y) for r in near.collect()} == {(a, b) for a in (3, 4) for b in (10, 11)}
    assert parts(of(z=1)) == 1 and of(z=1).count() == 4 and of(z=3).count() == 0 and df.count() == len(rows)
    assert [registered.held_zoom(path, z) for z in (-1, 3, 14)] == [0, 3, 5]


def test_database_by_columns(spark, tmp_path):
    path = str(tmp_path / "a.mbtiles")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE tiles (zoom_level int, tile_column int, tile_row int, tile_data blob)")
        db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", [(z, x, (1 << z) - 1 - y, b"%d/%d/%d" % (z, x, y)) for z in (2, 6) for x in range(1 << z) for y in range(1 << z)])
    of = lambda **bounds: registered.load(spark, "vector_tiles", path, {"partition_tiles": 512}, **bounds)
    df = of()
    assert parts(df) == 1 + 8
    near = of(z=6, x=40, y=(3, 5))
    assert parts(near) == 1 and sorted(bytes(r.data) for r in near.collect()) == [b"6/40/3", b"6/40/4", b"6/40/5"]
    assert df.count() == 16 + 4096 and [registered.held_zoom(path, z) for z in (0, 4, 14)] == [2, 2, 6]


def test_tiles_as_features_of_a_box(spark, tmp_path):
    path = archive(tmp_path / "b.pmtiles", (0, 4), 30, lambda z, x, y: gzip.compress(tile()))
    every = files.read(spark, path)
    assert every.count() == 256
    box = Box(1, 1, 40, 30)
    x0, x1, y0, y1 = tile_range(box, 4)
    got = files.read(spark, path, box).collect()
    assert {tuple(map(int, r.id.split("/")[1:4])) for r in got} <= {(4, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)} and got
    want = [r.id for r in every.where((F.col("max_x") >= 1) & (F.col("min_x") <= 40) & (F.col("max_y") >= 1) & (F.col("min_y") <= 30)).collect()]
    assert sorted(r.id for r in got) == sorted(want)


# ---- rasters -----------------------------------------------------------------------------


def tiff(path, values, rows_a_strip, packing=1, predictor=1):
    """West 20, north 40, cells of 0.5 by 0.25 degrees."""
    kind = {"f": 3, "i": 2, "u": 1}[values.dtype.kind]
    strips = []
    for a in range(0, len(values), rows_a_strip):
        part = values[a : a + rows_a_strip]
        if predictor == 2:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1).astype(values.dtype)
        strips.append(zlib.compress(part.tobytes()) if packing != 1 else part.tobytes())
    data = b"".join(strips)
    at, n = 8 + len(data), len(strips)
    places = [8 + sum(map(len, strips[:k])) for k in range(n)]
    tags = [(256, 3, 1, values.shape[1]), (257, 3, 1, values.shape[0]), (258, 3, 1, values.dtype.itemsize * 8), (259, 3, 1, packing), (273, 4, n, None), (277, 3, 1, 1), (278, 3, 1, rows_a_strip), (279, 4, n, None), (317, 3, 1, predictor), (339, 3, 1, kind), (33550, 12, 3, None), (33922, 12, 6, None), (42113, 2, 6, None)]
    bodies = {273: struct.pack(f"<{n}I", *places), 279: struct.pack(f"<{n}I", *map(len, strips)), 33550: struct.pack("<3d", 0.5, 0.25, 0), 33922: struct.pack("<6d", 0, 0, 0, 20, 40, 0), 42113: b"-9999\0"}
    ifd, extra, place = struct.pack("<H", len(tags)), b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, count, value in tags:
        body = bodies.get(tag)
        if body is None or len(body) <= 4:
            ifd += struct.pack("<HHI", tag, kind, count) + (struct.pack("<I", value) if body is None else body.ljust(4, b"\0"))
        else:
            ifd += struct.pack("<HHII", tag, kind, count, place + len(extra))
            extra += body
    path.write_bytes(b"II" + struct.pack("<HI", 42, at) + data + ifd + b"\0" * 4 + extra)
    return str(path)


@pytest.mark.parametrize(("kind", "packing", "predictor"), [("<f4", 1, 1), ("<i2", 8, 2), ("<f8", 32946, 1)])
def test_raster_by_blocks(spark, tmp_path, kind, packing, predictor):
    values = (np.arange(70 * 30).reshape(70, 30) % 997).astype(kind)
    values[3, 4] = -9999
    path = tiff(tmp_path / "g.tif", values, 8, packing, predictor)
    of = lambda **bounds: registered.load(spark, "raster", path, {"partition_cells": 1}, **bounds)
    df = of()
    assert parts(df) == 9
    rows = {(r.row, r.col): r for r in df.collect()}
    assert len(rows) == 2100 and np.isnan(rows[3, 4].value) and all(r.value == values[k] for k, r in rows.items() if k != (3, 4))
    assert (rows[69, 29].lon, rows[69, 29].lat) == (20 + 29.5 * 0.5, 40 - 69.5 * 0.25)
    near = of(lat=(35.0, 37.9), lon=(21.0, 90.0))
    assert parts(near) == 2 and near.count() == sum(35 <= r.lat <= 37.9 and r.lon >= 21 for r in rows.values())
    whole, box = binary.geotiff((tmp_path / "g.tif").read_bytes())
    assert box == (20, 22.5, 35, 40) and np.array_equal(whole, np.where(values == -9999, np.nan, values.astype(float)), equal_nan=True)


# ---- folders -----------------------------------------------------------------------------


def test_folders_are_read_by_what_they_hold(spark, tmp_path):
    one = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"place": "town"}}
    (tmp_path / "j").mkdir()
    for k in "ab":
        (tmp_path / "j" / f"{k}.geojson").write_text(json.dumps(one))
    (tmp_path / "j" / "notes.txt").write_text("no features")
    assert files.sniff(str(tmp_path / "j")) == "geojson" and files.read(spark, str(tmp_path / "j")).count() == 2
    (tmp_path / "s" / "deep").mkdir(parents=True)
    assert files.sniff(str(tmp_path / "s")) == "unknown" and files.sniff(str(tmp_path / "nothing")) == "unknown"
    (tmp_path / "s" / "deep" / "x.shp").write_bytes(b"")
    assert files.sniff(str(tmp_path / "s")) == "shapefile" and files.sniff("a/b.osm.pbf") == "osm_pbf"
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path / "nothing"))


def test_no_files_no_rows(spark, tmp_path):
    for kind in ("osm_pbf", "vector_tiles", "raster"):
        assert registered.load(spark, kind, str(tmp_path)).count() == 0
