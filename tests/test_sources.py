"""Readers, fed with bytes that the tests write."""

import gzip
import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohypse.functions.geo import Box
from isohypse.operators import joins, orbits, vector
from isohypse.sources import binary, files, geojson, texts


def varint(v):
    out = b""
    while v > 127:
        out += bytes([v & 127 | 128])
        v >>= 7
    return out + bytes([v])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def zz(v):
    return v << 1 if v >= 0 else (-v << 1) - 1


def packed(values):
    return b"".join(varint(v) for v in values)


SQUARE = [[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]]


def test_geojson(spark, tmp_path):
    feature = lambda geometry, **props: {"type": "Feature", "geometry": geometry, "properties": props}
    rows = [
        feature({"type": "Polygon", "coordinates": [SQUARE, [[1, 1], [2, 1], [2, 2], [1, 1]]]}, building="yes"),
        feature({"type": "MultiLineString", "coordinates": [[[0, 0, 7], [1, 1, 8]]]}, highway="primary"),
        feature({"type": "Point", "coordinates": [50, 50]}, place="town", NAME="Far"),
        feature(None, name="none"),
        feature({"type": "LineString", "coordinates": [[1, 1]]}),
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": rows}))
    out = {r.layer: r for r in files.read(spark, str(tmp_path / "a.geojson")).collect()}
    assert set(out) == {"buildings", "roads", "places"}
    assert out["roads"].geom.kind == "LineString" and len(out["buildings"].geom.parts[0]) == 2
    assert (out["buildings"].max_x, out["places"].name) == (4.0, "Far")
    near = files.read(spark, str(tmp_path / "a.geojson"), Box(-1, -1, 5, 5))
    assert near.count() == 2
    (tmp_path / "b.ndjson").write_text("\n".join([json.dumps(rows[0]), "{broken", json.dumps(rows[2])]))
    assert geojson.read_lines(spark, str(tmp_path / "b.ndjson")).count() == 2


def test_shapefile_with_table(spark, tmp_path):
    def record(k, body):
        return struct.pack(">2i", k, len(body) // 2) + body

    hole = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    points = SQUARE + hole
    polygon = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, len(points), 0, len(SQUARE)) + b"".join(struct.pack("<2d", *p) for p in points)
    body = record(1, struct.pack("<i", 0)) + record(2, polygon)
    (tmp_path / "s.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + b"\0" * 72 + body)
    fields = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([w, 0]) + b"\0" * 14 for n, k, w in ((b"name", b"C", 8), (b"pop", b"N", 6), (b"ok", b"L", 1)))
    rows = b" " + b"first".ljust(8) + b"   1.0" + b"T" + b" " + b"second".ljust(8) + b"  2.50" + b"n"
    (tmp_path / "s.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 2, 33 + len(fields), 16) + b"\0" * 20 + fields + b"\r" + rows)
    (row,) = binary.read_shapefiles(spark, str(tmp_path)).collect()
    assert row.geom.kind == "Polygon" and len(row.geom.parts[0]) == 2
    assert row.props == {"name": "second", "pop": "2.5", "ok": "false"} and row.id.endswith("/1")


def test_pbf_ways_are_assembled_by_a_join(spark, tmp_path):
    strings = b"".join(field(1, s) for s in (b"", b"place", b"city", b"building", b"yes"))
    ids, lats, lons = [1, 2, 3, 4], [380000000, 380000000, 380010000, 380010000], [230000000, 230010000, 230010000, 230000000]
    delta = lambda v: packed([zz(b - a) for a, b in zip([0, *v], v)])
    dense = field(1, delta(ids)) + field(8, delta(lats)) + field(9, delta(lons)) + field(10, packed([1, 2, 0, 0, 0, 0]))
    way = field(1, 100) + field(2, packed([3])) + field(3, packed([4])) + field(8, delta([2, 3, 4, 99, 2]))
    block = field(1, strings) + field(2, field(2, dense)) + field(2, field(3, way))
    blob = field(3, zlib.compress(block))
    head = field(1, b"OSMData") + field(3, len(blob))
    (tmp_path / "m.pbf").write_bytes(struct.pack(">I", len(head)) + head + blob + b"\0\0\0\x05junk")
    nodes, ways = binary.read_pbf(spark, str(tmp_path / "m.pbf"))
    by = {r.node_id: r for r in nodes.collect()}
    assert by[1].tags == {"place": "city"} and by[3].y == pytest.approx(38.001) and by[2].x == pytest.approx(23.001)
    refs = ways.select("way_id", F.posexplode("refs").alias("pos", "node_id"))
    (w,) = joins.assemble_ways(refs, nodes.select("node_id", "x", "y"), "pos").collect()
    assert len(w.line) == 4 and w.line[0] == w.line[-1]  # node 99 isn't there


def tile():
    move = lambda c, n: c | n << 3
    ring = [move(1, 1), zz(2000), zz(2000), move(2, 3), zz(100), 0, 0, zz(100), zz(-100), 0, move(7, 1)]
    feature = field(2, packed([0, 0])) + field(3, 3) + field(4, packed(ring))
    layer = field(1, b"buildings") + field(2, feature) + field(3, b"building") + field(4, field(1, b"yes")) + field(5, 4096)
    return field(3, layer)


def test_vector_tiles_in_both_archives(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.mbtiles") as db:
        db.execute("CREATE TABLE tiles (zoom_level int, tile_column int, tile_row int, tile_data blob)")
        db.execute("INSERT INTO tiles VALUES (14, 9270, ?, ?)", ((1 << 14) - 1 - 6317, gzip.compress(tile())))
    tiles = binary.mbtiles(spark, str(tmp_path / "a.mbtiles"), 14)
    (row,) = binary.tile_features(tiles).collect()
    assert row.layer == "buildings" and row.geom.kind == "Polygon" and row.props["building"] == "yes"
    x, y = row.geom.parts[0][0][0]
    assert x == pytest.approx((9270 + 2000 / 4096) / (1 << 14) * 360 - 180)

    own = {binary.hilbert_id(3, 1, 2): b"one", binary.hilbert_id(3, 5, 5): b"two"}
    entries = sorted(own)
    data = b"".join(own[t] for t in entries)
    deltas = [entries[0], entries[1] - entries[0]]
    root = gzip.compress(packed([2, *deltas, 1, 1, 3, 3, 1, 0]))
    head = b"PMTiles\x03" + struct.pack("<8Q", 127, len(root), 0, 0, 0, 0, 127 + len(root), len(data))
    archive = (head + b"\0" * 25 + bytes([2]) + b"\0" * 2).ljust(127, b"\0") + root + data
    p = binary.PMTiles(lambda at, n: archive[at : at + n])
    assert p.tile(3, 1, 2) == b"one" and p.tile(3, 5, 5) == b"two" and p.tile(3, 0, 0) is None


def test_hilbert_ids_are_a_permutation_with_unit_steps():
    cells = sorted((binary.hilbert_id(4, x, y), x, y) for x in range(16) for y in range(16))
    assert [c[0] for c in cells] == list(range(85, 85 + 256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(cells, cells[1:]))


def test_geotiff_and_png(spark, tmp_path):
    values = np.array([[1, 2, 3], [4, -9999, 6]], "<f4")
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 1, 24), (339, 3, 1, 3)]
    at = 8 + 24
    extra = struct.pack("<3d", 0.5, 0.25, 0) + struct.pack("<6d", 0, 0, 0, 20, 40, 0) + b"-9999\0"
    ifd = struct.pack("<H", len(tags) + 3) + b"".join(struct.pack("<HHII", *t) for t in tags)
    place = at + len(ifd) + 36 + 4
    ifd += struct.pack("<HHII", 33550, 12, 3, place) + struct.pack("<HHII", 33922, 12, 6, place + 24) + struct.pack("<HHII", 42113, 2, 6, place + 72) + b"\0" * 4
    (tmp_path / "g.tif").write_bytes(b"II" + struct.pack("<HI", 42, at) + values.tobytes() + ifd + extra)
    grid, box = binary.geotiff((tmp_path / "g.tif").read_bytes())
    assert box == (20, 39.5, 21.5, 40) and np.isnan(grid[1, 1]) and grid[1, 2] == 6
    assert binary.read_rasters(spark, str(tmp_path / "g.tif")).count() == 6

    pixels = np.array([[[128, 10, 128], [127, 255, 0]], [[128, 0, 0], [129, 1, 64]]], np.uint8)
    rows = b"\0" + pixels[0].tobytes() + b"\2" + (pixels[1].astype(int) - pixels[0]).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0" * 4
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert binary.terrarium(png).tolist() == [[10.5, -1.0], [0.0, 257.25]]


def test_gridded_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text("time,latitude,longitude,u,v\nUTC,degrees_north,degrees_east,m,m\n" + "\n".join(f"2020-01-01T00:00:00Z,{la},{lo},{la + lo},{'NaN' if lo == 2 else 1}" for la in (10, 11) for lo in (1, 2) if (la, lo) != (11, 1)))
    cells = {(r.row, r.col): r for r in texts.read_grid(spark, str(tmp_path / "g.csv"), "u", "v").collect()}
    assert len(cells) == 4 and cells[1, 0].u == 11.0 and np.isnan(cells[0, 0].u) and np.isnan(cells[0, 1].v) and cells[0, 1].u == 13.0


TLE = """ISS (ZARYA)
1 25544U 98067A   24001.50000000  .00016717  00000-0  10270-3 0  9009
2 25544  51.6320 247.4627 0006703 130.5360 325.0288 15.49220842    18
broken line
1 43013U 17073A   24001.25000000  .00000000  00000-0  00000-0 0  9991
2 43013  98.7000 100.0000 0001000  90.0000 270.0000 14.19500000    17
"""


def test_orbits(spark, tmp_path):
    (tmp_path / "t.txt").write_text(TLE)
    e = texts.elements(texts.element_sets(spark, str(tmp_path / "t.txt")))
    by = {r.number: r for r in e.collect()}
    assert set(by) == {"25544", "43013"} and by["25544"].name == "ISS (ZARYA)" and by["25544"].epoch == 1704110400.0
    track = orbits.ground_tracks(e, 1704110400.0, 60.0, 92).where("name LIKE 'ISS%'").collect()
    assert max(abs(r.lat) for r in track) == pytest.approx(51.6, abs=0.5)
    assert all(400 < r.altitude < 440 for r in track) and max(r.run for r in track) >= 1


def test_events_and_map_elements(spark, tmp_path):
    f = lambda i, mag, depth: {"id": i, "geometry": {"coordinates": [20, 35, *([depth] if depth is not None else [])]}, "properties": {"mag": mag, "place": "x", "time": 1700000000000}}
    (tmp_path / "e.json").write_text(json.dumps({"features": [f("a", 5.0, 12), f("b", 3.0, 150), f("c", 4.2, 420), f("d", None, 1), f("e", 2.0, None)]}))
    out = {r.id: r for r in texts.read_events(spark, str(tmp_path / "e.json"), 10.0).collect()}
    assert {k: r.layer for k, r in out.items()} == {"a": "earthquakes_shallow", "b": "earthquakes_intermediate", "c": "earthquakes_deep", "e": "earthquakes_shallow"}
    assert out["a"].props["name"] == "M5.0" and "name" not in out["b"].props

    ring = [{"lat": y, "lon": x} for x, y in SQUARE]
    members = [{"type": "way", "ref": 1, "role": "outer", "geometry": ring[:3]}, {"type": "way", "ref": 2, "role": "", "geometry": ring[2:][::-1]}, {"type": "way", "ref": 3, "role": "inner", "geometry": [{"lat": y, "lon": x} for x, y in [[1, 1], [2, 1], [2, 2], [1, 1]]]}]
    elements = [
        {"type": "node", "id": 1, "lat": 1, "lon": 2, "tags": {"place": "city", "name": "A"}},
        {"type": "way", "id": 2, "tags": {"highway": "primary"}, "geometry": ring},
        {"type": "way", "id": 3, "tags": {"building": "yes"}, "geometry": ring},
        {"type": "way", "id": 4, "tags": {"building": "yes"}},
        {"type": "relation", "id": 5, "tags": {"natural": "water"}, "members": members},
    ]
    (tmp_path / "o.json").write_text(json.dumps({"elements": elements}))
    e = texts.read_map_elements(spark, str(tmp_path / "o.json"))
    assert {r.id: r.geom.kind for r in texts.map_features(e).collect()} == {"node/1": "Point", "way/2": "LineString", "way/3": "Polygon"}
    (r,) = vector.assemble_relations(e).collect()
    assert r.geom.kind == "Polygon" and len(r.geom.parts[0]) == 2 and len(r.geom.parts[0][0]) == 5


def test_places_and_manifests(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"name": "Rome", "display_name": "Rome, Lazio, Italy", "category": "boundary", "boundingbox": ["41.8", "41.8", "12.4", "12.5"]}, {"name": "", "display_name": "Via, Rome", "category": "highway", "boundingbox": ["1", "x", "3", "4"]}]))
    (r,) = texts.read_places(spark, str(tmp_path / "p.json")).collect()
    assert (r.name, r.detail, r.is_boundary) == ("Rome", "Lazio, Italy", True) and r.max_lat - r.min_lat == pytest.approx(0.002)
    assert texts.read_places(spark, str(tmp_path / "p.json"), "a").count() == 0
    for k, body in (("x", '{"id": "one", "name": "One"}'), ("y", "{broken")):
        (tmp_path / "plug" / k).mkdir(parents=True)
        (tmp_path / "plug" / k / "plugin.json").write_text(body)
    good, notes = texts.read_manifests(spark, str(tmp_path / "plug" / "*" / "plugin.json"))
    assert [r.id for r in good.collect()] == ["one"] and notes.count() == 1
