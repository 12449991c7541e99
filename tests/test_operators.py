import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isohypse.functions import geo, strings
from isohypse.operators import bands, joins, ordered, raster, vector
from isohypse.operators.chains import chained
from isohypse.sinks import geojson as sink


def cells(spark, grid, name="f"):
    rows = [(name, r, c, float(v)) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "field_id string, row int, col int, value double")


def test_rings_from_a_thousand_shuffled_fragments():
    at = lambda k: (100 * math.cos(k * 2 * math.pi / 1000), 100 * math.sin(k * 2 * math.pi / 1000)) if k % 1000 else (100.0, 0.0)
    parts = [[at(k), at(k + 1)] if k % 3 else [at(k + 1), at(k)] for k in range(1000)]
    random.Random(1).shuffle(parts)
    rings, loose = vector.assemble_rings([*parts, [(0.0, 0.0), (1.0, 1.0)]])
    assert len(rings) == 1 and len(rings[0]) == 1001 and len(loose) == 1


def test_faces_simplification_and_hulls(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    lines = vector.noded([square, [(2.0, -1.0), (2.0, 5.0)]])
    found = vector.faces(lines)
    assert sorted(abs(vector.signed_double_area(f[:-1])) / 2 for f in found) == [8.0, 8.0]
    assert vector.simplify([(0, 0), (1, 0.01), (2, 0), (2, 2)], 0.1) == [(0, 0), (2, 0), (2, 2)]
    x, y = vector.inner_point(square)
    assert 0 < x < 4 and 0 < y < 4
    points = spark.createDataFrame([("a", float(x % 7), float(x % 5)) for x in range(200)], "k string, x double, y double")
    (h,) = vector.hulls(points, ["k"]).collect()
    assert len(h.ring) == 5


def test_areas_of_a_cone_equal_the_disc(spark):
    axis = np.linspace(-1, 1, 61)
    cone = np.maximum(100 * (1 - np.hypot(*np.meshgrid(axis, axis))), 0)
    got = {r.level: r.area for r in raster.region_area(cells(spark, cone), [20.0, 50.0, 80.0]).collect()}
    for level, area in got.items():
        want = math.pi * ((1 - level / 100) * 30) ** 2
        assert area == pytest.approx(want, rel=0.01)


def test_regions_and_bands_as_polygons(spark):
    axis = np.linspace(-1, 1, 41)
    x, y = np.meshgrid(axis, axis)
    hill = 100 * np.exp(-8 * (np.hypot(x, y) - 0.5) ** 2) - 60 * np.exp(-8 * ((x - 0.7) ** 2 + (y + 0.7) ** 2))  # a ring with a hollow
    hill[[0, -1], :] = hill[:, [0, -1]] = -50
    f, levels = cells(spark, hill).cache(), [20.0, 50.0, 80.0]
    total = lambda rings: abs(sum((1 if k == 0 else -1) * abs(vector.signed_double_area([(p.x, p.y) for p in r][:-1])) / 2 for k, r in enumerate(rings)))
    areas = {r.level: r.area for r in raster.region_area(f, levels).collect()}
    got = {}
    for r in bands.regions(f, levels, 41, 41).collect():
        got[r.level] = got.get(r.level, 0) + total(r.rings)
        assert len(r.rings) >= 1
    assert got == pytest.approx(areas, abs=1e-6)
    made = {}
    for r in bands.bands(f, levels, 41, 41).collect():
        made[r.low] = made.get(r.low, 0) + total(r.rings)
    want = {20.0: areas[20.0] - areas[50.0], 50.0: areas[50.0] - areas[80.0], 80.0: areas[80.0]}
    assert made == pytest.approx(want, abs=1e-6)


def test_contours_close_and_saddles_follow_the_centre(spark):
    axis = np.linspace(-1, 1, 21)
    bowl = np.hypot(*np.meshgrid(axis, axis))
    chains = raster.stitch(raster.contour_segments(cells(spark, bowl), [0.5])).collect()
    assert len(chains) == 1 and chains[0].closed
    assert all(abs(math.hypot(p.r - 10, p.c - 10) - 5) < 0.1 for p in chains[0].points)
    for low, buckets in ((-0.5, {12, 13}), (-3.0, {14, 15})):
        found = raster.contour_segments(cells(spark, [[1, low], [low, 1]]), [0.0]).collect()
        assert {s.bucket for s in found} == buckets
    assert raster.contour_segments(cells(spark, [[0, 0], [0, 1]]), [0.0]).count() == 1
    assert raster.contour_segments(cells(spark, [[5, 5], [5, 5]]), [0.0]).count() == 0


def test_chains_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(5)
    grid = np.add.outer(np.sin(np.arange(30) / 3), np.cos(np.arange(25) / 4)) + rng.normal(0, 0.3, (30, 25))
    segments = raster.contour_segments(cells(spark, grid), [0.0, 0.7]).cache()
    links = {(s.level, frozenset(((s.r0, s.c0), (s.r1, s.c1)))) for s in segments.collect()}
    seen = []
    for tile in (1, 7, 1000):
        chains = raster.stitch(segments, tile).collect()
        walked = [(c.level, frozenset(((p.r, p.c), (q.r, q.c)))) for c in chains for p, q in zip(c.points, c.points[1:])]
        assert len(walked) == len(links) and set(walked) == links
        assert all(((c.points[0].r, c.points[0].c) == (c.points[-1].r, c.points[-1].c)) == c.closed for c in chains)
        seen.append(sorted((c.level, c.closed, len(c.points)) for c in chains))
    assert seen[0] == seen[1] == seen[2]


def test_pieces_are_ordered_as_by_hand():
    first, last = np.array([1, 3, 2]), np.array([2, 4, 1])  # a loop 1-2-1 and a line 3-4
    chain, place, turned, closed = chained(first, last)
    assert (chain.tolist(), place.tolist(), closed.tolist()) == ([0, 1, 0], [0, 0, 1], [True, False, True])
    first, last = np.array([4, 2, 3]), np.array([3, 1, 2])  # 4-3, 3-2, 2-1
    chain, place, turned, closed = chained(first, last)
    assert (chain.tolist(), place.tolist(), turned.tolist(), closed.any()) == ([0, 0, 0], [0, 2, 1], [False, False, False], False)


def test_smoothing_divides_after_all_passes(spark):
    rng = np.random.default_rng(6)
    grid = rng.normal(0, 1, (7, 6))
    grid[2, 3] = grid[5, 0] = np.nan

    def blurred(g):
        p = np.pad(g, 1, mode="edge")
        return sum(p[i : i + 7, j : j + 6] for i in range(3) for j in range(3)) / 9

    v, k = np.nan_to_num(grid), (~np.isnan(grid)).astype(float)
    for _ in range(3):
        v, k = blurred(v), blurred(k)
    got = {(r.row, r.col): r.value for r in raster.smooth(cells(spark, grid), 3).collect()}
    for (r, c), value in got.items():
        assert math.isnan(value) if np.isnan(grid[r, c]) else value == pytest.approx(v[r, c] / k[r, c])


def test_hillshade_of_planes(spark):
    flat = raster.hillshade(cells(spark, np.zeros((4, 4))), 10.0).collect()
    assert all(r.value == pytest.approx(math.sin(math.radians(45))) for r in flat)
    hole = np.zeros((4, 4))
    hole[1, 1] = np.nan
    got = {(r.row, r.col): r.value for r in raster.hillshade(cells(spark, hole), 10.0).collect()}
    assert math.isnan(got[1, 1]) and not math.isnan(got[0, 0])


def test_padding_blend_and_noise(spark):
    p = {(r.row, r.col): r.value for r in raster.pad(cells(spark, [[1, np.nan], [3, 4]]), 2, 2, -9.0).collect()}
    assert len(p) == 16 and p[1, 2] == -9.0 and p[1, 1] == 1.0 and p[0, 0] == -9.0
    base, fine = cells(spark, [[-10, 5], [np.nan, -10]]), cells(spark, np.full((4, 4), -20.0))
    b = {(r.row, r.col): r.value for r in raster.blend(base, fine, 2, 2, 4, 4).collect()}
    assert b[0, 0] == -20 and b[0, 1] == 5 and b[1, 0] == -20
    n = [r.value for r in raster.noise_grid(spark, 20, 20, 3).collect()]
    assert all(0 <= v <= 1 for v in n) and len(set(n)) > 100
    assert n == [r.value for r in raster.noise_grid(spark, 20, 20, 3).collect()]


def test_streamlines_keep_their_distance(spark):
    rows = [("f", r, c, 1.0, 0.0) for r in range(12) for c in range(12)]
    lines = raster.streamlines(spark.createDataFrame(rows, "field_id string, row int, col int, u double, v double")).collect()
    assert len({r.line for r in lines}) >= 5 and all(abs(r.r - round(r.r)) < 1e-9 for r in lines)


def test_rings_points_and_clipping(spark):
    square = "cast(array(struct(0D, 0D), struct(4D, 0D), struct(4D, 4D), struct(0D, 4D), struct(0D, 0D)) as array<struct<x:double,y:double>>)"
    row = spark.range(1).select(
        geo.point_in_ring(F.lit(1.0), F.lit(1.0), F.expr(square)).alias("inside"),
        geo.point_in_ring(F.lit(5.0), F.lit(1.0), F.expr(square)).alias("outside"),
        geo.signed_double_area(F.expr(square)).alias("area"),
        geo.signed_double_area(geo.clip_ring(F.expr(square), geo.Box(1, 1, 10, 10))).alias("clipped"),
        geo.centroid(F.expr(square)).alias("centre"),
        F.size(geo.densify_line(F.expr(square), 1.0)).alias("dense"),
        geo.nice_interval(F.lit(1000.0), 44).alias("step"),
        geo.contour_levels(F.lit(-10.0), F.lit(20.0), 10.0).alias("levels"),
        geo.normal_bearing(F.lit(-190.0)).alias("bearing"),
    ).first()
    assert row.inside and not row.outside and (row.area, row.clipped) == (32.0, 18.0)
    assert (row.centre.x, row.dense, row.step, row.levels, row.bearing) == (2.0, 17, 20.0, [0.0, 10.0], 170.0)


def test_strings(spark):
    texts = ["41.9, 12.5", "120 35", "-20, 30, 45, 70", "somewhere", "1 2 3", "0 0 181 1 2"]
    got = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strings.parse_coordinates(F.col("t")).alias("p")).collect()]
    assert [g and tuple(g) for g in got] == [("point", 41.9, 12.5, None, None), ("point", 35.0, 120.0, None, None), ("box", -20.0, 30.0, 45.0, 70.0), None, None, None]
    row = spark.range(1).select(strings.compact_number(F.lit(-0.0000001)).alias("a"), strings.compact_number(F.lit(1.50)).alias("b"), strings.compact_number(F.lit(100.0)).alias("c"), strings.compact_number(F.lit(float("nan"))).alias("d"), strings.thousands(F.lit(1234567)).alias("e"), strings.fold_name(F.lit("Évora")).alias("f"), strings.quadrant(F.lit("South East")).alias("g"), strings.split_last_dot(F.lit("a.b.c")).alias("h")).first()
    assert tuple(row)[:7] == ("0", "1.5", "100", "0", "1 234 567", "evora", "south") and tuple(row.h) == ("a.b", "c")


def test_geojson_is_wound_and_read_back(spark, tmp_path):
    from isohypse.sources import geojson

    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    shell, hole = ring((0, 0), (0, 4), (4, 4), (4, 0), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 1))
    rows = [("a", "parks", {"kind": "Polygon", "parts": [[shell, hole]]}, {"name": 'x"y'}), ("b", "roads", {"kind": "MultiLineString", "parts": [[ring((0, 0), (1, 1))], [ring((0, float("nan")), (1, 1))]]}, None), ("c", "roads", {"kind": "LineString", "parts": [[ring((float("inf"), 0), (1, 1))]]}, {})]
    f = spark.createDataFrame(rows, "id string, layer string, geom struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>, props map<string,string>")
    out = {r.id: r.json for r in sink.feature_rows(f).collect()}
    assert set(out) == {"a", "b"} and '"LineString"' in out["b"] and "[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,2],[2,1],[1,1]]]" in out["a"]
    sink.write_collection(f, str(tmp_path / "one"), {"crs": "EPSG:4326"})
    assert geojson.read(spark, str(tmp_path / "one")).count() == 2
    sink.write_layers(f, str(tmp_path / "many"))
    assert sorted(p.name for p in (tmp_path / "many").glob("layer=*")) == ["layer=parks", "layer=roads"]
    assert sink.svg_paths(f).count() == 3


def test_greedy_labels_and_place_merge(spark):
    rows = [(1, "a", "one", 0.0, 0.0, 0.0, 10.0, 4.0, 0.0), (1, "a", "two", 1.0, 5.0, 0.0, 10.0, 4.0, 0.0), (1, "b", "three", 2.0, 40.0, 0.0, 10.0, 4.0, 45.0), (1, "a", "four", 3.0, 100.0, 0.0, 10.0, 4.0, 0.0)]
    labels = spark.createDataFrame(rows, "sheet int, layer string, name string, rank double, x double, y double, width double, height double, angle double")
    assert sorted(r.name for r in ordered.thin_labels(labels).collect()) == ["four", "one", "three"]
    limits = spark.createDataFrame([("a", 1)], "layer string, limit int")
    assert sorted(r.name for r in ordered.thin_labels(labels, limits).collect()) == ["one", "three"]
    places = spark.createDataFrame([("q", k, n, x, y) for k, (n, x, y) in enumerate([("Évora", 0.0, 0.0), ("evora", 0.4, 0.4), ("evora", 0.6, 0.0), ("Rome", 0.1, 0.1)])], "query string, rank int, name string, x double, y double")
    assert sorted(r["rank"] for r in joins.merge_places(places).collect()) == [0, 2, 3]


def test_progress_stream(spark, tmp_path):
    from isohypse.streaming import progress

    rows = [("a", 1.0, "running"), ("a", 3.0, "done"), ("a", 4.0, "running"), ("b", 2.0, "running"), ("b", 5.0, "failed")]
    spark.createDataFrame(rows, "source string, at double, state string").coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("source string, at double, state string").parquet(str(tmp_path / "in"))
    q = progress.states(events).writeStream.format("memory").queryName("progress").outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.source: (r.state, r.started, r.finished) for r in spark.table("progress").collect()}
    assert got == {"a": ("done", 1.0, 3.0), "b": ("failed", 2.0, 5.0)}
