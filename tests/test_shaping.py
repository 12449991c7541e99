"""Clipping, projecting and buffering against areas and lengths that are known."""

import math

import pytest
from pyspark.sql import functions as F

from isohypse.functions import geo
from isohypse.functions.geo import Box
from isohypse.operators import overlay, shaping
from isohypse.sources.model import GEOMETRY, with_extent

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(3, 3), (3, 7), (7, 7), (7, 3), (3, 3)]
COMB = [(-5, 0), (5, 0), (5, 9), (4, 9), (4, 2), (1, 2), (1, 9), (-5, 9), (-5, 0)]
SHAPES = {
    "in": ("Polygon", [[[(1, 1), (2, 1), (2, 2), (1, 1)]]]),
    "out": ("Polygon", [[[(50, 50), (51, 50), (51, 51), (50, 50)]]]),
    "ring": ("Polygon", [[SQUARE, HOLE]]),
    "comb": ("Polygon", [[COMB]]),
    "line": ("LineString", [[[(-2, 5), (2, 5), (2, 20), (6, 20), (6, 5), (30, 5)]]]),
    "around": ("LineString", [[[(-5, -5), (-5, 40), (40, 40)]]]),
    "inside": ("LineString", [[[(1, 1), (2, 5)]]]),
    "many": ("MultiLineString", [[[(-3, 1), (3, 1)]], [[(-3, 2), (-1, 2)]]]),
    "points": ("MultiPoint", [[[(1, 1)]], [[(8, 8)]], [[(11, 1)]]]),
    "corner": ("Point", [[[(8, 8)]]]),
}


def features(spark, names):
    rows = [(k, "roads", SHAPES[k][0], [[[{"x": float(x), "y": float(y)} for x, y in line] for line in part] for part in SHAPES[k][1]]) for k in names]
    df = spark.createDataFrame(rows, "id string, layer string, kind string, parts array<array<array<struct<x:double,y:double>>>>")
    return with_extent(df.select("id", "layer", F.struct("kind", "parts").cast(GEOMETRY).alias("geom")))


def length(parts):
    return sum(math.dist((a.x, a.y), (b.x, b.y)) for p in parts for a, b in zip(p[0], p[0][1:]))


def area(parts):
    one = lambda r: abs(sum(a.x * b.y - b.x * a.y for a, b in zip(r, r[1:]))) / 2
    return sum(one(p[0]) - sum(map(one, p[1:])) for p in parts)


def test_clipping_by_kind(spark):
    before = features(spark, SHAPES)
    after = shaping.clipped(before, Box(0, 0, 8, 8))
    out = {r.id: r for r in after.collect()}
    assert set(out) == {"in", "ring", "comb", "line", "inside", "many", "points", "corner"}
    assert {k for k, r in out.items() if not r.cut} == {"in", "inside", "corner"}
    assert area(out["ring"].geom.parts) == pytest.approx(64 - 16) and len(out["ring"].geom.parts[0]) == 2
    assert area(out["comb"].geom.parts) == pytest.approx(5 * 2 + 1 * 6 + 1 * 6)
    line = out["line"].geom
    assert (line.kind, len(line.parts), length(line.parts)) == ("MultiLineString", 2, pytest.approx(2 + 3 + 3 + 2))
    assert [(p.x, p.y) for p in line.parts[0][0]] == [(0, 5), (2, 5), (2, 8)] and [(p.x, p.y) for p in line.parts[1][0]] == [(6, 8), (6, 5), (8, 5)]
    assert (out["many"].geom.kind, length(out["many"].geom.parts)) == ("LineString", 3.0)
    assert (out["points"].geom.kind, len(out["points"].geom.parts)) == ("MultiPoint", 2) and out["points"].max_x == 8.0
    assert tuple(shaping.clip_counts(before, after).first()) == (5, 2)
    assert shaping.clipped(before.limit(0), Box(0, 0, 8, 8)).count() == 0


def test_projecting_with_and_without_new_vertices(spark):
    own = features(spark, ["line", "ring"])
    flat = {r.id: r for r in shaping.projected(own, "web_mercator").collect()}
    assert len(flat["line"].geom.parts[0][0]) == 6 and flat["line"].max_x == pytest.approx(30 * math.pi / 180 * geo.EARTH_RADIUS)
    round_ = {r.id: r for r in shaping.projected(own, "equal_earth", step=1.0).collect()}
    assert len(round_["line"].geom.parts[0][0]) == 4 + 15 + 4 + 15 + 24 + 1 and len(round_["ring"].geom.parts[0]) == 2
    there = spark.range(1).select(geo.project(F.lit(10.0), F.lit(10.0), "equal_earth").alias("p")).first().p
    assert (round_["ring"].max_x, round_["ring"].max_y) == (pytest.approx(there.x, rel=0.02), pytest.approx(there.y))


def polygon(n, d):
    return n / 2 * math.sin(2 * math.pi / n) * d * d


def test_buffers_of_points_lines_and_polygons(spark):
    own = features(spark, ["corner", "points", "inside", "line", "ring", "in"])
    got = {r.id: area(r.parts) for r in shaping.buffered(own, 1.0).collect()}
    circle = polygon(32, 1.0)
    assert got["corner"] == pytest.approx(circle) and got["points"] == pytest.approx(3 * circle)
    assert got["inside"] == pytest.approx(2 * math.hypot(1, 4) + math.pi, rel=0.01)
    assert got["ring"] == pytest.approx(100 - 16 + 40 + 12 + circle, rel=1e-6)  # the hole loses a border of one, to 2 by 2
    long = 4 + 15 + 4 + 15 + 24
    assert got["line"] == pytest.approx(2 * long + circle - 4 * (1 - math.pi / 4), rel=0.005)  # four right turns


def test_negative_buffers(spark):
    got = {r.id: r.parts for r in shaping.buffered(features(spark, ["ring", "in", "line"]), -1.0).collect()}
    assert set(got) == {"ring"} and len(got["ring"]) == 1
    assert area(got["ring"]) == pytest.approx(64 - (16 + 16 + polygon(32, 1.0)), rel=1e-6)
    assert {r.id for r in shaping.buffered(features(spark, ["ring", "line"]), 0.0).collect()} == {"ring"}


def test_overlays_of_parts_with_rings_of_different_lengths(spark):
    """Two parts of one ring each, of four and of six vertices."""
    other = [[[(20, 0), (22, 0), (23, 1), (22, 2), (20, 2), (20, 0)]], [[(30, 0), (31, 0), (30, 1), (30, 0)]]]
    SHAPES["two"] = ("MultiPolygon", other)
    own = features(spark, ["two"]).select("id", F.col("geom.parts").alias("parts"))
    both = own.select(overlay.overlay_column("difference")("parts", "parts").alias("none"), overlay.overlay_column("union")("parts", "parts").alias("all"), overlay.predicate_column("covers")("parts", "parts").alias("covers"), overlay.valid_column("parts").alias("valid")).first()
    assert both.none == [] and area(both["all"]) == pytest.approx(5 + 0.5) and both.covers and both.valid
    (joined,) = overlay.dissolve(own.unionByName(own), ["id"]).collect()
    assert area(joined.parts) == pytest.approx(5.5) and len(joined.parts) == 2
