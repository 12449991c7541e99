import pytest
from pyspark.sql import functions as F

from isohypse.operators import overlay as O
from isohypse.sources.binary import signed_double_area


def box(x, y, w, h):
    return [[[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]]


def size(polygons):
    return sum(abs(signed_double_area(p[0][:-1])) / 2 - sum(abs(signed_double_area(h[:-1])) / 2 for h in p[1:]) for p in polygons)


@pytest.mark.parametrize(
    ("a", "b", "both", "one"),
    [
        (box(0.0, 0.0, 4.0, 4.0), box(2.0, 1.0, 4.0, 4.0), 6.0, 26.0),
        (box(0.0, 0.0, 4.0, 4.0), box(1.0, 1.0, 2.0, 2.0), 4.0, 16.0),
        (box(0.0, 0.0, 4.0, 4.0), box(4.0, 0.0, 4.0, 4.0), 0.0, 32.0),
        (box(0.0, 0.0, 4.0, 4.0), box(9.0, 9.0, 1.0, 1.0), 0.0, 17.0),
        (box(0.0, 0.0, 4.0, 4.0), box(0.0, 0.0, 4.0, 4.0), 16.0, 16.0),
        (box(0.0, 0.0, 4.0, 4.0), [[[(2.0, -2.0), (6.0, 2.0), (2.0, 6.0), (-2.0, 2.0), (2.0, -2.0)]]], 16.0, 32.0),
    ],
)
def test_areas(a, b, both, one):
    assert size(O.overlay(a, b, "intersection")) == pytest.approx(both)
    assert size(O.overlay(a, b, "union")) == pytest.approx(one)
    assert size(O.overlay(a, b, "difference")) == pytest.approx(size(a) - both)


def test_a_hole_is_cut_and_filled():
    ring = O.overlay(box(0.0, 0.0, 4.0, 4.0), box(1.0, 1.0, 2.0, 2.0), "difference")
    assert len(ring) == 1 and len(ring[0]) == 2
    assert size(O.overlay(ring, box(1.0, 1.0, 2.0, 2.0), "union")) == pytest.approx(16.0)
    assert size(O.union_all([box(float(k), 0.0, 1.5, 1.0) for k in range(7)])) == pytest.approx(7.5)


def test_predicates():
    big, small = box(0.0, 0.0, 4.0, 4.0), box(0.0, 1.0, 2.0, 2.0)
    assert O.covers(big, small) and O.contains(big, small) and not O.covers(small, big)
    assert O.intersects(big, box(4.0, 4.0, 1.0, 1.0)) and not O.intersects(big, box(4.1, 4.0, 1.0, 1.0))
    bow = [[[(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]]]
    assert O.is_valid(big) and not O.is_valid(bow) and size(O.repaired(bow)) == pytest.approx(2.0)
    assert O.distance([[(0.0, 0.0), (0.0, 2.0)]], [[(3.0, 1.0)]]) == pytest.approx(3.0)


def test_columns_and_dissolving(spark):
    parts = lambda p: [[[{"x": x, "y": y} for x, y in r] for r in poly] for poly in p]
    kind = "array<array<array<struct<x:double,y:double>>>>"
    rows = [(k, k % 2, parts(box(float(k), 0.0, 2.0, 1.0)), float(k), 0.0, k + 2.0, 1.0) for k in range(6)]
    f = spark.createDataFrame(rows, f"id bigint, g int, parts {kind}, min_x double, min_y double, max_x double, max_y double")
    assert {r.g: sum(len(p) for p in r.parts) for r in O.dissolve(f, ["g"]).collect()} == {0: 1, 1: 1}
    cover = f.where("id = 2").withColumn("id", F.col("id") + 100)
    left = {r.id: r.parts for r in O.clearing(f, cover, 1.0).collect()}
    assert set(left) == {0, 1, 3, 4, 5} and max(p.x for p in left[1][0][0]) == 2.0
    both = f.crossJoin(f.where("id = 0").select(F.col("parts").alias("other"))).select("id", O.predicate_column("intersects")("parts", "other").alias("x")).collect()
    assert {r.id for r in both if r.x} == {0, 1, 2}


def test_sea_is_where_nothing_stands():
    coast = [[(5.0, -1.0), (5.0, 11.0)]]
    evidence = [(7.0, float(k), 1.0) for k in range(1, 9)]
    (sea,) = O.inferred_sea(coast, (0.0, 0.0, 10.0, 10.0), evidence)
    assert max(x for x, _ in sea) == 5.0
    assert O.inferred_sea(coast, (0.0, 0.0, 10.0, 10.0), []) == []
