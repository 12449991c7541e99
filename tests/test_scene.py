import json

import pytest
from pyspark.sql import functions as F

from isohypse.functions.geo import Box
from isohypse.operators import tiles
from isohypse.plans import scene
from isohypse.sources import geojson


def test_plan_fetch_and_build(spark, tmp_path):
    f = lambda i, g, **p: {"type": "Feature", "id": i, "geometry": g, "properties": p}
    line = lambda k: {"type": "LineString", "coordinates": [[0, k], [1, k + 0.001], [2, k]]}
    rows = [f(f"r{k}", line(k), highway="primary", name=f"Road {k}") for k in range(5)] + [f("p", {"type": "Point", "coordinates": [1, 1]}, place="town", name="Town"), f("far", {"type": "Point", "coordinates": [90, 1]}, place="town")]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": rows}))
    registry = scene.Registry()
    read = lambda s, box: geojson.read(s, str(tmp_path / "a.geojson"))
    assert registry.register("file", read) and not registry.register("file", read)
    registry.register("bad", lambda s, box: 1 / 0)
    box = Box(-1, -1, 10, 10)
    p = scene.plan(["file", "bad", "gone"], ["bad", "file", "gone"], box)
    assert p.order == ("bad", "file", "gone") and scene.plan([], ["file"], box) is None
    assert scene.plan(["osm", "file"], ["file", "osm"], Box(-90, -40, 90, 40)).order == ("file",)
    features, errors = scene.fetch(spark, registry, p, box)
    assert set(errors) == {"bad", "gone"} and features.count() == 6
    built = scene.build(features, {"roads_primary": 3}, tolerance=0.01).collect()
    assert len(built) == 3 and all(r.layer == "roads_primary" and len(r.geom.parts[0][0]) == 2 for r in built)
    assert {r.name for r in scene.labels(features).collect()} == {"Town", *(f"Road {k}" for k in range(5))}
    assert scene.attribution([("a", "A"), ("b", "B"), ("c", "A")], ["c+a", "none", "x"]) == ["A"]


def test_tiles_and_samples(spark):
    box = Box(10.0, 40.0, 11.0, 41.0)
    assert tiles.choose_zoom(box, 1024) == 10 and tiles.choose_zoom(Box(-180, -85, 180, 85), 100) == 0
    assert tiles.covering(spark, box, 8).count() == 2 and tiles.covering(spark, box, 12, 5).count() == 5
    assert tiles.image_size(box, 100) == (100, 100) and tiles.stride(1000, 300) == 3
    x0, x1, y0, y1 = tiles.tile_range(box, 8)
    one = spark.createDataFrame([(x0, y0, r, c, float(r)) for r in range(2) for c in range(2)], "x int, y int, row int, col int, value double")
    m = tiles.mosaic(one, box, 8, size=2).collect()
    assert len(m) == 8 and sum(v.value == v.value for v in m) == 4
    with pytest.raises(ValueError, match="more than"):
        tiles.mosaic(one, box, 15)
    cells = spark.createDataFrame([("f", r, c, float(10 * r + c)) for r in range(3) for c in range(3)], "field_id string, row int, col int, value double")
    points = spark.createDataFrame([(1, 10.25, 40.75), (2, 11.0, 40.0), (3, 12.0, 40.5)], "id int, lon double, lat double")
    assert {r.id: r.value for r in tiles.sample_bilinear(points, cells, box, 3, 3, "id").collect()} == {1: 5.5, 2: 22.0, 3: 12.0}
    assert {r.id: r.value for r in tiles.sample_nearest(points, cells, box, 3, 3).collect()}[2] == 22.0


def test_rings_are_split_at_the_antimeridian(spark):
    ring = [{"x": x, "y": y} for x, y in ((170.0, 0.0), (190.0, 0.0), (190.0, 10.0), (170.0, 10.0), (170.0, 0.0))]
    out = tiles.split_at_antimeridian(spark.createDataFrame([(1, ring)], "id int, ring array<struct<x:double,y:double>>"), "id")
    spans = sorted((min(p.x for p in r.ring), max(p.x for p in r.ring)) for r in out.collect())
    assert spans == [(-180.0, -170.0), (170.0, 180.0)]
    assert out.select(F.count("*")).first()[0] == 2
