"""Cases of the findings: rows, boxes and shells where rounding or sizes had decided."""

import math
import random

import pandas as pd
from pyspark.sql import functions as F

from isohypse.functions import frames, geo
from isohypse.operators import joins, parity, raster, shaping, thinning
from isohypse.sinks import geojson
from isohypse.sources.model import GEOMETRY, with_extent


def ring(west, south, east, north):
    return [{"x": x, "y": y} for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))]


def test_a_sliver_of_a_rectangle_stays(spark):
    rows = [(1, -60.599999999999994, 5.0, -59.99999999999999, 6.0), (2, -61.0, 5.0, -60.0, 6.0), (3, -61.0, -31.0, -59.0, -29.0)]
    own = spark.createDataFrame([(k, *b, "Polygon", [[ring(*b)]]) for k, *b in rows], "id int, min_x double, min_y double, max_x double, max_y double, kind string, parts array<array<array<struct<x:double,y:double>>>>")
    out = shaping.clipped(own.withColumn("geom", F.struct("kind", "parts").cast(GEOMETRY)).drop("kind", "parts"), geo.Box(-60.0, -30.0, 75.0, 40.0))
    assert {r.id: (r.min_x, r.max_x, r.min_y, r.max_y) for r in out.collect()} == {1: (-60.0, -59.99999999999999, 5.0, 6.0), 3: (-60.0, -59.0, -30.0, -29.0)}


def test_equal_shells_go_by_their_id(spark):
    """Areas of equal squares differ in their last digits."""
    squares = [(k, ring(10 + k / 100 - 2 + 0.003, 20 - k / 100 - 2 + 0.003, 10 + k / 100 + 2 + 0.003, 20 - k / 100 + 2 + 0.003)) for k in range(1, 41)]
    shells = spark.createDataFrame(squares + [(100 + k, r) for k, r in squares], "shell_id int, ring array<struct<x:double,y:double>>")
    holes = spark.createDataFrame([(k, [{"x": 10.0, "y": 20.0}]) for k in (7, 8)] + [(9, [{"x": 50.0, "y": 0.0}])], "hole_id int, ring array<struct<x:double,y:double>>")
    assert sorted(map(tuple, joins.holes_to_shells(holes, shells).collect())) == [(7, 1), (8, 1)]


def test_a_frame_beyond_an_edge_keeps_its_near_side(spark):
    f = spark.createDataFrame([(180.0, 10.0, 180.2, 10.2)], "w double, s double, e double, n double").select(frames.zoomed(F.col("w"), F.col("s"), F.col("e"), F.col("n"), F.lit(200.0)).alias("f")).first().f
    assert f.west > 180.0 and f.east == 180.0 and f.south < f.north


def test_pairs_of_boxes_use_all_partitions(spark):
    boxes = spark.range(400).selectExpr("id", "id % 20 * 2d AS min_x", "floor(id / 20) * 2d AS min_y").selectExpr("*", "min_x + 3 AS max_x", "min_y + 3 AS max_y")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = joins.overlapping_pairs(boxes, 5.0)
        assert out.count() == 380 * 2 + 361 * 2
        assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_are_cut_without_a_shuffle(spark):
    rng = random.Random(3)
    rows = []
    for k in range(200):
        points = [{"x": rng.choice((-2.0, 0.0, 3.0, 8.0, rng.uniform(-4, 12))), "y": rng.choice((0.0, 5.0, 8.0, rng.uniform(-4, 12)))} for _ in range(rng.randrange(2, 9))]
        rows.append((k, "LineString", [[points]]))
    own = spark.createDataFrame(rows, "id int, kind string, parts array<array<array<struct<x:double,y:double>>>>").select("id", F.struct("kind", "parts").cast(GEOMETRY).alias("geom"))
    out = shaping.clipped(with_extent(own), geo.Box(0.0, 0.0, 8.0, 8.0))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    size = lambda line: sum(math.dist((a["x"], a["y"]), (b["x"], b["y"])) for a, b in zip(line, line[1:]))
    want = {}
    for k, _, parts in rows:
        for a, b in zip(parts[0][0], parts[0][0][1:]):
            t0, t1 = 0.0, 1.0
            for c in "xy":
                d = b[c] - a[c]
                if d:
                    t0, t1 = max(t0, min(-a[c] / d, (8 - a[c]) / d)), min(t1, max(-a[c] / d, (8 - a[c]) / d))
                elif not 0 <= a[c] <= 8:
                    t0 = 2.0
            if t0 < t1:
                want[k] = want.get(k, 0.0) + (t1 - t0) * size([a, b])
    got = {r.id: sum(size(part[0]) for part in r.geom.parts) for r in out.collect()}
    assert set(want) <= set(got) and all(abs(got[k] - want.get(k, 0.0)) < 1e-9 for k in got)


def test_open_labels_of_a_place_are_bounded(monkeypatch):
    calls, own = [0], thinning.overlap

    def counted(a, b):
        calls[0] += 1
        return own(a, b)

    monkeypatch.setattr(thinning, "overlap", counted)
    n = 1500
    rows = pd.DataFrame({"_id": range(n), "rank": [float(k) for k in range(n)], "name": "", "x": [20 + (k % 40) * 0.9 for k in range(n)], "y": [20 + (k // 40) * 0.9 for k in range(n)], "layer": "", "width": 0.5, "height": 0.5, "angle": 0.0, "_alone": False, "_allowed": True, "_full": False, "_taken": False})
    out = thinning._judged(pd.concat([rows, rows.assign(_id=rows._id + n, rank=rows["rank"] + n)]))
    assert list(out._verdict[:100]) == [1] * 100 and set(out._verdict[n:]) == {0} and calls[0] < 10 * n
    same = rows.assign(x=30.0, y=30.0)
    calls[0] = 0
    assert list(thinning._judged(same)._verdict) == [1] + [0] * (n - 1) and calls[0] < 10 * n


def test_a_features_text_is_made_once(spark):
    line = [[[{"x": 1.5, "y": 2.0}, {"x": 3.0, "y": 4.0}]]]
    rows = [("a", "1", "LineString", line), ("a", "2", None, line), ("a", "3", "LineString", [[[{"x": float("nan"), "y": 2.0}]]]), ("a", "4", "LineString", []), ("a", "5", "LineString", None)]
    df = spark.createDataFrame(rows, "layer string, id string, kind string, parts array<array<array<struct<x:double,y:double>>>>")
    out = geojson.feature_rows(df.select("layer", "id", F.struct("kind", "parts").cast(GEOMETRY).alias("geom"), F.create_map().cast("map<string,string>").alias("props")))
    assert [r.id for r in out.collect()] == ["1"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("format_string" not in line for line in plan.split("\n") if "Filter" in line)


def test_streamlines_of_strips_are_those_of_the_field(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(f, r, c, rng.gauss(0, 1), rng.gauss(0, 1) if rng.random() > 0.02 else None) for f, n in (("a", 90), ("b", 61)) for r in range(n) for c in range(15)]
    flow = spark.createDataFrame(rows, "field_id string, row int, col int, u double, v double")
    want = sorted(map(tuple, raster.streamlines(flow, most=20, strip=1000).collect()))
    tracer = raster._tracer

    def bounded(*own):
        trace = tracer(*own)

        def run(key, pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
            assert len(pdf) <= (20 + 10 + 2 * 18) * 15  # a strip, its run-up and both margins
            return trace(key, pdf, before)

        return run

    monkeypatch.setattr(raster, "_tracer", bounded)
    assert len({r[:2] for r in want}) > 100
    # the second has no run-up, so that strips are traced again
    for run_up in (10, 0):
        assert sorted(map(tuple, raster.streamlines(flow, most=20, strip=20, run_up=run_up).collect())) == want


def test_edges_of_one_ring_go_to_all_partitions(spark, monkeypatch):
    points = [{"x": 50 + 40 * math.cos(k / 3000 * math.tau), "y": 50 + 40 * math.sin(k / 3000 * math.tau)} for k in range(3000)]
    areas = spark.createDataFrame([(1, [points])], "area_id int, rings array<array<struct<x:double,y:double>>>").coalesce(1)
    spots = spark.range(400).selectExpr("id", "id % 20 * 5d + 0.3 AS x", "floor(id / 20) * 5d + 0.3 AS y")
    edges = parity.touched(areas.withColumn("_cell", F.lit(4.0)), [])
    assert "REPARTITION_BY_NUM" in edges._jdf.queryExecution().executedPlan().toString()
    want = {r.id for r in spots.collect() if math.dist((r.x, r.y), (50, 50)) < 40}
    rows = lambda: sorted((r._row, r._col, sorted(map(str, r._edges)), sorted(r._turns), r._crossing) for r in parity.touched(areas.withColumn("_cell", F.lit(4.0)), []).collect())
    whole = rows()
    for stretch in (1024, 7, 1):
        monkeypatch.setattr(parity, "_STRETCH", stretch)
        assert {r.id for r in parity.points_in_areas(spots, areas, 4.0).collect()} == want
        assert rows() == whole
