"""Queries of layers, styles, settings and geometries; suppliers are scenes' layers, ways are lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import layers as L
from . import views as V
from .queries import R, query

_NAMES = ("terrain_hillshade", "water", "roads_motorway", "roads_primary", "roads", "parks", "places", "bathymetry", "shops", "depth_bands")
_LAYERS = f"(SELECT s_nationkey AS scene, s_suppkey AS pos, [{','.join(repr(n) for n in _NAMES)}][s_suppkey%10+1] AS name, s_suppkey%7*500 AS n_features, s_suppkey%3 AS n_labels, s_suppkey%4<>1 AS visible, s_suppkey%2*0.8 AS casing FROM supplier)"


def _layers(spark, d):
    key = F.col("s_suppkey")
    name = F.get(F.array(*[F.lit(n) for n in _NAMES]), (key % 10).cast("int"))
    return V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("scene"), key.alias("pos"), name.alias("name"), (key % 7 * 500).alias("n_features"), (key % 3).alias("n_labels"), (key % 4 != 1).alias("visible"), (key % 2 * 0.8).alias("casing"))


@query("content_bounds", "SELECT scene, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y FROM (SELECT id%25 AS scene, * FROM v_boxes) WHERE id%3<>0 GROUP BY scene")
def _(spark, d):
    b = V.boxes(spark, d).withColumn("scene", F.col("id") % 25).withColumn("visible", F.col("id") % 3 != 0)
    return L.content_bounds(b, ["scene"])


@query("surveyed_share", "SELECT col, round(coalesce(avg(CASE WHEN value < 0 THEN (row%3)/2.0::DOUBLE END),0),9) AS share FROM v_field GROUP BY col")
def _(spark, d):
    c = V.field(spark, d).withColumn("depth", F.col("value")).withColumn("surveyed", F.col("row") % 3 / 2.0)
    return L.surveyed_share(c, ["col"]).select("col", F.round("share", 9).alias("share"))


@query("sample_claims", "SELECT user_id, CASE WHEN min(value) >= 0.999 THEN 'measured' ELSE 'approximate' END AS provenance FROM events GROUP BY user_id")
def _(spark, d):
    return L.claims(V.table(spark, d, "events").select("user_id", F.col("value").alias("sample")), ["user_id"])


@query(
    "observation_dates",
    f"SELECT user_id, '{L.NOTICE}' || coalesce(' · ocean data ' || min(CASE WHEN event_id%3<2 THEN strftime(ts,'%Y-%m-%d') END), '') AS notice FROM events GROUP BY user_id",
)
def _(spark, d):
    key = F.get(F.array(F.lit("erddap_time"), F.lit("sst.erddap_time"), F.lit("time")), (F.col("event_id") % 3).cast("int"))
    m = V.table(spark, d, "events").select("user_id", key.alias("key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("value"))
    return L.observation_date(m, ["user_id"]).select("user_id", L.notice(F.col("observed")).alias("notice"))


@query("shows_sea", f"SELECT scene, bool_or(name IN ('bathymetry','depth_bands') AND n_features+n_labels > 0) AS marine FROM {_LAYERS} GROUP BY scene")
def _(spark, d):
    return L.shows_sea(_layers(spark, d))


@query(
    "scene_summary",
    f"SELECT scene, CASE WHEN n=0 THEN 'Nothing to draw' ELSE n::VARCHAR || CASE WHEN n=1 THEN ' layer' ELSE ' layers' END || ' · ' || CASE WHEN total > 9999 THEN replace(format('{{:,}}', total::BIGINT),',',' ') ELSE total::BIGINT::VARCHAR END || ' features' END AS summary FROM (SELECT scene, count(*) FILTER (n_features > 0) AS n, sum(n_features) AS total FROM {_LAYERS} GROUP BY scene)",
)
def _(spark, d):
    return L.summary(_layers(spark, d))


@query("toggleable_layers", f"SELECT scene, string_agg(name, ',' ORDER BY pos) AS names FROM {_LAYERS} WHERE n_features > 0 GROUP BY scene")
def _(spark, d):
    return L.toggleable(_layers(spark, d)).where(F.size("names") > 0).select("scene", F.array_join("names", ",").alias("names"))


@query("legend_entries", f"SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY pos) AS entry, name FROM {_LAYERS} WHERE n_features > 0 AND visible QUALIFY entry <= 10")
def _(spark, d):
    return L.legend(_layers(spark, d))


@query("newest_scenes", "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 8")
def _(spark, d):
    return L.newest(V.table(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_orderkey", "o_custkey")


@query("first_listed", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 2")
def _(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return L.first_listed(rows, ["l_orderkey"], "l_linenumber", 2)


@query(
    "selected_layers",
    "SELECT p_partkey, CASE p_partkey%3 WHEN 0 THEN 'water,parks' WHEN 1 THEN 'roads' ELSE 'water,roads,parks' END AS layers FROM part",
)
def _(spark, d):
    asked = [F.array(F.lit("parks"), F.lit("moon"), F.lit("water")), F.array(F.lit("roads")), F.array(F.lit("moon"))]
    own = F.when(F.col("p_partkey") % 3 == 0, asked[0]).when(F.col("p_partkey") % 3 == 1, asked[1]).otherwise(asked[2])
    return V.table(spark, d, "part").select("p_partkey", F.array_join(L.selected_layers(own, ["water", "roads", "parks"]), ",").alias("layers"))


@query(
    "relief_raised",
    f"""SELECT scene, name, pos, row_number() OVER (PARTITION BY scene ORDER BY CASE WHEN name='terrain_hillshade' THEN coalesce(first, last+1)-0.5 ELSE pos END, pos) AS rank
    FROM (SELECT *, min(CASE WHEN name IN ('places','shops') THEN pos END) OVER (PARTITION BY scene) AS first, max(pos) OVER (PARTITION BY scene) AS last FROM {_LAYERS})""",
)
def _(spark, d):
    return L.relief_raised(_layers(spark, d)).select("scene", "name", "pos", "rank")


@query(
    "road_turns",
    f"""WITH l AS (SELECT *, name LIKE 'roads%' AS road FROM {_LAYERS}), m AS (SELECT *, CASE WHEN road AND coalesce(lag(road) OVER (PARTITION BY scene ORDER BY pos), false) THEN 0 ELSE 1 END AS b FROM l),
    r AS (SELECT *, sum(b) OVER (PARTITION BY scene ORDER BY pos) AS run FROM m), p AS (SELECT scene, pos, name, run, CASE WHEN road THEN 'body' ELSE 'whole' END AS part, 1 AS k FROM r UNION ALL SELECT scene, pos, name, run, 'casing', 0 FROM r WHERE road AND casing > 0 AND n_features > 0)
    SELECT scene, row_number() OVER (PARTITION BY scene ORDER BY run, k, pos) AS turn, name, part FROM p""",
)
def _(spark, d):
    return L.turns(_layers(spark, d))


@query("sea_under_water", "SELECT id, 0 AS under FROM v_boxes WHERE id%2=0 UNION ALL SELECT id, 1 FROM v_boxes WHERE id%2=1")
def _(spark, d):
    b = V.boxes(spark, d).select("id")
    return L.sea_first(b.where("id % 2 = 0"), b.where("id % 2 = 1"))


@query("style_fallback", f"SELECT scene, pos, name, round(2*CASE name WHEN 'water' THEN 1.5 WHEN 'roads' THEN 2.0 WHEN 'parks' THEN 0.7 ELSE 0.5 END,6)::DOUBLE AS width FROM {_LAYERS}")
def _(spark, d):
    own = spark.createDataFrame([("water", 1.5), ("roads", 2.0)], "name string, width double")
    derived = spark.createDataFrame([("roads", 9.0), ("parks", 0.7)], "name string, width double")
    layers = _layers(spark, d)
    out = L.scaled_widths(L.styled(layers, own, derived), ["width"], 2.0)
    return out.distinct().join(layers.select("scene", "name", "pos"), ["scene", "name"]).select("scene", "pos", "name", R("width").alias("width"))


@query("source_overrides", "SELECT n_nationkey::VARCHAR AS source, 'attr' AS attribute, 'v' || (n_regionkey%2)::VARCHAR AS value FROM nation WHERE n_regionkey%2=1")
def _(spark, d):
    n = V.table(spark, d, "nation")
    defaults = n.select(F.col("n_nationkey").cast("string").alias("source"), F.lit("k").alias("key"), F.lit("attr").alias("attribute"), F.lit("v0").alias("value"))
    values = n.select(F.col("n_nationkey").cast("string").alias("source"), F.lit("k").alias("key"), F.concat(F.lit("v"), (F.col("n_regionkey") % 2).cast("string")).alias("value"))
    return L.overrides(defaults, values)


@query("synced_frames", "SELECT event_id, coalesce(value > 20 AND lag(user_id%4) OVER w <> user_id%4, false) AS sync FROM (SELECT *, event_id%50 AS g FROM events) WINDOW w AS (PARTITION BY g ORDER BY event_id)")
def _(spark, d):
    f = V.table(spark, d, "events").select("event_id", (F.col("event_id") % 50).alias("g"), (F.col("user_id") % 4).alias("frame"), (F.col("value") > 20).alias("settled"))
    return L.synced_frames(f, ["g"], "event_id").select("event_id", "sync")


@query("regions_of_points", "SELECT event_id, string_agg(name, ',' ORDER BY name) AS names FROM v_points JOIN (VALUES ('World',-180,-60,180,84),('Africa',-18,-35,52,38),('Asia',26,-11,180,78),('Europe',-25,34,45,72),('North America',-168,7,-52,84),('Oceania',112,-48,180,0),('South America',-82,-56,-34,13),('Antarctica',-180,-85,180,-60),('Mediterranean',-6,30,37,46)) r(name, w, s, e, n) ON lon BETWEEN w AND e AND lat BETWEEN s AND n GROUP BY event_id")
def _(spark, d):
    p = V.points(spark, d)
    inside = F.array_compact(F.array(*[F.when(geo.box_contains(F.col("lon"), F.col("lat"), geo.Box(*b)), n) for n, *b in sorted(L.REGIONS)]))
    return p.select("event_id", F.array_join(inside, ",").alias("names")).where("names <> ''")


_WAYS = "(SELECT way_id, pos, tie, node_id, x, y FROM v_refs JOIN v_nodes USING (node_id))"
_W = "OVER (PARTITION BY way_id ORDER BY pos, node_id, tie)"


@query(
    "line_anchors",
    f"""WITH s AS (SELECT way_id, x AS px, y AS py, lead(x) {_W} AS qx, lead(y) {_W} AS qy, row_number() {_W} AS k FROM {_WAYS}),
    l AS (SELECT *, sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)) AS size FROM s), c AS (SELECT *, sum(size) OVER (PARTITION BY way_id ORDER BY k) AS upto, sum(size) OVER (PARTITION BY way_id) AS total FROM l WHERE qx IS NOT NULL)
    SELECT way_id, round(px+(qx-px)*(total/2-(upto-size))/size,4) AS x, round(py+(qy-py)*(total/2-(upto-size))/size,4) AS y FROM c WHERE size > 0 AND upto >= total/2 QUALIFY row_number() OVER (PARTITION BY way_id ORDER BY k) = 1""",
)
def _(spark, d):
    w = V.ways(spark, d).where(geo.length(F.col("line")) > 0).select("way_id", L.line_anchor(F.col("line")).alias("p"))
    return w.select("way_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query(
    "uphill_left",
    f"""WITH s AS (SELECT way_id, x, y, row_number() {_W} AS k, count(*) OVER (PARTITION BY way_id) AS n FROM {_WAYS}),
    m AS (SELECT p.way_id, p.n, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM s p JOIN s q ON p.way_id=q.way_id AND p.k=p.n//2 AND q.k=p.n//2+1), g AS (SELECT way_id, (px+qx)/2-(qy-py)/sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py))*0.5 AS v FROM m WHERE px<>qx OR py<>qy),
    f AS (SELECT way_id, arg_min(x, k) AS first_x, arg_max(x, k) AS last_x FROM s GROUP BY way_id)
    SELECT f.way_id, round(CASE WHEN v < 10 THEN last_x ELSE first_x END,6) AS first_x FROM f LEFT JOIN g USING (way_id) WHERE v IS NULL OR abs(v-10) > 1e-9""",
)
def _(spark, d):
    # the field is x itself, so that a probe's value is its x
    w = V.ways(spark, d).withColumn("v", L.left_probe(F.col("line"), 0.5).x)
    w = w.where(F.col("v").isNull() | (F.abs(F.col("v") - 10) > 1e-9))
    return w.select("way_id", R(F.get(L.uphill_left(F.col("line"), F.col("v"), F.lit(10.0)), 0).x).alias("first_x"))


@query(
    "sampled_vertices",
    "SELECT f.place_id AS id, 0 AS pos, value FROM v_places f LEFT JOIN v_field g ON g.row=floor((3-f.y)/0.25+0.5)::INT AND g.col=floor(f.x/0.25+0.5)::INT",
)
def _(spark, d):
    p = V.places(spark, d).select(F.col("place_id").alias("id"), F.array(F.struct("x", "y")).alias("line"))
    return L.sampled_vertices(p, V.field(spark, d), 0.0, 3.0, 0.25)


@query(
    "geometry_forms",
    f"SELECT way_id, n > 3 AS has_area, CASE WHEN n > 3 THEN 1 ELSE 0 END AS n_polygons, CASE WHEN n > 3 THEN 0 ELSE 1 END AS n_lines, CASE WHEN n > 3 THEN 'Polygon' ELSE 'Empty' END AS kind, round(sx,6) AS sum_x FROM (SELECT way_id, count(*) AS n, sum(2*x+1) AS sx FROM {_WAYS} GROUP BY way_id)",
)
def _(spark, d):
    w = V.ways(spark, d).select("way_id", F.struct(F.when(F.size("line") > 3, "Polygon").otherwise("LineString").alias("kind"), F.array(F.array("line")).alias("parts")).alias("geom"))
    g = F.col("geom")
    moved = F.flatten(F.flatten(L.map_vertices(g.parts, lambda x, y: F.struct((2 * x + 1).alias("x"), y.alias("y")))))
    total = F.aggregate(moved, F.lit(0.0), lambda s, p: s + p.x)
    return w.select("way_id", L.has_area(g).alias("has_area"), F.size(L.polygons(g)).alias("n_polygons"), F.size(L.lines(g)).alias("n_lines"), L.normal_kind(L.polygons(g), "Polygon").alias("kind"), R(total).alias("sum_x"))


@query(
    "typed_properties",
    "SELECT p_partkey, ['int','double','bool','string'][p_partkey%4+1] AS kind, CASE p_partkey%4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size+0.5 END AS real, CASE WHEN p_partkey%4=0 THEN p_size::BIGINT END AS whole, CASE WHEN p_partkey%4=2 THEN p_size%2=0 END AS truth FROM part",
)
def _(spark, d):
    size = F.col("p_size").cast("string")
    forms = F.array(size, F.concat(size, F.lit(".5")), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), F.concat(size, F.lit(" m")))
    t = V.table(spark, d, "part").select("p_partkey", L.typed(F.get(forms, (F.col("p_partkey") % 4).cast("int"))).alias("t"))
    return t.select("p_partkey", "t.kind", "t.real", "t.whole", "t.truth")
