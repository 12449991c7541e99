"""Queries over the driver's tables: each operator with SQL that gives the same rows.

An entry is (function, SQL or None).  Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, strings, tags
from ..operators import bands, joins, orbits, ordered, raster, shaping, terrain, vector
from ..session import cut
from ..sinks import geojson as sink
from ..sources.model import GEOMETRY, with_extent
from . import views as V
from .dimensions import GROUP_ORDER, GROUPS, groups, label_limit, mark_symbol, symbol_parts

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]
QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Registers a query with its SQL; views that the SQL names are put in front."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = (f, V.with_views(sql) if sql else None)
        return f

    return add


def R(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


BOX = geo.Box(-20.0, 30.0, 45.0, 70.0)

# ---- points, boxes, projections ----------------------------------------------------------


@query("bbox_filter_points", "SELECT event_id, lon, lat, layer FROM v_points WHERE lon BETWEEN -20 AND 45 AND lat BETWEEN 30 AND 70")
def _(spark, d):
    return V.points(spark, d).where(geo.box_contains(F.col("lon"), F.col("lat"), BOX)).select("event_id", "lon", "lat", "layer")


@query("bbox_intersects", "SELECT id FROM v_boxes WHERE max_x >= -20 AND min_x <= 45 AND max_y >= 30 AND min_y <= 70")
def _(spark, d):
    return V.boxes(spark, d).where(geo.boxes_intersect(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), BOX)).select("id")


@query(
    "mercator_tiles",
    """SELECT x, y, count(*) AS n FROM (SELECT least(greatest(trunc((lon+180)/360*1024), 0), 1023)::INT AS x,
    least(greatest(trunc((1-ln(tan(radians(c))+1/cos(radians(c)))/pi())/2*1024), 0), 1023)::INT AS y
    FROM (SELECT lon, greatest(least(lat, 85.05112878), -85.05112878) AS c FROM v_points)) GROUP BY x, y""",
)
def _(spark, d):
    return V.points(spark, d).withColumn("t", geo.tile(F.col("lon"), F.col("lat"), 10)).groupBy("t.x", "t.y").agg(F.count("*").alias("n"))


@query(
    "mercator_project",
    """SELECT event_id, round(6378137.0::DOUBLE*pi()/180*lon, 4) AS x, round(6378137.0::DOUBLE*ln(tan(pi()/4+greatest(least(lat,85.05112878),-85.05112878)*pi()/360)), 4) AS y FROM v_points""",
)
def _(spark, d):
    p = geo.project(F.col("lon"), F.col("lat"), "web_mercator")
    return V.points(spark, d).select("event_id", F.round(p.x, 4).alias("x"), F.round(p.y, 4).alias("y"))


@query("mercator_roundtrip", "SELECT event_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM v_points")
def _(spark, d):
    out = V.points(spark, d).withColumn("p", geo.pixel(F.col("lon"), F.col("lat"), 14))
    q = geo.from_pixel(F.col("p.x"), F.col("p.y"), 14)
    return out.select("event_id", R(q.lon).alias("lon"), R(q.lat).alias("lat"))


@query("projection_roundtrips", "SELECT event_id, m AS mode, round(lon, 6) AS lon, round(lat, 6) AS lat FROM v_points, (SELECT unnest(['wgs84_raw','web_mercator','local_azimuthal','equal_earth']) AS m)")
def _(spark, d):
    out = None
    for mode in geo.MODES:
        p = V.points(spark, d).withColumn("p", geo.project(F.col("lon"), F.col("lat"), mode, 10.0, 40.0))
        q = geo.unproject(F.col("p.x"), F.col("p.y"), mode, 10.0, 40.0)
        part = p.select("event_id", F.lit(mode).alias("mode"), R(q.lon).alias("lon"), R(q.lat).alias("lat"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "equal_earth_forward",
    """SELECT event_id, round(radians(lon)*cos(t)/(sqrt(3)/2*(1.340264-0.243318*t*t+t*t*t*t*t*t*(0.006251+0.034164*t*t)))*6378137, 3) AS x,
    round(t*(1.340264-0.081106*t*t+t*t*t*t*t*t*(0.000893+0.003796*t*t))*6378137, 3) AS y
    FROM (SELECT event_id, lon, asin(sin(radians(lat))*sqrt(3)/2) AS t FROM v_points)""",
)
def _(spark, d):
    p = geo.equal_earth(F.col("lon"), F.col("lat"))
    return V.points(spark, d).select("event_id", F.round(p.x, 3).alias("x"), F.round(p.y, 3).alias("y"))


@query("ground_resolution", "SELECT event_id, round(cos(radians(lat))*(2*pi()*6378137/(256*1024)), 6) AS metres FROM v_points")
def _(spark, d):
    return V.points(spark, d).select("event_id", R(geo.ground_resolution(F.col("lat"), 10)).alias("metres"))


@query(
    "pad_point_bbox",
    """SELECT event_id, round(lon-0.05/greatest(0.02,cos(radians(lat))),6) AS min_lon, round(lat-0.05,6) AS min_lat,
    round(lon+0.05/greatest(0.02,cos(radians(lat))),6) AS max_lon, round(lat+0.05,6) AS max_lat FROM v_points""",
)
def _(spark, d):
    b = geo.padded_point(F.col("lat"), F.col("lon"))
    return V.points(spark, d).select("event_id", *[R(b[k]).alias(k) for k in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query(
    "centred_bbox",
    """SELECT event_id, greatest(lon-least(mag*40,360)/2,-180) AS min_lon, greatest(lat-least(mag*40,180)/2,-90) AS min_lat,
    least(lon+least(mag*40,360)/2,180) AS max_lon, least(lat+least(mag*40,180)/2,90) AS max_lat FROM (SELECT event_id, lon, lat, (event_id%1000)/64.0::DOUBLE AS mag FROM v_points)""",
)
def _(spark, d):
    p = V.points(spark, d).withColumn("mag", (F.col("event_id") % 1000) / 64.0)
    b = geo.centred_box(F.col("lat"), F.col("lon"), F.col("mag") * 40, F.col("mag") * 40)
    return p.select("event_id", *[b[k].alias(k) for k in ("min_lon", "min_lat", "max_lon", "max_lat")])


@query("depth_bucket", "SELECT CASE WHEN depth<70 THEN 'earthquakes_shallow' WHEN depth<300 THEN 'earthquakes_intermediate' ELSE 'earthquakes_deep' END AS layer, count(*) AS n, round(max(mag),6) AS strongest FROM v_points GROUP BY 1")
def _(spark, d):
    return V.points(spark, d).groupBy(geo.depth_bucket(F.col("depth")).alias("layer")).agg(F.count("*").alias("n"), R(F.max("mag")).alias("strongest"))


@query("quake_radius", "SELECT event_id, round(12*least(0.005*pow(1.55,greatest(0,mag-3)),0.09),6) AS radius FROM v_points")
def _(spark, d):
    return V.points(spark, d).select("event_id", R(geo.magnitude_radius(F.col("mag"), F.lit(12.0))).alias("radius"))


@query(
    "quake_circles",
    """SELECT event_id, k::INT AS k, round(lon+0.5/greatest(0.05,cos(radians(lat)))*cos(k*2*pi()/48),6) AS x, round(lat+0.5*sin(k*2*pi()/48),6) AS y
    FROM v_points, (SELECT unnest(range(0,48)) AS k)""",
)
def _(spark, d):
    p = V.points(spark, d)
    out = p.select("event_id", F.posexplode(geo.circle(F.col("lon"), F.col("lat"), F.lit(0.5))).alias("k", "p"))
    return out.select("event_id", "k", R("p.x").alias("x"), R("p.y").alias("y"))


@query("wrap_longitude", "SELECT event_id, round(((lon*3+180)%360+360)%360-180,6) AS lon FROM v_points")
def _(spark, d):
    return V.points(spark, d).select("event_id", R(geo.wrap_longitude(F.col("lon") * 3)).alias("lon"))


@query("strong_events_topk", "SELECT event_id, mag, layer FROM v_points ORDER BY mag DESC, event_id LIMIT 2000")
def _(spark, d):
    return V.points(spark, d).orderBy(F.desc("mag"), "event_id").limit(2000).select("event_id", "mag", "layer")


@query("extent_by_layer", "SELECT layer, min(lon) AS min_x, min(lat) AS min_y, max(lon) AS max_x, max(lat) AS max_y, count(*) AS n FROM v_points GROUP BY layer")
def _(spark, d):
    return V.points(spark, d).groupBy("layer").agg(F.min("lon").alias("min_x"), F.min("lat").alias("min_y"), F.max("lon").alias("max_x"), F.max("lat").alias("max_y"), F.count("*").alias("n"))


@query(
    "julian_gmst",
    """SELECT event_id, round(jd,5) AS julian, round(mod(280.46061837::DOUBLE+360.98564736629::DOUBLE*(jd-2451545.0)+0.000387933::DOUBLE*c*c-c*c*c/38710000.0,360.0::DOUBLE),4) AS gmst
    FROM (SELECT event_id, jd, (jd-2451545.0)/36525.0 AS c FROM (SELECT event_id, 2440587.5::DOUBLE+epoch(ts)/86400.0::DOUBLE AS jd FROM events))""",
)
def _(spark, d):
    jd = geo.julian_date(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return V.table(spark, d, "events").select("event_id", F.round(jd, 5).alias("julian"), F.round(geo.gmst_degrees(jd), 4).alias("gmst"))


@query("nice_interval", "SELECT p_partkey, s*(CASE WHEN m < sqrt(2) THEN 1 WHEN m < sqrt(10) THEN 2 WHEN m < sqrt(50) THEN 5 ELSE 10 END) AS step FROM (SELECT p_partkey, pow(10.0, floor(log10(p_retailprice/7))) AS s, p_retailprice/7/pow(10.0, floor(log10(p_retailprice/7))) AS m FROM part)")
def _(spark, d):
    return V.table(spark, d, "part").select("p_partkey", geo.nice_interval(F.col("p_retailprice"), 7).alias("step"))


@query("colour_ramp", "SELECT p_partkey, printf('#%02x%02x%02x', round_even(10+(250-10)*t,0)::INT, round_even(40+(90-40)*t,0)::INT, round_even(200+(20-200)*t,0)::INT) AS colour FROM (SELECT p_partkey, (p_size-1)/49.0::DOUBLE AS t FROM part)")
def _(spark, d):
    t = (F.col("p_size") - 1) / 49.0
    mix = lambda a, b: geo.lerp_channel(F.lit(float(a)), F.lit(float(b)), t)
    return V.table(spark, d, "part").select("p_partkey", geo.colour_hex(mix(10, 250), mix(40, 90), mix(200, 20)).alias("colour"))


# ---- ways --------------------------------------------------------------------------------

_ORDERED = "list({'x': x, 'y': y} ORDER BY pos, node_id, tie)"
_WAYS = f"SELECT way_id, {_ORDERED} AS line FROM v_refs JOIN v_nodes USING (node_id) GROUP BY way_id"


@query("way_assembly", f"SELECT way_id, len(line) AS n, line[1].x AS first_x, line[-1].y AS last_y FROM ({_WAYS})")
def _(spark, d):
    w = V.ways(spark, d)
    return w.select("way_id", F.size("line").cast("bigint").alias("n"), F.get("line", 0).x.alias("first_x"), F.element_at("line", -1).y.alias("last_y"))


_EDGES = "SELECT way_id, x AS qx, y AS qy, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v_refs JOIN v_nodes USING (node_id) WINDOW w AS (PARTITION BY way_id ORDER BY pos, node_id, tie)"


@query("way_length", f"SELECT way_id, count(*) AS n, round(sum(coalesce(sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)),0)),6) AS length FROM ({_EDGES}) GROUP BY way_id")
def _(spark, d):
    out = joins.way_lengths(V.refs(spark, d), V.nodes(spark, d), "pos", "node_id", "tie")
    return out.select("way_id", "n", R("length").alias("length"))


@query("signed_area_orientation", f"SELECT way_id, round(sum(coalesce(px*qy-qx*py,0)),6) AS area2 FROM ({_EDGES}) GROUP BY way_id")
def _(spark, d):
    return V.ways(spark, d).select("way_id", R(geo.signed_double_area(F.col("line"))).alias("area2"))


@query("way_extent_mean", "SELECT way_id, min(x) AS min_x, max(y) AS max_y, round(avg(x),6) AS mean_x FROM v_refs JOIN v_nodes USING (node_id) GROUP BY way_id")
def _(spark, d):
    e, m = geo.extent(F.col("line")), geo.vertex_mean(F.col("line"))
    return V.ways(spark, d).select("way_id", e.min_x.alias("min_x"), e.max_y.alias("max_y"), R(m.x).alias("mean_x"))


@query(
    "chaikin_once",
    f"""SELECT way_id, CASE WHEN n < 3 THEN n ELSE 2*(n-1) END AS n_points, round(CASE WHEN n < 3 THEN sx ELSE 2*sx-(0.75*fx+0.25*s2)-(0.25*p2+0.75*lx) END, 4) AS sum_x
    FROM (SELECT way_id, len(line) AS n, list_sum([p.x for p in line]) AS sx, line[1].x AS fx, line[-1].x AS lx, line[2].x AS s2, line[-2].x AS p2 FROM ({_WAYS}))""",
)
def _(spark, d):
    s = geo.smooth_line(F.col("line"))
    out = V.ways(spark, d).withColumn("s", s)
    return out.select("way_id", F.size("s").cast("bigint").alias("n_points"), F.round(F.aggregate("s", F.lit(0.0), lambda a, p: a + p.x), 4).alias("sum_x"))


@query("densify_line", f"SELECT way_id, 1+sum(CASE WHEN px IS NULL THEN 0 ELSE greatest(least(ceil(greatest(abs(qx-px),abs(qy-py))/5),1024),1) END)::BIGINT AS n_points FROM ({_EDGES}) GROUP BY way_id")
def _(spark, d):
    return V.ways(spark, d).select("way_id", F.size(geo.densify_line(F.col("line"), 5.0)).cast("bigint").alias("n_points"))


@query("antimeridian_split", f"SELECT way_id, sum(CASE WHEN abs(qx-px)>180 THEN 1 ELSE 0 END)+1 AS n_runs FROM ({_EDGES}) GROUP BY way_id")
def _(spark, d):
    track = V.refs(spark, d).join(V.nodes(spark, d), "node_id").withColumnRenamed("x", "lon")
    return ordered.antimeridian_runs(track, ["way_id"], ["pos", "node_id", "tie"]).groupBy("way_id").agg((F.max("run") + 1).alias("n_runs"))


@query(
    "gaps_islands_runs",
    """SELECT user_id, run, min(ts) AS first_ts, count(*) AS n, any_value(layer) AS layer FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS run FROM (SELECT user_id, ts, event_id, layer,
    CASE WHEN lag(layer) OVER w IS NOT DISTINCT FROM layer THEN 0 ELSE 1 END AS new FROM v_points WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, run""",
)
def _(spark, d):
    out = ordered.runs(V.points(spark, d), ["user_id"], ["ts", "event_id"], F.col("layer"))
    return out.groupBy("user_id", "run").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"), F.first("layer").alias("layer"))


@query(
    "illumination_runs",
    f"""SELECT way_id, weight, count(*) AS n FROM (SELECT way_id, round(0.4+1.5*(round((1-greatest(least(CASE WHEN s>0 THEN dy/s*sin(radians(315))-dx/s*cos(radians(315)) ELSE 0 END,1),-1))/2*4)/4),6) AS weight
    FROM (SELECT way_id, qx-px AS dx, qy-py AS dy, sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)) AS s FROM ({_EDGES}) WHERE px IS NOT NULL)) GROUP BY way_id, weight""",
)
def _(spark, d):
    w = Window.partitionBy("way_id").orderBy("pos", "node_id", "tie")
    e = V.refs(spark, d).join(V.nodes(spark, d), "node_id").withColumn("dx", F.col("x") - F.lag("x").over(w)).withColumn("dy", F.col("y") - F.lag("y").over(w)).where("dx IS NOT NULL")
    return e.groupBy("way_id", R(ordered.azimuth_weight(F.col("dx"), F.col("dy"))).alias("weight")).agg(F.count("*").alias("n"))


@query("speed_bands", "SELECT greatest(least(trunc(value/100*6)::INT,5),0) AS band, count(*) AS n, round(avg(value),6) AS mean FROM events GROUP BY 1")
def _(spark, d):
    return V.table(spark, d, "events").groupBy(ordered.speed_band(F.col("value"), 0.0, 100.0, 6).alias("band")).agg(F.count("*").alias("n"), R(F.avg("value")).alias("mean"))


@query("geojson_rows", f"""SELECT way_id, len(line) AS n, round(line[1].x,6) AS x0 FROM ({_WAYS}) WHERE len(line) >= 2""")
def _(spark, d):
    f = V.ways(spark, d).where(F.size("line") >= 2).select(F.lit("ways").alias("layer"), F.col("way_id").cast("string").alias("id"), F.struct(F.lit("LineString").alias("kind"), F.array(F.array("line")).alias("parts")).alias("geom"), F.create_map().cast("map<string,string>").alias("props"))
    rows = sink.feature_rows(f)
    c = F.from_json(F.get_json_object("json", "$.geometry.coordinates"), "array<array<double>>")
    return rows.select(F.col("id").cast("bigint").alias("way_id"), F.size(c).cast("bigint").alias("n"), R(F.get(F.get(c, 0), 0)).alias("x0"))


# ---- tags, names, strings ----------------------------------------------------------------


def _classify_sql() -> str:
    k, v = "split_part(kind,'=',1)", "split_part(kind,'=',2)"
    tag = lambda key: f"(CASE WHEN {k}='{key}' THEN {v} ELSE '' END)"
    inn = lambda values: "(" + ",".join(f"'{x}'" for x in values) + ")"
    t = tag("seamark:type")
    marks = " ".join(f"WHEN {t} IN {inn(types)} THEN '{layer}'" for layer, types in tags.SEAMARK_TYPES.items())
    marks += f" WHEN {t} IN {inn(tags.SEAMARK_AREAS)} THEN 'seamark_areas' " + " ".join(f"WHEN starts_with({t},'{p}') THEN '{x}'" for p, x in tags.SEAMARK_PREFIXES)
    return f"""CASE WHEN {k}='railway' THEN 'railways' WHEN {k}='highway' THEN 'roads' WHEN {k}='building' THEN 'buildings' WHEN {k}='shop' THEN 'shops' WHEN {k}='amenity' THEN 'amenities'
    WHEN {tag('natural')}='coastline' OR {tag('place')} IN ('sea','ocean') THEN 'coastline' WHEN {k}='seamark:type' THEN (CASE {marks} ELSE 'seamark_areas' END)
    WHEN {tag('route')}='ferry' OR {tag('waterway')} IN ('seaway','fairway') THEN 'ferry_routes' WHEN {tag('natural')}='water' OR {k} IN ('waterway','water') OR {tag('landuse')} IN ('reservoir','basin') THEN 'water'
    WHEN {k}='place' OR named THEN 'places' WHEN {tag('leisure')} IN {inn(tags.PARK_LEISURE)} OR {tag('landuse')} IN {inn(tags.PARK_LANDUSE)} THEN 'parks'
    WHEN {tag('landuse')}='forest' OR {tag('natural')} IN ('wood','tree_row') THEN 'forests' WHEN {tag('landuse')} IN {inn(tags.FIELD_LANDUSE)} THEN 'fields'
    WHEN {tag('natural')} IN {inn(tags.NATURAL_KINDS)} OR {tag('landuse')} IN ('brownfield','quarry') THEN 'natural' WHEN {k}='barrier' THEN 'barriers' WHEN {k}='power' THEN 'power' WHEN {k}='landuse' THEN 'landuse' END"""


@query("classify_tags", f"SELECT id, {_classify_sql()} AS layer FROM v_tags")
def _(spark, d):
    return V.tags(spark, d).select("id", tags.classify(F.col("tags")).alias("layer"))


@query("can_be_polygon", "SELECT id, split_part(kind,'=',1) IN ('building','landuse','leisure','natural','water','area') AS polygonal FROM v_tags")
def _(spark, d):
    return V.tags(spark, d).select("id", tags.can_be_polygon(F.col("tags")).alias("polygonal"))


@query(
    "road_class",
    "SELECT CASE split_part(kind,'=',2) WHEN 'primary' THEN 'roads_primary' WHEN 'track' THEN 'roads_service' WHEN 'living_street' THEN 'roads_residential' ELSE 'roads_other' END AS layer, count(*) AS n FROM v_tags WHERE split_part(kind,'=',1)='highway' GROUP BY 1",
)
def _(spark, d):
    h = F.element_at("tags", "highway")
    return V.tags(spark, d).where(h.isNotNull()).groupBy(tags.road_class(h).alias("layer")).agg(F.count("*").alias("n"))


@query("name_alias", "SELECT id, CASE WHEN named THEN trim(p_name) END AS name FROM v_tags")
def _(spark, d):
    return V.tags(spark, d).select("id", tags.name_of(F.col("tags")).alias("name"))


@query(
    "layer_inventory",
    f"""SELECT layer, count(*) AS n, CASE WHEN starts_with(layer,'seamark') THEN 'Sea' WHEN layer IN ('roads','railways','ferry_routes') THEN 'Movement' ELSE 'Land' END AS grp
    FROM (SELECT {_classify_sql()} AS layer FROM v_tags) WHERE layer IS NOT NULL GROUP BY layer""",
)
def _(spark, d):
    f = V.tags(spark, d).select(tags.classify(F.col("tags")).alias("layer")).where("layer IS NOT NULL")
    group = F.when(F.col("layer").startswith("seamark"), "Sea").when(F.col("layer").isin("roads", "railways", "ferry_routes"), "Movement").otherwise("Land")
    return sink.inventory(f).withColumn("grp", group)


@query(
    "parse_coordinates",
    """SELECT c_custkey, CASE WHEN abs(a) <= 90 OR abs(b) <= 90 THEN 'point' END AS kind, CASE WHEN abs(a) <= 90 THEN a WHEN abs(b) <= 90 THEN b END AS lat, CASE WHEN abs(a) <= 90 THEN b WHEN abs(b) <= 90 THEN a END AS lon
    FROM (SELECT c_custkey, round((c_custkey*7919%3600)/1e1-180,1) AS a, round((c_custkey*104729%3600)/1e1-180,1) AS b FROM customer)""",
)
def _(spark, d):
    key = F.col("c_custkey")
    a, b = (key * 7919 % 3600) / 10.0 - 180.0, (key * 104729 % 3600) / 10.0 - 180.0
    text = F.format_string("near %.1f, %.1f", a, b)
    out = V.table(spark, d, "customer").select("c_custkey", strings.parse_coordinates(text).alias("p"))
    return out.select("c_custkey", "p.kind", F.col("p.a").alias("lat"), F.col("p.b").alias("lon"))


@query("extract_numbers", r"SELECT doc_id, len(regexp_extract_all(text, '-?\d+(?:\.\d+)?'))::BIGINT AS n FROM documents")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.size(strings.numbers(F.col("text"))).cast("bigint").alias("n"))


@query(
    "text_forms",
    r"""SELECT p_partkey, replace(lower(p_name),' ','-') AS slug, regexp_replace(p_type,'[^A-Za-z0-9_-]','_','g') AS stem, upper(p_type[1]) || replace(p_type[2:],'_',' ') AS label,
    CASE WHEN regexp_matches(regexp_replace(p_brand,'[^A-Za-z0-9_-]','_','g'),'^[0-9]') THEN 'layer_' ELSE '' END || regexp_replace(p_brand,'[^A-Za-z0-9_-]','_','g') AS svg FROM part""",
)
def _(spark, d):
    p = V.table(spark, d, "part")
    return p.select("p_partkey", strings.slug(F.col("p_name")).alias("slug"), strings.file_stem(F.col("p_type")).alias("stem"), strings.humanise(F.col("p_type")).alias("label"), strings.svg_id(F.col("p_brand")).alias("svg"))


@query("xml_escape", """SELECT page_id, md5(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'"','&quot;')) AS h FROM pages""")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.md5(strings.xml_escape(F.col("html"))).alias("h"))


@query("thousands", "SELECT o_orderkey, CASE WHEN abs(v) > 9999 THEN replace(format('{:,}', v), ',', ' ') ELSE v::VARCHAR END AS text FROM (SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS v FROM orders)")
def _(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", strings.thousands(F.col("o_totalprice").cast("bigint")).alias("text"))


@query(
    "format_distance",
    """SELECT event_id, CASE WHEN layer='click' THEN printf('%.3f', v) || '°' WHEN v >= 1000 THEN printf('%.1f km', v/1000) ELSE printf('%.0f m', v) END AS text FROM (SELECT event_id, layer, (event_id*37%50000)/8.0::DOUBLE+0.01 AS v FROM v_points)""",
)
def _(spark, d):
    v = (F.col("event_id") * 37 % 50000) / 8.0 + 0.01
    crs = F.when(F.col("layer") == "click", "EPSG:4326").otherwise("EPSG:3857")
    return V.points(spark, d).select("event_id", strings.format_distance(v, crs).alias("text"))


@query("epoch_iso", "SELECT event_id, strftime(ts,'%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def _(spark, d):
    return V.table(spark, d, "events").select("event_id", strings.iso_from_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("iso"))


@query("cache_key", "SELECT id, sha256(printf('%.6f,%.6f,%.6f,%.6f|', min_x, min_y, max_x, max_y) || 'roads,water') AS key FROM v_boxes")
def _(spark, d):
    b = [F.col(k) for k in ("min_x", "min_y", "max_x", "max_y")]
    return V.boxes(spark, d).select("id", strings.cache_key(b, F.array(F.lit("water"), F.lit("roads"))).alias("key"))


@query(
    "layer_inventory_grouped",
    f"""SELECT g.rank, g.grp, layer, n FROM (SELECT layer, count(*) AS n FROM (SELECT {_classify_sql()} AS layer FROM v_tags) WHERE layer IS NOT NULL GROUP BY layer) JOIN (SELECT * FROM (VALUES {",".join(f"({GROUP_ORDER.index(g)}, '{g}', '{layer}')" for layer, g in GROUPS.items())}) AS t(rank, grp, name)) g ON g.name = layer""",
)
def _(spark, d):
    f = V.tags(spark, d).select(tags.classify(F.col("tags")).alias("layer")).where("layer IS NOT NULL")
    return sink.inventory(f).join(F.broadcast(groups(spark)), "layer").select("rank", "grp", "layer", "n")


@query(
    "label_limits",
    f"""SELECT id, layer FROM (SELECT id, {_classify_sql()} AS layer FROM v_tags) l WHERE layer IS NOT NULL QUALIFY row_number() OVER (PARTITION BY layer ORDER BY id) <= (CASE layer WHEN 'places' THEN 120 WHEN 'amenities' THEN 80 WHEN 'shops' THEN 80 ELSE 60 END)""",
)
def _(spark, d):
    f = V.tags(spark, d).select("id", tags.classify(F.col("tags")).alias("layer")).where("layer IS NOT NULL")
    return ordered.capped(f, "layer", ["id"], label_limit(F.col("layer"))).select("id", "layer")


@query("mark_symbols", "SELECT id, CASE split_part(kind,'=',2) WHEN 'light_major' THEN 2 WHEN 'wreck' THEN 4 WHEN 'buoy_lateral' THEN 1 END AS n_parts FROM v_tags WHERE split_part(kind,'=',1)='seamark:type' AND split_part(kind,'=',2) IN ('light_major','wreck','buoy_lateral')")
def _(spark, d):
    t = V.tags(spark, d).select("id", mark_symbol(F.col("tags")).alias("symbol")).where("symbol IS NOT NULL")
    parts = symbol_parts(spark).groupBy("symbol").agg(F.count("*").alias("n_parts"))
    return t.join(F.broadcast(parts), "symbol").select("id", F.col("n_parts").cast("int").alias("n_parts"))


# ---- joins -------------------------------------------------------------------------------


_WIDER = "(SELECT id, min_x, min_y, max_x+4 AS max_x, max_y+4 AS max_y FROM v_boxes)"


@query("overlap_pairs_bucketed", f"SELECT a.id AS first, b.id AS second FROM {_WIDER} a JOIN {_WIDER} b ON a.id < b.id AND a.max_x >= b.min_x AND a.min_x <= b.max_x AND a.max_y >= b.min_y AND a.min_y <= b.max_y")
def _(spark, d):
    wider = V.boxes(spark, d).withColumns({"max_x": F.col("max_x") + 4, "max_y": F.col("max_y") + 4})
    return joins.overlapping_pairs(wider, 5.0)


def _areas(spark, d) -> DataFrame:
    """Diamonds around the nations' points."""
    key = F.col("n_nationkey").cast("bigint")
    x, y = (key * 7919 % 3000) / 10.0 - 150.0, (key * 104729 % 1200) / 10.0 - 60.0
    at = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    ring = F.array(at(-20.0, 0.0), at(0.0, -15.0), at(20.0, 0.0), at(0.0, 15.0), at(-20.0, 0.0))
    return V.table(spark, d, "nation").select(key.alias("area_id"), F.array(ring).alias("rings"))


_AREAS_SQL = "(SELECT n_nationkey::BIGINT AS area_id, (n_nationkey::BIGINT*7919%3000)/1e1-150 AS cx, (n_nationkey::BIGINT*104729%1200)/1e1-60 AS cy FROM nation)"
_INSIDE = "abs(p.lon-a.cx)/20+abs(p.lat-a.cy)/15 < 1-1e-9"


@query("point_in_ring", f"SELECT area_id, count(*) AS n FROM v_points p JOIN {_AREAS_SQL} a ON {_INSIDE} WHERE abs(abs(p.lon-a.cx)/20+abs(p.lat-a.cy)/15-1) > 1e-9 GROUP BY area_id")
def _(spark, d):
    p = V.points(spark, d).select("event_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    areas = _areas(spark, d)
    left = areas.select("area_id", F.get(F.get("rings", 0), 0).alias("left"))
    met = joins.points_in_areas(p, areas).join(left, "area_id")
    edge = F.abs(F.abs(F.col("x") - (F.col("left.x") + 20.0)) / 20 + F.abs(F.col("y") - F.col("left.y")) / 15 - 1)
    return met.where(edge > 1e-9).groupBy("area_id").agg(F.count("*").alias("n"))


@query(
    "evidence_density",
    f"""SELECT area_id AS face_id, score, is_sea FROM (SELECT area_id, score, count(*) OVER () >= 2 AND max(score) OVER () > 0 AND score/600 < 0.1*max(score/600) OVER () AS is_sea FROM (SELECT a.area_id, coalesce(sum(w),0)::DOUBLE AS score FROM {_AREAS_SQL} a LEFT JOIN
    (SELECT event_id, min(area_id) AS area_id, any_value(user_id%3+1)::DOUBLE AS w FROM v_points p JOIN {_AREAS_SQL} a ON {_INSIDE} GROUP BY event_id) h ON h.area_id=a.area_id GROUP BY a.area_id))""",
)
def _(spark, d):
    p = V.points(spark, d).select(F.col("event_id").alias("point_id"), F.col("lon").alias("x"), F.col("lat").alias("y"), (F.col("user_id") % 3 + 1).cast("double").alias("weight"))
    faces = _areas(spark, d).select(F.col("area_id").alias("face_id"), "rings")
    return joins.evidence_density(p, faces).select("face_id", "score", "is_sea")


@query(
    "hole_to_shell",
    """SELECT hole_id, arg_min(shell_id, {'s': size, 'i': shell_id}) AS shell_id FROM (SELECT id AS hole_id, min_x AS x, min_y AS y FROM v_boxes) h JOIN (SELECT c_custkey AS shell_id, (c_custkey*7919%36000)/1e2-180 AS cx,
    (c_custkey*104729%16000)/1e2-80 AS cy, c_custkey%4+1 AS size FROM customer) s ON x > cx-size+0.003 AND x < cx+size+0.003 AND y > cy-size+0.003 AND y < cy+size+0.003 GROUP BY hole_id""",
)
def _(spark, d):
    b = V.boxes(spark, d)
    holes = b.select(F.col("id").alias("hole_id"), F.array(F.struct(F.col("min_x").alias("x"), F.col("min_y").alias("y"))).alias("ring"))
    key, size = F.col("id"), (F.col("id") % 4 + 1).cast("double")
    at = lambda sx, sy: F.struct((F.col("min_x") + size * sx + 0.003).alias("x"), (F.col("min_y") + size * sy + 0.003).alias("y"))
    shells = b.select(key.alias("shell_id"), F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1), at(-1, -1)).alias("ring"))
    return joins.holes_to_shells(holes, shells)


@query("label_mark_merge", "SELECT coalesce(m.key, l.key) AS key, mark_id, label FROM (SELECT printf('[%.6f,%.6f]', x, y) AS key, node_id AS mark_id FROM v_nodes) m FULL JOIN (SELECT printf('[%.6f,%.6f]', lon, lat) AS key, arg_max(layer, event_id) AS label FROM v_points GROUP BY 1) l ON m.key=l.key")
def _(spark, d):
    marks = V.nodes(spark, d).select(F.col("node_id").alias("mark_id"), "x", "y")
    labels = V.points(spark, d).select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("layer").alias("name"), F.col("event_id").alias("seq"))
    return joins.merge_labels(marks, labels)


@query("place_dedupe", "SELECT a.place_id AS first, b.place_id AS second FROM v_places a JOIN v_places b ON a.name=b.name AND a.place_id < b.place_id AND abs(a.x-b.x) < 0.5 AND abs(a.y-b.y) < 0.5")
def _(spark, d):
    return joins.duplicate_places(V.places(spark, d))


@query("attribution_semi", "SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey=n_nationkey AND s_acctbal > 9000)")
def _(spark, d):
    wanted = V.table(spark, d, "supplier").where("s_acctbal > 9000")
    n = V.table(spark, d, "nation")
    return n.join(wanted, n["n_nationkey"] == wanted["s_nationkey"], "left_semi").select("n_nationkey", "n_name")


@query("settings_diff", "SELECT coalesce(a.key,b.key) AS key, a.value AS was, b.value AS now FROM (SELECT user_id AS key, min_by(event_type, event_id) AS value FROM events GROUP BY 1) a FULL JOIN (SELECT user_id AS key, max_by(event_type, event_id) AS value FROM events GROUP BY 1) b ON a.key=b.key WHERE a.value IS DISTINCT FROM b.value")
def _(spark, d):
    e = V.table(spark, d, "events").groupBy(F.col("user_id").alias("key"))
    return ordered.changed_settings(e.agg(F.min_by("event_type", "event_id").alias("value")), e.agg(F.max_by("event_type", "event_id").alias("value")))


# ---- ordered rows ------------------------------------------------------------------------


@query(
    "coalesce_session_edits",
    """SELECT user_id, entry, any_value(kind) AS kind, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM (SELECT user_id, ts, kind, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS entry FROM (SELECT user_id, ts, event_type AS kind,
    CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND epoch(ts)-epoch(lag(ts) OVER w) < 7200 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))) GROUP BY user_id, entry""",
)
def _(spark, d):
    log = V.table(spark, d, "events").select("user_id", "ts", "event_type")
    return ordered.coalesce_edits(log, ["user_id"], "ts", "event_type", 7200.0)


@query(
    "source_state_machine",
    "SELECT user_id AS source, max_by(event_type, event_id) AS state, sum(c) AS n_changes FROM (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events) GROUP BY user_id",
)
def _(spark, d):
    return ordered.source_states(V.table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("per_layer_cap", "SELECT event_id, layer FROM v_points QUALIFY row_number() OVER (PARTITION BY layer ORDER BY event_id) <= 50")
def _(spark, d):
    return ordered.capped(V.points(spark, d), "layer", ["event_id"], F.lit(50)).select("event_id", "layer")


@query("longest_segment_per_name", "SELECT name, max(length) AS length, arg_max(segment_id, {'l': length, 'k': -segment_id}) AS segment_id FROM (SELECT c_custkey AS segment_id, c_acctbal AS length, trim(c_mktsegment || ' ' || (c_nationkey%25)::VARCHAR) AS name FROM customer) GROUP BY name ORDER BY length DESC, name LIMIT 60")
def _(spark, d):
    s = V.table(spark, d, "customer").select(F.col("c_custkey").alias("segment_id"), F.col("c_acctbal").alias("length"), F.concat_ws(" ", "c_mktsegment", (F.col("c_nationkey") % 25).cast("string")).alias("name"))
    return ordered.longest_by_name(s, 60)


@query("weakest_provenance", "SELECT user_id, min_by(p, r) AS provenance FROM (SELECT user_id, r, ['approximate','synthetic','uncalibrated','measured'][r] AS p FROM (SELECT user_id, (event_id%4)::INT+1 AS r FROM events)) GROUP BY user_id")
def _(spark, d):
    names = F.array(*[F.lit(x) for x in ("approximate", "synthetic", "uncalibrated", "measured")])
    e = V.table(spark, d, "events").select("user_id", F.get(names, (F.col("event_id") % 4).cast("int")).alias("p"))
    return ordered.weakest(e, ["user_id"], "p")


@query(
    "merge_collections",
    "WITH m AS (SELECT 'src' || s_nationkey::VARCHAR AS source, s_suppkey AS pos, 'k' || (s_suppkey%9)::VARCHAR || '_' || s_suppkey::VARCHAR AS key, s_name AS value FROM supplier UNION ALL SELECT 'src' || s_nationkey::VARCHAR, s_suppkey, 'unit', s_name FROM supplier) SELECT source || '.' || key AS key, value FROM m UNION ALL SELECT key, min_by(value, pos) FROM m WHERE key='unit' GROUP BY key",
)
def _(spark, d):
    s = V.table(spark, d, "supplier")
    source = F.concat(F.lit("src"), F.col("s_nationkey").cast("string"))
    own = s.select(source.alias("source"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("k"), (F.col("s_suppkey") % 9).cast("string"), F.lit("_"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("value"))
    unit = s.select(source.alias("source"), F.col("s_suppkey").alias("pos"), F.lit("unit").alias("key"), F.col("s_name").alias("value"))
    return ordered.merged_metadata(own.unionByName(unit), ("unit",))


@query("cache_eviction", "SELECT id FROM (SELECT o_orderkey AS id, sum(trunc(o_totalprice)::BIGINT) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC ROWS UNBOUNDED PRECEDING) AS s FROM orders) WHERE s > 3000000")
def _(spark, d):
    f = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("mtime"), F.col("o_totalprice").cast("bigint").alias("bytes"), "o_orderpriority")
    return ordered.evicted(f, ["o_orderpriority"], 3_000_000).select("id")


@query("layer_rank_order", "SELECT layer, n, row_number() OVER (ORDER BY r, layer) AS rank FROM (SELECT layer, count(*) AS n, coalesce(list_position(['view','click'], layer), 3) AS r FROM v_points GROUP BY layer)")
def _(spark, d):
    known = F.array(F.lit("view"), F.lit("click"))
    r = F.array_position(known, F.col("layer"))
    counts = V.points(spark, d).groupBy("layer").agg(F.count("*").alias("n")).withColumn("r", F.when(r > 0, r).otherwise(3))
    return counts.select("layer", "n", F.row_number().over(Window.orderBy("r", "layer")).cast("bigint").alias("rank"))


@query("set_operations", "SELECT l_suppkey AS k, 'both' AS part FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT s_suppkey, 'both' FROM supplier WHERE s_acctbal > 0 UNION ALL (SELECT s_suppkey, 'only' FROM supplier WHERE s_acctbal > 0 EXCEPT SELECT l_suppkey, 'only' FROM lineitem WHERE l_quantity > 45)")
def _(spark, d):
    used = V.table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("k"))
    known = V.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"))
    return used.intersect(known).withColumn("part", F.lit("both")).unionByName(known.subtract(used).withColumn("part", F.lit("only")))


# ---- rasters -----------------------------------------------------------------------------

_ROW, _COL = "(PARTITION BY row ORDER BY col)", "(PARTITION BY col ORDER BY row)"
_NEAR = f"""(SELECT row, col, coalesce(lag(h) OVER {_COL}, h) AS u, h, coalesce(lead(h) OVER {_COL}, h) AS d FROM (SELECT row, col, {{'w': coalesce(lag(value) OVER {_ROW}, value), 'c': value, 'e': coalesce(lead(value) OVER {_ROW}, value)}} AS h FROM v_field))"""


@query("field_extent", "SELECT field_id, min(value) AS low, max(value) AS high FROM v_field GROUP BY field_id")
def _(spark, d):
    return raster.extent(V.field(spark, d))


@query("box_blur", f"SELECT row, col, round((u.w+u.c+u.e+h.w+h.c+h.e+d.w+d.c+d.e)/9,6) AS value FROM {_NEAR}")
def _(spark, d):
    return raster.box_blur(V.field(spark, d)).select("row", "col", R("value").alias("value"))


_OK = "(CASE WHEN row%7=3 AND col%5=2 THEN NULL ELSE value END)"
_NEAR_OK = f"""(SELECT row, col, coalesce(lag(h) OVER {_COL}, h) AS u, h, coalesce(lead(h) OVER {_COL}, h) AS d FROM (SELECT row, col, {{'w': coalesce(lag(v) OVER {_ROW}, v), 'c': v, 'e': coalesce(lead(v) OVER {_ROW}, v)}} AS h FROM (SELECT row, col, {{'v': coalesce({_OK},0), 'k': CASE WHEN {_OK} IS NULL THEN 0 ELSE 1 END}} AS v FROM v_field)))"""


def _sum(part: str) -> str:
    return "+".join(f"{a}.{b}.{part}" for a in "uhd" for b in "wce")


@query("masked_smooth", f"SELECT row, col, round(({_sum('v')})/({_sum('k')}),6) AS value FROM {_NEAR_OK} WHERE h.c.k=1")
def _(spark, d):
    hole = (F.col("row") % 7 == 3) & (F.col("col") % 5 == 2)
    f = V.field(spark, d).withColumn("value", F.when(hole, F.lit(float("nan"))).otherwise(F.col("value")))
    return raster.smooth(f).where(~F.isnan("value")).select("row", "col", R("value").alias("value"))


_K, _A = 1 / (8 * 30.0), math.radians(315.0)
_LX, _LY, _LZ = math.sin(_A) * math.cos(math.radians(45.0)), math.cos(_A) * math.cos(math.radians(45.0)), math.sin(math.radians(45.0))


@query(
    "hillshade",
    f"""SELECT row, col, round(greatest(least((-e*{_LX!r}::DOUBLE-n*{_LY!r}::DOUBLE+{_LZ!r}::DOUBLE)/sqrt(e*e+n*n+1),1),0),6) AS value FROM (SELECT row, col, ((u.e+2*h.e+d.e)-(u.w+2*h.w+d.w))*{_K!r}::DOUBLE AS e, ((u.w+2*u.c+u.e)-(d.w+2*d.c+d.e))*{_K!r}::DOUBLE AS n FROM {_NEAR})""",
)
def _(spark, d):
    return raster.hillshade(V.field(spark, d), 30.0).select("row", "col", R("value").alias("value"))


@query("decimate", "SELECT row//4 AS row, col//4 AS col, value FROM v_field WHERE row%4=0 AND col%4=0")
def _(spark, d):
    return raster.decimate(V.field(spark, d), 4).select("row", "col", "value")


@query("crop", "SELECT row-10 AS row, col-5 AS col, value FROM v_field WHERE row BETWEEN 10 AND 90 AND col BETWEEN 5 AND 40")
def _(spark, d):
    return raster.crop(V.field(spark, d), 10, 5, 90, 40).select("row", "col", "value")


_MASKS = """(SELECT row, col, level, a, b, c, d, (a>0)::INT+2*(b>0)::INT+4*(c>0)::INT+8*(d>0)::INT AS mask FROM (SELECT row, col, level, CASE WHEN tl=level THEN -tiny ELSE tl-level END AS a, CASE WHEN tr=level THEN -tiny ELSE tr-level END AS b, CASE WHEN br=level THEN -tiny ELSE br-level END AS c, CASE WHEN bl=level THEN -tiny ELSE bl-level END AS d
FROM (SELECT *, 1e-12*CASE WHEN greatest(abs(lo-level),abs(hi-level))>0 THEN greatest(abs(lo-level),abs(hi-level)) ELSE 1 END AS tiny FROM (SELECT row, col, value AS tl, lead(value) OVER (PARTITION BY row ORDER BY col) AS tr, lead(value) OVER (PARTITION BY col ORDER BY row) AS bl, min(value) OVER () AS lo, max(value) OVER () AS hi FROM v_field) f
JOIN (SELECT row-1 AS row, col-1 AS col, value AS br FROM v_field) g USING (row, col), (SELECT unnest([-100.0,0.0,100.0])::DOUBLE AS level))))"""
LEVELS = [-100.0, 0.0, 100.0]


@query("contour_masks", f"SELECT level, mask, count(*) AS n FROM {_MASKS} WHERE mask BETWEEN 1 AND 14 GROUP BY level, mask")
def _(spark, d):
    return raster.contour_cells(V.field(spark, d), LEVELS).groupBy("level", "mask").agg(F.count("*").alias("n"))


_ENDS = {0: ("row", "col+a/(a-b)"), 1: ("row+b/(b-c)", "col+1"), 2: ("row+1", "col+d/(d-c)"), 3: ("row+a/(a-d)", "col")}


def _segments_sql() -> str:
    cases = [(f"mask={m}", [p]) for m, p in raster.SIMPLE_CASES.items()] + [(f"mask={m} AND a+b+c+d {'>' if up else '<='} 0", list(ps)) for (m, up), ps in raster.SADDLES.items()]
    line = lambda s, e: f"{{'r0': ({_ENDS[s][0]})::DOUBLE, 'c0': ({_ENDS[s][1]})::DOUBLE, 'r1': ({_ENDS[e][0]})::DOUBLE, 'c1': ({_ENDS[e][1]})::DOUBLE}}"
    whens = " ".join(f"WHEN {cond} THEN [{','.join(line(*p) for p in ps)}]" for cond, ps in cases)
    return f"(SELECT level, row, col, unnest(CASE {whens} END) AS s FROM {_MASKS} WHERE mask BETWEEN 1 AND 14)"


@query("contour_segments", f"SELECT level, row, col, round(s.r0,6) AS r0, round(s.c0,6) AS c0, round(s.r1,6) AS r1, round(s.c1,6) AS c1 FROM {_segments_sql()}")
def contour_segments(spark, d):
    s = raster.contour_segments(V.field(spark, d), LEVELS)
    return s.select("level", "row", "col", *[R(k).alias(k) for k in ("r0", "c0", "r1", "c1")])


@query("contour_length_by_level", f"SELECT level, count(*) AS n, round(sum(sqrt((s.r1-s.r0)*(s.r1-s.r0)+(s.c1-s.c0)*(s.c1-s.c0))),3) AS length FROM {_segments_sql()} GROUP BY level")
def _(spark, d):
    s = raster.contour_segments(V.field(spark, d), LEVELS)
    step = F.sqrt((F.col("r1") - F.col("r0")) * (F.col("r1") - F.col("r0")) + (F.col("c1") - F.col("c0")) * (F.col("c1") - F.col("c0")))
    return s.groupBy("level").agg(F.count("*").alias("n"), F.round(F.sum(step), 3).alias("length"))


@query("band_histogram", "SELECT least(floor((value+400)/100),7)::INT AS band, count(*) AS n_cells, round(avg(value),6) AS mean_value FROM v_field WHERE value BETWEEN -400 AND 400 GROUP BY 1")
def _(spark, d):
    return raster.band_histogram(V.field(spark, d), -400.0, 400.0, 8).select("band", "n_cells", R("mean_value").alias("mean_value"))


@query(
    "block_summits_topk",
    "SELECT br AS block_row, bc AS block_col, peak, lowest FROM (SELECT row//16 AS br, col//16 AS bc, max(value) AS peak, min(value) AS lowest FROM v_field WHERE row < (SELECT (max(row)+1)//16*16 FROM v_field) GROUP BY 1, 2) WHERE peak >= 1 AND peak-lowest >= 40 ORDER BY peak DESC, br, bc LIMIT 24",
)
def _(spark, d):
    f = V.field(spark, d)
    rows = f.agg(F.max("row")).first()[0] + 1
    return raster.block_summits(f, rows, 64, 16).select("block_row", "block_col", "peak", "lowest")


@query(
    "raster_blend",
    """SELECT row, col, round(CASE WHEN NOT depth < 0 THEN value WHEN value < 0 THEN value+(depth-value)*w ELSE value END,6) AS value, round(CASE WHEN depth < 0 AND value < 0 THEN w ELSE 0 END,6) AS surveyed
    FROM (SELECT f.row, f.col, f.value, g.value AS depth, least(1,greatest(0,least(f.row+0.5,n-f.row-0.5,f.col+0.5,32-f.col-0.5)/(0.06*least(n,32)))) AS w
    FROM (SELECT row//2 AS row, col//2 AS col, value FROM v_field WHERE row%2=0 AND col%2=0) f, (SELECT max(row)//2+1 AS n, max(row)+1 AS m FROM v_field) JOIN v_field g ON g.row=least(floor((f.row+0.5)*m/n),m-1) AND g.col=2*f.col+1)""",
)
def _(spark, d):
    f = V.field(spark, d)
    rows = f.agg(F.max("row")).first()[0] + 1
    return raster.blend(raster.decimate(f, 2), f, (rows + 1) // 2, 32, rows, 64).select("row", "col", R("value").alias("value"), R("surveyed").alias("surveyed"))


_REGIONS = f"""SELECT level, sum(CASE mask WHEN 15 THEN 1 WHEN 1 THEN ab*ad/2 WHEN 2 THEN (1-ab)*bc/2 WHEN 4 THEN (1-bc)*(1-dc)/2 WHEN 8 THEN (1-ad)*dc/2 WHEN 3 THEN (ad+bc)/2 WHEN 6 THEN (2-ab-dc)/2 WHEN 12 THEN (2-ad-bc)/2 WHEN 9 THEN (ab+dc)/2
    WHEN 14 THEN 1-ab*ad/2 WHEN 13 THEN 1-(1-ab)*bc/2 WHEN 11 THEN 1-(1-bc)*(1-dc)/2 WHEN 7 THEN 1-(1-ad)*dc/2 WHEN 5 THEN CASE WHEN a+b+c+d > 0 THEN 1-(1-ab)*bc/2-(1-ad)*dc/2 ELSE ab*ad/2+(1-bc)*(1-dc)/2 END
    WHEN 10 THEN CASE WHEN a+b+c+d > 0 THEN 1-ab*ad/2-(1-bc)*(1-dc)/2 ELSE (1-ab)*bc/2+(1-ad)*dc/2 END ELSE 0 END) AS area FROM (SELECT *, a/nullif(a-b,0) AS ab, b/nullif(b-c,0) AS bc, d/nullif(d-c,0) AS dc, a/nullif(a-d,0) AS ad FROM {_MASKS}) GROUP BY level"""


@query("region_areas", f"SELECT level, round(area,3) AS area FROM ({_REGIONS})")
def _(spark, d):
    return raster.region_area(V.field(spark, d), LEVELS).select("level", F.round("area", 3).alias("area"))


@query("elevation_bands")
def elevation_bands(spark, d):
    return bands.bands(V.field(spark, d), LEVELS).select("band", "low", "high", "rings")


@query("band_areas", f"SELECT level AS low, lead(level) OVER (ORDER BY level) AS high, round(area-coalesce(lead(area) OVER (ORDER BY level),0),2) AS area FROM ({_REGIONS})")
def _(spark, d):
    made = bands.band_areas(V.field(spark, d), LEVELS)
    return made.groupBy("low", "high").agg(F.round(F.sum("area"), 2).alias("area"))


@query("shade_bands")
def _(spark, d):
    f = V.field(spark, d)
    rows = f.agg(F.max("row")).first()[0] + 1
    return bands.shade_bands(f, rows, 64, 30.0, 4).select("tone", "rings")


@query("stitch_contours")
def _(spark, d):
    s = raster.stitch(raster.contour_segments(V.field(spark, d), LEVELS))
    return s.select("level", "chain", "closed", F.size("points").alias("n"))


@query("stitched_length_by_level", f"SELECT level, round(sum(sqrt((s.r1-s.r0)*(s.r1-s.r0)+(s.c1-s.c0)*(s.c1-s.c0))),3) AS length FROM {_segments_sql()} GROUP BY level")
def _(spark, d):
    chains = raster.with_length(raster.stitch(raster.contour_segments(V.field(spark, d), LEVELS)))
    return chains.groupBy("level").agg(F.round(F.sum("length"), 3).alias("length"))


@query("value_noise")
def _(spark, d):
    return V.points(spark, d).select("event_id", terrain.noise_at(F.col("lon"), F.col("lat"), 7, 32.0).alias("value"))


@query("synthetic_terrain")
def _(spark, d):
    sheets = V.places(spark, d).select(F.col("place_id").alias("frame_id"), F.col("x").alias("west"), F.col("y").alias("south"), (F.col("x") + F.col("place_id") % 5 / 10.0 + 0.1).alias("east"), (F.col("y") + 0.2).alias("north"))
    return terrain.synthetic(sheets, 24)


@query("streamlines")
def _(spark, d):
    f = V.field(spark, d)
    return raster.streamlines(f.select("field_id", "row", "col", F.col("value").alias("u"), F.lit(120.0).alias("v")))


@query("point_hulls")
def _(spark, d):
    return vector.hulls(V.points(spark, d).select("layer", F.col("lon").alias("x"), F.col("lat").alias("y")), ["layer"])


@query("simplified_ways")
def _(spark, d):
    return V.ways(spark, d).select("way_id", F.size(vector.simplified("line", F.lit(5.0))).alias("n"))


@query("polygonize")
def _(spark, d):
    b = V.boxes(spark, d)
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    line = F.array(at("min_x", "min_y"), at("max_x", "min_y"), at("max_x", "max_y"), at("min_x", "max_y"), at("min_x", "min_y"))
    scene = (F.floor(F.col("min_x") / 10) * 100 + F.floor(F.col("min_y") / 10)).cast("bigint")
    return vector.polygonize(b.select(scene.alias("scene"), line.alias("line")), "scene").select("scene", "face", F.size("ring").alias("n"))


@query("satellite_tracks")
def _(spark, d):
    key = F.col("s_suppkey")
    e = V.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit(1.7e9).alias("epoch"), (key % 98).cast("double").alias("inclination"), (key * 7 % 360).cast("double").alias("node"), ((key % 50) / 1000.0).alias("eccentricity"), (key * 13 % 360).cast("double").alias("perigee"), (key * 29 % 360).cast("double").alias("anomaly"), (12.0 + key % 4).alias("motion"))
    return orbits.ground_tracks(e, 1.7e9, 60.0, 90)


@query("label_thinning")
def _(spark, d):
    p = V.points(spark, d)
    sheet = (F.floor(F.col("lon") / 20) * 100 + F.floor(F.col("lat") / 20)).cast("bigint")
    labels = p.select(sheet.alias("sheet"), "layer", F.col("event_id").cast("string").alias("name"), (-F.col("mag")).alias("rank"), ((F.col("lon") + 180) * 40).alias("x"), ((F.col("lat") + 90) * 40).alias("y"), F.lit(60.0).alias("width"), F.lit(14.0).alias("height"), (F.col("event_id") % 30).cast("double").alias("angle"))
    return ordered.thin_labels(labels)


# ---- shapes ------------------------------------------------------------------------------

_CLIP = geo.Box(-60.0, -30.0, 75.0, 40.0)


def _shape(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), parts.alias("parts")).cast(GEOMETRY).alias("geom")


@query(
    "clip_ways",
    """WITH s AS (SELECT way_id, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM v_refs JOIN v_nodes USING (node_id) WINDOW w AS (PARTITION BY way_id ORDER BY pos, node_id, tie)),
    t AS (SELECT way_id, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS length, greatest(0, CASE WHEN bx<>ax THEN least((-60-ax)/(bx-ax),(75-ax)/(bx-ax)) WHEN ax BETWEEN -60 AND 75 THEN 0 ELSE 2 END, CASE WHEN by_<>ay THEN least((-30-ay)/(by_-ay),(40-ay)/(by_-ay)) WHEN ay BETWEEN -30 AND 40 THEN 0 ELSE 2 END) AS t0,
    least(1, CASE WHEN bx<>ax THEN greatest((-60-ax)/(bx-ax),(75-ax)/(bx-ax)) ELSE 1 END, CASE WHEN by_<>ay THEN greatest((-30-ay)/(by_-ay),(40-ay)/(by_-ay)) ELSE 1 END) AS t1 FROM s WHERE bx IS NOT NULL)
    SELECT way_id AS id, round(sum((t1-t0)*length),4) AS length FROM t WHERE t0 < t1 GROUP BY way_id""",
)
def _(spark, d):
    ways = V.ways(spark, d).where(F.size("line") >= 2).select(F.col("way_id").alias("id"), _shape("LineString", F.array(F.array("line"))))
    inside = shaping.clipped(cut(with_extent(ways)), _CLIP)
    total = F.aggregate(F.transform("geom.parts", lambda p: geo.length(F.get(p, 0))), F.lit(0.0), lambda s, v: s + v)
    return inside.select("id", F.round(total, 4).alias("length"))


@query("clip_boxes", "SELECT id, round((least(max_x,75)-greatest(min_x,-60))*(least(max_y,40)-greatest(min_y,-30)),6) AS area FROM v_boxes WHERE max_x > -60 AND min_x < 75 AND max_y > -30 AND min_y < 40")
def _(spark, d):
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(at("min_x", "min_y"), at("max_x", "min_y"), at("max_x", "max_y"), at("min_x", "max_y"), at("min_x", "min_y"))
    inside = shaping.clipped(V.boxes(spark, d).withColumn("geom", _shape("Polygon", F.array(F.array(ring)))), _CLIP)
    return inside.select("id", F.round(geo.area(F.get("geom.parts", 0)), 6).alias("area"))


@query("buffer_lines", "SELECT place_id AS id, round(2*0.25*(place_id%9+1)/10 + 16*sin(2*pi()/32)*0.0625, 6) AS area FROM v_places")
def _(spark, d):
    start = F.struct("x", "y")
    end = F.struct((F.col("x") + (F.col("place_id") % 9 + 1) / 10.0).alias("x"), "y")
    lines = V.places(spark, d).select(F.col("place_id").alias("id"), _shape("LineString", F.array(F.array(F.array(start, end)))))
    return shaping.buffered(lines, 0.25).select("id", F.round(geo.area(F.get("parts", 0)), 6).alias("area"))


from . import frames, layers  # noqa: E402, F401  (they add their queries)
