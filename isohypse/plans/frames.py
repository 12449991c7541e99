"""Queries of frames, sheets, canvases and labels; boxes of customers are the frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frames as fr
from . import views as V
from .queries import R, query

_CORNERS = ("min_x", "min_y", "max_x", "max_y")
_SPANS = "least(CASE WHEN wide > 0 THEN wide END, CASE WHEN tall > 0 THEN tall END)"
_SIDES = "(SELECT id, min_x, min_y, max_x, max_y, abs(max_x-min_x)*cos(radians(least(greatest((min_y+max_y)/2,-89.9),89.9))) AS wide, abs(max_y-min_y) AS tall FROM v_boxes)"


def _c(*names: str):
    return [F.col(n) for n in names or _CORNERS]


@query("frame_spans", f"SELECT id, round(coalesce({_SPANS},0),9) AS window_span, round(coalesce({_SPANS},1.0),9) AS radius_span FROM {_SIDES}")
def _(spark, d):
    return V.boxes(spark, d).select("id", F.round(fr.window_span(*_c()), 9).alias("window_span"), F.round(fr.radius_span(*_c()), 9).alias("radius_span"))


@query(
    "terrain_window",
    f"""SELECT id, round(w,9) AS wavelength, round(1200*pow(w/0.3,0.85),6) AS relief, 1+(w/2>=f)::INT+(w/4>=f)::INT+(w/8>=f)::INT+(w/16>=f)::INT+(w/32>=f)::INT+(w/64>=f)::INT+(w/128>=f)::INT+(w/256>=f)::INT+(w/512>=f)::INT+(w/1024>=f)::INT+(w/2048>=f)::INT AS octaves
    FROM (SELECT id, 0.3*pow(2, round_even(log2(s*1.2/0.3),0)) AS w, greatest(1e-9, 8*s/319) AS f FROM (SELECT id, {_SPANS} AS s FROM {_SIDES}))""",
)
def _(spark, d):
    b = V.boxes(spark, d).select("id", fr.window_span(*_c()).alias("s"))
    return b.select("id", F.round(fr.wavelength(F.col("s")), 9).alias("wavelength"), R(fr.relief(F.col("s"))).alias("relief"), fr.resolvable_octaves(F.col("s")).alias("octaves"))


_ASPECT = "(max_x-min_x)/(degrees(ln(tan(radians(45+least(max_y,85.05112878)/2))))-degrees(ln(tan(radians(45+greatest(min_y,-85.05112878)/2)))))"


@query("projected_aspect", f"SELECT id, round({_ASPECT},6) AS aspect FROM v_boxes")
def _(spark, d):
    return V.boxes(spark, d).select("id", R(fr.projected_aspect(*_c())).alias("aspect"))


@query(
    "grow_to_aspect",
    """SELECT id, round(greatest(CASE WHEN grow_x THEN cx-h*1.5/2 ELSE min_x END,-180),6) AS west, round(CASE WHEN grow_x THEN min_y ELSE degrees(2*atan(exp(radians(cm-w/1.5/2)))-pi()/2) END,6) AS south,
    round(least(CASE WHEN grow_x THEN cx+h*1.5/2 ELSE max_x END,180),6) AS east, round(CASE WHEN grow_x THEN max_y ELSE degrees(2*atan(exp(radians(cm+w/1.5/2)))-pi()/2) END,6) AS north
    FROM (SELECT *, w/h < 1.5 AS grow_x FROM (SELECT *, max_x-min_x AS w, (min_x+max_x)/2 AS cx, degrees(ln(tan(radians(45+max_y/2))))-degrees(ln(tan(radians(45+min_y/2)))) AS h, degrees(ln(tan(radians(45+(min_y+max_y)/4)))) AS cm FROM v_boxes))""",
)
def _(spark, d):
    b = V.boxes(spark, d).select("id", fr.grown_to_aspect(*_c(), 1.5).alias("f"))
    return b.select("id", *[R(f"f.{k}").alias(k) for k in ("west", "south", "east", "north")])


@query(
    "zoomed_frame",
    """SELECT id, round(greatest((min_x+max_x)/2-w*k/2,-180),6) AS west, round(greatest((min_y+max_y)/2-t*k/2,-90),6) AS south, round(least((min_x+max_x)/2+w*k/2,180),6) AS east, round(least((min_y+max_y)/2+t*k/2,90),6) AS north
    FROM (SELECT *, least(greatest(1/(CASE id%3 WHEN 0 THEN 0.0005 WHEN 1 THEN 2.0 ELSE 5000.0 END), greatest(0.001/t,0.001/w)), least(170/t,360/w)) AS k FROM (SELECT *, max_x-min_x AS w, max_y-min_y AS t FROM v_boxes))""",
)
def _(spark, d):
    factor = F.when(F.col("id") % 3 == 0, 0.0005).when(F.col("id") % 3 == 1, 2.0).otherwise(5000.0)
    b = V.boxes(spark, d).select("id", fr.zoomed(*_c(), factor).alias("f"))
    return b.select("id", *[R(f"f.{k}").alias(k) for k in ("west", "south", "east", "north")])


@query(
    "honest_projection",
    "SELECT id, mode, CASE WHEN mode IN ('web_mercator','local_azimuthal') AND abs(1-cos(radians(greatest(abs(min_y),abs(max_y))))/cos(radians((min_y+max_y)/2))) > 0.12 THEN 'equal_earth' ELSE mode END AS used FROM (SELECT id, min_y, max_y+(id%4)*5 AS max_y FROM v_boxes WHERE min_y < 60), (SELECT unnest(['web_mercator','equal_earth','local_azimuthal']) AS mode)",
)
def _(spark, d):
    b = V.boxes(spark, d).where("min_y < 60").withColumn("max_y", F.col("max_y") + F.col("id") % 4 * 5)
    b = b.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in ("web_mercator", "equal_earth", "local_azimuthal")])))
    return b.select("id", "mode", fr.honest_mode(F.col("min_y"), F.col("max_y"), F.col("mode")).alias("used"))


@query(
    "widened_request",
    "SELECT id, round(greatest(-70.5,min_x-0.09*(max_x-min_x)),6) AS west, round(greatest(11.0,min_y-0.09*(max_y-min_y)),6) AS south, round(least(43.0,max_x+0.09*(max_x-min_x)),6) AS east, round(least(90.0,max_y+0.09*(max_y-min_y)),6) AS north, round(greatest(1e-9,least((max_x-min_x)/63,(max_y-min_y)/31)),9) AS probe FROM v_boxes",
)
def _(spark, d):
    b = V.boxes(spark, d)
    f = b.select("id", fr.widened(*_c()).alias("f"), F.round(fr.probe_step(*_c(), 32, 64), 9).alias("probe"))
    return f.select("id", *[R(f"f.{k}").alias(k) for k in ("west", "south", "east", "north")], "probe")


@query(
    "sheet_sizes",
    """SELECT p_partkey, round(CASE WHEN w > 0 AND h > 0 THEN greatest(1, sqrt(w*h/1920000)) ELSE 1 END,6) AS scale, greatest(1, floor(w*greatest(h,1)+0.5)::INT) AS pixels,
    CASE WHEN w/h >= 1 THEN 1600.0 ELSE floor(1600*w/h+0.5) END AS sheet_w, CASE WHEN w/h >= 1 THEN floor(1600/(w/h)+0.5) ELSE 1600.0 END AS sheet_h FROM (SELECT p_partkey, p_size*130.0::DOUBLE AS w, p_retailprice::DOUBLE AS h FROM part)""",
)
def _(spark, d):
    p = V.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 130.0).alias("w"), F.col("p_retailprice").cast("double").alias("h"))
    s = p.select("p_partkey", R(fr.line_scale(F.col("w"), F.col("h"))).alias("scale"), fr.pixels(F.col("w"), F.col("h")).alias("pixels"), fr.fitted_sheet(F.col("w"), F.col("h"), 1200, 1600).alias("s"))
    return s.select("p_partkey", "scale", "pixels", F.col("s.width").alias("sheet_w"), F.col("s.height").alias("sheet_h"))


@query(
    "parse_inches",
    """SELECT p_partkey, CASE WHEN p_partkey%5 IN (0,1,2) AND p_size > 0 THEN p_size::DOUBLE END AS width, CASE WHEN p_partkey%5 IN (0,1,2) AND p_size > 0 THEN 12.5::DOUBLE END AS height FROM part""",
)
def _(spark, d):
    size = F.col("p_size").cast("string")
    kinds = [F.concat(size, F.lit("x12.5")), F.concat(size, F.lit("X12.5")), F.concat(size, F.lit(",:12.5")), F.concat(size, F.lit("x")), F.concat(size, F.lit("x12x5"))]
    p = V.table(spark, d, "part").select("p_partkey", fr.parse_inches(F.get(F.array(*kinds), (F.col("p_partkey") % 5).cast("int"))).alias("s"))
    return p.select("p_partkey", "s.width", "s.height")


_CANVAS = fr.Canvas(-180.0, -80.0, 180.0, 80.0, 1200.0, 800.0, 1.5, 30.0, 12.0, -7.0)
# margin 48, fit = min(1104/360, 704/160), offsets 48 and (800-160*fit)/2; about the middle (600, 400)
_FIT = "(1104.0::DOUBLE/360)"
_SCREEN = f"(SELECT event_id, lon, lat, (1200-360*{_FIT})/2+(lon+180)*{_FIT}-600 AS dx, (800-160*{_FIT})/2+(80-lat)*{_FIT}-400 AS dy FROM v_points)"


@query("world_to_screen", f"SELECT event_id, round(612+1.5*(dx*cos(radians(30))-dy*sin(radians(30))),6) AS x, round(393+1.5*(dx*sin(radians(30))+dy*cos(radians(30))),6) AS y, round(lon,6) AS back_lon, round(lat,6) AS back_lat FROM {_SCREEN}")
def _(spark, d):
    p = V.points(spark, d).select("event_id", _CANVAS.to_screen(F.col("lon"), F.col("lat")).alias("s"))
    p = p.withColumn("w", _CANVAS.to_world(F.col("s.x"), F.col("s.y")))
    return p.select("event_id", R("s.x").alias("x"), R("s.y").alias("y"), R("w.x").alias("back_lon"), R("w.y").alias("back_lat"))


@query(
    "label_boxes",
    "SELECT place_id, round(x-greatest(4.0/40,length(name)*4.0/200)/2,6) AS min_x, round(y-4.0/110,6) AS min_y, round(x+greatest(4.0/40,length(name)*4.0/200)/2,6) AS max_x, round(y+4.0/110,6) AS max_y FROM v_places",
)
def _(spark, d):
    p = V.places(spark, d).select("place_id", fr.label_box(F.col("x"), F.col("y"), F.col("name"), F.lit(4.0)).alias("b"))
    return p.select("place_id", *[R(f"b.{k}").alias(k) for k in ("min_x", "min_y", "max_x", "max_y")])


_HALF = "(SELECT event_id, (lon+180)*3 AS x, (lat+90)*4 AS y, radians(event_id%180) AS a FROM v_points)"
_AT = "x+sx*40*cos(a)-sy*10*sin(a) AS px, y+sx*40*sin(a)+sy*10*cos(a) AS py"


@query(
    "label_fits",
    f"SELECT event_id, bool_and(px >= 0 AND px < 1080 AND py >= 0 AND py < 720) AS fits FROM (SELECT event_id, {_AT} FROM {_HALF}, (VALUES (-1,-1),(1,-1),(1,1),(-1,1)) t(sx, sy)) GROUP BY event_id HAVING NOT bool_or(abs(px) < 1e-6 OR abs(py) < 1e-6 OR abs(px-1080) < 1e-6 OR abs(py-720) < 1e-6)",
)
def _(spark, d):
    p = V.points(spark, d).select("event_id", ((F.col("lon") + 180) * 3).alias("x"), ((F.col("lat") + 90) * 4).alias("y"), (F.col("event_id") % 180).cast("double").alias("a"))
    on = lambda k: fr.label_fits(F.col("x"), F.col("y"), F.lit(80.0 + k), F.lit(20.0 + k), F.col("a"), 1080.0, 720.0)
    # rows within rounding of the edge are left to neither side
    near = F.lit(False)
    for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        a = F.radians("a")
        px, py = F.col("x") + sx * 40 * F.cos(a) - sy * 10 * F.sin(a), F.col("y") + sx * 40 * F.sin(a) + sy * 10 * F.cos(a)
        near = near | (F.abs(px) < 1e-6) | (F.abs(py) < 1e-6) | (F.abs(px - 1080) < 1e-6) | (F.abs(py - 720) < 1e-6)
    return p.where(~near).select("event_id", on(0).alias("fits"))


@query(
    "label_priority",
    "SELECT p_partkey, CASE l WHEN 'places' THEN CASE k WHEN 'city' THEN 0 WHEN 'town' THEN 1 WHEN 'hamlet' THEN 5 ELSE 7 END WHEN 'summits' THEN 100 WHEN 'street_names' THEN 200 WHEN 'shops' THEN 400 ELSE 500 END AS priority FROM (SELECT p_partkey, ['places','summits','street_names','shops','water'][p_partkey%5+1] AS l, ['city','town','hamlet','castle'][p_size%4+1] AS k FROM part)",
)
def _(spark, d):
    pick = lambda names, at: F.get(F.array(*[F.lit(n) for n in names]), at.cast("int"))
    layer, kind = pick(("places", "summits", "street_names", "shops", "water"), F.col("p_partkey") % 5), pick(("city", "town", "hamlet", "castle"), F.col("p_size") % 4)
    return V.table(spark, d, "part").select("p_partkey", fr.label_priority(layer, kind).alias("priority"))


@query("label_types", "SELECT id, CASE WHEN kind LIKE 'place=%' OR kind LIKE 'amenity=%' OR kind LIKE 'shop=%' THEN split_part(kind,'=',2) ELSE 'feature' END AS type FROM v_tags")
def _(spark, d):
    return V.tags(spark, d).select("id", fr.label_type(F.col("tags"), F.lit("feature")).alias("type"))


@query("resolved_names", "SELECT s_suppkey, CASE s_suppkey%4 WHEN 0 THEN 'Terrain' WHEN 1 THEN 'Night' ELSE 'Classic' END AS name FROM supplier")
def _(spark, d):
    asked = F.get(F.array(F.lit(" terrain "), F.lit("NIGHT"), F.lit(""), F.lit("none")), (F.col("s_suppkey") % 4).cast("int"))
    return V.table(spark, d, "supplier").select("s_suppkey", fr.resolved_name(asked, ["Classic", "Terrain", "Night"], "Classic").alias("name"))


@query("smoothing_iterations", "SELECT p_partkey, floor((CASE WHEN p_partkey%3=0 THEN p_size ELSE 2 END)*(p_partkey%4)*0.5+0.5)::INT AS n FROM part")
def _(spark, d):
    own = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size"))
    return V.table(spark, d, "part").select("p_partkey", fr.smoothing_iterations(own, 2, F.col("p_partkey") % 4 * 0.5).alias("n"))


@query("form_encoded", "SELECT page_id, url_encode(url) AS encoded FROM pages WHERE url IS NOT NULL")
def _(spark, d):
    return V.table(spark, d, "pages").where("url IS NOT NULL").select("page_id", fr.form_encoded(F.col("url")).alias("encoded"))


@query("rolling_window", "SELECT event_id, strftime(ts - INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%S') AS starttime, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS endtime FROM v_points")
def _(spark, d):
    return V.points(spark, d).select("event_id", fr.rolling_window(F.col("ts"), 7).alias("w")).select("event_id", "w.*")
