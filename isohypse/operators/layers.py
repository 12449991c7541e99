"""Operators on a scene's layers: bounds, claims, order, turns of drawing, styles, selections, texts.

layers are rows (scene, pos, name, n_features, n_labels, visible, and style columns); a
scene's layers are few, so that windows over a scene are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.strings import thousands

#: Road layers from major to minor, and those that carry labels.
ROADS = ("roads_motorway", "roads_trunk", "roads_primary", "roads_secondary", "roads_tertiary", "roads_residential", "roads_service", "roads_other", "roads")
LABELS = ("places", "shops", "amenities", "summits", "satellite_tracks")
#: Layers that show the sea.
MARINE = ("seamark_lights", "seamark_buoys", "seamark_beacons", "seamark_hazards", "seamark_harbours", "seamark_areas", "bathymetry", "depth_bands", "current_streamlines")
#: The notice on sheets that show the sea.
NOTICE = "NOT FOR NAVIGATION · not a charted survey, and not corrected by Notices to Mariners"
#: Named regions, west to north.
REGIONS = (
    ("World", -180, -60, 180, 84),
    ("Africa", -18, -35, 52, 38),
    ("Asia", 26, -11, 180, 78),
    ("Europe", -25, 34, 45, 72),
    ("North America", -168, 7, -52, 84),
    ("Oceania", 112, -48, 180, 0),
    ("South America", -82, -56, -34, 13),
    ("Antarctica", -180, -85, 180, -60),
    ("Mediterranean", -6, 30, 37, 46),
)


def regions(spark) -> DataFrame:
    """name, west, south, east, north."""
    return spark.createDataFrame([(n, *map(float, b)) for n, *b in REGIONS], "name string, west double, south double, east double, north double")


def content_bounds(features: DataFrame, keys: list[str]) -> DataFrame:
    """The box of all visible features of each scene."""
    shown = features.where("visible")
    return shown.groupBy(*keys).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


# ---- claims ------------------------------------------------------------------------------


def surveyed_share(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, share: the mean of `surveyed` over cells with a finite depth under 0; 0 without any."""
    sea = geo.finite(F.col("depth")) & (F.col("depth") < 0)
    return cells.groupBy(*keys).agg(F.coalesce(F.avg(F.when(sea, F.col("surveyed"))), F.lit(0.0)).alias("share"))


def claims(samples: DataFrame, keys: list[str]) -> DataFrame:
    """keys, provenance: measured if there are samples and all are surveyed, else approximate."""
    whole = F.coalesce(F.min(F.when(F.col("sample").isNotNull(), F.col("sample") >= 0.999)), F.lit(False))
    return samples.groupBy(*keys).agg(F.when(whole, "measured").otherwise("approximate").alias("provenance"))


def observation_date(metadata: DataFrame, keys: list[str]) -> DataFrame:
    """keys, observed: the earliest day of any source's observation time."""
    named = (F.col("key") == "erddap_time") | F.col("key").endswith(".erddap_time")
    return metadata.groupBy(*keys).agg(F.min(F.when(named, F.split("value", "T")[0])).alias("observed"))


def notice(observed: Column) -> Column:
    return F.concat_ws(" · ", F.lit(NOTICE), F.when(observed.isNotNull(), F.concat(F.lit("ocean data "), observed)))


def shows_sea(layers: DataFrame) -> DataFrame:
    """scene, marine: whether a layer of the sea has features or labels."""
    own = F.col("name").isin(*MARINE) & ((F.col("n_features") > 0) | (F.col("n_labels") > 0))
    return layers.groupBy("scene").agg(F.max(own).alias("marine"))


# ---- inventories -------------------------------------------------------------------------


def summary(layers: DataFrame) -> DataFrame:
    """scene, summary: how many layers have something, and how many features these are."""
    n, total = F.count(F.when(F.col("n_features") > 0, 1)), F.sum("n_features")
    text = F.concat(n.cast("string"), F.when(n == 1, " layer").otherwise(" layers"), F.lit(" · "), thousands(total), F.lit(" features"))
    return layers.groupBy("scene").agg(F.when(n == 0, "Nothing to draw").otherwise(text).alias("summary"))


def toggleable(layers: DataFrame) -> DataFrame:
    """scene, names: layers with features, in drawing order."""
    rows = F.collect_list(F.when(F.col("n_features") > 0, F.struct("pos", "name")))
    return layers.groupBy("scene").agg(F.transform(F.array_sort(rows), lambda r: r["name"]).alias("names"))


def legend(layers: DataFrame, entries: int = 10) -> DataFrame:
    """scene, entry, name: the first visible layers with features, in drawing order."""
    entry = F.row_number().over(Window.partitionBy("scene").orderBy("pos"))
    shown = layers.where((F.col("n_features") > 0) & F.col("visible"))
    return shown.withColumn("entry", entry).where(F.col("entry") <= entries).select("scene", "entry", "name")


def newest(rows: DataFrame, keys: list[str], token: str, most: int = 8) -> DataFrame:
    """The rows with the highest tokens of each key."""
    helper = f"{token}_age_rank"
    age = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(token)))
    return rows.withColumn(helper, age).where(F.col(helper) <= most).drop(helper)


def selected_layers(asked: Column, supported: list[str]) -> Column:
    """The asked layers that are supported, in the supported order; all of them if none is."""
    all_ = F.array(*[F.lit(s) for s in supported])
    own = F.array_intersect(all_, asked)
    return F.when(F.size(own) > 0, own).otherwise(all_)


# ---- order -------------------------------------------------------------------------------


def relief_raised(layers: DataFrame, relief: str = "terrain_hillshade") -> DataFrame:
    """Layers with `rank`: the shading moves up to just under the first layer with labels."""
    scene = Window.partitionBy("scene")
    first = F.min(F.when(F.col("name").isin(*LABELS), F.col("pos"))).over(scene)
    last = F.max("pos").over(scene) + 1
    key = F.when(F.col("name") == relief, F.coalesce(first, last) - 0.5).otherwise(F.col("pos").cast("double"))
    return layers.withColumn("rank", F.row_number().over(scene.orderBy(key, "pos")))


def turns(layers: DataFrame) -> DataFrame:
    """scene, turn, name, part: what is drawn when.

    In each run of neighbouring road layers all casings come before all bodies; other layers
    are drawn whole.
    """
    road = F.col("name").isin(*ROADS)
    order = Window.partitionBy("scene").orderBy("pos")
    begins = F.when(road & F.coalesce(F.lag(road).over(order), F.lit(False)), 0).otherwise(1)
    runs = layers.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cased = F.when((F.col("casing") > 0) & (F.col("n_features") > 0), F.array(F.lit("casing"), F.lit("body"))).otherwise(F.array(F.lit("body")))
    parts = runs.withColumn("part", F.explode(F.when(road, cased).otherwise(F.array(F.lit("whole")))))
    turn = F.row_number().over(Window.partitionBy("scene").orderBy("run", F.when(F.col("part") == "casing", 0).otherwise(1), "pos"))
    return parts.select("scene", turn.alias("turn"), "name", "part")


def sea_first(inferred: DataFrame, water: DataFrame) -> DataFrame:
    """Inferred sea before fetched water, so that it lies under it: an order column beside the rows."""
    return inferred.withColumn("under", F.lit(0)).unionByName(water.withColumn("under", F.lit(1)))


# ---- styles and settings -----------------------------------------------------------------


def styled(layers: DataFrame, explicit: DataFrame, derived: DataFrame, default: float = 0.5) -> DataFrame:
    """scene, name, width: a layer's own style, else the derived one, else a thin line.

    explicit and derived: name, width.
    """
    own = explicit.select("name", F.col("width").alias("own_width"))
    other = derived.select("name", F.col("width").alias("derived_width"))
    return layers.join(own, "name", "left").join(other, "name", "left").select("scene", "name", F.coalesce("own_width", "derived_width", F.lit(default)).alias("width"))


def scaled_widths(layers: DataFrame, columns: list[str], scale: float) -> DataFrame:
    return layers.withColumns({c: F.col(c) * scale for c in columns})


def overrides(defaults: DataFrame, values: DataFrame) -> DataFrame:
    """source, attribute, value: only settings that differ from their defaults, by their target names.

    defaults: source, key, attribute, value; values: source, key, value.
    """
    now = values.select("source", "key", F.col("value").alias("now"))
    met = defaults.join(now, ["source", "key"])
    return met.where(F.col("now").isNotNull() & ~F.col("now").eqNullSafe(F.col("value"))).select("source", "attribute", F.col("now").alias("value"))


def synced_frames(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds `sync`: the frame changed and the one before it had settled. frames: frame, settled."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag("frame").over(w)
    return frames.withColumn("sync", F.coalesce(F.col("settled") & before.isNotNull() & (before != F.col("frame")), F.lit(False)))


def first_listed(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """The first rows of each listing."""
    helper = f"{order}_listed_rank"
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn(helper, rank).where(F.col(helper) <= most).drop(helper)


# ---- geometries --------------------------------------------------------------------------


def map_vertices(parts: Column, to) -> Column:
    """Every vertex of any geometry's parts through a function of (x, y)."""
    return F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: to(p.x, p.y))))


def has_area(geom: Column) -> Column:
    return geom.kind.contains("olygon") & F.exists(geom.parts, lambda part: F.size(F.get(part, 0)) > 0)


def polygons(geom: Column) -> Column:
    """The polygons of a geometry, none for lines and points."""
    return F.when(geom.kind.contains("olygon"), F.filter(geom.parts, lambda part: F.size(F.get(part, 0)) > 0)).otherwise(F.slice(geom.parts, 1, 0))


def lines(geom: Column) -> Column:
    """The lines of a geometry, none for polygons and points."""
    return F.when(geom.kind.contains("LineString"), F.filter(geom.parts, lambda part: F.size(F.get(part, 0)) > 0)).otherwise(F.slice(geom.parts, 1, 0))


def normal_kind(parts: Column, kind: str) -> Column:
    """Empty, the kind, or its multiple, by the number of parts."""
    return F.when(F.size(parts) == 0, "Empty").when(F.size(parts) == 1, kind).otherwise(f"Multi{kind}")


def along(line: Column, distance: Column) -> Column:
    """The point at a distance along a line; its end beyond it."""
    pairs = F.arrays_zip(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))).alias("p"), F.slice(line, 2, F.size(line)).alias("q"))
    start = F.struct(F.lit(0.0).alias("gone"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))

    def step(s: Column, e: Column) -> Column:
        size = F.sqrt((e.q.x - e.p.x) * (e.q.x - e.p.x) + (e.q.y - e.p.y) * (e.q.y - e.p.y))
        t = (distance - s.gone) / size
        here = F.struct((e.p.x + (e.q.x - e.p.x) * t).alias("x"), (e.p.y + (e.q.y - e.p.y) * t).alias("y"))
        return F.struct((s.gone + size).alias("gone"), F.when(s["at"].isNull() & (size > 0) & (distance <= s.gone + size), here).otherwise(s["at"]).alias("at"))

    return F.coalesce(F.aggregate(pairs, start, step)["at"], F.element_at(line, -1))


def line_anchor(line: Column) -> Column:
    """Where a street's label stands: half its length along it."""
    return along(line, geo.length(line) / 2)


def uphill_left(line: Column, left_value: Column, level: Column) -> Column:
    """The line, turned round where the value left of its middle is finite and under the level."""
    return F.when(geo.finite(left_value) & (left_value < level), F.reverse(line)).otherwise(line)


def left_probe(line: Column, step: float) -> Column:
    """The point a step to the left of the middle of a line's middle segment."""
    k = F.floor(F.size(line) / 2).cast("int")
    p, q = F.get(line, k - 1), F.get(line, k)
    size = F.sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y))
    point = F.struct(((p.x + q.x) / 2 - (q.y - p.y) / size * step).alias("x"), ((p.y + q.y) / 2 + (q.x - p.x) / size * step).alias("y"))
    return F.when((F.size(line) >= 2) & (size > 0), point)


def sampled_vertices(shapes: DataFrame, cells: DataFrame, west: float, north: float, step: float) -> DataFrame:
    """id, pos, value: the nearest cell's value at each vertex of a line. shapes: id, line."""
    at = shapes.select("id", F.posexplode("line").alias("pos", "p"))
    near = lambda v: F.floor(v / step + 0.5).cast("int")
    at = at.select("id", "pos", near(F.lit(north) - F.col("p.y")).alias("row"), near(F.col("p.x") - west).alias("col"))
    return at.join(cells.select("row", "col", "value"), ["row", "col"], "left").select("id", "pos", "value")


def typed(value: Column) -> Column:
    """A property's text as kind, integer, number and truth; a whole number is a number too."""
    whole, real = F.when(value.rlike(r"^[+-]?\d{1,18}$"), value.cast("bigint")), F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value.cast("double"))
    truth = F.when(value.isin("true", "false"), value == "true")
    kind = F.when(value.isNull(), None).when(truth.isNotNull(), "bool").when(whole.isNotNull(), "int").when(real.isNotNull(), "double").otherwise("string")
    return F.struct(kind.alias("kind"), value.alias("text"), whole.alias("whole"), real.alias("real"), truth.alias("truth"))
