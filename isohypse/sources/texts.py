"""Text formats: gridded CSV, orbital elements, event feeds, map-server JSON, geocoder hits, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.strings import detail_text, iso_from_millis
from ..functions.tags import can_be_polygon, classify
from .model import GEOMETRY, with_extent

# ---- gridded CSV -------------------------------------------------------------------------


def read_grid(spark: SparkSession, path: str, *variables: str) -> DataFrame:
    """field_id, row (0 in the north), col and the variables of griddap CSV files.

    A file has a header, a row of units and rows in any order; the grid is the product of
    its latitudes and longitudes, and cells without a row are missing (NaN).
    """
    raw = spark.read.option("header", "true").csv(path).withColumn("field_id", F.input_file_name())
    rows = raw.select("field_id", F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), *[F.col(v).try_cast("double").alias(v) for v in variables])
    rows = rows.where("lat IS NOT NULL AND lon IS NOT NULL")  # the row of units goes here
    lats = rows.select("field_id", "lat").distinct().withColumn("row", F.row_number().over(Window.partitionBy("field_id").orderBy(F.desc("lat"))) - 1)
    lons = rows.select("field_id", "lon").distinct().withColumn("col", F.row_number().over(Window.partitionBy("field_id").orderBy("lon")) - 1)
    grid = lats.join(lons, "field_id").join(rows, ["field_id", "lat", "lon"], "left")
    return grid.select("field_id", "row", "col", "lat", "lon", *[F.coalesce(v, F.lit(float("nan"))).alias(v) for v in variables])


# ---- orbital elements --------------------------------------------------------------------


def element_sets(spark: SparkSession, path: str) -> DataFrame:
    """name, line1, line2 of listings with two or three lines a set; broken sets are skipped."""
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.input_file_name().alias("file"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("pos", "line"))
    w = Window.partitionBy("file").orderBy("pos")
    rows = lines.withColumn("name", F.lag("line").over(w)).withColumn("line2", F.lead("line").over(w))
    rows = rows.where(F.col("line").startswith("1 ") & F.col("line2").startswith("2 ") & (F.length("line") >= 68) & (F.length("line2") >= 63))
    plain = F.when(F.col("name").rlike("^[12] "), None).otherwise(F.trim("name"))
    return rows.select("file", "pos", F.coalesce(plain, F.trim(F.substring("line", 3, 5))).alias("name"), F.col("line").alias("line1"), "line2")


def elements(sets: DataFrame) -> DataFrame:
    """The numbers of each set: degrees, revolutions a day, epoch in seconds since 1970."""
    part = lambda line, a, n: F.trim(F.substring(line, a, n)).try_cast("double")
    yy = part("line1", 19, 2).cast("int")
    year = F.when(yy >= 57, yy + 1900).otherwise(yy + 2000)
    epoch = F.unix_timestamp(F.make_date(year, F.lit(1), F.lit(1)).cast("timestamp")) + (part("line1", 21, 12) - 1) * 86400.0
    return sets.select(
        "name",
        F.trim(F.substring("line1", 3, 5)).alias("number"),
        epoch.alias("epoch"),
        part("line2", 9, 8).alias("inclination"),
        part("line2", 18, 8).alias("node"),
        F.concat(F.lit("0."), F.trim(F.substring("line2", 27, 7))).try_cast("double").alias("eccentricity"),
        part("line2", 35, 8).alias("perigee"),
        part("line2", 44, 8).alias("anomaly"),
        part("line2", 53, 11).alias("motion"),
    ).where("motion > 0 AND epoch IS NOT NULL")


# ---- events ------------------------------------------------------------------------------


def read_events(spark: SparkSession, path: str, span: float, source: str = "usgs") -> DataFrame:
    """Earthquakes as circles, a layer for each depth class; events without a magnitude go."""
    schema = "features array<struct<id:string, geometry:struct<coordinates:array<double>>, properties:struct<mag:double, place:string, time:bigint, url:string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    lon, lat, mag = F.get("f.geometry.coordinates", 0), F.get("f.geometry.coordinates", 1), F.col("f.properties.mag")
    depth = F.coalesce(F.get("f.geometry.coordinates", 2), F.lit(0.0))
    rows = rows.where(geo.finite(mag) & geo.finite(lon) & geo.finite(lat))
    ring = geo.circle(lon, lat, geo.magnitude_radius(mag, F.lit(span)))
    geom = F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(geo.close_ring(ring))).alias("parts"))
    name = F.when(mag >= 4, F.format_string("M%.1f", mag))
    props = F.map_filter(F.map_from_arrays(F.array(F.lit("name"), F.lit("place"), F.lit("time"), F.lit("magnitude"), F.lit("depth_km")), F.array(name, F.col("f.properties.place"), iso_from_millis(F.col("f.properties.time")), mag.cast("string"), depth.cast("string"))), lambda k, v: v.isNotNull())
    out = rows.select(F.coalesce("f.id", F.xxhash64("f").cast("string")).alias("id"), geo.depth_bucket(depth).alias("layer"), F.lit(source).alias("source"), F.lit("measured").alias("provenance"), geom.alias("geom"), props.alias("props"), mag.alias("magnitude"))
    return with_extent(out)


# ---- map-server JSON ---------------------------------------------------------------------

_POINTS = "array<struct<lat:double,lon:double>>"


def read_map_elements(spark: SparkSession, path: str) -> DataFrame:
    """type, id, tags, lat, lon, geometry and members of captured responses."""
    schema = f"elements array<struct<type:string, id:bigint, lat:double, lon:double, tags:map<string,string>, geometry:{_POINTS}, members:array<struct<type:string, ref:bigint, role:string, geometry:{_POINTS}>>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("elements"))


def _line(points: Column) -> Column:
    ok = F.filter(points, lambda p: geo.finite(p.lat) & geo.finite(p.lon))
    return F.transform(ok, lambda p: F.struct(p.lon.alias("x"), p.lat.alias("y")))


def map_features(elements_: DataFrame, source: str = "osm") -> DataFrame:
    """Nodes and ways as features (relations: see operators.vector.assemble_relations).

    A closed way is a polygon only if a tag can be one; a way without geometry goes.
    """
    line = _line(F.coalesce("geometry", F.array().cast(_POINTS)))
    kind = F.when(F.col("type") == "node", "Point").when(geo.is_closed(F.col("_line")) & can_be_polygon(F.col("tags")), "Polygon").otherwise("LineString")
    point = F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))
    out = elements_.where("type IN ('node', 'way') AND tags IS NOT NULL").withColumn("_line", line).withColumn("layer", classify(F.col("tags")))
    out = out.where(F.col("layer").isNotNull() & ((F.col("type") == "node") | (F.size("_line") >= 2)))
    parts = F.array(F.array(F.when(F.col("type") == "node", point).otherwise(F.col("_line"))))
    rows = out.select(F.concat_ws("/", "type", F.col("id").cast("string")).alias("id"), "layer", F.lit(source).alias("source"), F.lit("measured").alias("provenance"), F.struct(kind.alias("kind"), parts.alias("parts")).cast(GEOMETRY).alias("geom"), F.col("tags").alias("props"))
    return with_extent(rows)


# ---- geocoder and manifests --------------------------------------------------------------


def read_places(spark: SparkSession, path: str, text: str | None = None) -> DataFrame:
    """name, detail, box, is_boundary of captured hits; queries of under two characters have none."""
    schema = "name string, display_name string, category string, addresstype string, boundingbox array<string>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    if text is not None and len(text.strip()) < 2:
        rows = rows.limit(0)
    b = F.transform("boundingbox", lambda x: x.try_cast("double"))
    rows = rows.withColumn("b", b).where((F.size("b") == 4) & ~F.exists("b", lambda x: x.isNull()))
    name = F.coalesce(F.when(F.trim("name") != "", F.trim("name")), F.trim(F.get(F.split("display_name", ","), 0)))
    wide = lambda low, high: (F.least(low, high - 0.001), F.greatest(high, low + 0.001))
    (s, n), (w, e) = wide(F.get("b", 0), F.get("b", 1)), wide(F.get("b", 2), F.get("b", 3))
    return rows.select(name.alias("name"), detail_text(F.col("display_name"), name).alias("detail"), w.alias("min_lon"), s.alias("min_lat"), e.alias("max_lon"), n.alias("max_lat"), (F.col("category") == "boundary").alias("is_boundary"))


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Plug-in manifests (file, id, name) in the order of their files, and notes on broken ones."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rows = files.select("file", F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.name").alias("name"))
    good = F.col("id").isNotNull() & F.col("name").isNotNull()
    return rows.where(good).orderBy("file"), rows.where(~good).select("file", F.lit("no readable manifest").alias("note"))
