"""GeoJSON, SVG paths and diagnostics as text rows and files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import finite, oriented
from ..functions.strings import compact_number, svg_id, xml_escape


def _position(p: Column) -> Column:
    return F.concat(F.lit("["), compact_number(p.x), F.lit(","), compact_number(p.y), F.lit("]"))


def _positions(line: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(line, _position), ","), F.lit("]"))


def _written(geom: Column) -> Column:
    """The parts without a vertex that isn't finite."""
    return F.filter(geom.parts, lambda part: ~F.exists(F.flatten(part), lambda p: ~(finite(p.x) & finite(p.y))) & (F.size(F.get(part, 0)) > 0))


def geometry_json(geom: Column) -> Column:
    """The geometry's GeoJSON or null: shells run counter-clockwise, holes clockwise.

    Parts with a vertex that isn't finite are dropped; a part without siblings loses its Multi.
    """
    ok = _written(geom)
    base = F.replace(geom.kind, F.lit("Multi"), F.lit(""))
    ring = lambda r, i: _positions(F.when(i == 0, oriented(r, True)).otherwise(oriented(r, False)))
    rings = lambda part: F.concat(F.lit("["), F.array_join(F.transform(part, ring), ","), F.lit("]"))
    each = F.transform(ok, lambda part: F.when(base == "Polygon", rings(part)).when(base == "LineString", _positions(F.get(part, 0))).otherwise(_position(F.get(F.get(part, 0), 0))))
    one = F.concat(F.lit('{"type":"'), base, F.lit('","coordinates":'), F.get(each, 0), F.lit("}"))
    many = F.concat(F.lit('{"type":"Multi'), base, F.lit('","coordinates":['), F.array_join(each, ","), F.lit("]}"))
    return F.when(F.size(ok) == 1, one).when(F.size(ok) > 1, many)


def feature_rows(features: DataFrame) -> DataFrame:
    """layer, id, json: a Feature each; features whose geometry can't be written go.

    That is asked of the parts, as a filter on the text would make the text twice.
    """
    writable = F.col("geom.kind").isNotNull() & (F.coalesce(F.size(_written(F.col("geom"))), F.lit(0)) > 0)
    geometry = geometry_json(F.col("geom"))
    text = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.struct(F.col("id").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("id").alias("v")))) - 6), F.lit(',"geometry":'), geometry, F.lit(',"properties":'), F.coalesce(F.to_json("props"), F.lit("{}")), F.lit("}"))
    return features.where(writable).select("layer", "id", text.alias("json"))


def write_layers(features: DataFrame, path: str) -> None:
    """Line-wise GeoJSON, a folder for each layer: written by all tasks, only the layers at hand are replaced."""
    rows = feature_rows(features).select("layer", F.col("json").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").text(path)


def write_collection(features: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """One FeatureCollection: the rows in one file, for outputs that a person opens."""
    rows = feature_rows(features)
    w = F.row_number().over(Window.orderBy("layer", "id"))
    lines = rows.select(w.alias("k"), F.concat(F.when(w > 1, ",").otherwise(""), F.col("json")).alias("value"))
    head = '{"type":"FeatureCollection","metadata":' + json.dumps(metadata or {}, sort_keys=True) + ',"features":['
    spark = features.sparkSession
    ends = spark.createDataFrame([(0, head), (1 << 30, "]}")], "k int, value string")
    lines.unionByName(ends).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def svg_paths(features: DataFrame) -> DataFrame:
    """layer, id, path: an SVG path for each feature, closed for polygons."""
    step = lambda p, i: F.concat(F.when(i == 0, "M").otherwise("L"), compact_number(p.x, 2), F.lit(" "), compact_number(-p.y, 2))
    ring = lambda r: F.concat(F.array_join(F.transform(r, step), ""), F.when(F.col("geom.kind").contains("olygon"), "Z").otherwise(""))
    d = F.array_join(F.transform(F.flatten("geom.parts"), ring), " ")
    return features.select(svg_id(F.col("layer")).alias("layer"), xml_escape(F.col("id")).alias("id"), F.concat(F.lit('<path d="'), d, F.lit('"/>')).alias("path"))


def inventory(features: DataFrame) -> DataFrame:
    """layer, n: how many features each layer has."""
    return features.groupBy("layer").agg(F.count("*").alias("n"))
