"""GeoJSON and line-wise GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import classify, name_of
from .model import GEOMETRY, is_empty, with_extent

_POSITION = "array<double>"
#: Depth of nesting of the coordinates of each kind.
_KINDS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def _vertex(p: Column) -> Column:
    return F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))


def _line(positions: Column) -> Column:
    return F.transform(positions, _vertex)


def geometry(text: Column) -> Column:
    """The geometry of a JSON text; a part without siblings loses its Multi, heights are dropped."""
    kind = F.get_json_object(text, "$.type")
    coords = F.get_json_object(text, "$.coordinates")
    out = F.when(text.isNull(), F.lit(None).cast(GEOMETRY))
    for name, depth in _KINDS.items():
        nested = F.from_json(coords, "array<" * depth + _POSITION + ">" * depth)
        if depth == 0:
            parts = F.array(F.array(F.array(_vertex(nested))))
        elif name == "MultiPoint":
            parts = F.transform(nested, lambda p: F.array(F.array(_vertex(p))))
        elif name == "LineString":
            parts = F.array(F.array(_line(nested)))
        elif name == "MultiLineString":
            parts = F.transform(nested, lambda ps: F.array(_line(ps)))
        elif name == "Polygon":
            parts = F.array(F.transform(nested, _line))
        else:
            parts = F.transform(nested, lambda rings: F.transform(rings, _line))
        parts = F.filter(parts, lambda part: F.size(F.get(part, 0)) > 0)
        single = name.replace("Multi", "")
        out = out.when(kind == name, F.when(nested.isNotNull(), F.struct(F.when(F.size(parts) == 1, single).otherwise(name).alias("kind"), parts.alias("parts"))))
    return out


def from_objects(objects: DataFrame, source: str) -> DataFrame:
    """objects: file, pos, json (a Feature each) -> features; layers from `layer` or the tags."""
    props = F.from_json(F.get_json_object("json", "$.properties"), "map<string,string>")
    out = objects.withColumn("props", props).withColumn("geom", geometry(F.get_json_object("json", "$.geometry")))
    out = out.where(~is_empty(F.col("geom")))
    layer = F.coalesce(F.element_at("props", "layer"), classify(F.col("props")), F.lit("features"))
    own = F.coalesce(F.get_json_object("json", "$.id"), F.concat_ws("/", F.lit(source), layer, F.col("pos").cast("string")))
    named = F.map_filter("props", lambda k, v: v.isNotNull())
    rows = out.select(own.alias("id"), layer.alias("layer"), F.lit(source).alias("source"), F.lit("measured").alias("provenance"), "geom", named.alias("props"))
    rows = rows.withColumn("name", name_of(F.col("props")))
    return with_extent(rows)


def read(spark: SparkSession, path: str | list[str], source: str = "file") -> DataFrame:
    """Files with a FeatureCollection, a Feature, or anything with `features`."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    many = F.from_json(F.get_json_object("value", "$.features"), "array<string>")
    objects = files.select("file", F.posexplode(F.coalesce(many, F.array("value"))).alias("pos", "json"))
    return from_objects(objects, source)


def read_lines(spark: SparkSession, path: str, source: str = "file") -> DataFrame:
    """One object a line; lines that can't be read are skipped.

    A feature without an id is named by its file and text, whatever the file's splits.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.hex(F.xxhash64(F.input_file_name(), "value")).alias("pos"), F.col("value").alias("json"))
    return from_objects(lines.where(F.get_json_object("json", "$.type") == "Feature"), source)
