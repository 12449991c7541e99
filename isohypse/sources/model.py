"""The one schema that every source gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import Box, boxes_intersect, finite

VERTEX = "struct<x:double,y:double>"
GEOMETRY = f"struct<kind:string,parts:array<array<array<{VERTEX}>>>>"
FEATURES = f"id string, layer string, source string, provenance string, geom {GEOMETRY}, props map<string,string>"
CELLS = "field_id string, row int, col int, value double"

#: Layers in drawing order.
LAYERS = ("bathymetry", "depth_bands", "water", "natural", "landuse", "parks", "forests", "fields", "buildings", "roads", "railways", "ferry_routes", "coastline", "barriers", "power", "amenities", "shops", "places", "seamark_areas", "seamark_harbours", "seamark_hazards", "seamark_beacons", "seamark_buoys", "seamark_lights")


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom.parts))


def with_extent(features: DataFrame) -> DataFrame:
    """Adds min_x, min_y, max_x, max_y; rows without finite vertices go."""
    ok = F.filter(vertices(F.col("geom")), lambda p: finite(p.x) & finite(p.y))
    out = features.withColumn("_v", ok).where(F.size("_v") > 0)
    xs, ys = F.transform("_v", lambda p: p.x), F.transform("_v", lambda p: p.y)
    return out.withColumns({"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}).drop("_v")


def in_box(features: DataFrame, box: Box) -> DataFrame:
    """Features whose box meets the query's."""
    return features.where(boxes_intersect(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), box))


def is_empty(geom: Column) -> Column:
    """No part with enough vertices for its kind: 1 for points, 2 for lines, 4 for rings."""
    least = F.when(geom.kind.contains("olygon"), 4).when(geom.kind.contains("ine"), 2).otherwise(1)
    return geom.isNull() | ~F.exists(geom.parts, lambda part: F.size(F.get(part, 0)) >= least)
