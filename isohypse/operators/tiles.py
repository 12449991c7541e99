"""Tiles and samples: which tiles cover a box, mosaics of tiles, values of a grid at points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import Box


def tile_range(box: Box, zoom: int) -> tuple[int, int, int, int]:
    """First and last column, first and last row (row 0 in the north)."""
    n = 1 << zoom

    def at(lon: float, lat: float) -> tuple[int, int]:
        lat = math.radians(max(-geo.MAX_LATITUDE, min(geo.MAX_LATITUDE, lat)))
        x, y = (lon + 180) / 360 * n, (1 - math.log(math.tan(lat) + 1 / math.cos(lat)) / math.pi) / 2 * n
        return max(0, min(n - 1, int(x))), max(0, min(n - 1, int(y)))

    (x0, y0), (x1, y1) = at(box.min_lon, box.max_lat), at(box.max_lon, box.min_lat)
    return x0, x1, y0, y1


def choose_zoom(box: Box, target_pixels: int, most_tiles: int = 256, deepest: int = 15) -> int:
    """The deepest zoom whose box is no wider than the target and takes at most so many tiles."""
    best = 0
    for zoom in range(deepest + 1):
        x0, x1, y0, y1 = tile_range(box, zoom)
        if box.lon_span / 360 * geo.world_pixels(zoom) <= target_pixels and (x1 - x0 + 1) * (y1 - y0 + 1) <= most_tiles:
            best = zoom
    return best


def covering(spark: SparkSession, box: Box, zoom: int, cap: int | None = None) -> DataFrame:
    """x, y of the covering tiles, column by column; at most `cap` of them where one is set."""
    x0, x1, y0, y1 = tile_range(box, zoom)
    out = spark.range((x1 - x0 + 1) * (y1 - y0 + 1)).select((F.floor(F.col("id") / (y1 - y0 + 1)) + x0).cast("int").alias("x"), (F.col("id") % (y1 - y0 + 1) + y0).cast("int").alias("y"))
    return out.orderBy("x", "y").limit(cap) if cap else out


def mosaic(tiles: DataFrame, box: Box, zoom: int, size: int = 256, most_tiles: int = 256) -> DataFrame:
    """Cells of one field out of tiles' cells (x, y, row, col, value); missing tiles stay NaN."""
    x0, x1, y0, y1 = tile_range(box, zoom)
    if (x1 - x0 + 1) * (y1 - y0 + 1) > most_tiles:
        raise ValueError(f"{(x1 - x0 + 1) * (y1 - y0 + 1)} tiles are more than {most_tiles}")
    own = tiles.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).select(((F.col("y") - y0) * size + F.col("row")).alias("row"), ((F.col("x") - x0) * size + F.col("col")).alias("col"), "value")
    rows, cols = (y1 - y0 + 1) * size, (x1 - x0 + 1) * size
    grid = tiles.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    return grid.join(own, ["row", "col"], "left").select(F.lit("mosaic").alias("field_id"), "row", "col", F.coalesce("value", F.lit(float("nan"))).alias("value"))


def grid_position(lon: Column, lat: Column, box: Box, rows: int, cols: int) -> tuple[Column, Column]:
    """Fractional row and column of a place in a grid whose outer nodes lie on the box."""
    return (box.max_lat - lat) / (box.lat_span / max(1, rows - 1)), (lon - box.min_lon) / (box.lon_span / max(1, cols - 1))


def to_lonlat(row: Column, col: Column, box: Box, rows: int, cols: int) -> Column:
    return F.struct((box.min_lon + col * (box.lon_span / max(1, cols - 1))).alias("lon"), (box.max_lat - row * (box.lat_span / max(1, rows - 1))).alias("lat"))


def _clamped(v: Column, n: int) -> Column:
    return F.greatest(F.least(v, F.lit(n - 1)), F.lit(0)).cast("int")


def sample_nearest(points: DataFrame, cells: DataFrame, box: Box, rows: int, cols: int) -> DataFrame:
    """points (lon, lat) with the value of the nearest cell: an equi-join on its row and column."""
    r, c = grid_position(F.col("lon"), F.col("lat"), box, rows, cols)
    at = points.withColumn("row", _clamped(F.round(r), rows)).withColumn("col", _clamped(F.round(c), cols))
    return at.join(cells.select("row", "col", "value"), ["row", "col"], "left").drop("row", "col")


def sample_bilinear(points: DataFrame, cells: DataFrame, box: Box, rows: int, cols: int, key: str) -> DataFrame:
    """key, value: four corners a point, weighted; a missing corner makes the value missing."""
    r, c = grid_position(F.col("lon"), F.col("lat"), box, rows, cols)
    at = points.withColumn("_r", F.greatest(F.least(r, F.lit(rows - 1.0)), F.lit(0.0))).withColumn("_c", F.greatest(F.least(c, F.lit(cols - 1.0)), F.lit(0.0)))
    at = at.withColumn("_r0", _clamped(F.floor("_r"), max(1, rows - 1))).withColumn("_c0", _clamped(F.floor("_c"), max(1, cols - 1)))
    fr, fc = F.col("_r") - F.col("_r0"), F.col("_c") - F.col("_c0")
    corner = lambda dr, dc, w: F.struct((F.col("_r0") + dr).alias("row"), (F.col("_c0") + dc).alias("col"), w.alias("w"))
    corners = at.withColumn("k", F.explode(F.array(corner(0, 0, (1 - fr) * (1 - fc)), corner(0, 1, (1 - fr) * fc), corner(1, 0, fr * (1 - fc)), corner(1, 1, fr * fc)))).where("k.w > 0").select(key, "k.row", "k.col", "k.w")
    met = corners.join(cells.select("row", "col", "value"), ["row", "col"], "left")
    missing = F.max(F.when(geo.finite(F.col("value")), 0).otherwise(1))
    return met.groupBy(key).agg(F.when(missing == 0, F.sum(F.col("value") * F.col("w"))).alias("value"))


def image_size(box: Box, longest: int) -> tuple[int, int]:
    """Width and height: the longer side as asked for, the other in proportion, two at least."""
    if box.lon_span >= box.lat_span:
        return longest, max(2, round(longest * box.lat_span / box.lon_span))
    return max(2, round(longest * box.lon_span / box.lat_span)), longest


def stride(cells: int, target: int) -> int:
    return max(1, round(cells / target))


def split_at_antimeridian(rings: DataFrame, key: str) -> DataFrame:
    """key, ring: closed rings whose longitudes go beyond +-180, as pieces inside the world."""
    out = None
    world = Box(-180.0, -90.0, 180.0, 90.0)
    for shift in (-360.0, 0.0, 360.0):
        moved = F.transform("ring", _shifted(shift))
        part = rings.select(key, geo.clip_ring(moved, world).alias("ring")).where("ring IS NOT NULL AND size(ring) >= 4")
        out = part if out is None else out.unionByName(part)
    return out


def _shifted(by: float):
    return lambda p: F.struct((p.x + by).alias("x"), p.y.alias("y"))
