"""Operators on ordered rows: runs, gaps, sessions, ranks, caps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .thinning import thin_labels  # noqa: F401


def runs(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Adds `run`: a number that grows where the value changes along the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(value), 0).otherwise(1)
    return df.withColumn("_new", changed).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def speed_band(speed: Column, low: float, high: float, bands: int) -> Column:
    at = (speed - low) / (high - low) * bands if high > low else F.lit(0.0)
    return F.greatest(F.least(at.cast("int"), F.lit(bands - 1)), F.lit(0))


def azimuth_weight(dx: Column, dy: Column, azimuth: float = 315.0, bands: int = 5, lit: float = 0.4, shadow: float = 1.9) -> Column:
    """Line weight of an edge whose left side is uphill, by how its slope faces the light."""
    a = math.radians(azimuth)
    size = F.sqrt(dx * dx + dy * dy)
    facing = F.when(size > 0, (dy / size) * math.sin(a) + (-dx / size) * math.cos(a)).otherwise(0.0)
    fraction = (1.0 - F.greatest(F.least(facing, F.lit(1.0)), F.lit(-1.0))) / 2.0
    if bands <= 1:
        return F.lit((lit + shadow) / 2.0)
    return lit + (shadow - lit) * (F.round(fraction * (bands - 1)) / (bands - 1))


def antimeridian_runs(track: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds `run`: a new one wherever the longitude jumps by over 180 degrees."""
    w = Window.partitionBy(*keys).orderBy(*order)
    jump = F.coalesce((F.abs(F.col("lon") - F.lag("lon").over(w)) > 180).cast("int"), F.lit(0))
    return track.withColumn("_jump", jump).withColumn("run", F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def coalesce_edits(log: DataFrame, keys: list[str], time: str, kind: str, gap: float = 1.0) -> DataFrame:
    """keys, entry, kind, first, last, n: edits of one kind under `gap` seconds apart are one."""
    w = Window.partitionBy(*keys).orderBy(time)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    apart = seconds - F.lag(seconds).over(w)
    new = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)) & (apart < gap), 0).otherwise(1)
    numbered = log.withColumn("_new", new).withColumn("entry", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "entry").agg(F.first(kind).alias("kind"), F.min(time).alias("first_at"), F.max(time).alias("last_at"), F.count("*").alias("n"))


def source_states(log: DataFrame, source: str, seq: str, state: str) -> DataFrame:
    """source, state, n_changes: each source's last state and how often it changed."""
    w = Window.partitionBy(source).orderBy(seq)
    changed = log.withColumn("_c", F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1))
    return changed.groupBy(F.col(source).alias("source")).agg(F.max_by(state, seq).alias("state"), F.sum("_c").alias("n_changes"))


def capped(features: DataFrame, layer: str, order: list[str], cap: Column) -> DataFrame:
    """The first features of each layer, as many as its cap (a column) says."""
    rank = F.row_number().over(Window.partitionBy(layer).orderBy(*order))
    return features.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def longest_by_name(segments: DataFrame, limit: int = 160) -> DataFrame:
    """name, length, segment_id: the longest segment of each trimmed name, the longest names first."""
    named = segments.withColumn("name", F.trim("name")).where(F.col("name") != "")
    best = named.groupBy("name").agg(F.max(F.struct(F.col("length"), (-F.col("segment_id")).alias("k"))).alias("m"))
    return best.select("name", F.col("m.length").alias("length"), (-F.col("m.k")).alias("segment_id")).orderBy(F.desc("length"), "name").limit(limit)


def weakest(values: DataFrame, keys: list[str], provenance: str) -> DataFrame:
    """The weakest claim of each group."""
    order = ("approximate", "synthetic", "uncalibrated", "measured")
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(provenance))
    return values.groupBy(*keys).agg(F.min_by(provenance, rank).alias("provenance"))


def merged_metadata(rows: DataFrame, promoted: tuple[str, ...]) -> DataFrame:
    """key, value: every entry as source.key, and the promoted keys from the first source in plan order.

    rows: source, pos, key, value.
    """
    own = rows.select(F.concat_ws(".", "source", "key").alias("key"), "value")
    top = rows.where(F.col("key").isin(*promoted) & F.col("value").isNotNull()).groupBy("key").agg(F.min_by("value", "pos").alias("value"))
    return own.unionByName(top)


def evicted(files: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The oldest entries that have to go for the newest to fit the limit. files: id, mtime, bytes."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("mtime"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("_sum", F.sum("bytes").over(newest)).where(F.col("_sum") > limit).drop("_sum")


def changed_settings(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, was, now where they differ."""
    both = before.select("key", F.col("value").alias("was")).join(after.select("key", F.col("value").alias("now")), "key", "full_outer")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))
