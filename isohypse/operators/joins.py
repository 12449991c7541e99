"""Joins of features: references to nodes, points and boxes to areas, names to names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.strings import fold_name
from .parity import least_areas, points_in_areas


def assemble_ways(refs: DataFrame, nodes: DataFrame, *order: str) -> DataFrame:
    """way_id, line (array of x, y): references joined to nodes; unresolved ones are left out.

    refs: way_id, node_id and the columns that order a way's references; nodes: node_id, x, y.
    """
    joined = refs.join(nodes, "node_id")
    vertex = F.struct(*order, F.col("x"), F.col("y"))
    return joined.groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(vertex)), lambda v: F.struct(v.x.alias("x"), v.y.alias("y"))).alias("line"))


def way_lengths(refs: DataFrame, nodes: DataFrame, *order: str) -> DataFrame:
    """way_id, n, length: by a window over each way, without gathering its vertices."""
    w = Window.partitionBy("way_id").orderBy(*order, "node_id")
    px, py = F.lag("x").over(w), F.lag("y").over(w)
    step = F.sqrt((F.col("x") - px) * (F.col("x") - px) + (F.col("y") - py) * (F.col("y") - py))
    return refs.join(nodes, "node_id").withColumn("_step", F.coalesce(step, F.lit(0.0))).groupBy("way_id").agg(F.count("*").alias("n"), F.sum("_step").alias("length"))


def _cells(min_x: Column, min_y: Column, max_x: Column, max_y: Column, size: float) -> Column:
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(span(min_x, max_x), lambda i: F.transform(span(min_y, max_y), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def overlapping_pairs(boxes: DataFrame, cell: float) -> DataFrame:
    """first, second: pairs of intersecting boxes, first < second; an equi-join on grid cells.

    Each pair is found once: in the cell of its common box's lower corner.  The boxes of the
    cells are few bytes and their pairs many, so the cells are dealt to all shuffle partitions
    here, where sizes would put them into a few.
    """
    parts = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = boxes.withColumn("c", F.explode(_cells(F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"), cell)))
    other = spread.select(F.col("c").alias("c2"), *[F.col(k).alias(f"o_{k}") for k in ("id", "min_x", "min_y", "max_x", "max_y")])
    met = spread.repartition(parts, "c").join(other.repartition(parts, "c2"), (F.col("c") == F.col("c2")) & (F.col("id") < F.col("o_id")))
    met = met.where((F.col("max_x") >= F.col("o_min_x")) & (F.col("min_x") <= F.col("o_max_x")) & (F.col("max_y") >= F.col("o_min_y")) & (F.col("min_y") <= F.col("o_max_y")))
    home = (F.floor(F.greatest("min_x", "o_min_x") / cell) == F.col("c.i")) & (F.floor(F.greatest("min_y", "o_min_y") / cell) == F.col("c.j"))
    return met.where(home).select(F.col("id").alias("first"), F.col("o_id").alias("second"))


def holes_to_shells(holes: DataFrame, shells: DataFrame, cell: float | None = None) -> DataFrame:
    """hole_id, shell_id: the smallest shell that holds a hole's first vertex, of equal ones that of the smallest id; stray holes go.

    Sizes are compared as floats, as areas of equal shells differ in their last digits.
    Shells of one ring count once, and so do first vertices at one place; places don't meet
    all shells around them.
    """
    points = holes.select("hole_id", F.get("ring", 0).x.alias("x"), F.get("ring", 0).y.alias("y"))
    size = F.abs(geo.signed_double_area(F.col("ring"))).cast("float").alias("_size")
    areas = shells.groupBy("ring").agg(F.min("shell_id").alias("shell_id")).select(F.struct(size, "shell_id").alias("area_id"), F.array("ring").alias("rings"))
    met = points.join(least_areas(points, areas, cell), ["x", "y"])
    return met.groupBy("hole_id").agg(F.min("area_id").alias("_best")).select("hole_id", F.col("_best.shell_id").alias("shell_id"))


def evidence_density(points: DataFrame, faces: DataFrame, cell: float | None = None, share: float = 0.1) -> DataFrame:
    """face_id, score, density, is_sea: summed weights in each face's first holder, by area.

    Faces with less than `share` of the densest face's density are sea, if there are two
    faces or more and any evidence.
    """
    areas = faces.select(F.col("face_id").alias("area_id"), "rings")
    first = points_in_areas(points, areas, cell).groupBy("point_id").agg(F.min("area_id").alias("face_id"), F.first("weight").alias("weight"))
    scores = first.groupBy("face_id").agg(F.sum("weight").alias("score"))
    out = faces.select("face_id", geo.area(F.col("rings")).alias("area")).join(scores, "face_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    out = out.withColumn("density", F.col("score") / F.col("area"))
    top = out.agg(F.max("density").alias("_most"), F.count("*").alias("_n"))
    return out.join(F.broadcast(top)).select("face_id", "score", "density", ((F.col("_n") >= 2) & (F.col("_most") > 0) & (F.col("density") < share * F.col("_most"))).alias("is_sea"))


def merge_labels(marks: DataFrame, labels: DataFrame) -> DataFrame:
    """key, mark_id, label: marks and labels at the same place (six decimals); unmatched ones stay."""
    key = F.format_string("[%.6f,%.6f]", "x", "y")
    last = labels.withColumn("key", key).groupBy("key").agg(F.max_by("name", "seq").alias("label"))
    return marks.withColumn("key", key).select("key", "mark_id").join(last, "key", "full_outer")


def duplicate_places(places: DataFrame, reach: float = 0.5) -> DataFrame:
    """first, second: places with one folded name and centres under `reach` degrees apart.

    The grid of the reach bounds the join within a name: only places in neighbouring
    cells of it meet.
    """
    own = places.withColumn("_k", fold_name(F.col("name"))).withColumn("_i", F.floor(F.col("x") / reach)).withColumn("_j", F.floor(F.col("y") / reach))
    near = own.withColumn("_i", F.explode(F.array(*[F.col("_i") + d for d in (-1, 0, 1)]))).withColumn("_j", F.explode(F.array(*[F.col("_j") + d for d in (-1, 0, 1)])))
    other = near.select("_k", "_i", "_j", F.col("place_id").alias("second"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    met = own.join(other, ["_k", "_i", "_j"]).where((F.col("place_id") < F.col("second")) & (F.abs(F.col("x") - F.col("x2")) < reach) & (F.abs(F.col("y") - F.col("y2")) < reach))
    return met.select(F.col("place_id").alias("first"), "second")


def merge_places(places: DataFrame, limit: int = 8) -> DataFrame:
    """The first `limit` places of a search in rank order, without those that repeat an accepted one.

    places: query, rank, name, x, y.  Each query's few hits are one group.
    """

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        for i, r in pdf.iterrows():
            if all(r._k != pdf._k[j] or abs(r.x - pdf.x[j]) >= 0.5 or abs(r.y - pdf.y[j]) >= 0.5 for j in kept):
                kept.append(i)
            if len(kept) == limit:
                break
        return pdf.loc[kept].drop(columns="_k")

    schema = places.schema
    return places.withColumn("_k", fold_name(F.col("name"))).groupBy("query").applyInPandas(merged, schema)
