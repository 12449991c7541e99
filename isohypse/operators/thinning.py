"""Greedy labels in parallel: in rank order, those that overlap none taken before.

The result is that of going through a sheet's labels one by one; the work is in rounds over
square tiles.  A tile goes through its labels in order and tells of each one whether it is
out (it overlaps a taken one), open (it overlaps an earlier one that may yet be taken) or
clear.  A label that lies in one tile and is clear is taken at once and counts for the
labels after it; one on a border is taken if it is clear in each of its tiles, and is shown
to them in the next round.  Labels that overlap share a tile, so no overlap is missed, and
the first label of all is decided everywhere, so each round decides some.  A tile keeps a
bounded number of open labels in each place; what comes after them waits for the next round.  Chains of
overlaps end inside a tile mostly, so a few rounds are enough.

A tile with more than `most` labels is thinned before, in rounds that need no group: a
label that is the first in each small cell that it touches is taken, and those that overlap
the one winner of one of their cells are out.

With limits, a label is out once its layer has enough labels on the sheet, and open while
too many before it are open.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

_ORDER = ("rank", "name", "x", "y", "layer", "_id")
_CELL = 64.0
#: A cell with so many open labels leaves all after them open that aren't out; the next round decides.
_OPEN = 256


def _half(across: bool) -> Column:
    a = F.radians("angle")
    c, s = F.abs(F.cos(a)), F.abs(F.sin(a))
    return (F.col("width") * (c if across else s) + F.col("height") * (s if across else c)) / 2


def _squares(size: float) -> Column:
    """The squares of a grid that a label's box touches."""
    hx, hy = _half(True), _half(False)
    return F.flatten(F.transform(_range("x", hx, size), lambda i: F.transform(_range("y", hy, size), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def _range(at: str, half: Column, size: float) -> Column:
    return F.sequence(F.floor((F.col(at) - half) / size), F.floor((F.col(at) + half) / size))


def overlap(a: tuple, b: tuple) -> bool:
    """Whether two turned boxes (x, y, width, height, cos, sin) meet; touching counts."""
    ax, ay, aw, ah, ac, as_ = a
    bx, by, bw, bh, bc, bs = b
    dx, dy = bx - ax, by - ay
    for c, s in ((ac, as_), (bc, bs)):
        for ux, uy in ((c, s), (-s, c)):
            reach = (aw * abs(ac * ux + as_ * uy) + ah * abs(ac * uy - as_ * ux)) / 2 + (bw * abs(bc * ux + bs * uy) + bh * abs(bc * uy - bs * ux)) / 2
            if abs(dx * ux + dy * uy) > reach:
                return False
    return True


def overlaps(a: str, b: str) -> Column:
    """The same for two struct columns with x, y, width, height, angle."""
    dx, dy = F.col(f"{b}.x") - F.col(f"{a}.x"), F.col(f"{b}.y") - F.col(f"{a}.y")
    turn = {k: (F.cos(F.radians(f"{k}.angle")), F.sin(F.radians(f"{k}.angle"))) for k in (a, b)}
    met = F.lit(True)
    for c, s in turn.values():
        for ux, uy in ((c, s), (-s, c)):
            reach = sum(((F.col(f"{k}.width") * F.abs(m * ux + n * uy) + F.col(f"{k}.height") * F.abs(m * uy - n * ux)) / 2 for k, (m, n) in turn.items()), F.lit(0.0))
            met = met & (F.abs(dx * ux + dy * uy) <= reach)
    return met


def _judged(pdf: pd.DataFrame) -> pd.DataFrame:
    """_id and verdict (-1 out, 0 open, 1 clear) of a tile's labels; those taken before come first."""
    pdf = pdf.sort_values(["_taken", *_ORDER], ascending=[False] + [True] * len(_ORDER), kind="stable", na_position="last")
    a = np.radians(pdf.angle.to_numpy(float))
    boxes = list(zip(*(pdf[k].tolist() for k in ("x", "y", "width", "height")), np.cos(a).tolist(), np.sin(a).tolist(), strict=True))
    sure: dict[tuple[int, int], list[tuple]] = {}
    maybe: dict[tuple[int, int], list[tuple]] = {}
    verdicts = []
    for box, taken, allowed, full, alone in zip(boxes, *(pdf[k].tolist() for k in ("_taken", "_allowed", "_full", "_alone")), strict=True):
        x, y, w, h, c, s = box
        hx, hy = (w * abs(c) + h * abs(s)) / 2, (w * abs(s) + h * abs(c)) / 2
        cells = [(i, j) for i in range(math.floor((x - hx) / _CELL), math.floor((x + hx) / _CELL) + 1) for j in range(math.floor((y - hy) / _CELL), math.floor((y + hy) / _CELL) + 1)]
        near = lambda grid: any(abs(other[0] - x) <= ox + hx and abs(other[1] - y) <= oy + hy and overlap(box, other) for cell in cells for other, ox, oy in grid.get(cell, ()))  # noqa: B023, E731
        verdict = 1
        if not taken:
            if full or near(sure):
                verdict = -1
            elif not allowed or any(len(maybe.get(cell, ())) >= _OPEN for cell in cells) or near(maybe):
                verdict = 0
        verdicts.append(verdict)
        if verdict >= 0:
            grid = sure if taken or verdict == 1 and alone else maybe
            for cell in cells:
                if grid is sure or len(grid.get(cell, ())) < _OPEN:
                    grid.setdefault(cell, []).append((box, hx, hy))
    return pd.DataFrame({"_id": pdf._id.to_numpy(), "_verdict": verdicts})[~pdf._taken.to_numpy(bool)]


def _ordered(*parts: str):
    return Window.partitionBy(*parts).orderBy(*(F.asc_nulls_last(c) for c in _ORDER))


def _with_places(todo: DataFrame, taken: DataFrame | None) -> DataFrame:
    """_allowed and _full: whether the label's layer has room for it, whatever happens to those before, and whether it has none."""
    both = todo.withColumn("_taken", F.lit(False))
    if taken is not None:
        both = both.unionByName(taken.withColumn("_taken", F.lit(True)))
    before = _ordered("sheet", "layer").rowsBetween(Window.unboundedPreceding, -1)
    sure = F.coalesce(F.sum(F.col("_taken").cast("int")).over(before), F.lit(0))
    any_ = F.coalesce(F.count("*").over(before), F.lit(0))
    both = both.withColumn("_allowed", F.col("_limit").isNull() | (any_ < F.col("_limit"))).withColumn("_full", F.coalesce(sure >= F.col("_limit"), F.lit(False)))
    return both.where(~F.col("_taken")).drop("_taken")


def _first_in_cells(todo: DataFrame) -> DataFrame:
    """Verdicts of a round without groups: winners of all their cells, and what overlaps the winner of a cell."""
    cells = todo.withColumn("_c", F.explode(_squares(_CELL)))
    key = F.struct(*(F.struct(F.col(c).isNull().alias("n"), F.col(c).alias("v")).alias(c) for c in _ORDER))
    box = F.struct("x", "y", "width", "height", "angle")
    first = cells.groupBy("sheet", "_c").agg(F.min_by(F.struct("_id", box.alias("box"), (F.col("_allowed") & ~F.col("_full")).alias("ok")), key).alias("_first"))
    met = cells.select("_id", "sheet", "_c", "_full", box.alias("_box")).join(first, ["sheet", "_c"])
    wins = met.groupBy("_id").agg(F.min((F.col("_id") == F.col("_first._id")) & F.col("_first.ok")).alias("wins"))
    winners = cells.join(wins.where("wins"), "_id").select("sheet", "_c", F.col("_id").alias("_winner"), box.alias("_other"))
    near = cells.select("_id", "sheet", "_c", "_full", box.alias("_box")).join(winners, ["sheet", "_c"], "left")
    verdict = F.when(F.col("_id") == F.col("_winner"), 1).when(F.col("_full") | F.coalesce(overlaps("_box", "_other"), F.lit(False)), -1).otherwise(0)
    return near.groupBy("_id").agg(F.min(verdict).alias("_verdict"))


def thin_labels(labels: DataFrame, limits: DataFrame | None = None, tile: float = 4096.0, most: int = 100_000) -> DataFrame:
    """The labels that stay, with their columns.

    labels: sheet, layer, name, rank, x, y, width, height, angle (degrees); limits: layer,
    limit.  Labels go by rank, then name, place and layer; of equal rows one stays.
    """
    own = labels.withColumn("_id", F.monotonically_increasing_id()).withColumn("_tiles", _squares(tile)).withColumn("_alone", F.size("_tiles") == 1)
    if limits is not None:
        own = own.join(limits.select("layer", F.col("limit").alias("_limit")), "layer", "left")
    else:
        own = own.withColumn("_limit", F.lit(None).cast("int"))
    todo, kept, shown, crowded = cut(own), [], None, True
    while not todo.isEmpty():
        taken = None
        for part in kept:
            taken = part if taken is None else taken.unionByName(part)
        placed = _with_places(todo, taken) if limits is not None else todo.withColumns({"_allowed": F.lit(True), "_full": F.lit(False)})
        if crowded:
            crowded = todo.select("sheet", F.explode("_tiles").alias("_t")).groupBy("sheet", "_t").count().agg(F.max("count")).first()[0] > most
        rows = placed.withColumn("_taken", F.lit(False))
        if shown is not None:
            rows = rows.unionByName(shown.withColumns({"_allowed": F.lit(True), "_full": F.lit(False), "_taken": F.lit(True)}))
        if crowded:
            verdicts = _first_in_cells(placed)
        else:
            columns = ["_id", "rank", "name", "x", "y", "layer", "width", "height", "angle", "_alone", "_allowed", "_full", "_taken"]
            tiles = rows.select("sheet", F.explode("_tiles").alias("_t"), *columns)
            verdicts = tiles.groupBy("sheet", "_t").applyInPandas(_judged, "_id bigint, _verdict int").groupBy("_id").agg(F.min("_verdict").alias("_verdict"))
        judged = cut(todo.join(verdicts, "_id"))
        new = judged.where("_verdict = 1").drop("_verdict").select(todo.columns)
        kept.append(new)
        # winners of cells have thinned what they overlap already
        shown = None if crowded else new.where("NOT _alone")
        todo = judged.where("_verdict = 0").drop("_verdict").select(todo.columns)
    out = todo
    for part in kept:
        out = out.unionByName(part)
    return out.select(labels.columns)
