"""Clipping, projecting and buffering of features.

Clipping keeps what lies inside untouched and drops what lies outside, both by boxes alone;
only what crosses the border is cut: points and upright rectangles by comparison, lines by
their segments' parameters, other polygons by an overlay with the box.  Projecting
is one expression a feature.  A buffer is the union of one piece a vertex or edge.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import Box
from ..sources.model import GEOMETRY, with_extent
from .overlay import dissolve, overlay_column

_PARTS = "array<array<array<struct<x:double,y:double>>>>"
_BOX = ("min_x", "min_y", "max_x", "max_y")


def _named(kind: str, parts: str) -> str:
    """The geometry of parts; one without siblings loses its Multi."""
    single = f"replace({kind}, 'Multi', '')"
    return f"cast(named_struct('kind', CASE WHEN size({parts}) = 1 THEN {single} ELSE concat('Multi', {single}) END, 'parts', {parts}) AS {GEOMETRY})"


def _cut_lines(box: Box):
    """A function of a column of parts to the stretches of their lines inside the box, in their order."""
    limits = ((float(box.min_lon), float(box.max_lon)), (float(box.min_lat), float(box.max_lat)))

    @F.arrow_udf(_PARTS)
    def of(parts: pa.Array) -> pa.Array:
        rings = parts.values
        places = rings.values
        part_of, ring_of, point_of = (a.offsets.to_numpy() for a in (parts, rings, places))
        xy = [v.to_numpy(zero_copy_only=False) for v in places.values.flatten()]
        # a line is a part's first ring
        own = np.arange(part_of[0], part_of[-1])
        own = own[ring_of[own + 1] > ring_of[own]]
        feature = np.searchsorted(part_of, own, side="right") - 1
        first, n = point_of[ring_of[own]], np.maximum(point_of[ring_of[own] + 1] - point_of[ring_of[own]] - 1, 0)
        line = np.repeat(np.arange(len(own)), n)
        pos = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        at = first[line] + pos
        t0, t1 = np.zeros(len(at)), np.ones(len(at))
        with np.errstate(all="ignore"):
            for v, (low, high) in zip(xy, limits, strict=True):
                a, d = v[at], v[at + 1] - v[at]
                one, two = (low - a) / d, (high - a) / d
                t0 = np.maximum(t0, np.where(d != 0, np.minimum(one, two), np.where((a >= low) & (a <= high), 0.0, np.nan)))
                t1 = np.minimum(t1, np.where(d != 0, np.maximum(one, two), 1.0))
            kept = np.flatnonzero(t0 < t1)
        line, pos, at, t0, t1 = line[kept], pos[kept], at[kept], t0[kept], t1[kept]
        fresh = np.ones(len(at), bool)
        fresh[1:] = ~((line[1:] == line[:-1]) & (pos[1:] == pos[:-1] + 1) & (t1[:-1] == 1) & (t0[1:] == 0))
        start = np.flatnonzero(fresh)
        where = lambda v, t: np.where(t == 0, v[at], np.where(t == 1, v[at + 1], v[at] + (v[at + 1] - v[at]) * t))
        points = pa.StructArray.from_arrays([pa.array(np.insert(where(v, t1), start, where(v, t0)[start])) for v in xy], ["x", "y"])
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values)
        runs = lists(np.r_[start[1:], len(at)][: len(start)] + np.arange(1, len(start) + 1), points)
        return lists(np.cumsum(np.bincount(feature[line[start]], minlength=len(parts))), lists(np.arange(1, len(start) + 1), runs))

    return of.asNondeterministic()  # else a filter on its result computes it again


def _upright(parts: str) -> str:
    """Whether parts are one rectangle with upright sides, as SQL."""
    turn = lambda u, v: f"get(r, 0).{u} = get(r, 1).{u} AND get(r, 1).{v} = get(r, 2).{v} AND get(r, 2).{u} = get(r, 3).{u} AND get(r, 3).{v} = get(r, 0).{v}"
    return f"size({parts}) = 1 AND exists({parts}, part -> size(part) = 1 AND exists(part, r -> size(r) = 5 AND get(r, 0) = get(r, 4) AND ({turn('x', 'y')} OR {turn('y', 'x')})))"


def clipped(features: DataFrame, box: Box) -> DataFrame:
    """Features inside the box, with `cut`: whether the box took something off them.

    features: id, geom (kind, parts), min_x, min_y, max_x, max_y and any others.  Touching a side only leaves nothing of a line or polygon, but keeps a point.
    Read the features from a table or a checkpoint: each kind is a scan of its own.
    """
    w, s, e, n = (float(v) for v in (box.min_lon, box.min_lat, box.max_lon, box.max_lat))
    met = features.where(geo.boxes_intersect(*(F.col(c) for c in _BOX), box))
    within = (F.col("min_x") >= w) & (F.col("max_x") <= e) & (F.col("min_y") >= s) & (F.col("max_y") <= n)
    others = [c for c in features.columns if c not in (*_BOX, "geom")]
    whole = met.where(within).select(*others, "geom").withColumn("cut", F.lit(False))
    crossing = met.where(~within)
    points = crossing.where("geom.kind LIKE '%oint'").withColumn("parts", F.filter("geom.parts", lambda p: F.get(F.get(p, 0), 0).x.between(w, e) & F.get(F.get(p, 0), 0).y.between(s, n)))
    lines = crossing.where("geom.kind LIKE '%ine%'").withColumn("parts", _cut_lines(box)(F.col("geom.parts").cast(_PARTS)))
    frame = F.expr(f"array(array(array({', '.join(f'named_struct({chr(39)}x{chr(39)}, {x!r}d, {chr(39)}y{chr(39)}, {y!r}d)' for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s)))})))")
    areas = crossing.where("geom.kind LIKE '%olygon'").withColumn("_upright", F.coalesce(F.expr(_upright("geom.parts")), F.lit(False)))
    # a stretch of any width stays of a rectangle, where an overlay's new vertices may fall together
    inner = (F.least("max_x", F.lit(e)) > F.greatest("min_x", F.lit(w))) & (F.least("max_y", F.lit(n)) > F.greatest("min_y", F.lit(s)))
    into = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), F.lit(high))
    boxes = areas.where(F.col("_upright") & inner).withColumn("parts", F.transform("geom.parts", lambda part: F.transform(part, lambda r: F.transform(r, lambda p: F.struct(into(p.x, w, e).alias("x"), into(p.y, s, n).alias("y"))))))
    areas = areas.where("NOT _upright").withColumn("parts", overlay_column("intersection")(F.col("geom.parts").cast(_PARTS), frame))
    out = whole
    for part in (points, lines, boxes, areas):
        cut = part.where("size(parts) > 0").select(*others, F.expr(_named("geom.kind", "parts")).alias("geom"), F.lit(True).alias("cut"))
        out = out.unionByName(cut)
    return with_extent(out)


def clip_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many geometries were clipped, and how many dropped."""
    both = before.select(F.lit(1).alias("was"), F.lit(0).alias("stays"), F.lit(0).alias("cut")).unionByName(after.select(F.lit(0).alias("was"), F.lit(1).alias("stays"), F.col("cut").cast("int").alias("cut")))
    return both.agg(F.coalesce(F.sum("cut"), F.lit(0)).alias("clipped"), (F.coalesce(F.sum("was"), F.lit(0)) - F.coalesce(F.sum("stays"), F.lit(0))).alias("dropped"))


#: Modes whose straight lines aren't straight in degrees; their edges are split first.
CURVED = ("equal_earth",)


def projected(features: DataFrame, mode: str, center_lon: float = 0.0, center_lat: float = 0.0, step: float = 1.0) -> DataFrame:
    """Features in the projection's coordinates; under a curved one, edges get vertices every `step` degrees."""
    split = (lambda line: geo.densify_line(line, step)) if mode in CURVED else (lambda line: line)
    place = lambda p: geo.project(p.x, p.y, mode, center_lon, center_lat)
    parts = F.transform("geom.parts", lambda part: F.transform(part, lambda line: F.transform(split(line), place)))
    out = features.withColumn("geom", F.struct(F.col("geom.kind").alias("kind"), parts.alias("parts")).cast(GEOMETRY))
    return with_extent(out.drop(*_BOX))


# ---- buffers -----------------------------------------------------------------------------


def _circle(quarter: int) -> str:
    """Directions of a circle of 4 * quarter vertices."""
    angles = [2 * math.pi * k / (4 * quarter) for k in range(4 * quarter)]
    return "array(" + ", ".join(f"named_struct('x', {math.cos(a)!r}d, 'y', {math.sin(a)!r}d)" for a in angles) + ")"


def buffered(features: DataFrame, distance: float, quarter: int = 8) -> DataFrame:
    """id, parts: all places within the distance of each feature, or, for polygons under a negative one, further than it from the border.

    features: id, geom.  The pieces are one polygon an edge, the edge moved along a circle of
    4 * quarter vertices, so that pieces of neighbouring edges share the circle of their
    common vertex.  They are united (with the polygon itself) in salted parts by feature;
    under a negative distance the polygon loses them.  A feature with nothing left, and a
    line or point under a distance of zero or less, has no row.
    """
    d, n = abs(float(distance)), 4 * quarter
    area = F.col("geom.kind").contains("olygon")
    if distance == 0:
        return features.where(area).select("id", F.col("geom.parts").cast(_PARTS).alias("parts"))
    own = features.where(area) if distance < 0 else features
    lines = own.selectExpr("id", "explode(geom.parts) AS rings").selectExpr("id", "explode(rings) AS l").where("size(l) > 0")
    edges = lines.selectExpr("id", "explode(CASE WHEN size(l) = 1 THEN array(named_struct('a', l[0], 'b', l[0])) ELSE zip_with(slice(l, 1, size(l) - 1), slice(l, 2, size(l)), (a, b) -> named_struct('a', a, 'b', b)) END) AS e")
    edges = edges.selectExpr("id", "e.a", "e.b", "e.b.x - e.a.x AS dx", "e.b.y - e.a.y AS dy").distinct()
    # a side of the circle goes to the end of the edge that it faces; where that changes, a vertex stands at both
    before = f"ahead[(k + {n - 1}) % {n}]"
    ring = f"flatten(transform(circle, (u, k) -> CASE WHEN ahead[k] = {before} THEN array(IF(ahead[k], at_b[k], at_a[k])) WHEN ahead[k] THEN array(at_a[k], at_b[k]) ELSE array(at_b[k], at_a[k]) END))"
    moved = lambda p: f"transform(circle, u -> named_struct('x', {p}.x + u.x * {d!r}d, 'y', {p}.y + u.y * {d!r}d))"
    pieces = edges.selectExpr("id", "a", "b", "dx", "dy", f"{_circle(quarter)} AS circle")
    pieces = pieces.selectExpr("id", "circle", f"{moved('a')} AS at_a", f"{moved('b')} AS at_b", f"transform(circle, (u, k) -> dx * (u.x + circle[(k + 1) % {n}].x) + dy * (u.y + circle[(k + 1) % {n}].y) > 0) AS ahead")
    pieces = pieces.selectExpr("id", f"{ring} AS r").selectExpr("id", f"cast(array(array(concat(r, array(r[0])))) AS {_PARTS}) AS parts")
    inner = own.where(area).select("id", F.col("geom.parts").cast(_PARTS).alias("parts"))
    if distance > 0:
        return dissolve(pieces.unionByName(inner), ["id"])
    band = dissolve(pieces, ["id"]).select(F.col("id").alias("_of"), F.col("parts").alias("_band"))
    return inner.join(band, F.col("id") == F.col("_of")).select("id", overlay_column("difference")("parts", "_band").alias("parts")).where("size(parts) > 0")
