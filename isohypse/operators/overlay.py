"""Exact predicates and overlays of polygons, without a geometry library.

An overlay nodes all edges, asks of each piece whether the result lies on its left and on
its right (even-odd rule in both operands), keeps the pieces where the answers differ and
joins them to rings.  Geometries are structs (kind, parts); each call works on one pair, so
layers are spread over tasks, and unions of layers go in two steps through salted parts.
"""

from __future__ import annotations

import math
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.binary import Ring, nested, signed_double_area
from .vector import noded

Polygon = list[Ring]
_VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_PARTS = T.ArrayType(T.ArrayType(T.ArrayType(_VERTEX)))
_ARROW = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def side(polygons: list[Polygon], x: float, y: float) -> int:
    """1 inside, 0 on the boundary, -1 outside, by the even-odd rule over all rings."""
    inside = False
    for polygon in polygons:
        for ring in polygon:
            for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True):
                cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                    return 0
                if (ay > y) != (by > y) and (cross > 0) == (by > ay):
                    inside = not inside
    return 1 if inside else -1


def _closed(polygons: list[Polygon]) -> list[Polygon]:
    return [[r if r[0] == r[-1] else [*r, r[0]] for r in p if len(r) >= 3] for p in polygons]


OPERATIONS = {"intersection": lambda a, b: a and b, "union": lambda a, b: a or b, "difference": lambda a, b: a and not b}


def overlay(a: list[Polygon], b: list[Polygon], operation: str) -> list[Polygon]:
    """Polygons of the intersection, union or difference."""
    keep = OPERATIONS[operation]
    a, b = _closed(a), _closed(b)
    pieces = {(min(p, q), max(p, q)) for p, q in noded([r for p in a + b for r in p])}
    out: dict[tuple, list[tuple]] = defaultdict(list)
    for p, q in pieces:
        dx, dy = q[0] - p[0], q[1] - p[1]
        mx, my, step = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2, 1e-7
        sides = []
        for s in (1, -1):
            x, y = mx - s * dy * step, my + s * dx * step
            sides.append(keep(side(a, x, y) > 0, side(b, x, y) > 0))
        if sides[0] != sides[1]:
            start, end = (p, q) if sides[0] else (q, p)
            out[start].append(end)
    rings = []
    while out:
        start = next(iter(out))
        ring, at, back = [start], start, None
        while True:
            ways = out[at]
            if len(ways) > 1 and back is not None:  # at a touching vertex the sharpest right turn keeps rings apart
                base = math.atan2(back[1] - at[1], back[0] - at[0])
                ways.sort(key=lambda w, at=at, base=base: (base - math.atan2(w[1] - at[1], w[0] - at[0])) % (2 * math.pi))
            nxt = ways.pop(0)
            if not ways:
                del out[at]
            ring.append(nxt)
            back, at = at, nxt
            if at == start or at not in out:
                break
        if len(ring) >= 4 and ring[0] == ring[-1]:
            rings.append(_straight(ring))
    shells, holes = [r for r in rings if signed_double_area(r[:-1]) > 0], [r for r in rings if signed_double_area(r[:-1]) < 0]
    return nested(shells, holes)


def _straight(ring: Ring) -> Ring:
    """Without vertices on straight stretches."""
    own = ring[:-1]
    kept = [p for k, p in enumerate(own) if abs((p[0] - own[k - 1][0]) * (own[(k + 1) % len(own)][1] - p[1]) - (p[1] - own[k - 1][1]) * (own[(k + 1) % len(own)][0] - p[0])) > 1e-14]
    return [*kept, kept[0]] if len(kept) >= 3 else ring


def union_all(polygons: list[list[Polygon]]) -> list[Polygon]:
    """The union of many, in pairs of like size."""
    own = [p for p in polygons if p]
    while len(own) > 1:
        own = [overlay(own[k], own[k + 1], "union") if k + 1 < len(own) else own[k] for k in range(0, len(own), 2)]
    return own[0] if own else []


def repaired(polygons: list[Polygon]) -> list[Polygon]:
    """A valid form of crossing rings."""
    return overlay(polygons, [], "union")


def _segments(polygons: list[Polygon]) -> list[tuple]:
    return [(p, q) for poly in _closed(polygons) for r in poly for p, q in zip(r[:-1], r[1:], strict=True) if p != q]


def _crosses(s: tuple, t: tuple) -> bool:
    """Whether two segments cross in the inside of both."""
    (a, b), (c, d) = s, t
    turn = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    return turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0


def covers(a: list[Polygon], b: list[Polygon]) -> bool:
    """No point of b lies outside a; the boundary counts as inside."""
    ours, theirs = _segments(a), _segments(b)
    if any(side(_closed(a), *p) < 0 or side(_closed(a), (p[0] + q[0]) / 2, (p[1] + q[1]) / 2) < 0 for p, q in theirs):
        return False
    return not any(_crosses(s, t) for s in ours for t in theirs) and not overlay(b, a, "difference")


def contains(a: list[Polygon], b: list[Polygon]) -> bool:
    """covers(), and b isn't only on a's boundary; for polygons these are the same."""
    return bool(_segments(b)) and covers(a, b)


def intersects(a: list[Polygon], b: list[Polygon]) -> bool:
    """Any common point; touching counts."""
    ca, cb = _closed(a), _closed(b)
    if any(side(ca, *p) >= 0 for poly in cb for r in poly for p in r) or any(side(cb, *p) >= 0 for poly in ca for r in poly for p in r):
        return True
    return any(_crosses(s, t) for s in _segments(a) for t in _segments(b))


def is_valid(polygons: list[Polygon]) -> bool:
    """Rings are closed, have four vertices and more, and don't cross."""
    if any(len(r) < 4 or r[0] != r[-1] for p in polygons for r in p):
        return False
    own = _segments(polygons)
    return not any(_crosses(own[i], own[j]) for i in range(len(own)) for j in range(i + 1, len(own)))


def distance(a: list[Ring], b: list[Ring]) -> float:
    """The least distance of two sets of lines (single vertices count as points)."""

    def to_segment(p, s, e) -> float:
        dx, dy = e[0] - s[0], e[1] - s[1]
        n = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / n)) if n else 0.0
        return math.hypot(p[0] - s[0] - t * dx, p[1] - s[1] - t * dy)

    pairs = lambda lines: [(r[k], r[min(k + 1, len(r) - 1)]) for r in lines for k in range(max(1, len(r) - 1))]
    sa, sb = pairs(a), pairs(b)
    if any(_crosses(s, t) for s in sa for t in sb):
        return 0.0
    return min(min(to_segment(s[0], *t), to_segment(s[1], *t), to_segment(t[0], *s), to_segment(t[1], *s)) for s in sa for t in sb)


# ---- over columns ------------------------------------------------------------------------


def _read(parts) -> list[Polygon]:
    return [] if parts is None else [[[(p["x"], p["y"]) for p in r] for r in part] for part in parts]


def _write(polygons: list[Polygon]) -> list:
    return [[[{"x": x, "y": y} for x, y in r] for r in p] for p in polygons]


# Arrow values, not pandas: nested lists of different lengths have no array form there.


def overlay_column(operation: str):
    """A function of two columns of parts (array of polygons) to the overlay's parts."""

    @F.arrow_udf(_PARTS)
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([_write(overlay(_read(x), _read(y), operation)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], _ARROW)

    return of


def predicate_column(name: str):
    """covers, contains or intersects of two columns of parts."""
    test = {"covers": covers, "contains": contains, "intersects": intersects}[name]

    @F.arrow_udf(T.BooleanType())
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([test(_read(x), _read(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    return of


@F.arrow_udf(T.BooleanType())
def valid_column(parts: pa.Array) -> pa.Array:
    return pa.array([is_valid(_read(p)) for p in parts.to_pylist()], pa.bool_())


@F.arrow_udf(_PARTS)
def repaired_column(parts: pa.Array) -> pa.Array:
    return pa.array([_write(repaired(_read(p))) for p in parts.to_pylist()], _ARROW)


def dissolve(features: DataFrame, keys: list[str], salt: int = 32) -> DataFrame:
    """keys, parts: the union of each group's polygons, first in salted parts."""
    types = dict(features.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", parts array<array<array<struct<x:double,y:double>>>>"

    def joined(table: pa.Table) -> pa.Table:
        whole = union_all([_read(p) for p in table.column("parts").to_pylist()])
        return pa.table([*(table.column(k).slice(0, 1) for k in keys), pa.array([_write(whole)], _ARROW)], names=[*keys, "parts"])

    part = features.select(*keys, "parts").withColumn("_salt", F.pmod(F.xxhash64("parts"), F.lit(salt))).groupBy(*keys, "_salt").applyInArrow(joined, schema)
    return part.groupBy(*keys).applyInArrow(joined, schema)


def clearing(features: DataFrame, cover: DataFrame, cell: float) -> DataFrame:
    """features (id, parts, min_x...) less the cover's polygons (id, parts, min_x...); those wholly covered go.

    Boxes meet by grid cells; each feature is cut once by the union of what meets it.
    """
    from .joins import overlapping_pairs

    boxes = lambda df, sign: df.select((F.col("id") * 2 + sign).alias("id"), "min_x", "min_y", "max_x", "max_y")
    met = overlapping_pairs(boxes(features, 0).unionByName(boxes(cover, 1)), cell).where("first % 2 <> second % 2")
    pairs = met.select(F.floor(F.when(F.col("first") % 2 == 0, F.col("first")).otherwise(F.col("second")) / 2).alias("id"), F.floor(F.when(F.col("first") % 2 == 1, F.col("first")).otherwise(F.col("second")) / 2).alias("cover_id"))
    cutters = pairs.join(cover.select(F.col("id").alias("cover_id"), "parts"), "cover_id")
    cutter = dissolve(cutters.select("id", "parts"), ["id"]).withColumnRenamed("parts", "_cut")
    left = features.join(cutter, "id", "left")
    out = left.withColumn("parts", F.when(F.col("_cut").isNull(), F.col("parts")).otherwise(overlay_column("difference")("parts", "_cut")))
    return out.where(F.size("parts") > 0).drop("_cut")


def inferred_sea(coast: list[Ring], frame: tuple[float, float, float, float], evidence: list[tuple[float, float, float]], least_share: float = 0.005, share: float = 0.1) -> list[Ring]:
    """Faces of coast and frame with little evidence of land (x, y, weight): the sea.

    Needs two faces that aren't islands and some evidence; faces under `least_share` of the
    frame are left out, and islands (faces that don't touch the frame) are land.
    """
    from .vector import faces, inner_point

    w, s, e, n = frame
    box = [(w, s), (e, s), (e, n), (w, n), (w, s)]
    total = (e - w) * (n - s)
    found = [f for f in faces(noded([*coast, box])) if w - 1e-9 <= inner_point(f)[0] <= e + 1e-9 and s - 1e-9 <= inner_point(f)[1] <= n + 1e-9]
    sized = [(f, abs(signed_double_area(f[:-1])) / 2) for f in found]
    sized = [(f, a) for f, a in sized if a >= least_share * total]
    touches = [any(abs(x - w) < 1e-9 or abs(x - e) < 1e-9 or abs(y - s) < 1e-9 or abs(y - n) < 1e-9 for x, y in f) for f, _ in sized]
    score = [0.0] * len(sized)
    for x, y, weight in evidence:
        k = next((i for i, (f, _) in enumerate(sized) if side([[f]], x, y) > 0), None)
        if k is not None:
            score[k] += weight
    density = [v / a for v, (_, a) in zip(score, sized, strict=True)]
    most = max((d for d, t in zip(density, touches, strict=True) if t), default=0.0)
    if len(sized) < 2 or sum(touches) < 2 or most <= 0:
        return []
    return [f for (f, _), d, t in zip(sized, density, touches, strict=True) if t and d < share * most]
