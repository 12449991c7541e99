"""Vector geometry that needs a sequence of steps: rings from fragments, faces, hulls, simpler lines.

Each function on plain lists is also offered as a grouped or vectorised operator; a group is
one relation, one feature or one scene, never a layer.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.binary import Ring, nested, signed_double_area
from ..sources.model import GEOMETRY
from .chains import chained

Point = tuple[float, float]


def assemble_rings(fragments: list[Ring]) -> tuple[list[Ring], list[Ring]]:
    """(closed rings, lines left over): fragments are joined where their ends are equal.

    Fragments that are rings by themselves come first, then the joined ones by their first
    fragment.  Where three fragments meet, the first two are joined.
    """
    own = [list(f) for f in fragments if len(f) >= 2]
    rings = [f for f in own if f[0] == f[-1] and len(f) >= 4]
    loose = [f for f in own if f[0] == f[-1] and len(f) < 4]
    open_ = [f for f in own if f[0] != f[-1]]
    name: dict[Point, int] = {}
    ends = np.array([[name.setdefault(f[0], len(name)), name.setdefault(f[-1], len(name))] for f in open_], np.int64).reshape(-1, 2)
    chain, place, turned, _ = chained(ends[:, 0], ends[:, 1])
    joined: dict[int, Ring] = {}
    for k in np.lexsort((place, chain)).tolist():
        part = open_[k][::-1] if turned[k] else open_[k]
        joined.setdefault(int(chain[k]), [part[0]]).extend(part[1:])
    for line in joined.values():
        (rings if len(line) >= 4 and line[0] == line[-1] else loose).append(line)
    return rings, loose


def assemble_relations(elements: DataFrame) -> DataFrame:
    """id, tags, geom of relations: outer and inner members to polygons, or lines if nothing closes."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        roles: dict[bool, list[Ring]] = {True: [], False: []}
        for m in first.members:
            line = [(p["lon"], p["lat"]) for p in (m["geometry"] if m["geometry"] is not None else [])]
            if len(line) >= 2 and m["role"] in ("outer", "", None, "inner"):
                roles[m["role"] != "inner"].append(line)
        outer, loose = assemble_rings(roles[True])
        inner, _ = assemble_rings(roles[False])
        parts = nested(outer, inner) if outer else [[line] for line in loose]
        kind = "MultiPolygon" if outer else "MultiLineString"
        kind = kind.replace("Multi", "") if len(parts) == 1 else kind
        geom = {"kind": kind, "parts": [[[{"x": x, "y": y} for x, y in r] for r in p] for p in parts]}
        return pd.DataFrame([(first.id, first.tags, geom)] if parts else [], columns=["id", "tags", "geom"])

    relations = elements.where("type = 'relation' AND members IS NOT NULL").select("id", "tags", "members")
    return relations.groupBy("id").applyInPandas(build, f"id bigint, tags map<string,string>, geom {GEOMETRY}")


def simplify(line: Ring, tolerance: float) -> Ring:
    """Douglas-Peucker with a stack in place of recursion."""
    if len(line) < 3 or tolerance <= 0:
        return line
    keep, stack = {0, len(line) - 1}, [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = line[a], line[b]
        dx, dy = bx - ax, by - ay
        size, far, at = math.hypot(dx, dy), -1.0, -1
        for k in range(a + 1, b):
            x, y = line[k]
            d = abs(dy * (x - ax) - dx * (y - ay)) / size if size else math.hypot(x - ax, y - ay)
            if d > far:
                far, at = d, k
        if far > tolerance:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [line[k] for k in sorted(keep)]


_LINE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


@F.pandas_udf(_LINE)
def simplified(line: pd.Series, tolerance: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else [{"x": x, "y": y} for x, y in simplify([(p["x"], p["y"]) for p in v], t)] for v, t in zip(line, tolerance, strict=True)])


def convex_hull(points: list[Point]) -> Ring:
    """Monotone chains; counter-clockwise and closed."""
    own = sorted(set(points))
    if len(own) < 3:
        return own
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    out: list[Point] = []
    for way in (own, own[::-1]):
        chain: list[Point] = []
        for p in way:
            while len(chain) >= 2 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        out += chain[:-1]
    return [*out, out[0]]


def hulls(points: DataFrame, keys: list[str], rounds: int = 2) -> DataFrame:
    """keys, ring: the hull of each group's points (x, y).

    Hulls of salted parts first, then the hull of these: no group has to be held whole.
    """

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = convex_hull(list(zip(pdf.x, pdf.y, strict=True)))
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], x, y) for x, y in ring], columns=[*keys, "x", "y"])

    types = dict(points.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", x double, y double"
    parts = points.select(*keys, "x", "y", F.pmod(F.xxhash64("x", "y"), F.lit(64)).alias("_salt"))
    part = parts.groupBy(*keys, "_salt").applyInPandas(hull, schema)
    whole = part.distinct().groupBy(*keys).applyInPandas(lambda pdf: _one_ring(pdf, keys), ", ".join(f"{k} {types[k]}" for k in keys) + ", ring array<struct<x:double,y:double>>")
    return whole


def _one_ring(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    ring = convex_hull(list(zip(pdf.x, pdf.y, strict=True)))
    return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], [{"x": x, "y": y} for x, y in ring])], columns=[*keys, "ring"])


def faces(lines: list[Ring]) -> list[Ring]:
    """Bounded faces of lines that meet only at their vertices: a walk along half-edges.

    At each vertex the walk turns to the next edge clockwise, so that every face is walked
    once; walks with a positive area are the bounded ones.
    """
    near: dict[Point, list[Point]] = defaultdict(list)
    for line in lines:
        for a, b in zip(line[:-1], line[1:], strict=True):
            if a != b:
                near[a].append(b)
                near[b].append(a)
    turns = {p: sorted(set(q), key=lambda o, p=p: math.atan2(o[1] - p[1], o[0] - p[0])) for p, q in near.items()}
    place = {(p, q): k for p, own in turns.items() for k, q in enumerate(own)}
    seen: set[tuple[Point, Point]] = set()
    out = []
    for start in place:
        if start in seen:
            continue
        ring, edge = [start[0]], start
        while edge not in seen:
            seen.add(edge)
            a, b = edge
            ring.append(b)
            edge = (b, turns[b][place[b, a] - 1])
        if len(ring) >= 4 and signed_double_area(ring[:-1]) > 0:
            out.append(ring)
    return out


def noded(lines: list[Ring]) -> list[Ring]:
    """Cuts lines where they cross or touch, so that faces() can walk them.

    Segments are compared only within cells of a grid sized by their number.
    """
    segments = [(a, b) for line in lines for a, b in zip(line[:-1], line[1:], strict=True) if a != b]
    if not segments:
        return []
    xs, ys = [p[0] for s in segments for p in s], [p[1] for s in segments for p in s]
    size = max(max(xs) - min(xs), max(ys) - min(ys), 1e-12) / max(1.0, math.sqrt(len(segments)))
    grid: dict[tuple[int, int], list[int]] = defaultdict(list)
    for k, (a, b) in enumerate(segments):
        for i in range(int(min(a[0], b[0]) // size), int(max(a[0], b[0]) // size) + 1):
            for j in range(int(min(a[1], b[1]) // size), int(max(a[1], b[1]) // size) + 1):
                grid[i, j].append(k)
    cuts: dict[int, dict[float, Point]] = {k: {0.0: s[0], 1.0: s[1]} for k, s in enumerate(segments)}
    done: set[tuple[int, int]] = set()
    for own in grid.values():
        for x, i in enumerate(own):
            for j in own[x + 1 :]:
                if (i, j) in done:
                    continue
                done.add((i, j))
                (a, b), (c, d) = segments[i], segments[j]
                rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
                den = rx * sy - ry * sx
                if den:
                    t, u = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / den, ((c[0] - a[0]) * ry - (c[1] - a[1]) * rx) / den
                    if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                        p = a if abs(t) < 1e-12 else b if abs(t - 1) < 1e-12 else c if abs(u) < 1e-12 else d if abs(u - 1) < 1e-12 else (a[0] + t * rx, a[1] + t * ry)
                        cuts[i][min(max(t, 0.0), 1.0)] = p
                        cuts[j][min(max(u, 0.0), 1.0)] = p
    out = []
    for own in cuts.values():
        path = [own[t] for t in sorted(own)]
        out += [[a, b] for a, b in zip(path[:-1], path[1:], strict=True) if a != b]
    return out


def polygonize(lines: DataFrame, key: str) -> DataFrame:
    """key, face, ring: the faces that a scene's lines (key, line) enclose."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        own = noded([[(p["x"], p["y"]) for p in line] for line in pdf.line])
        rows = [(pdf[key].iloc[0], k, [{"x": x, "y": y} for x, y in ring]) for k, ring in enumerate(faces(own))]
        return pd.DataFrame(rows, columns=[key, "face", "ring"])

    kind = dict(lines.dtypes)[key]
    return lines.groupBy(key).applyInPandas(build, f"{key} {kind}, face int, ring array<struct<x:double,y:double>>")


def inner_point(ring: Ring) -> Point:
    """A point inside a ring: the middle of the widest stretch at half height."""
    ys = sorted({p[1] for p in ring})
    y = (ys[len(ys) // 2 - 1] + ys[len(ys) // 2]) / 2 if len(ys) > 1 else ys[0]
    xs = sorted(ax + (y - ay) * (bx - ax) / (by - ay) for (ax, ay), (bx, by) in zip(ring[:-1], ring[1:], strict=True) if (ay > y) != (by > y))
    spans = [(b - a, (a + b) / 2) for a, b in zip(xs[::2], xs[1::2], strict=False)]
    return (max(spans)[1], y) if spans else ring[0]
