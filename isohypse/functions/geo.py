"""Column expressions on coordinates, boxes, rings and projections.

Every function takes and returns Columns, so that filters and projections stay in one
generated stage and boxes reach the scan as pushed-down comparisons.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the projections.
EARTH_RADIUS = 6378137.0
MAX_LATITUDE = 85.05112878
EQUAL_EARTH = (1.340264, -0.081106, 0.000893, 0.003796)
_M = math.sqrt(3.0) / 2.0


@dataclass(frozen=True)
class Box:
    """A geographic box; closed on all sides."""

    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float

    @property
    def lon_span(self) -> float:
        return self.max_lon - self.min_lon

    @property
    def lat_span(self) -> float:
        return self.max_lat - self.min_lat

    @property
    def area(self) -> float:
        return self.lon_span * self.lat_span

    def valid(self) -> bool:
        return -180 <= self.min_lon < self.max_lon <= 180 and -90 <= self.min_lat < self.max_lat <= 90


# ---- predicates --------------------------------------------------------------------------


def box_contains(x: Column, y: Column, box: Box) -> Column:
    return x.between(box.min_lon, box.max_lon) & y.between(box.min_lat, box.max_lat)


def boxes_intersect(min_x: Column, min_y: Column, max_x: Column, max_y: Column, box: Box) -> Column:
    """Closed intervals: touching counts."""
    return (max_x >= box.min_lon) & (min_x <= box.max_lon) & (max_y >= box.min_lat) & (min_y <= box.max_lat)


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over a ring of structs x, y whose last vertex repeats the first."""
    crossings = F.zip_with(
        F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))),
        F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))),
        lambda a, b: F.when((a.y > y) != (b.y > y), F.when(x < (b.x - a.x) * (y - a.y) / (b.y - a.y) + a.x, 1).otherwise(0)).otherwise(0),
    )
    return F.aggregate(crossings, F.lit(0), lambda s, v: s + v) % 2 == 1


def is_closed(line: Column) -> Column:
    """Four vertices or more, the last equal to the first."""
    return (F.size(line) >= 4) & (F.element_at(line, 1) == F.element_at(line, -1))


def close_ring(ring: Column) -> Column:
    return F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def too_costly(box: Box, n_layers: int, all_layers: bool) -> bool:
    """A request that deserves a warning: 0.08 square degrees with all or over six layers."""
    return box.area >= 0.08 and (all_layers or n_layers > 6)


def refused(box: Box) -> bool:
    return box.area > 300.0


# ---- measures ----------------------------------------------------------------------------


def _edges(line: Column, f) -> Column:
    return F.aggregate(F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line), F.lit(1))), f), F.lit(0.0), lambda s, v: s + v)


def signed_double_area(ring: Column) -> Column:
    return _edges(ring, lambda a, b: a.x * b.y - b.x * a.y)


def area(polygon: Column) -> Column:
    """Shell less holes, over an array of rings."""
    sizes = F.transform(polygon, lambda r: F.abs(signed_double_area(r)) / 2)
    return F.get(sizes, 0) - F.aggregate(F.slice(sizes, 2, F.greatest(F.size(sizes), F.lit(1))), F.lit(0.0), lambda s, v: s + v)


def length(line: Column) -> Column:
    return _edges(line, lambda a, b: F.sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)))


def centroid(ring: Column) -> Column:
    """Area-weighted centre of a closed ring, as struct x, y."""
    total = signed_double_area(ring)
    cx = _edges(ring, lambda a, b: (a.x + b.x) * (a.x * b.y - b.x * a.y))
    cy = _edges(ring, lambda a, b: (a.y + b.y) * (a.x * b.y - b.x * a.y))
    return F.when(total != 0, F.struct((cx / (3 * total)).alias("x"), (cy / (3 * total)).alias("y")))


def vertex_mean(line: Column) -> Column:
    """Mean of all vertices, a repeated last one included."""
    n = F.size(line)
    mean = lambda name: F.aggregate(line, F.lit(0.0), lambda s, p: s + p[name]) / n
    return F.when(n > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def extent(line: Column) -> Column:
    """Box of the finite vertices, or null."""
    ok = F.filter(line, lambda p: finite(p.x) & finite(p.y))
    xs, ys = F.transform(ok, lambda p: p.x), F.transform(ok, lambda p: p.y)
    return F.when(F.size(ok) > 0, F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")))


def oriented(ring: Column, counter_clockwise: bool = True) -> Column:
    signed = signed_double_area(ring)
    return F.when(signed < 0 if counter_clockwise else signed > 0, F.reverse(ring)).otherwise(ring)


# ---- Web Mercator ------------------------------------------------------------------------


def clamp_latitude(lat: Column) -> Column:
    return F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))


def world_pixels(zoom: int) -> float:
    return 256.0 * (1 << zoom)


def tile(lon: Column, lat: Column, zoom: int) -> Column:
    """struct x, y: truncated, then clamped to the world."""
    n = 1 << zoom
    rad = F.radians(clamp_latitude(lat))
    clamp = lambda v: F.greatest(F.least(v.cast("int"), F.lit(n - 1)), F.lit(0))
    x = (lon + 180.0) / 360.0 * n
    y = (1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * n
    return F.struct(clamp(x).alias("x"), clamp(y).alias("y"))


def pixel(lon: Column, lat: Column, zoom: int) -> Column:
    world = world_pixels(zoom)
    rad = F.radians(clamp_latitude(lat))
    return F.struct(((lon + 180.0) / 360.0 * world).alias("x"), ((1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * world).alias("y"))


def from_pixel(x: Column, y: Column, zoom: int) -> Column:
    world = world_pixels(zoom)
    return F.struct((x / world * 360.0 - 180.0).alias("lon"), F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / world)))).alias("lat"))


def ground_resolution(lat: Column, zoom: int) -> Column:
    """Metres a pixel."""
    return F.cos(F.radians(lat)) * (2.0 * math.pi * EARTH_RADIUS / world_pixels(zoom))


def mercator_y_degrees(lat: Column) -> Column:
    rad = F.radians(clamp_latitude(lat))
    return F.degrees(F.log(F.tan(math.pi / 4.0 + rad / 2.0)))


# ---- projections -------------------------------------------------------------------------

MODES = ("wgs84_raw", "web_mercator", "local_azimuthal", "equal_earth")


def parse_mode(name: str | None) -> str:
    return name if name in MODES else "web_mercator"


def project(lon: Column, lat: Column, mode: str, center_lon: float = 0.0, center_lat: float = 0.0) -> Column:
    """struct x, y in metres (degrees for the raw mode)."""
    if mode == "wgs84_raw":
        return F.struct(lon.alias("x"), lat.alias("y"))
    if mode == "local_azimuthal":
        k = math.cos(math.radians(center_lat))
        return F.struct(((lon - center_lon) * (k * math.pi / 180.0 * EARTH_RADIUS)).alias("x"), ((lat - center_lat) * (math.pi / 180.0 * EARTH_RADIUS)).alias("y"))
    if mode == "equal_earth":
        return equal_earth(lon, lat, center_lon)
    y = F.log(F.tan(math.pi / 4.0 + clamp_latitude(lat) * (math.pi / 360.0))) * EARTH_RADIUS
    return F.struct((lon * (EARTH_RADIUS * math.pi / 180.0)).alias("x"), y.alias("y"))


def unproject(x: Column, y: Column, mode: str, center_lon: float = 0.0, center_lat: float = 0.0) -> Column:
    """struct lon, lat."""
    if mode == "wgs84_raw":
        return F.struct(x.alias("lon"), y.alias("lat"))
    if mode == "local_azimuthal":
        k = math.cos(math.radians(center_lat))
        return F.struct((x / (EARTH_RADIUS * k) * (180.0 / math.pi) + center_lon).alias("lon"), (y / EARTH_RADIUS * (180.0 / math.pi) + center_lat).alias("lat"))
    if mode == "equal_earth":
        return from_equal_earth(x, y, center_lon)
    return F.struct((x / EARTH_RADIUS * (180.0 / math.pi)).alias("lon"), ((2.0 * F.atan(F.exp(y / EARTH_RADIUS)) - math.pi / 2.0) * (180.0 / math.pi)).alias("lat"))


def _ee_terms(t: Column) -> tuple[Column, Column]:
    """The polynomial and its derivative at the parametric latitude."""
    a1, a2, a3, a4 = EQUAL_EARTH
    t2 = t * t
    t6 = t2 * t2 * t2
    return t * (a1 + a2 * t2 + t6 * (a3 + a4 * t2)), a1 + 3 * a2 * t2 + t6 * (7 * a3 + 9 * a4 * t2)


def equal_earth(lon: Column, lat: Column, center_lon: float = 0.0) -> Column:
    s = F.greatest(F.least(F.sin(F.radians(lat)) * _M, F.lit(1.0)), F.lit(-1.0))
    t = F.asin(s)
    y, dy = _ee_terms(t)
    x = F.radians(lon - center_lon) * F.cos(t) / (_M * dy)
    return F.struct((x * EARTH_RADIUS).alias("x"), (y * EARTH_RADIUS).alias("y"))


def from_equal_earth(x: Column, y: Column, center_lon: float = 0.0, steps: int = 12) -> Column:
    """Newton steps on the parametric latitude, a fold of fixed length."""
    goal = y / EARTH_RADIUS

    def step(t: Column, _: Column) -> Column:
        value, slope = _ee_terms(t)
        return t - (value - goal) / slope

    t = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), goal, step)
    _, dy = _ee_terms(t)
    lat = F.degrees(F.asin(F.greatest(F.least(F.sin(t) / _M, F.lit(1.0)), F.lit(-1.0))))
    near_pole = F.abs(F.cos(t)) < 1e-12
    lon = F.when(near_pole, F.lit(center_lon)).otherwise(F.degrees(x / EARTH_RADIUS * (_M * dy) / F.cos(t)) + center_lon)
    return F.struct(lon.alias("lon"), lat.alias("lat"))


def outline(box: Box, steps: int = 16) -> list[tuple[float, float]]:
    """Points along a box's sides, for the box of its projection."""
    out = []
    for k in range(steps + 1):
        lon, lat = box.min_lon + box.lon_span * k / steps, box.min_lat + box.lat_span * k / steps
        out += [(lon, box.min_lat), (lon, box.max_lat), (box.min_lon, lat), (box.max_lon, lat)]
    return out


# ---- boxes and circles -------------------------------------------------------------------


def centred_box(lat: Column, lon: Column, lat_span: Column, lon_span: Column) -> Column:
    """Box around a point: spans at most 180 by 360, edges clamped to the world."""
    h, w = F.least(lat_span, F.lit(180.0)) / 2, F.least(lon_span, F.lit(360.0)) / 2
    return F.struct(F.greatest(lon - w, F.lit(-180.0)).alias("min_lon"), F.greatest(lat - h, F.lit(-90.0)).alias("min_lat"), F.least(lon + w, F.lit(180.0)).alias("max_lon"), F.least(lat + h, F.lit(90.0)).alias("max_lat"))


def padded_point(lat: Column, lon: Column, pad: float = 0.05) -> Column:
    """A box of `pad` degrees of latitude to each side, as wide on the ground."""
    w = pad / F.greatest(F.lit(0.02), F.cos(F.radians(lat)))
    return F.struct((lon - w).alias("min_lon"), (lat - pad).alias("min_lat"), (lon + w).alias("max_lon"), (lat + pad).alias("max_lat"))


def magnitude_radius(magnitude: Column, span: Column) -> Column:
    return span * F.least(0.005 * F.pow(F.lit(1.55), F.greatest(F.lit(0.0), magnitude - 3.0)), F.lit(0.09))


def circle(lon: Column, lat: Column, radius: Column, segments: int = 48) -> Column:
    """An open ring of vertices, stretched in longitude by the latitude."""
    stretch = 1.0 / F.greatest(F.lit(0.05), F.cos(F.radians(lat)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(segments - 1)),
        lambda k: F.struct((lon + radius * stretch * F.cos(k * (2 * math.pi / segments))).alias("x"), (lat + radius * F.sin(k * (2 * math.pi / segments))).alias("y")),
    )


def wrap_longitude(lon: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def depth_bucket(depth_km: Column) -> Column:
    return F.when(depth_km < 70, "earthquakes_shallow").when(depth_km < 300, "earthquakes_intermediate").otherwise("earthquakes_deep")


# ---- intervals and ramps -----------------------------------------------------------------


def nice_interval(span: Column, lines: int) -> Column:
    """The nearest, by ratio, of 1, 2, 5 and 10 times a power of ten; 1 for no span."""
    raw = span / lines
    scale = F.pow(F.lit(10.0), F.floor(F.log10(raw)).cast("double"))
    best = F.array_min(F.transform(F.array(*[F.lit(c) for c in (1.0, 2.0, 5.0, 10.0)]), lambda c, i: F.struct(F.abs(F.log(c * scale / raw)).alias("d"), i.alias("i"), (c * scale).alias("v"))))
    return F.when(finite(span) & (span > 0), best.v).otherwise(1.0)


def contour_levels(low: Column, high: Column, interval: float, cap: int = 400) -> Column:
    """Multiples of the interval strictly inside the range, the lowest `cap`."""
    first, last = F.floor(low / interval) + 1, F.ceil(high / interval) - 1
    return F.when(last >= first, F.slice(F.transform(F.sequence(first, last), lambda k: k * F.lit(interval)), 1, cap)).otherwise(F.array().cast("array<double>"))


def boundaries(low: Column, high: Column, count: int) -> Column:
    """count + 1 even values, both ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(count)), lambda k: low + (high - low) * k / F.lit(float(count)))


#: Depths a chart shows, in metres.
CHART_DEPTHS = (2, 5, 10, 20, 30, 50, 100, 200, 500, 1000, 2000, 5000, 10000)


def depth_boundaries(lowest: float, count: int, chart: bool = True) -> list[float]:
    """Upper edges of depth bands from the surface down, as elevations: even, or at a chart's depths.

    A chart keeps the shallowest count + 1 of the depths above the floor, and the surface.
    """
    if lowest >= 0:
        return []
    if not chart:
        return [lowest * k / count for k in range(count, -1, -1)]
    deeper = [d for d in CHART_DEPTHS if d < -lowest][:count]
    return [-float(d) for d in reversed(deeper)] + [0.0]


def land_boundaries(low: float, high: float, count: int) -> list[float]:
    """Even edges from the shore, or the lowest land, to the top; none without land."""
    if high <= 0:
        return []
    start = max(0.0, low)
    return [start + (high - start) * k / count for k in range(count + 1)]


def lerp_channel(a: Column, b: Column, t: Column) -> Column:
    clamped = F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0))
    return F.bround(a + (b - a) * clamped).cast("int")


def colour_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r, g, b)


def luma(r: Column, g: Column, b: Column) -> Column:
    return (299 * r + 587 * g + 114 * b) / 1000.0


def normal_bearing(degrees: Column) -> Column:
    """To (-180, 180]; 0 for what isn't finite."""
    m = F.pmod(degrees, F.lit(360.0))
    return F.when(finite(degrees), F.when(m > 180, m - 360).otherwise(m)).otherwise(0.0)


def quintic_fade(t: Column) -> Column:
    return t * t * t * (t * (t * 6 - 15) + 10)


def julian_date(seconds: Column) -> Column:
    return 2440587.5 + seconds / 86400.0


def gmst_degrees(julian: Column) -> Column:
    """Greenwich mean sidereal time; the remainder keeps its sign."""
    c = (julian - 2451545.0) / 36525.0
    return (280.46061837 + 360.98564736629 * (julian - 2451545.0) + 0.000387933 * c * c - c * c * c / 38710000.0) % 360.0


def smooth_line(line: Column, closed: bool = False) -> Column:
    """One round of corner cutting: each corner becomes two, at a quarter of its edges."""
    mix = lambda a, b, t: F.struct((a.x + (b.x - a.x) * t).alias("x"), (a.y + (b.y - a.y) * t).alias("y"))
    pairs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line), F.lit(1))), lambda a, b: F.array(mix(a, b, 0.25), mix(a, b, 0.75)))
    cut = F.flatten(pairs)
    if closed:
        out = F.concat(cut, F.slice(cut, 1, 1))
    else:
        out = F.concat(F.slice(line, 1, 1), F.slice(cut, 2, F.greatest(F.size(cut) - 2, F.lit(0))), F.slice(line, -1, 1))
    return F.when(F.size(line) < 3, line).otherwise(out)


def densify_line(line: Column, step: float = 1.0, most: int = 1024) -> Column:
    """Splits each edge into parts of at most `step` along its longer axis."""

    def split(a: Column, b: Column) -> Column:
        span = F.greatest(F.abs(b.x - a.x), F.abs(b.y - a.y))
        n = F.greatest(F.least(F.ceil(span / step).cast("int"), F.lit(most)), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((a.x + (b.x - a.x) * k / n).alias("x"), (a.y + (b.y - a.y) * k / n).alias("y")))

    edges = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line), F.lit(1))), split)
    return F.when(F.size(line) < 2, line).otherwise(F.concat(F.flatten(edges), F.slice(line, -1, 1)))


def _clip_by(half, inside, cut):
    return lambda vertices: half(vertices, inside, cut)


def clip_ring(ring: Column, box: Box) -> Column:
    """Sutherland-Hodgman clipping of a closed ring to a box: four half-plane folds."""

    def half(vertices: Column, inside, cut) -> Column:
        n = F.size(vertices)

        def of(a: Column, i: Column) -> Column:
            b = F.get(vertices, F.when(i + 1 < n, i + 1).otherwise(0))
            ia, ib = inside(a), inside(b)
            keep = F.when(ia, F.array(a)).otherwise(F.slice(F.array(a), 1, 0))
            return F.when(ia != ib, F.concat(keep, F.array(cut(a, b)))).otherwise(keep)

        return F.flatten(F.transform(vertices, of))

    def at_x(v: float):
        return lambda a, b: F.struct(F.lit(v).alias("x"), (a.y + (b.y - a.y) * (v - a.x) / (b.x - a.x)).alias("y"))

    def at_y(v: float):
        return lambda a, b: F.struct((a.x + (b.x - a.x) * (v - a.y) / (b.y - a.y)).alias("x"), F.lit(v).alias("y"))

    out = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))
    for inside, cut in ((lambda p: p.x >= box.min_lon, at_x(box.min_lon)), (lambda p: p.x <= box.max_lon, at_x(box.max_lon)), (lambda p: p.y >= box.min_lat, at_y(box.min_lat)), (lambda p: p.y <= box.max_lat, at_y(box.max_lat))):
        out = F.get(F.transform(F.array(out), _clip_by(half, inside, cut)), 0)
    return F.when(F.size(out) >= 3, F.concat(out, F.slice(out, 1, 1)))
