"""Invented terrain against plain arithmetic, and its continuity."""

import math

import pytest

from isohypse.operators import raster
from isohypse.operators import terrain as T


def lattice(ix, iy, seed):
    wrap = lambda v: v & T._MASK
    h = wrap(ix * T.FACTORS[0]) ^ wrap(iy * T.FACTORS[1]) ^ wrap(seed * T.FACTORS[2])
    for shift, factor in T.ROUNDS:
        h = wrap((h ^ h >> shift) * factor)
    return ((h ^ h >> 31) >> 11) / 2**53


def noise(x, y, seed):
    ix, iy = math.floor(x), math.floor(y)
    u, v = (t**3 * (t * (t * 6 - 15) + 10) for t in (x - ix, y - iy))
    a, b, c, d = (lattice(ix + i, iy + j, seed) for j in (0, 1) for i in (0, 1))
    return (a + (b - a) * u) * (1 - v) + (c + (d - c) * u) * v


def fractal(x, y, n, salt):
    return sum(0.42**k * noise(x * 2**k, y * 2**k, 1729 + salt + 7919 * k) for k in range(n)) / sum(0.42**k for k in range(12))


def height(lon, lat, span, grid):
    wave = 0.3 * 2.0 ** round(math.log2(span * 1.2 / 0.3))
    finest, n = 8 * span / (grid - 1), 1
    while n < 12 and wave / 2**n >= finest:
        n += 1
    x, y = lon * math.cos(math.radians(lat)) / wave, lat / wave
    wx, wy = fractal(x + 5.2, y + 1.3, min(4, n), 101), fractal(x + 9.7, y + 3.4, min(4, n), 211)
    base = fractal(x + 0.45 * (2 * wx - 1), y + 0.45 * (2 * wy - 1), n, 0)
    shaped = 0.55 * base + 0.45 * (1 - abs(2 * base - 1)) ** 1.5
    return min(max(shaped, 0), 1) ** 2.4 * 1200 * (wave / 0.3) ** 0.85


@pytest.fixture(scope="module")
def cells(spark):
    frames = [(1, 10.0, 40.0, 10.4, 40.2), (2, 10.4, 40.0, 10.8, 40.2), (3, -20.0, -10.0, 10.0, 30.0), (4, 1.0, 1.0, 1.0, 2.0), (5, None, 0.0, 1.0, 1.0), (6, 2.0, 2.0, 2.0, 2.0)]
    out = T.synthetic(spark.createDataFrame(frames, "frame_id int, west double, south double, east double, north double"), 20)
    return {(r.field_id, r.row, r.col): r for r in out.collect()}


def test_heights_equal_plain_arithmetic(cells):
    assert len(cells) == 4 * 400 and {k[0] for k in cells} == {"1", "2", "3", "4"}  # a line has cells, a point has none
    for (name, row, col), r in list(cells.items())[::37]:
        span = {"1": 0.2, "2": 0.2, "3": 30 * math.cos(math.radians(10)), "4": 1.0}[name]
        assert r.value == pytest.approx(height(r.lon, r.lat, span, 20), rel=1e-9)
    assert (cells["1", 0, 0].lon, cells["1", 0, 0].lat, cells["1", 19, 19].lon, cells["1", 19, 19].lat) == pytest.approx((10.0, 40.2, 10.4, 40.0))


def test_neighbouring_frames_show_one_landscape(cells):
    for row in range(20):
        assert cells["1", row, 19].value == pytest.approx(cells["2", row, 0].value, rel=1e-9)
    assert len({round(r.value, 3) for r in cells.values()}) > 600


def test_noise_of_all_places(spark, sf_dir):
    from isohypse.plans import queries, views

    places = {r.event_id: r for r in views.points(spark, sf_dir).collect()}
    got = queries.QUERIES["value_noise"][0](spark, sf_dir).collect()
    assert len(got) == len(places)
    for r in got[::17]:
        p = places[r.event_id]
        assert r.value == pytest.approx(noise(p.lon / 32, p.lat / 32, 7), rel=1e-12)


def test_no_frames(spark):
    assert T.synthetic(spark.createDataFrame([], "frame_id int, west double, south double, east double, north double")).count() == 0


def test_short_contours_go(spark):
    rows = [(1, [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]), (2, [(0.0, 0.0), (0.0, 3.0)]), (3, [(0.0, 0.0)]), (4, [(0.0, 0.0), (0.0, 2.9)])]
    chains = spark.createDataFrame([(k, [{"r": r, "c": c} for r, c in p]) for k, p in rows], "chain int, points array<struct<r:double,c:double>>")
    assert {r.chain: r.length for r in raster.with_length(chains).collect()} == pytest.approx({1: 2 + math.sqrt(2), 2: 3.0, 3: 0.0, 4: 2.9})
    assert [r.chain for r in raster.long_chains(chains).collect()] == [1, 2]
