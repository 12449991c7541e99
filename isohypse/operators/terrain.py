"""Invented terrain over a table of frames.

Heights are a function of place alone: noise on a lattice of the globe, warped by more
noise, mixed with ridges and sharpened.  A frame chooses the size of the largest landform,
by a ladder of powers of two, and how many octaves its grid can show; so frames of one size
side by side show one landscape.  A row of the grid is a row of the table, so frames and
their rows are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import frames as fr

#: The landscape's seed, its octaves' gain and number, its warp, ridges and contrast.
SEED, GAIN, LACUNARITY, OCTAVES = 1729, 0.42, 2.0, 12
WARP_OCTAVES, WARP, RIDGES, RIDGE_POWER, CONTRAST = 4, 0.45, 0.45, 1.5, 2.4
#: Where the two warps are taken from the noise, and their salts; the seed's step by octave.
WARPS = ((5.2, 1.3, 101), (9.7, 3.4, 211))
SEED_STEP = 7919
#: Fixed values of the lattice hash.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
ROUNDS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
_MASK = (1 << 64) - 1


def lattice(ix: np.ndarray, iy: np.ndarray, seed: int) -> np.ndarray:
    """A number from 0 to 1 for each lattice point."""
    a, b, c = FACTORS
    h = ix.astype(np.int64).view(np.uint64) * np.uint64(a) ^ iy.astype(np.int64).view(np.uint64) * np.uint64(b) ^ np.uint64(seed * c & _MASK)
    for shift, factor in ROUNDS:
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def noise(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Lattice numbers between which the fade is of the fifth degree."""
    ix, iy = np.floor(x), np.floor(y)
    u, v = (t * t * t * (t * (t * 6 - 15) + 10) for t in (x - ix, y - iy))
    north, south = (lattice(ix, iy + k, seed) * (1 - u) + lattice(ix + 1, iy + k, seed) * u for k in (0, 1))
    return north * (1 - v) + south * v


def noise_at(x: Column, y: Column, seed: int, scale: float = 1.0) -> Column:
    """Noise of a place, as a column."""

    @F.arrow_udf("double")
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(noise(a.to_numpy(zero_copy_only=False) / scale, b.to_numpy(zero_copy_only=False) / scale, seed))

    return of(x, y)


def octaves(x: np.ndarray, y: np.ndarray, count: np.ndarray, salt: int) -> np.ndarray:
    """Octaves of noise, as many as count says; the scale is that of all there could be."""
    total = np.zeros(len(x))
    for k in range(int(count.max(initial=0))):
        there = np.flatnonzero(count > k)
        f = LACUNARITY**k
        total[there] += GAIN**k * noise(x[there] * f, y[there] * f, SEED + salt + k * SEED_STEP)
    return total / sum(GAIN**k for k in range(OCTAVES))


def heights(lon: np.ndarray, lat: np.ndarray, wavelength: np.ndarray, count: np.ndarray, relief: np.ndarray) -> np.ndarray:
    x, y = lon * np.cos(np.radians(lat)) / wavelength, lat / wavelength
    few = np.minimum(count, WARP_OCTAVES)
    dx, dy = (WARP * (2 * octaves(x + ox, y + oy, few, salt) - 1) for ox, oy, salt in WARPS)
    base = octaves(x + dx, y + dy, count, 0)
    mixed = (1 - RIDGES) * base + RIDGES * (1 - np.abs(2 * base - 1)) ** RIDGE_POWER
    return np.clip(mixed, 0, 1) ** CONTRAST * relief


def synthetic(frames: DataFrame, grid: int = 320) -> DataFrame:
    """field_id, row, col, lon, lat, value of each frame: row 0 in the north, outer cells on the frame's sides.

    frames: frame_id, west, south, east, north; one with a null, or a point, has no cells.
    """
    span = fr.window_span(F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    own = frames.select(F.col("frame_id").cast("string").alias("field_id"), *(F.col(k).cast("double").alias(k) for k in ("west", "south", "east", "north")), span.alias("span")).where("span > 0 AND west IS NOT NULL AND south IS NOT NULL AND east IS NOT NULL AND north IS NOT NULL")
    own = own.withColumns({"wavelength": fr.wavelength(F.col("span")), "relief": fr.relief(F.col("span")), "count": fr.resolvable_octaves(F.col("span"), grid)})
    rows = own.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).repartition("field_id", "row")
    slices = max(1, 100_000 // grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, slices):
                part = batch.slice(a, slices)
                at = {n: np.repeat(part.column(n).to_numpy(zero_copy_only=False), grid) for n in ("west", "south", "east", "north", "wavelength", "relief", "count", "row")}
                col = np.tile(np.arange(grid, dtype=np.int32), part.num_rows)
                lat = at["north"] + (at["south"] - at["north"]) * at["row"] / (grid - 1)
                lon = at["west"] + (at["east"] - at["west"]) * col / (grid - 1)
                value = heights(lon, lat, at["wavelength"], at["count"], at["relief"])
                names = part.column("field_id").take(pa.array(np.repeat(np.arange(part.num_rows), grid)))
                yield pa.RecordBatch.from_arrays([names, pa.array(at["row"].astype(np.int32)), pa.array(col), pa.array(lon), pa.array(lat), pa.array(value)], names=["field_id", "row", "col", "lon", "lat", "value"])

    return rows.mapInArrow(run, "field_id string, row int, col int, lon double, lat double, value double")
