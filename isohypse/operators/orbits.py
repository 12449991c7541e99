"""Satellites: positions over time from orbital elements."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from .ordered import antimeridian_runs

#: The earth's gravity (km^3/s^2), its second zonal harmonic, radius (km).
MU, J2, RADIUS_KM = 398600.4418, 1.08262668e-3, 6378.137


def semi_major_axis(motion: Column) -> Column:
    """Kilometres, from revolutions a day."""
    n = motion * (2 * math.pi / 86400.0)
    return F.pow(MU / (n * n), F.lit(1 / 3))


def horizon_degrees(altitude_km: Column) -> Column:
    return F.degrees(F.acos(RADIUS_KM / (RADIUS_KM + F.greatest(altitude_km, F.lit(1.0)))))


_POINT = T.StructType([T.StructField(k, T.DoubleType()) for k in ("lon", "lat", "altitude")])


@F.pandas_udf(_POINT)
def sub_point(epoch: pd.Series, inclination: pd.Series, node: pd.Series, eccentricity: pd.Series, perigee: pd.Series, anomaly: pd.Series, motion: pd.Series, at: pd.Series) -> pd.DataFrame:
    """The point under a satellite: Kepler's equation and the secular drift of an oblate earth."""
    i, e = np.radians(inclination.to_numpy()), eccentricity.to_numpy()
    n = motion.to_numpy() * 2 * np.pi / 86400
    a = np.cbrt(MU / n**2)
    dt = at.to_numpy() - epoch.to_numpy()
    drift = 1.5 * J2 * (RADIUS_KM / (a * (1 - e**2))) ** 2 * n
    om = np.radians(node.to_numpy()) - drift * np.cos(i) * dt
    w = np.radians(perigee.to_numpy()) + drift * (2 - 2.5 * np.sin(i) ** 2) * dt
    m = np.remainder(np.radians(anomaly.to_numpy()) + n * dt, 2 * np.pi)
    ecc = np.where(e >= 0.8, np.pi, m)
    for _ in range(24):
        step = (ecc - e * np.sin(ecc) - m) / (1 - e * np.cos(ecc))
        ecc = ecc - step
        if np.abs(step).max(initial=0) < 1e-12:
            break
    true = 2 * np.arctan2(np.sqrt(1 + e) * np.sin(ecc / 2), np.sqrt(1 - e) * np.cos(ecc / 2))
    r, u = a * (1 - e * np.cos(ecc)), w + true
    x, y, z = r * (np.cos(om) * np.cos(u) - np.sin(om) * np.sin(u) * np.cos(i)), r * (np.sin(om) * np.cos(u) + np.cos(om) * np.sin(u) * np.cos(i)), r * np.sin(u) * np.sin(i)
    jd = 2440587.5 + at.to_numpy() / 86400
    c = (jd - 2451545.0) / 36525
    gmst = np.radians(np.fmod(280.46061837 + 360.98564736629 * (jd - 2451545.0) + 0.000387933 * c**2 - c**3 / 38710000, 360))
    lon = np.remainder(np.degrees(np.arctan2(y, x) - gmst) + 180, 360) - 180
    return pd.DataFrame({"lon": lon, "lat": np.degrees(np.arcsin(z / r)), "altitude": r - RADIUS_KM})


def ground_tracks(elements: DataFrame, start: float, step: float, steps: int) -> DataFrame:
    """name, pos, at, lon, lat, altitude, run: points of each track, split at the antimeridian."""
    rows = elements.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("at", F.lit(float(start)) + F.col("pos") * step)
    p = sub_point("epoch", "inclination", "node", "eccentricity", "perigee", "anomaly", "motion", "at")
    rows = rows.withColumn("p", p).select("name", "pos", "at", "p.lon", "p.lat", "p.altitude")
    return antimeridian_runs(rows, ["name"], ["pos"])


def footprints(points: DataFrame) -> DataFrame:
    """Adds `ring`: the horizon seen from each point."""
    radius = horizon_degrees(F.col("altitude"))
    return points.withColumn("ring", geo.circle(F.col("lon"), F.col("lat"), radius, 72))
