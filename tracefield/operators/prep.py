"""From raw trips (trip_id, seq, lat, lon, ts) to evenly spaced, indexed samples."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .grid import with_cells

# Spacing in metres, parts of a spacing, and the length in steps of 1e-5 degrees from which a gap stays open.
SPACING, PARTS, TUNNEL = 5.0, 5, 100
SPACED = "trip_id long, k long, lat double, lon double, t double"


def _trip(*order: str) -> Window:
    return Window.partitionBy("trip_id").orderBy(*order)


def every(trips: DataFrame, rate: int) -> DataFrame:
    """Every ``rate``-th point of each trip, from the first on."""
    if rate <= 1:
        return trips
    return trips.withColumn("_k", F.row_number().over(_trip("seq")) - 1).filter(F.col("_k") % rate == 0).drop("_k")


def rebased(trips: DataFrame) -> DataFrame:
    """``trips`` with ``t``: seconds since the trip's first point."""
    return trips.withColumn("t", (F.col("ts") - F.first("ts").over(_trip("seq"))).cast("double"))


def _metres(lat: float, lon: float) -> tuple[float, float]:
    return (lat - geo.ORIGIN_LAT) * geo.METERS, (lon - geo.ORIGIN_LON) * geo.METERS * math.cos(lat / 360.0 * (geo.PI * 2.0))


def _shares(here: tuple[float, float], a: tuple[float, float], b: tuple[float, float], r: float) -> tuple[float, ...]:
    """Shares of the way from a to b at the distance r from here, the greater first."""
    ax, ay = a[0] - here[0], a[1] - here[1]
    dx, dy = b[0] - a[0], b[1] - a[1]
    q, h, c = dx * dx + dy * dy, 2.0 * (ax * dx + ay * dy), ax * ax + ay * ay - r * r
    root = h * h - 4.0 * q * c
    return ((-h + math.sqrt(root)) / (2.0 * q), (-h - math.sqrt(root)) / (2.0 * q)) if root > 0 and q > 0 else ()


def spaced(lat: np.ndarray, lon: np.ndarray, t: np.ndarray, spacing: float = SPACING) -> list[tuple[float, float, float]]:
    """Points (lat, lon, t) each ``spacing`` metres from the one before, along a line; the first raw point is not one.

    From each point the line ahead is searched for where it leaves a circle
    around it. On the current piece only what lies ahead counts; the nearer
    crossing is taken only if the farther one is on the piece but behind.
    """
    out: list[tuple[float, float, float]] = []
    here, piece, ahead, at = (float(lat[0]), float(lon[0])), 0, 0.0, 0
    ends = [_metres(float(a), float(b)) for a, b in zip(lat, lon)]
    while at < len(lat) - 1:
        found = None
        shares = _shares(_metres(*here), ends[at], ends[at + 1], spacing)
        if shares and 0.0 <= shares[0] <= 1.0:
            found = next((a for a in shares if 0.0 <= a <= 1.0 and (at > piece or a > ahead)), None)
        if found is None:
            at += 1
            continue
        a, piece, ahead = found, at, found
        here = tuple(float((1 - a) * v[at] + a * v[at + 1]) for v in (lat, lon))
        out.append((*here, float((1 - a) * t[at] + a * t[at + 1])))
    return out


def resample(trips: DataFrame, spacing: float = SPACING) -> DataFrame:
    """trip_id, k, lat, lon and t at constant spacing. Each trip is walked by itself (a step depends on the one before); trips without two points out give none."""

    def walk(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("seq")
        rows = spaced(x["lat"].to_numpy(), x["lon"].to_numpy(), x["t"].to_numpy(), spacing) if len(x) else []
        if len(rows) < 2:
            rows = []
        out = pd.DataFrame(rows, columns=["lat", "lon", "t"])
        out.insert(0, "trip_id", x["trip_id"].iloc[0])
        out.insert(1, "k", range(len(out)))
        return out

    points = rebased(trips.filter("lat is not null and lon is not null and ts is not null"))
    return points.select("trip_id", "seq", "lat", "lon", "t").groupBy("trip_id").applyInPandas(walk, SPACED)


def densify(points: DataFrame, parts: int = PARTS, tunnel: int = TUNNEL) -> DataFrame:
    """``parts`` points for each step between spaced points (trip_id, k, lat, lon, t), but one for a step too long: trip_id, k, part, lat, lon and speed_inv."""
    w = _trip("k")
    lead = lambda c: F.lead(c).over(w).alias(f"{c}2")
    rows = points.select("trip_id", "k", "lat", "lon", "t", lead("lat"), lead("lon"), lead("t"))
    length = geo.planar(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    n = F.when(F.col("lat2").isNull() | (F.ceil(length / F.lit(0.00001)) >= tunnel), 1).otherwise(parts)
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
    alpha = F.col("part").cast("double") / F.lit(float(parts))
    at = lambda c: F.when(F.col("part") == 0, F.col(c)).otherwise(geo.lerp(F.col(c), F.col(f"{c}2"), alpha)).alias(c)
    return rows.select("trip_id", "k", "part", at("lat"), at("lon"), F.coalesce(F.col("t2") - F.col("t"), F.lit(0.0)).alias("speed_inv"))


def with_distance(samples: DataFrame, *order: str) -> DataFrame:
    """``samples`` with ``k`` (0, 1, ...) and ``total_distance`` along each trip, ordered by ``order`` (by default idx)."""
    w = _trip(*(order or ("idx",)))
    step = geo.planar(F.col("lat"), F.col("lon"), F.lag("lat").over(w), F.lag("lon").over(w))
    total = F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return samples.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("total_distance", total).withColumn("k", F.row_number().over(w) - 1).drop("_step")


def with_heading(samples: DataFrame) -> DataFrame:
    """``samples`` with ``angle``: the heading to the next one; the last keeps that of the one before."""
    w = _trip("idx")
    to = geo.heading(F.col("lat"), F.col("lon"), F.lead("lat").over(w), F.lead("lon").over(w))
    out = samples.withColumn("_to", to)
    return out.withColumn("angle", F.coalesce("_to", F.lag("_to").over(w), F.lit(0.0))).drop("_to")


def build_index(trips: DataFrame, rate: int = 1, interpolate: bool = True) -> DataFrame:
    """Indexed samples of raw trips: trip_id, idx, lat, lon, total_distance, speed_inv, angle, clat and clon.

    Without interpolation the raw points are the samples, and idx,
    total_distance and speed_inv are 0.
    """
    trips = every(trips, rate)
    if not interpolate:
        w = _trip("seq")
        raw = rebased(trips).withColumn("idx", F.row_number().over(w) - 1)
        out = with_heading(raw.select("trip_id", "idx", "lat", "lon"))
        return with_cells(out.select("trip_id", F.lit(0).cast("long").alias("idx"), "lat", "lon", F.lit(0.0).alias("total_distance"), F.lit(0.0).alias("speed_inv"), "angle"))
    fine = densify(resample(trips))
    out = with_distance(fine.withColumn("idx", F.row_number().over(_trip("k", "part")) - 1).drop("k", "part"))
    out = with_heading(out.drop("k"))
    return with_cells(out.select("trip_id", F.col("idx").cast("long").alias("idx"), "lat", "lon", "total_distance", "speed_inv", "angle"))
