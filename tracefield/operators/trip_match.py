"""Counts of trips that make legs, for many requests at once, trip by trip.

What ``trace.match`` asks of a trip needs that trip alone. Where a job asks
hundreds of circles of trips that all pass the same place, joins would move
every visit of every trip several times; here each task keeps whole trips,
asks them all requests and gives away only counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import save
from .trace import CHECK_COUNT, CHECK_RADIUS, STEP, VISIT

#: Degrees of a task's own grid, trips that it asks at once, and parts of the table of trips.
FINE, TRIPS, PARTS = 0.00005, 2000, 64
Leg = tuple[float, float, float, float, float, float, float]  # lat1, lon1, r1, lat2, lon2, r2, dist


def by_trip(samples: DataFrame) -> DataFrame:
    """A saved table with one row for each trip: its samples in one array (a trip is one row, however long), and its box."""
    parts = max(PARTS, int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    box = [f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))]
    rows = samples.repartition(parts, "trip_id").groupBy("trip_id").agg(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))).alias("s"), *box)
    return save(rows.drop("trip_id"), "trips")


def three_legs(r: Sequence[float]) -> tuple[Leg, Leg]:
    """The legs of a three-point request: lat1, lon1 .. lat3, lon3, r1, r2, r3, d1, d2."""
    a, b, c, radius, d = r[0:2], r[2:4], r[4:6], r[6:9], r[9:11]
    return (*a, radius[0], *b, radius[1], d[0]), (*b, radius[1], *c, radius[2], d[1])


def history_legs(p: Sequence[tuple[float, float, float, float]]) -> list[Leg]:
    """The legs of a path's history (points lat, lon, radius, dist, newest first), as ``trace.history_legs`` has them."""
    leg = lambda i, skip: (*p[i][:3], *p[i - skip][:3], p[i][3] if skip == 1 else p[i][3] + p[i - 1][3])
    return [leg(i, 1) for i in range(1, len(p))] + [leg(i, 2) for i in range(2, len(p))]


def probe_legs(p: Sequence[tuple[float, float, float, float]], bins: int = geo.BINS) -> list[tuple[Leg, Leg]]:
    """The two legs to the probe in each direction, as ``trace.direction_scores`` has them."""
    (lat, lon, r, d), (lat1, lon1, r1, d1) = p[0], p[1]
    out = []
    for b in range(bins):
        a = math.radians(b * (360.0 / bins))
        to = (lat + d * math.cos(a), lon + d * math.sin(a) / math.cos(math.radians(lat)))
        out.append(((lat, lon, r, *to, r, d), (lat1, lon1, r, *to, r1, d + d1)))
    return out


def merge_check(trips: DataFrame, pairs: Sequence[tuple[list, list]], metric: str = "planar") -> list[bool]:
    """``trace.merge_check`` of pairs of paths (points lat, lon, newest first), in their order."""
    asked = Requests()
    for one, other in pairs:
        for a, b in ((one, other), (other, one)):
            middle = a[min(len(b) // 2 + 2, len(a)) - 1]
            asked.ask(three_legs((*a[-1], *middle, *b[0], CHECK_RADIUS, CHECK_RADIUS, CHECK_RADIUS, -1.0, -1.0)))
    n = asked.counts(trips, metric)
    return [bool(n[2 * k] > CHECK_COUNT and n[2 * k + 1] > CHECK_COUNT) for k in range(len(pairs))]


class Requests:
    """What is asked in one job: each request is a group of legs that a trip makes in addition to a shared group."""

    def __init__(self):
        self.site_of: dict[tuple[float, float, float], int] = {}
        self.legs: list[tuple[int, int, bool, float]] = []  # sites, whether they touch, the widest gap
        self.shared: list[list[int]] = []
        self.asked: list[tuple[int, list[int]]] = []

    def _leg(self, leg: Leg) -> int:
        lat1, lon1, r1, lat2, lon2, r2, dist = leg
        site = lambda *k: self.site_of.setdefault(k, len(self.site_of))
        dx, dy = lat1 - lat2, (lon1 - lon2) * math.cos(lat1 / 360.0 * (geo.PI * 2.0))
        apart = math.sqrt(dx * dx + dy * dy)
        slack = r1 + r2
        self.legs.append((site(lat1, lon1, r1), site(lat2, lon2, r2), apart <= slack, (apart if dist < 0 else dist) * 2.0 + slack))
        return len(self.legs) - 1

    def share(self, legs: Sequence[Leg]) -> int:
        """A group of legs that several requests have in common; its number."""
        self.shared.append([self._leg(x) for x in legs])
        return len(self.shared) - 1

    def ask(self, legs: Sequence[Leg], shared: int = -1) -> int:
        """A request; its place in the counts."""
        self.asked.append((shared, [self._leg(x) for x in legs]))
        return len(self.asked) - 1

    def counts(self, trips: DataFrame, metric: str = "planar") -> np.ndarray:
        """The number of trips that make all legs of each request; ``trips`` is of :func:`by_trip`."""
        if not self.asked:
            return np.zeros(0, np.int64)
        sites = np.array(list(self.site_of))
        pad = sites[:, 2]
        wide = pad if metric == "planar" else pad / np.maximum(np.cos(np.radians(sites[:, 0])), 1e-3)
        near = trips.filter((F.col("lat_max") >= float((sites[:, 0] - pad).min())) & (F.col("lat_min") <= float((sites[:, 0] + pad).max())) & (F.col("lon_max") >= float((sites[:, 1] - wide).min())) & (F.col("lon_min") <= float((sites[:, 1] + wide).max())))
        sent = trips.sparkSession.sparkContext.broadcast((sites, wide, self.legs, self.shared, self.asked, metric))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(sent.value[4]), np.int64)
            for batch in batches:
                for k in range(0, batch.num_rows, TRIPS):
                    total += _count(batch.column(0).slice(k, TRIPS), *sent.value)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

        out = np.zeros(len(self.asked), np.int64)
        for r in near.select("s").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
            out[r["at"]] = r["n"]
        return out


def _visits(col: pa.ListArray, sites: np.ndarray, wide: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each trip in each site (sites x trips); last is -1 where it is never there or stays too long."""
    s = col.flatten()
    trip = np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy()))
    idx, lat, lon = (s.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    low, high = (sites[:, 0] - sites[:, 2]).min() - FINE, (sites[:, 0] + sites[:, 2]).max() + FINE
    west, east = (sites[:, 1] - wide).min() - FINE, (sites[:, 1] + wide).max() + FINE
    keep = (lat >= low) & (lat <= high) & (lon >= west) & (lon <= east)
    trip, idx, lat, lon = trip[keep], idx[keep], lat[keep], lon[keep]
    # Sorted by cell, a row of cells below a site is one stretch.
    row, width = np.floor((lat - low) / FINE).astype(np.int64), int((east - west) / FINE) + 2
    key = row * width + np.floor((lon - west) / FINE).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, trip, idx, lat, lon = key[order], trip[order], idx[order], lat[order], lon[order]
    big = np.iinfo(np.int64).max
    lo, hi = np.full((len(sites), len(col)), big), np.full((len(sites), len(col)), -1, np.int64)
    for k, ((y, x, r), w) in enumerate(zip(sites, wide)):
        rows = np.arange(math.floor((y - r - low) / FINE) - 1, math.floor((y + r - low) / FINE) + 2) * width
        a = np.searchsorted(key, rows + max(0, math.floor((x - w - west) / FINE) - 1))
        b = np.searchsorted(key, rows + min(width - 1, math.floor((x + w - west) / FINE) + 1), "right")
        shrink = 1.0 if metric == "planar" else math.cos(y / 360.0 * (geo.PI * 2.0))
        for i, j in zip(a, b):
            if i < j:
                dy, dx = y - lat[i:j], (x - lon[i:j]) * shrink
                at = np.flatnonzero(np.sqrt(dy * dy + dx * dx) < r) + i
                np.minimum.at(lo[k], trip[at], idx[at])
                np.maximum.at(hi[k], trip[at], idx[at])
    hi[(hi >= 0) & (hi - lo > VISIT)] = -1
    return lo, hi


def _count(col: pa.ListArray, sites: np.ndarray, wide: np.ndarray, legs: list, shared: list, asked: list, metric: str) -> np.ndarray:
    """The number of the trips that make each request."""
    lo, hi = _visits(col, sites, wide, metric)
    there = hi >= 0

    def made(group: list[int], base: np.ndarray | None) -> np.ndarray:
        for k in group:
            a, b, touch, gap = legs[k]
            ok = there[a] & there[b]
            if not touch:
                ok &= (hi[a] <= lo[b]) & ((lo[b] - hi[a]) * STEP < gap)
            base = ok if base is None else base & ok
            if not base.any():
                return base
        return base

    bases = [made(group, None) for group in shared]
    out = np.zeros(len(asked), np.int64)
    for k, (base, group) in enumerate(asked):
        if base < 0 or bases[base].any():
            out[k] = np.count_nonzero(made(group, None if base < 0 else bases[base]))
    return out
