"""Similarity of paths (arrays of structs of lat and lon)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

# Points of a resampled path, window, far distance, and replies for paths that can't be compared.
POINTS, WINDOW, FAR, NEVER = 40, 32, 0.0005, 1000000.0


def length_of(path: Column) -> Column:
    """Sum of the distances between successive points."""
    steps = F.transform(F.sequence(F.lit(2), F.size(path)), lambda i: geo.latlon_distance(F.element_at(path, i - 1)["lat"], F.element_at(path, i - 1)["lon"], F.element_at(path, i)["lat"], F.element_at(path, i)["lon"]))
    return F.when(F.size(path) > 1, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))


def raw(a: Column, b: Column) -> Column:
    """Sum of planar distances of points in pairs, and the summed difference."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p))
    return F.struct(
        total(lambda p: geo.planar(p["a"]["lat"], p["a"]["lon"], p["b"]["lat"], p["b"]["lon"])).alias("total"),
        total(lambda p: p["a"]["lat"] - p["b"]["lat"]).alias("dlat"),
        total(lambda p: p["a"]["lon"] - p["b"]["lon"]).alias("dlon"),
    )


def raw_latlon(a: Column, b: Column, threshold: float = 1000.0) -> Column:
    """Sum of distances in pairs, those above the threshold as 1000, and the last one of them."""

    def d(p: Column) -> Column:
        x = geo.latlon_distance(p["a"]["lat"], p["a"]["lon"], p["b"]["lat"], p["b"]["lon"], np.pi)
        return F.when(x > threshold, F.lit(1000.0)).otherwise(x)

    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.struct(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + d(p)).alias("total"), d(F.element_at(pairs, -1)).alias("last"))


def unbiased(a: Column, b: Column) -> Column:
    """Mean distance in pairs after the mean difference is taken off."""
    n = F.size(a)
    mean = lambda c: F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(0.0), lambda s, p: s + p["b"][c] - p["a"][c]) / n
    bias = F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))
    shifted = F.zip_with(a, b, lambda x, y: geo.planar(x["lat"] + bias["lat"], x["lon"] + bias["lon"], y["lat"], y["lon"]))
    return F.aggregate(shifted, F.lit(0.0), lambda s, d: s + d) / n


def shares_node(a: Column, b: Column) -> Column:
    """Whether two arrays of node ids have one in common."""
    return F.arrays_overlap(a, b)


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.hypot(p[..., 0] - q[..., 0], (p[..., 1] - q[..., 1]) * np.cos(np.radians(p[..., 0])))


def resample(path: np.ndarray, points: int = POINTS) -> np.ndarray:
    """Points at equal distances along a path, both ends left out. The places add up in floating point, so one more can come out at the end."""
    along = np.concatenate([[0.0], np.cumsum(_distances(path[:-1], path[1:]))])
    step = along[-1] / (points + 1)
    if not step > 0:
        return np.zeros((0, 2))
    places = np.add.accumulate(np.full(points + 3, step))
    places = places[places < along[-1]]
    k = np.clip(np.searchsorted(along, places, side="right") - 1, 0, len(path) - 2)
    share = ((places - along[k]) / np.maximum(along[k + 1] - along[k], 1e-300))[:, None]
    return path[k] * (1 - share) + path[k + 1] * share


def window_similarity(a: np.ndarray, b: np.ndarray, threshold: float = FAR) -> float:
    """The least sum of distances between windows of both resampled paths; NEVER where they are too short."""
    if len(a) < 2 or len(b) < 2:
        return NEVER
    p, q = resample(a), resample(b)
    n = min(len(p), len(q))
    m = n - WINDOW
    if m <= 0:
        return NEVER
    # All distances once; a window pair's sum lies along a diagonal.
    d = _distances(p[:n, None], q[None, :n])
    d = np.where(d > threshold, 1000.0, d)
    steps = np.arange(WINDOW)
    i, j = np.meshgrid(np.arange(m), np.arange(m), indexing="ij")
    return float(min(NEVER, d[i[..., None] + steps, j[..., None] + steps].sum(-1).min()))


def window_similarities(pairs: DataFrame, threshold: float = FAR) -> DataFrame:
    """pid and similarity of pairs (pid, path_a, path_b). Null or short paths give NEVER."""

    def points(path) -> np.ndarray:
        return np.array([(p["lat"], p["lon"]) for p in path], float).reshape(-1, 2) if path is not None else np.zeros((0, 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"pid": x["pid"], "similarity": [window_similarity(points(a), points(b), threshold) for a, b in zip(x["path_a"], x["path_b"])]})

    return pairs.select(F.col("pid").cast("long"), "path_a", "path_b").mapInPandas(run, "pid long, similarity double")


def spline(path: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A natural cubic spline through a path's points, by chord length, at shares 0 to 1."""
    t = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(path, axis=0).T))])
    t = t / t[-1] if t[-1] > 0 else np.linspace(0, 1, len(path))
    h = np.maximum(np.diff(t), 1e-12)
    n = len(path)
    m = np.zeros((n, n))
    rhs = np.zeros((n, 2))
    m[0, 0] = m[-1, -1] = 1
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        rhs[i] = 6 * ((path[i + 1] - path[i]) / h[i] - (path[i] - path[i - 1]) / h[i - 1])
    bend = np.linalg.solve(m, rhs)
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, n - 2)
    a, b = ((t[k + 1] - at) / h[k])[:, None], ((at - t[k]) / h[k])[:, None]
    return a * path[k] + b * path[k + 1] + ((a**3 - a) * bend[k] + (b**3 - b) * bend[k + 1]) * (h[k] ** 2)[:, None] / 6


def spline_similarity(a: np.ndarray, b: np.ndarray, threshold: float = 0.0002) -> tuple[float, float, float]:
    """The least sum of planar distances between windows of both paths' splines, and the summed difference there; 1000 for paths that are far apart in a pair of points or that repeat a point."""
    if len(a) != len(b) or len(a) < 2 or (np.hypot(*(a - b).T) > threshold).any() or any(len({tuple(p) for p in x[:-1]}) < len(x) - 1 for x in (a, b)):
        return 1000.0, 0.0, 0.0
    at = np.arange(1 / POINTS, 1.0, 1 / POINTS)
    p, q = spline(a, at), spline(b, at)
    best = (10000.0, 0.0, 0.0)
    for i in range(len(p) - WINDOW):
        for j in range(len(q) - WINDOW):
            d = p[i : i + WINDOW] - q[j : j + WINDOW]
            total = float(np.hypot(*d.T).sum())
            if total < best[0]:
                best = (total, float(d[:, 0].sum()), float(d[:, 1].sum()))
    return best
