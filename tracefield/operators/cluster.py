"""Clusters of points and of places on a line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import save

# The stride of first centres, rounds, the deviation of the information criterion.
SEED_STRIDE, ROUNDS, SPREAD = 70667, 1000, 0.0005


def kmeans(points: DataFrame, k: int, rounds: int = ROUNDS) -> DataFrame:
    """cluster, lat, lon, n and mean distance (plus 0.00005) of ``k`` centres of points (pid, lat, lon).

    First centres are the points at places i * 70667 (modulo their number) in
    order of pid. The k centres, of a size fixed by the call, are held on the
    driver; each round is one pass of expressions over the points.
    """
    n = points.count()
    if not n:
        return points.sparkSession.createDataFrame([], "cluster int, lat double, lon double, n long, distance double")
    wanted = [i * SEED_STRIDE % n for i in range(k)]
    # Ranks by parts, so that no task orders all points: parts are ranges of pid, numbered by their sizes.
    parts = max(1, n // 1_000_000)
    ranged = save(points.select("pid", "lat", "lon").repartitionByRange(parts, "pid").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    base, bases = 0, {}
    for part in sorted(sizes):
        bases[part], base = base, base + sizes[part]
    start = F.create_map(*(F.lit(v) for kv in bases.items() for v in kv))[F.col("part")]
    ranked = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("pid")) - 1 + start)
    first = {r["at"]: (r["lat"], r["lon"]) for r in ranked.filter(F.col("at").isin(wanted)).collect()}
    centres = [first[w] for w in wanted]
    before, sums = None, []
    for _ in range(rounds):
        labelled = assign(points, centres)
        sums = labelled.groupBy("cluster").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"), F.avg("distance").alias("distance")).collect()
        centres = [next(((r["lat"], r["lon"]) for r in sums if r["cluster"] == j), centres[j]) for j in range(k)]
        now = sorted((r["cluster"], r["n"], round(r["lat"], 12), round(r["lon"], 12)) for r in sums)
        if now == before:
            break
        before = now
    by = {r["cluster"]: r for r in sums}
    rows = [(j, float(c[0]), float(c[1]), int(by[j]["n"]) if j in by else 0, float(by[j]["distance"]) + 0.00005 if j in by else 0.0) for j, c in enumerate(centres)]
    return points.sparkSession.createDataFrame(rows, "cluster int, lat double, lon double, n long, distance double")


def assign(points: DataFrame, centres: list[tuple[float, float]]) -> DataFrame:
    """``points`` with the nearest centre (the first of equals) and its distance."""
    near = F.array_min(F.array(*(F.struct(geo.latlon_distance(F.col("lat"), F.col("lon"), F.lit(float(a)), F.lit(float(b))).alias("distance"), F.lit(j).alias("cluster")) for j, (a, b) in enumerate(centres))))
    return points.withColumn("_near", near).withColumn("cluster", F.col("_near.cluster")).withColumn("distance", F.col("_near.distance")).drop("_near")


def information(points: DataFrame, centres: list[tuple[float, float]]) -> float:
    """The Bayesian information criterion of centres with a fixed deviation."""
    r = assign(points, centres).agg(F.count("*").alias("n"), F.sum(F.col("distance") * F.col("distance")).alias("s")).first()
    per = -2.0 * float(np.log(1.0 / (2.0 * geo.PI * SPREAD * SPREAD)))
    return r["n"] * per + 2.0 * (r["s"] or 0.0) / (2.0 * SPREAD * SPREAD) + float(np.log(max(r["n"], 1))) * len(centres)


def xmeans(points: DataFrame, k1: int, k2: int) -> DataFrame:
    """``kmeans`` with the number of centres from k1 to k2 that has the least criterion."""
    points = save(points.select("pid", "lat", "lon"), "points")
    best = min(range(k1, k2 + 1), key=lambda k: (information(points, [(r["lat"], r["lon"]) for r in kmeans(points, k).orderBy("cluster").collect()]), k))
    return kmeans(points, best)


def em(x: np.ndarray, w: np.ndarray, k: int, rounds: int = 200, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, variances (diagonal), weights and log-likelihood of a mixture of ``k`` normals of weighted points; first means at even quantiles of the first axis."""
    x = x.reshape(len(x), -1)
    order = np.argsort(x[:, 0], kind="stable")
    upto = np.cumsum(w[order]) / w.sum()
    mean = x[order][np.searchsorted(upto, (np.arange(k) + 0.5) / k).clip(0, len(x) - 1)].astype(float)
    var = np.tile(np.average((x - np.average(x, 0, w)) ** 2, 0, w) / k + floor, (k, 1))
    share, last, total = np.full(k, 1 / k), -np.inf, -np.inf
    for _ in range(rounds):
        log = np.log(share) - 0.5 * (np.log(2 * np.pi * var).sum(1) + (((x[:, None] - mean) ** 2) / var).sum(2))
        top = log.max(1, keepdims=True)
        p = np.exp(log - top)
        s = p.sum(1, keepdims=True)
        total = float((w * (np.log(s[:, 0]) + top[:, 0])).sum())
        p = p / s * w[:, None]
        n = np.maximum(p.sum(0), 1e-12)
        mean = (p.T @ x) / n[:, None]
        var = np.stack([(p[:, j][:, None] * (x - mean[j]) ** 2).sum(0) / n[j] for j in range(k)]) + floor
        share = n / n.sum()
        if abs(total - last) < 1e-8 * max(1.0, abs(total)):
            break
        last = total
    return mean, var, share, total


def gaussian_mixture(points: np.ndarray, k1: int, k2: int) -> np.ndarray:
    """Means (lat, lon) of the mixture with the least criterion (7 parameters each)."""
    best = None
    w = np.ones(len(points))
    for k in range(k1, k2 + 1):
        mean, _, _, total = em(points, w, k, floor=1e-14)
        score = np.log(2 * len(points)) * k * 7 - 2 * total
        if best is None or score < best[0]:
            best = (score, mean)
    return best[1]


def lateral_peaks(v: np.ndarray) -> tuple[list[int], list[float], list[float]]:
    """Places, variances and weights of the one to three normals that fit a profile best, each place counted as often as its value's whole part; none for fewer than 10 in all."""
    n = np.maximum(np.asarray(v, float), 0).astype(int)
    if n.sum() < 10:
        return [], [], []
    at = np.flatnonzero(n)
    best = None
    for k in (1, 2, 3):
        if k > len(at):
            break
        mean, var, share, total = em(at.astype(float), n[at].astype(float), k)
        score = (3 * k - 1) * np.log(n.sum()) - 2 * total
        if best is None or score < best[0]:
            best = (score, mean[:, 0], var[:, 0], share)
    return [int(m) for m in best[1]], [float(x) for x in best[2]], [float(x) for x in best[3]]


def profile_peaks(profiles: DataFrame) -> DataFrame:
    """node and peaks (places, variances, weights) of lateral profiles (node, profile)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found = [lateral_peaks(v if v is not None else []) for v in x["profile"]]
            yield pd.DataFrame({"node": x["node"], "peaks": [f[0] for f in found], "variances": [f[1] for f in found], "weights": [f[2] for f in found]})

    return profiles.select(F.col("node").cast("long"), "profile").mapInPandas(run, "node long, peaks array<int>, variances array<double>, weights array<double>")
