"""Rasters as sparse tables of pixels (row, col)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.components import label
from . import trace
from .grid import box_join

# Index distance between both middles of a trip, and around it; hits' weight in the region image.
NEAR, AROUND, WEIGHT = 300, 300, 32
# The merge check's half size in degrees, raster size, blotted middle, radius and deviation.
HALF_SIZE, SIZE, BLOT, RADIUS, SIGMA, TRUNCATE = 0.004, 512, (192, 320), 0.00005, 4, 4.0
# How far a way of pixels may lead, how near it must come, and the radius of a drawn vertex.
REACH, NEAR_TARGET, DISC = 80, 12, 3


def steps(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Each sample with its successor (lat2, lon2) where the successor's index is the next."""
    w = Window.partitionBy(*keys, "trip_id").orderBy("idx")
    lead = lambda c: F.lead(c).over(w)
    return samples.withColumn("idx2", lead("idx")).withColumn("lat2", lead("lat")).withColumn("lon2", lead("lon")).filter("idx2 = idx + 1").drop("idx2")


def rasterise(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of segments (keys, row1, col1, row2, col2): one for each step along the longer axis, the last point left out."""
    rows, cols = F.col("row2") - F.col("row1"), F.col("col2") - F.col("col1")
    tall = F.abs(rows) > F.abs(cols)
    n = F.greatest(F.abs(rows), F.abs(cols))
    out = segments.filter(n > 0).withColumn("_n", n).withColumn("_tall", tall).withColumn("_k", F.explode(F.sequence(F.lit(0), n - 1)))
    share = F.col("_k").cast("double") / F.col("_n")
    walk = lambda a, b: F.when(F.col(b) > F.col(a), F.col(a) + F.col("_k")).otherwise(F.col(a) - F.col("_k"))
    slide = lambda a, b: (F.col(a).cast("double") * (1.0 - share) + F.col(b).cast("double") * share).cast("int")
    row = F.when(F.col("_tall"), walk("row1", "row2")).otherwise(slide("row1", "row2"))
    col = F.when(F.col("_tall"), slide("col1", "col2")).otherwise(walk("col1", "col2"))
    return out.select(*keys, row.alias("row"), col.alias("col"))


def _pixels(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments in degrees (lat, lon, lat2, lon2 and a box and size in the row) as segments in pixels."""
    at = lambda v, low, high: ((F.col(v) - F.col(low)) / (F.col(high) - F.col(low)) * F.col("size").cast("double")).cast("int")
    out = segments.select(*keys, "size", *(at(f"lat{k}" if k == 2 else "lat", "lat_min", "lat_max").alias(f"row{k}") for k in (1, 2)), *(at(f"lon{k}" if k == 2 else "lon", "lon_min", "lon_max").alias(f"col{k}") for k in (1, 2)))
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < F.col("size"))
    return rasterise(out, [*keys, "size"]).filter(inside("row") & inside("col")).drop("size")


def passthrough(samples: DataFrame, requests: DataFrame, metric: str = "planar") -> DataFrame:
    """How often trips through three circles touch each pixel near where they pass the last (qid, lat1..lon3, radius, lat_min, lon_min, lat_max, lon_max, size): qid, row, col and cnt."""
    three = requests.select("qid", *(f"{x}{k}" for k in (1, 2, 3) for x in ("lat", "lon")), *(F.col("radius").alias(f"r{k}") for k in (1, 2, 3)), F.lit(-1.0).alias("d1"), F.lit(-1.0).alias("d2"))
    trips = trace.three_point_trips(samples, three, metric).filter(F.abs(F.col("i_mid") - F.col("i2")) < NEAR).select("qid", "trip_id", F.col("i2").alias("middle"))
    boxes = requests.select("qid", (F.col("lat_min") - 0.00002).alias("lat_min"), (F.col("lon_min") - 0.00002).alias("lon_min"), (F.col("lat_max") + 0.00002).alias("lat_max"), (F.col("lon_max") + 0.00002).alias("lon_max"))
    rows = box_join(samples.select("trip_id", "idx", "lat", "lon", "clat", "clon"), boxes, exact=False).join(trips, ["qid", "trip_id"])
    rows = steps(rows, ["qid"]).filter(F.abs(F.col("idx") - F.col("middle")) <= AROUND)
    rows = rows.join(requests.select("qid", "lat_min", "lon_min", "lat_max", "lon_max", "size"), "qid")
    return _pixels(rows, ["qid"]).groupBy("qid", "row", "col").agg(F.count("*").alias("cnt"))


def region_density(samples: DataFrame, region: tuple[float, float, float, float], rows: int, cols: int) -> DataFrame:
    """row, col and weight (32 a hit) of all trips over a region (min_lat, min_lon, max_lat, max_lon)."""
    a, b, c, d = region
    at = lambda v, low, high, n: geo.pixel(F.col(v), low, high, n)
    seg = steps(samples.select("trip_id", "idx", "lat", "lon"), []).select(at("lat", a, c, rows).alias("row1"), at("lon", b, d, cols).alias("col1"), at("lat2", a, c, rows).alias("row2"), at("lon2", b, d, cols).alias("col2"))
    hits = rasterise(seg, []).filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))
    return hits.groupBy("row", "col").agg((F.count("*") * WEIGHT).alias("weight"))


def kernel(sigma: float = SIGMA, truncate: float = TRUNCATE) -> np.ndarray:
    """The weights of a Gaussian, cut at ``truncate`` deviations."""
    r = int(truncate * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def blur(pixels: DataFrame, keys: list[str], size: int = SIZE, sigma: float = SIGMA) -> DataFrame:
    """A Gaussian blur of sparse pixels (keys, row, col, cnt), first along rows, then along columns; the raster is mirrored at its edges."""
    w = kernel(sigma)
    r = len(w) // 2
    taps = F.array(*(F.struct(F.lit(int(k - r)).alias("k"), F.lit(float(v)).alias("w")) for k, v in enumerate(w)))
    out = pixels.withColumn("cnt", F.col("cnt").cast("double"))
    for axis, other in (("row", "col"), ("col", "row")):
        far = out.withColumn("tap", F.explode(taps))
        # A pixel of the mirror image gives its share to the pixel inside that it stands for.
        places = F.array_distinct(F.array(F.col(axis), -F.col(axis) - 1, F.lit(2 * size - 1) - F.col(axis)))
        far = far.withColumn("at", F.explode(places)).withColumn(axis, F.col("at") + F.col("tap.k")).filter(F.col(axis).between(0, size - 1))
        out = far.groupBy(*keys, axis, other).agg(F.sum(F.col("cnt") * F.col("tap.w")).alias("cnt"))
    return out


def merge_similarity(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """How much of path b's traffic lies where path a's does (pid, path_a, path_b: arrays of lat, lon, newest first): pid and similarity.

    Each path's pass-through raster through its nodes 5, 3 and 0, blotted in
    the middle, blurred and scaled to its greatest value. 0 where b has no
    traffic.
    """
    lat, lon = F.col("path_a")[0]["lat"], F.col("path_a")[0]["lon"]
    wide = F.lit(HALF_SIZE) / F.cos(F.radians(lat))
    box = [(lat - HALF_SIZE).alias("lat_min"), (lon - wide).alias("lon_min"), (lat + HALF_SIZE).alias("lat_max"), (lon + wide).alias("lon_max"), F.lit(SIZE).alias("size"), F.lit(RADIUS).alias("radius")]
    ask = lambda c, side: pairs.select(F.struct("pid", F.lit(side).alias("side")).alias("qid"), *(F.try_element_at(F.col(c), F.lit(i + 1))[x].alias(f"{x}{k}") for k, i in ((1, 5), (2, 3), (3, 0)) for x in ("lat", "lon")), *box)
    pixels = passthrough(samples, ask("path_a", 1).unionByName(ask("path_b", 2)))
    middle = F.col("row").between(BLOT[0], BLOT[1] - 1) & F.col("col").between(BLOT[0], BLOT[1] - 1)
    blurred = blur(pixels.filter(~middle), ["qid"])
    top = blurred.groupBy("qid").agg(F.max("cnt").alias("top"))
    scaled = blurred.join(top, "qid").select(F.col("qid.pid").alias("pid"), F.col("qid.side").alias("side"), "row", "col", (F.col("cnt") / F.col("top")).alias("v"))
    both = scaled.groupBy("pid", "row", "col").agg(F.sum(F.when(F.col("side") == 1, F.col("v")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("side") == 2, F.col("v")).otherwise(0.0)).alias("b"))
    sums = both.groupBy("pid").agg(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0.0))).alias("more"), F.sum("b").alias("all"))
    out = pairs.select("pid").join(sums, "pid", "left")
    return out.select("pid", F.coalesce(1.0 - F.col("more") / F.nullif(F.col("all"), F.lit(0.0)), F.lit(0.0)).alias("similarity"))


def pixels_linked(pixels: DataFrame, requests: DataFrame, reach: int = REACH, near: int = NEAR_TARGET) -> DataFrame:
    """Whether set pixels (row, col) lead, side by side or corner to corner, from one place to near another (qid, row, col, row2, col2).

    A way starts at the place's pixel or one of its eight neighbours, stays
    within ``reach`` pixels of it and ends within ``near`` pixels of the target.
    qid and linked, one row a request. A request takes the pixels of its own
    circle only, so that its group is bounded; requests and pixels meet by tile.
    """
    tile = lambda c: F.floor(F.col(c) / reach).cast("int")
    beside = lambda c: F.explode(F.sequence(tile(c) - 1, tile(c) + 1))
    asked = requests.select("qid", F.col("row").alias("r0"), F.col("col").alias("c0"), "row2", "col2").withColumn("tr", beside("r0")).withColumn("tc", beside("c0"))
    rows = pixels.select("row", "col").withColumn("tr", tile("row")).withColumn("tc", tile("col")).join(asked, ["tr", "tc"])
    square = lambda a, b: (F.col("row") - F.col(a)) * (F.col("row") - F.col(a)) + (F.col("col") - F.col(b)) * (F.col("col") - F.col(b))
    begin = F.greatest(F.abs(F.col("row") - F.col("r0")), F.abs(F.col("col") - F.col("c0"))) <= 1
    rows = rows.filter(square("r0", "c0") <= reach * reach).select("qid", (F.col("row") - F.col("r0")).alias("y"), (F.col("col") - F.col("c0")).alias("x"), begin.alias("begin"), (square("row2", "col2") <= near * near).alias("end"))
    wide = 2 * reach + 3

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        at = ((group["y"] + reach + 1) * wide + group["x"] + reach + 1).to_numpy(np.int64)
        there = np.zeros(wide * wide, bool)
        there[at] = True
        places = np.flatnonzero(there)
        edges = [(places[there[places + d]], places[there[places + d]] + d) for d in (1, wide - 1, wide, wide + 1)]
        vertices, component = label(*(np.concatenate(x) for x in zip(*edges, (places, places))))
        of = component[np.searchsorted(vertices, at)]
        ends = np.intersect1d(of[group["begin"].to_numpy(bool)], of[group["end"].to_numpy(bool)])
        return pd.DataFrame({"qid": group["qid"].iloc[:1], "linked": [len(ends) > 0]})

    found = rows.groupBy("qid").applyInPandas(linked, rows.select("qid", F.lit(True).alias("linked")).schema)
    return requests.select("qid").join(found, "qid", "left").select("qid", F.coalesce("linked", F.lit(False)).alias("linked"))


def mask_values(points: DataFrame, mask: DataFrame, region: tuple[float, float, float, float], rows: int, cols: int) -> DataFrame:
    """``points`` (lat, lon and more) with the ``value`` of a mask (row, col, value; row 0 at the north) over a region, 0 outside of both."""
    a, b, c, d = region
    row = ((1.0 - (F.col("lat") - a) / (c - a)) * float(rows)).cast("int")
    col = ((F.col("lon") - b) / (d - b) * float(cols)).cast("int")
    inside = geo.in_region(F.col("lat"), F.col("lon"), region)
    placed = points.withColumn("_row", F.when(inside, row)).withColumn("_col", F.when(inside, col))
    known = mask.select(F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("value").alias("_value"))
    return placed.join(known, ["_row", "_col"], "left").select(*points.columns, F.coalesce("_value", F.lit(0)).alias("value"))


def discs(pixels: DataFrame, radius: int = DISC) -> DataFrame:
    """The distinct pixels (row, col) within ``radius`` of the given ones."""
    near = [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]
    offset = F.explode(F.array(*(F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in near)))
    return pixels.withColumn("_o", offset).select((F.col("row") + F.col("_o.y")).alias("row"), (F.col("col") + F.col("_o.x")).alias("col")).distinct()


def dense(pixels: DataFrame, rows: int, cols: int, value: str = "cnt") -> np.ndarray:
    """A raster of bounded size as an array on the driver, row 0 at the bottom."""
    if rows * cols > 1 << 26:
        raise ValueError("too large a raster for the driver")
    out = np.zeros((rows, cols))
    for r in pixels.select("row", "col", value).toLocalIterator():
        out[r["row"], r["col"]] = r[value]
    return out


def meters_per_degree(lat: float) -> float:
    return 111111.0 * math.cos(math.radians(lat))
