"""The grid that turns circle and box predicates into hash joins.

Samples carry their cell. A query is laid over the cells it may touch, joined
by cell and then tested exactly, so both sides are partitioned by cell and the
optimizer chooses the join by their sizes at run time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def with_cells(points: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``points`` with ``clat`` and ``clon``."""
    return points.withColumn("clat", geo.cell_lat(F.col(lat))).withColumn("clon", geo.cell_lon(F.col(lon)))


def _span(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / F.lit(geo.CELL)).cast("int"), F.floor(high / F.lit(geo.CELL)).cast("int"))


def cover_circle(circles: DataFrame, metric: str = "planar") -> DataFrame:
    """``circles`` (lat, lon, radius and more), one row for each cell that the circle's box touches."""
    lat, lon, r = F.col("lat"), F.col("lon"), F.col("radius")
    wide = r if metric == "planar" else r / F.greatest(F.cos(F.radians(lat)), F.lit(1e-3))
    return circles.withColumn("clat", F.explode(_span(lat - r, lat + r))).withColumn("clon", F.explode(_span(-lon - wide, -lon + wide)))


def cover_box(boxes: DataFrame) -> DataFrame:
    """``boxes`` (lat_min, lon_min, lat_max, lon_max and more), one row for each cell touched."""
    return boxes.withColumn("clat", F.explode(_span(F.col("lat_min"), F.col("lat_max")))).withColumn("clon", F.explode(_span(-F.col("lon_max"), -F.col("lon_min"))))


def circle_join(samples: DataFrame, circles: DataFrame, metric: str = "planar") -> DataFrame:
    """Samples strictly inside circles: the samples' columns and the circles' other columns.

    metric: ``planar`` (degrees as they are) or ``equirect`` (longitudes shrunk
    at the circle's latitude).
    """
    keys = [c for c in circles.columns if c not in ("lat", "lon", "radius")]
    q = cover_circle(circles, metric).select(*keys, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("radius").alias("_radius"), "clat", "clon")
    distance = geo.planar if metric == "planar" else geo.latlon_distance
    near = distance(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) < F.col("_radius")
    return samples.join(q, ["clat", "clon"]).filter(near).drop("_lat", "_lon", "_radius")


def box_join(samples: DataFrame, boxes: DataFrame, exact: bool = True) -> DataFrame:
    """Samples in boxes; with ``exact=False`` all samples of the cells touched."""
    q = cover_box(boxes)
    out = samples.join(q, ["clat", "clon"])
    if exact:
        out = out.filter(F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max")))
    return out.drop("lat_min", "lat_max", "lon_min", "lon_max")


def scan_rectangle(samples: DataFrame, lat_min: float, lon_min: float, lat_max: float, lon_max: float) -> DataFrame:
    """All samples of the cells that a rectangle touches; literal cell bounds prune partitions."""
    low, high = (int(math.floor(v / geo.CELL)) for v in (lat_min, lat_max))
    west, east = (int(math.floor(-v / geo.CELL)) for v in (lon_max, lon_min))
    return samples.filter(F.col("clat").between(low, high) & F.col("clon").between(west, east))


def segment_pairs(left: DataFrame, right: DataFrame, reach: float, size: float | None = None) -> DataFrame:
    """Pairs of rows whose points or boxes come within ``reach`` by cells of that size, or of ``size`` where the boxes are wider than that.

    ``left`` and ``right`` have lat_min, lat_max, lon_min and lon_max (under
    these names) and otherwise different columns. The pair is found once.
    """
    size = F.lit(float(size or reach))
    span = lambda low, high, pad: F.sequence(F.floor((low - pad) / size).cast("long"), F.floor((high + pad) / size).cast("long"))

    def laid(df: DataFrame, mark: str, pad: float) -> DataFrame:
        box = {c: F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")}
        out = df.withColumn("_x", F.explode(span(box["lat_min"], box["lat_max"], pad))).withColumn("_y", F.explode(span(box["lon_min"], box["lon_max"], pad)))
        return out.select(*(F.col(c).alias(f"{mark}_{c}") if c in box else F.col(c) for c in out.columns))

    a, b = laid(left, "l", reach), laid(right, "r", 0.0)
    both = a.join(b, ["_x", "_y"])
    touch = (F.col("l_lat_min") - reach <= F.col("r_lat_max")) & (F.col("r_lat_min") <= F.col("l_lat_max") + reach) & (F.col("l_lon_min") - reach <= F.col("r_lon_max")) & (F.col("r_lon_min") <= F.col("l_lon_max") + reach)
    # The cell of the overlap's lower corner finds the pair; all others are repeats.
    first_x = F.floor(F.greatest(F.col("l_lat_min") - reach, F.col("r_lat_min")) / size)
    first_y = F.floor(F.greatest(F.col("l_lon_min") - reach, F.col("r_lon_min")) / size)
    drop = ["_x", "_y"] + [f"{m}_{c}" for m in "lr" for c in ("lat_min", "lat_max", "lon_min", "lon_max")]
    return both.filter(touch & (F.col("_x") == first_x) & (F.col("_y") == first_y)).drop(*drop)
