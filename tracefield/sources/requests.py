"""Request lines as request tables, and result tables as reply lines.

A line is comma-separated text; a letter in front tells its kind, lines of bare
numbers are point requests. Lines come as a table (line, text). What is left
over from whole groups of numbers is ignored, a malformed number counts as 0,
null and empty lines ask for nothing. Requests carry ``qid``, a struct of the
line and the request's place k in it.

| text | table | answered by |
|-|-|-|
| 11 numbers a request | :func:`three_points` | ``trace.three_point`` |
| C and 11 numbers | :func:`three_points` with ``tag="C"`` | ``trace.mean_path`` |
| 5 numbers a request | :func:`two_points` | ``trace.p2p`` |
| S and 4 numbers a request | :func:`speeds` | ``trace.speed_rank`` |
| G and 12 numbers | :func:`histograms` | ``raster.passthrough`` |
| N, a count and 4 numbers a point | :func:`paths` | ``trace.direction_scores``, with NA for 360 directions; ``trace.mean_along_history`` for NI |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_POINTS = ("lat1", "lon1", "lat2", "lon2", "lat3", "lon3", "r1", "r2", "r3", "d1", "d2")
_PAIR = ("lat1", "lon1", "lat2", "lon2", "radius")
_SPEED = ("lat", "lon", "radius", "ranking")
_PATH = ("lat", "lon", "radius", "dist")
# Fixed order: the three points from the oldest on, then radius, box and pixels a side.
_BOX = ("lat1", "lon1", "lat2", "lon2", "lat3", "lon3", "radius", "lat_min", "lon_min", "lat_max", "lon_max", "size")


def tag(text: Column) -> Column:
    """The letters in front of a line, empty for bare numbers, null for a null line."""
    return F.regexp_extract(text, "^[A-Z]*", 0)


def _number(items: Column, at: Column) -> Column:
    return F.coalesce(F.try_element_at(items, (at + 1).cast("int")).try_cast("double"), F.lit(0.0))


def _groups(lines: DataFrame, wanted: str, names: tuple[str, ...], skip: int, most: int | None = None) -> DataFrame:
    """line, tag, k and the named numbers of every whole group of the lines of a kind."""
    rows = lines.filter(F.length("text") > 0).select("line", tag(F.col("text")).alias("tag"), F.split("text", ",").alias("items"))
    # A comma at the end closes the last number.
    items = F.when(F.element_at("items", -1) == "", F.slice("items", 1, F.size("items") - 1)).otherwise(F.col("items"))
    rows = rows.filter(F.col("tag").rlike(f"^(?:{wanted})$")).withColumn("items", items)
    n = F.floor((F.size("items") - skip) / len(names)).cast("int")
    if most is not None:
        n = F.least(n, F.lit(most))
    rows = rows.withColumn("n", n).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select("line", "tag", "k", *(_number(F.col("items"), F.col("k") * len(names) + (skip + i)).alias(c) for i, c in enumerate(names)))


def three_points(lines: DataFrame, tag: str = "") -> DataFrame:
    """qid, lat1 .. lon3, r1 .. r3, d1 and d2; of a C line the first request only."""
    rows = _groups(lines, tag, _POINTS, 1 if tag else 0, 1 if tag else None)
    return rows.select(F.struct("line", "k").alias("qid"), *_POINTS)


def two_points(lines: DataFrame) -> DataFrame:
    """qid, lat1, lon1, lat2, lon2 and radius."""
    return _groups(lines, "", _PAIR, 0).select(F.struct("line", "k").alias("qid"), *_PAIR)


def speeds(lines: DataFrame) -> DataFrame:
    """qid, lat, lon, radius and ranking."""
    return _groups(lines, "S", _SPEED, 1).select(F.struct("line", "k").alias("qid"), *_SPEED)


def histograms(lines: DataFrame) -> DataFrame:
    """qid, the three points, radius, lat_min, lon_min, lat_max, lon_max and size."""
    rows = _groups(lines, "G", _BOX, 1, 1)
    return rows.select(F.struct("line", "k").alias("qid"), *_BOX[:-1], F.col("size").cast("int").alias("size"))


def paths(lines: DataFrame) -> DataFrame:
    """qid, tag (N, NA or NI) and path: an array of lat, lon, radius and dist, newest first."""
    points = _groups(lines, "N|NA|NI", _PATH, 2)
    whole = points.groupBy("line", "tag").agg(F.sort_array(F.collect_list(F.struct("k", *_PATH))).alias("p"))
    path = F.transform("p", lambda x: F.struct(*(x[c].alias(c) for c in _PATH)))
    return whole.select(F.struct("line", F.lit(0).alias("k")).alias("qid"), "tag", path.alias("path"))


def replies(results: DataFrame, *order: str, value: Column) -> DataFrame:
    """line and text: a line's values (one a row of ``results``) by k and the columns ``order``, with a space after each."""
    key = F.struct(F.col("qid.k").alias("k"), *order, value.cast("string").alias("value"))
    text = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["value"]), " "), F.lit(" "))
    return results.groupBy(F.col("qid.line").alias("line")).agg(text.alias("text"))
