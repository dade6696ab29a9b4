"""Raw trips and sample indexes in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.grid import with_cells

RAW = "local_id string, lat string, lon string, ts string"


def _number(c: str, kind: str):
    """Unreadable numbers are 0."""
    return F.coalesce(F.expr(f"try_cast({c} AS {kind})"), F.lit(0).cast(kind))


def read_trips(spark: SparkSession, folder: str) -> DataFrame:
    """trip_id, seq, lat, lon and ts of files ``<name>_<id>.<ext>`` of lines ``local_id,lat,lon,timestamp``.

    Lines of fewer than four fields are left out; unreadable numbers are 0;
    the id comes from the file's name.
    """
    lines = spark.read.text(folder).select("value", F.regexp_extract("_metadata.file_name", r"_(\d+)", 1).alias("name"), F.monotonically_increasing_id().alias("at"))
    fields = F.split("value", ",")
    rows = lines.filter(F.size(fields) >= 4).select("name", "at", *(fields[i].alias(c) for i, c in ((1, "lat"), (2, "lon"), (3, "ts"))))
    rows = rows.select(F.expr("try_cast(name AS bigint)").alias("trip_id"), "at", _number("lat", "double").alias("lat"), _number("lon", "double").alias("lon"), _number("ts", "long").alias("ts"))
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("trip_id").orderBy("at")) - 1).cast("long")).select("trip_id", "seq", "lat", "lon", "ts")


def write_index(samples: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Samples as Parquet, a folder for each row of cells, clustered by cell and trip within."""
    samples.repartitionByRange("clat", "clon").sortWithinPartitions("clat", "clon", "trip_id", "idx").write.partitionBy("clat").mode(mode).parquet(folder)


def read_index(spark: SparkSession, folder: str, trip_bound: int | None = None) -> DataFrame:
    """An index that :func:`write_index` wrote; only trips up to a bound if one is given."""
    out = spark.read.parquet(folder)
    return out if trip_bound is None else out.filter(F.col("trip_id") <= trip_bound)


def index_lines(samples: DataFrame) -> DataFrame:
    """The text form: clat, clon and line (trip idx lat lon total_distance speed_inv angle)."""
    line = F.format_string("%d %d %.6f %.6f %.12f %.6f %.2f", "trip_id", "idx", "lat", "lon", "total_distance", "speed_inv", "angle")
    return samples.select("clat", "clon", line.alias("line"))


def write_index_text(samples: DataFrame, folder: str) -> None:
    """Text files in a folder for each cell (``cell=<clat>_<clon>``), in order of trip and index."""
    rows = index_lines(samples.orderBy("clat", "clon", "trip_id", "idx")).select(F.concat_ws("_", "clat", "clon").alias("cell"), F.col("line").alias("value"))
    rows.write.partitionBy("cell").mode("overwrite").text(folder)


def read_index_text(spark: SparkSession, folder: str, trip_bound: int | None = None) -> DataFrame:
    """Samples of text index files (``<clat>_<clon>.txt`` or those of :func:`write_index_text`). Lines of 5 to 7 fields are read; missing ones are 0."""
    part = F.split("value", " ")
    names = ("trip_id", "idx", "lat", "lon", "total_distance", "speed_inv", "angle")
    kinds = ("bigint", "bigint", "double", "double", "double", "double", "double")
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).filter(F.size(part) >= 5)
    raw = lines.select(*(F.try_element_at(part, F.lit(i + 1)).alias(f"_{c}") for i, c in enumerate(names)))
    out = raw.select(*(F.coalesce(F.expr(f"try_cast(_{c} AS {k})"), F.lit(0).cast(k)).alias(c) for c, k in zip(names, kinds)))
    out = with_cells(out)
    return out if trip_bound is None else out.filter(F.col("trip_id") <= trip_bound)


def trip_points(trips: DataFrame, trip_id: int) -> DataFrame:
    """The raw points of one trip, in order."""
    return trips.filter(F.col("trip_id") == trip_id).orderBy("seq").select("lat", "lon")

