"""Writers and readers of road graphs and forests."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import with_ends
from ..storage import drop

#: Rows that a single JSON document takes.
ONE_DOCUMENT = 1_000_000


def _text(c: str) -> Column:
    return F.format_string("%.6f", F.col(c))


def edge_features(edges: DataFrame, vertices: DataFrame, region: tuple[float, float, float, float] | None = None) -> DataFrame:
    """id and GeoJSON feature (a line of two points, longitude first) of every edge, of those with both ends in a region if one is given."""
    e = with_ends(edges, vertices)
    if region is not None:
        a, b, c, d = region
        for k in (1, 2):
            e = e.filter(F.col(f"lat{k}").between(a, c) & F.col(f"lon{k}").between(b, d))
    line = F.concat(F.lit("[["), _text("lon1"), F.lit(","), _text("lat1"), F.lit("],["), _text("lon2"), F.lit(","), _text("lat2"), F.lit("]]"))
    text = F.concat(F.lit('{"type":"Feature","properties":{"id":'), F.col("id").cast("string"), F.lit(',"type":"residential"},"geometry":{"type":"LineString","coordinates":'), line, F.lit("}}"))
    return e.select("id", text.alias("feature"))


def write_geojson_lines(edges: DataFrame, vertices: DataFrame, folder: str, region=None) -> None:
    """One feature a line, in as many files as there are partitions."""
    edge_features(edges, vertices, region).select(F.col("feature").alias("value")).write.mode("overwrite").text(folder)


def geojson(edges: DataFrame, vertices: DataFrame, region=None) -> str:
    """One FeatureCollection; for graphs of up to ``ONE_DOCUMENT`` edges."""
    rows = edge_features(edges, vertices, region)
    _small(rows)
    return '{"type":"FeatureCollection","features":[' + ",".join(r["feature"] for r in rows.orderBy("id").toLocalIterator()) + "]}"


def _small(rows: DataFrame) -> None:
    if rows.limit(ONE_DOCUMENT + 1).count() > ONE_DOCUMENT:
        raise ValueError("too large for one document; write lines instead")


def graph_rows(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The members of the JSON form: kind (vertex or edge), a, b (-1 for a vertex) and text; self-loops are left out."""
    v = vertices.select(F.lit("vertex").alias("kind"), F.col("id").alias("a"), F.lit(-1).cast("long").alias("b"), F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('":['), _text("lat"), F.lit(","), _text("lon"), F.lit("]")).alias("text"))
    e = edges.filter("src <> dst").select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.concat(F.lit('["'), F.col("src").cast("string"), F.lit('","'), F.col("dst").cast("string"), F.lit('"]')).alias("text"))
    return v.unionByName(e)


def graph_json(vertices: DataFrame, edges: DataFrame) -> str:
    """``{"vertices": {id: [lat, lon]}, "edges": [[src, dst]]}``."""
    rows = graph_rows(vertices, edges)
    _small(rows)
    parts: dict[str, list[str]] = {"vertex": [], "edge": []}
    for r in rows.orderBy("kind", "a", "b").toLocalIterator():
        parts[r["kind"]].append(r["text"])
    return '{"vertices":{' + ",".join(parts["vertex"]) + '},"edges":[' + ",".join(parts["edge"]) + "]}"


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices (id, lat, lon) and edges (id, src, dst) of a graph in JSON."""
    raw = json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    v = spark.createDataFrame([(int(k), float(x[0]), float(x[1])) for k, x in raw["vertices"].items()], "id long, lat double, lon double")
    e = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(raw["edges"])], "id long, src long, dst long")
    return v, e


def write_graph(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{folder}/vertices")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/vertices"), spark.read.parquet(f"{folder}/edges")


def write_checkpoint(tables: dict[str, DataFrame], folder: str, step: int, keep: int = 2) -> None:
    """Tables of a forest at a step; older steps beyond ``keep`` go. A step counts once its marker stands."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/step={step:09d}/{name}")
    spark.range(1).write.mode("overwrite").parquet(f"{folder}/step={step:09d}/_done")
    for old in _steps(spark, folder)[:-keep]:
        drop(spark, f"{folder}/step={old:09d}")


def _steps(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[5:]) for n in names if n.startswith("step=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_done")))


def read_checkpoint(spark: SparkSession, folder: str, names: list[str]) -> tuple[int, dict[str, DataFrame]] | None:
    """The newest whole step and its tables, or None."""
    steps = _steps(spark, folder)
    if not steps:
        return None
    return steps[-1], {n: spark.read.parquet(f"{folder}/step={steps[-1]:09d}/{n}") for n in names}


def png(raster: np.ndarray, bits: int = 16) -> bytes:
    """A grey PNG of a raster whose row 0 is at the bottom; values are cut to what fits."""
    top = (1 << bits) - 1
    lines = np.clip(raster[::-1], 0, top).astype(">u2" if bits == 16 else np.uint8)
    raw = b"".join(b"\0" + line.tobytes() for line in lines)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", raster.shape[1], raster.shape[0], bits, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def _frame(vertices: DataFrame, metres: float, margin: float) -> tuple[float, float, float, float, int, int] | None:
    """The least latitude and longitude of a drawing, its pixels a degree, and its rows and columns; None without vertices."""
    from ..operators.raster import meters_per_degree

    b = vertices.agg(F.min("lat").alias("a"), F.min("lon").alias("b"), F.max("lat").alias("c"), F.max("lon").alias("d")).first()
    if b["a"] is None:
        return None
    pad_lat, pad_lon = (b["c"] - b["a"]) * margin, (b["d"] - b["b"]) * margin
    low_lat, low_lon = b["a"] - pad_lat, b["b"] - pad_lon
    rows, cols = 111111.0 / metres, meters_per_degree(b["a"]) / metres
    return low_lat, low_lon, rows, cols, int((b["c"] + pad_lat - low_lat) * rows) + 1, int((b["d"] + pad_lon - low_lon) * cols) + 1


def graph_pixels(vertices: DataFrame, edges: DataFrame, metres: float = 1.0, margin: float = 0.1) -> tuple[DataFrame, int, int]:
    """The graph's edges as pixels (row, col, cnt) of a raster with a margin, and its rows and columns."""
    from ..operators.raster import rasterise

    frame = _frame(vertices, metres, margin)
    if frame is None:
        return rasterise(vertices.limit(0).select(*(F.lit(0).alias(c) for c in ("row1", "col1", "row2", "col2"))), []).withColumn("cnt", F.lit(0)), 0, 0
    low_lat, low_lon, rows, cols, *size = frame
    at = lambda c, low, k: ((F.col(c) - F.lit(low)) * F.lit(k)).cast("int")
    seg = with_ends(edges, vertices).select(at("lat1", low_lat, rows).alias("row1"), at("lon1", low_lon, cols).alias("col1"), at("lat2", low_lat, rows).alias("row2"), at("lon2", low_lon, cols).alias("col2"))
    return rasterise(seg, []).groupBy("row", "col").agg(F.count("*").alias("cnt")), *size


def vertex_pixels(vertices: DataFrame, metres: float = 1.0, margin: float = 0.1) -> DataFrame:
    """The pixels (row, col) of a small disc at each vertex, in the raster of :func:`graph_pixels`."""
    from ..operators.raster import discs

    low_lat, low_lon, rows, cols, *_ = _frame(vertices, metres, margin) or (0.0, 0.0, 1.0, 1.0)
    at = lambda c, low, k: ((F.col(c) - F.lit(low)) * F.lit(k)).cast("int")
    return discs(vertices.select(at("lat", low_lat, rows).alias("row"), at("lon", low_lon, cols).alias("col")).distinct())


def svg(edges: DataFrame, vertices: DataFrame, width: int = 1000) -> str:
    """A drawing of a graph of up to ``ONE_DOCUMENT`` edges."""
    rows = with_ends(edges, vertices).select("lat1", "lon1", "lat2", "lon2")
    _small(rows)
    b = vertices.agg(F.min("lat").alias("a"), F.min("lon").alias("b"), F.max("lat").alias("c"), F.max("lon").alias("d")).first()
    k = width / max(b["d"] - b["b"], b["c"] - b["a"], 1e-9) if b["a"] is not None else 1.0
    lines = [f'<line x1="{(r["lon1"] - b["b"]) * k:.2f}" y1="{(b["c"] - r["lat1"]) * k:.2f}" x2="{(r["lon2"] - b["b"]) * k:.2f}" y2="{(b["c"] - r["lat2"]) * k:.2f}"/>' for r in rows.toLocalIterator()]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" stroke="black">' + "".join(lines) + "</svg>"
