"""Streams of requests give what the request table gives."""

from tracefield.operators import grid, trace
from tracefield.streaming import answer_stream, stream_circles

SCHEMA = "qid int, lat1 double, lon1 double, lat2 double, lon2 double, radius double"


def test_stream_equals_table(spark, tmp_path):
    rows = [(t, i, 42.0 + i * 1e-5, -71.0) for t in range(3) for i in range(100)]
    samples = grid.with_cells(spark.createDataFrame(rows, "trip_id long, idx int, lat double, lon double"))
    asked = spark.createDataFrame([(k, 42.0, -71.0, 42.0 + k * 1e-4, -71.0, 5e-5) for k in range(1, 5)], SCHEMA)
    asked.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    answer_stream(stream, lambda r: trace.p2p(samples, r), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, trace.p2p(samples, asked).collect()))
    circles = stream.selectExpr("qid", "lat2 as lat", "lon2 as lon", "radius")
    query = stream_circles(circles, samples).writeStream.format("memory").queryName("inside").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("inside").count() == grid.circle_join(samples, asked.selectExpr("qid", "lat2 as lat", "lon2 as lon", "radius")).count()
