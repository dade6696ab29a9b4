"""Request lines, ways of pixels, masks and drawings on small cases."""

from pyspark.sql import functions as F

from tracefield.functions import vector
from tracefield.operators import raster
from tracefield.sources import graphs, requests


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "line int, text string")


def test_lines_become_requests(spark):
    eleven = ",".join(str(k) for k in range(1, 12))
    table = lines(spark, eleven + "," + eleven + ",5", "C," + eleven + "," + eleven, "S,1,2,x,4,9,9", "G,1,2,3,4,5,6,7,8,9,10,11,512", "NA,2,1,2,3,4,5,6,7,8,9", "", None, "Q,1")
    three = {tuple(r["qid"]): list(r)[1:] for r in requests.three_points(table).collect()}
    assert three == {(0, 0): [float(k) for k in range(1, 12)], (0, 1): [float(k) for k in range(1, 12)]}
    assert [tuple(r["qid"]) for r in requests.three_points(table, "C").collect()] == [(1, 0)]
    assert {tuple(r["qid"]) for r in requests.two_points(table).collect()} == {(0, k) for k in range(4)}
    assert [list(r)[1:] for r in requests.speeds(table).collect()] == [[1.0, 2.0, 0.0, 4.0]]  # a malformed number is 0
    box = requests.histograms(table).collect()
    assert len(box) == 1 and box[0]["size"] == 512 and box[0]["lat3"] == 5.0
    path = requests.paths(table).collect()
    assert [(r["tag"], [tuple(p) for p in r["path"]]) for r in path] == [("NA", [(1.0, 2.0, 3.0, 4.0), (5.0, 6.0, 7.0, 8.0)])]
    assert requests.paths(table.limit(0)).collect() == []


def test_a_comma_at_the_end_asks_for_nothing_more(spark):
    assert requests.two_points(lines(spark, "1,2,3,4,5,")).count() == 1
    assert requests.two_points(lines(spark, "1,2,3,4,")).count() == 0


def test_replies_keep_the_order(spark):
    rows = spark.createDataFrame([((0, k), k * k) for k in (10, 2, 1)], "qid struct<line: int, k: int>, n int")
    assert [tuple(r) for r in requests.replies(rows, value=F.col("n")).collect()] == [(0, "1 4 100 ")]


def test_pixels_linked(spark):
    way = [(0, c) for c in range(40)] + [(k, 40 + k) for k in range(30)] + [(0, 0)]  # a line, a diagonal, a repeated pixel
    gap = [(60, c) for c in range(40) if c != 20]
    pixels = spark.createDataFrame(way + gap, "row int, col int")
    asked = [(0, 0, 0, 29, 69), (1, 60, 0, 60, 39), (2, 1, 1, 0, 20), (3, 200, 200, 0, 0), (4, 60, 0, 60, 30)]
    out = raster.pixels_linked(pixels, spark.createDataFrame(asked, "qid int, row int, col int, row2 int, col2 int"))
    got = {r["qid"]: r["linked"] for r in out.collect()}
    # 1 ends before the gap at 20, 20 pixels short; 4 stops 11 short of its target; 2 begins beside its place.
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}
    assert [r["linked"] for r in raster.pixels_linked(pixels.limit(0), spark.createDataFrame(asked[:1], "qid int, row int, col int, row2 int, col2 int")).collect()] == [False]


def test_mask_and_discs(spark):
    mask = spark.createDataFrame([(0, 1, 7), (1, 0, 9)], "row int, col int, value int")
    points = spark.createDataFrame([(0, 0.75, 0.75), (1, 0.25, 0.25), (2, 0.25, 0.75), (3, 2.0, 0.5), (4, None, 0.5)], "p int, lat double, lon double")
    assert {r["p"]: r["value"] for r in raster.mask_values(points, mask, (0.0, 0.0, 1.0, 1.0), 2, 2).collect()} == {0: 7, 1: 9, 2: 0, 3: 0, 4: 0}
    vertices = spark.createDataFrame([(0, 42.0, -71.0), (1, 42.0, -71.0)], "id long, lat double, lon double")
    assert graphs.vertex_pixels(vertices).count() == sum(1 for y in range(-3, 4) for x in range(-3, 4) if y * y + x * x <= 9)
    assert graphs.vertex_pixels(vertices.limit(0)).count() == 0


def test_blur_until_peaks_part(spark):
    v = [0.0] * 72
    for k in range(30, 43):
        v[k] = 1.0 + k % 2
    row = spark.createDataFrame([(v, [0.0] * 72)], "v array<double>, flat array<double>")
    out = row.select(vector.blur_apart(F.col("v")).alias("v"), vector.blur_apart(F.col("flat")).alias("flat"), vector.blur_circular(F.col("v")).alias("once"))
    out = out.select("flat", vector.peak_gap(F.col("v"), 36).alias("gap"), vector.peak_gap(F.lit(None).cast("array<double>"), 36).alias("none"))
    r = out.first()
    assert r["gap"] is None or r["gap"] > 4
    assert r["flat"] == [0.0] * 72 and r["none"] is None
