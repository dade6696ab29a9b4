"""Registered queries on geometry, score vectors, rasters, similarity, windows and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import geo
from .functions import vector as V
from .operators import grid, prep, raster, similarity, trace
from .queries import CIRCLES, PI2, SQL, THREE, W, _THREE_LEGS, _THREE_TRIPS, query, samples, sql_dist, sql_match, sql_values, table, values

# --- geometry ----------------------------------------------------------------------------------

_NEXT = "nxt AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(idx) OVER w AS idx2 FROM samples WINDOW w AS (PARTITION BY trip_id ORDER BY idx))"


def _pairs(spark, sf_dir):
    w = Window.partitionBy("trip_id").orderBy("idx")
    return samples(spark, sf_dir).withColumn("lat2", F.lead("lat").over(w)).withColumn("lon2", F.lead("lon").over(w)).filter("lat2 is not null")


@query(
    W
    + _NEXT
    + f""" SELECT trip_id, idx, round(sqrt(pow(lat - lat2, 2) + pow(lon - lon2, 2)), 9) AS planar, round({sql_dist('lat', 'lon', 'lat2', 'lon2')}, 9) AS shrunk,
 round((lat - 40e0) * 111111e0, 3) AS x, round((lon + 70e0) * 111111e0 * cos(lat / 360e0 * ({PI2})), 3) AS y,
 round(atan2(lat2 - lat, (lon2 - lon) * cos(lat / 360e0 * ({PI2}))) / ({PI2}) * 360e0, 5) AS heading, clat, clon FROM nxt WHERE lat2 IS NOT NULL"""
)
def sample_geometry(spark, sf_dir):
    """Distances, projection, heading and cell of each sample and its successor."""
    c = F.col
    metres = geo.to_meters(c("lat"), c("lon"))
    return _pairs(spark, sf_dir).select(
        "trip_id",
        "idx",
        F.round(geo.planar(c("lat"), c("lon"), c("lat2"), c("lon2")), 9).alias("planar"),
        F.round(geo.latlon_distance(c("lat"), c("lon"), c("lat2"), c("lon2")), 9).alias("shrunk"),
        F.round(metres["x"], 3).alias("x"),
        F.round(metres["y"], 3).alias("y"),
        F.round(geo.heading(c("lat"), c("lon"), c("lat2"), c("lon2")), 5).alias("heading"),
        "clat",
        "clon",
    )


_BEARING = f"atan2((lon2 - lon) * cos(lat / 360e0 * ({PI2})), lat2 - lat) / ({PI2}) * 360e0"


@query(
    W
    + _NEXT
    + f""", b AS (SELECT trip_id, idx, CASE WHEN {_BEARING} < 0 THEN {_BEARING} + 360e0 ELSE {_BEARING} END AS a FROM nxt WHERE lat2 IS NOT NULL)
SELECT CAST(floor((a + 1e-3) / 5e0) AS INT) AS bin, count(*) AS n, CAST(least(abs(CAST(floor((a + 1e-3) / 5e0) AS INT) - 18), 72 - abs(CAST(floor((a + 1e-3) / 5e0) AS INT) - 18)) AS INT) AS from_18 FROM b GROUP BY ALL"""
)
def bearing_histogram(spark, sf_dir):
    """Bearings by bins of 5 degrees, and each bin's circular distance to bin 18."""
    c = F.col
    a = geo.bearing(c("lat"), c("lon"), c("lat2"), c("lon2"))
    rows = _pairs(spark, sf_dir).select(F.floor((a + 1e-3) / 5.0).cast("int").alias("bin"))
    return rows.groupBy("bin").agg(F.count("*").alias("n")).withColumn("from_18", geo.bin_difference(F.col("bin"), F.lit(18)))


@query(W + _NEXT + f" SELECT trip_id, round(sum({sql_dist('lat', 'lon', 'lat2', 'lon2')}), 8) AS length FROM nxt WHERE lat2 IS NOT NULL GROUP BY trip_id")
def path_length(spark, sf_dir):
    """The length of each trip."""
    c = F.col
    return _pairs(spark, sf_dir).groupBy("trip_id").agg(F.round(F.sum(geo.latlon_distance(c("lat"), c("lon"), c("lat2"), c("lon2"))), 8).alias("length"))


_SEGMENTS = [(0, 42.349, -71.1, 42.351, -71.1), (1, 42.35, -71.102, 42.35, -71.098), (2, 42.3495, -71.1005, 42.3495, -71.1005), (3, 42.3492, -71.1012, 42.3511, -71.0991)]
_SEGMENT_SCHEMA = "sid INT, ax DOUBLE, ay DOUBLE, bx DOUBLE, by_ DOUBLE"


@query(
    W
    + sql_values(_SEGMENTS, _SEGMENT_SCHEMA, "g")
    + """, l AS (SELECT g.*, s.trip_id, s.idx, s.lat AS px, s.lon AS py, sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) AS len FROM samples s CROSS JOIN g)
SELECT sid, trip_id, idx, round(CASE WHEN len = 0 OR ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) < 0 THEN sqrt(pow(px - ax, 2) + pow(py - ay, 2))
 WHEN ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / len > len THEN sqrt(pow(px - bx, 2) + pow(py - by_, 2)) ELSE abs((px - ax) * (by_ - ay) - (py - ay) * (bx - ax)) / len END, 8) AS distance FROM l"""
)
def point_segment_distance(spark, sf_dir):
    """Distances of all samples to a few segments."""
    segments = F.broadcast(values(spark, _SEGMENTS, _SEGMENT_SCHEMA))  # a literal of four rows
    c = F.col
    d = geo.point_segment(c("lat"), c("lon"), c("ax"), c("ay"), c("bx"), c("by_"))
    rows = samples(spark, sf_dir).crossJoin(segments)  # a stated query set against all rows
    return rows.select("sid", "trip_id", "idx", F.round(d, 8).alias("distance"))


_CELL_EDGES = """e AS (SELECT trip_id, idx, lat AS ax, lon AS ay, lat2 AS bx, lon2 AS by_ FROM nxt WHERE lat2 IS NOT NULL)"""


@query(
    W
    + _NEXT
    + ", "
    + _CELL_EDGES
    + """, h AS (SELECT *, 1e0 * (by_ - ay) - 0.3e0 * (bx - ax) AS t, (ax - 42.349e0) * (by_ - ay) - (ay + 71.1007e0) * (bx - ax) AS al, (ax - 42.349e0) * 0.3e0 - (ay + 71.1007e0) * 1e0 AS sh FROM e)
SELECT trip_id, idx, round(al / t, 7) AS length, round(42.349e0 + al / t, 7) AS x, round(-71.1007e0 + al / t * 0.3e0, 7) AS y FROM h WHERE t <> 0 AND al / t >= 0 AND sh / t >= 0 AND sh / t <= 1"""
)
def ray_segment_hit(spark, sf_dir):
    """Where a ray meets the trips' segments."""
    c = F.col
    hit = geo.ray_segment(F.lit(42.349), F.lit(-71.1007), F.lit(1.0), F.lit(0.3), c("lat"), c("lon"), c("lat2"), c("lon2"))
    rows = _pairs(spark, sf_dir).withColumn("h", hit).filter("h.ok")
    return rows.select("trip_id", "idx", F.round("h.length", 7).alias("length"), F.round("h.x", 7).alias("x"), F.round("h.y", 7).alias("y"))


# --- windows, order, sets ------------------------------------------------------------------------


@query(
    W
    + _NEXT
    + """, st AS (SELECT trip_id, idx, lat, lon, sqrt(pow(lat - lag(lat) OVER w, 2) + pow(lon - lag(lon) OVER w, 2)) AS step FROM samples WINDOW w AS (PARTITION BY trip_id ORDER BY idx))
SELECT trip_id, idx, CAST(row_number() OVER (PARTITION BY trip_id ORDER BY idx) - 1 AS INT) AS k, round(coalesce(sum(step) OVER (PARTITION BY trip_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 0), 9) AS total_distance FROM st"""
)
def running_length(spark, sf_dir):
    """Row index and running planar length along each trip."""
    return prep.with_distance(samples(spark, sf_dir).select("trip_id", "idx", "lat", "lon")).select("trip_id", "idx", "k", F.round("total_distance", 9).alias("total_distance"))


@query(W + sql_values(CIRCLES, "qid INT, lat DOUBLE, lon DOUBLE, radius DOUBLE", "c") + """, near_ AS (SELECT c.qid, s.trip_id, min(sqrt(pow(c.lat - s.lat, 2) + pow(c.lon - s.lon, 2))) AS dist FROM samples s JOIN c ON sqrt(pow(c.lat - s.lat, 2) + pow(c.lon - s.lon, 2)) < c.radius GROUP BY c.qid, s.trip_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, trip_id) AS k FROM near_) SELECT qid, trip_id, CAST(k AS INT) AS k, round(dist, 9) AS dist FROM r WHERE k <= 3""")
def topk_candidates(spark, sf_dir):
    """The three trips that come nearest to each circle's centre."""
    circles = values(spark, CIRCLES, "qid INT, lat DOUBLE, lon DOUBLE, radius DOUBLE")
    named = circles.withColumn("clat_", F.col("lat")).withColumn("clon_", F.col("lon"))
    found = grid.circle_join(samples(spark, sf_dir), named)
    near = found.groupBy("qid", "trip_id").agg(F.min(geo.planar(F.col("clat_"), F.col("clon_"), F.col("lat"), F.col("lon"))).alias("dist"))
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "trip_id"))).filter("k <= 3")
    return ranked.select("qid", "trip_id", "k", F.round("dist", 9).alias("dist"))


@query(W + "a AS (SELECT DISTINCT trip_id FROM samples WHERE clat = 42349), b AS (SELECT DISTINCT trip_id FROM samples WHERE clat = 42350), c AS (SELECT DISTINCT trip_id FROM samples WHERE clon = 71099) SELECT trip_id FROM a INTERSECT SELECT trip_id FROM b EXCEPT SELECT trip_id FROM c")
def trip_set_operations(spark, sf_dir):
    """Trips in two rows of cells and not in a column of them."""
    s = samples(spark, sf_dir)
    trips = lambda cond: s.filter(cond).select("trip_id").distinct()
    return trips("clat = 42349").intersect(trips("clat = 42350")).exceptAll(trips("clon = 71099"))


# --- score vectors: the embeddings' values as circles of directions ---------------------------------

_E = "v AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0e0)) AS p, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, len(embedding) AS n FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))


def _rounded(v, digits=6):
    return V.rounded(v, digits)


def _sql_at(i: str, circular: bool, v: str = "p") -> str:
    wrapped = f"{v}[(({i} + n) % n) + 1]"
    return wrapped if circular else f"CASE WHEN {i} >= 0 AND {i} < n THEN {wrapped} ELSE 0e0 END"


def _sql_blur(circular: bool) -> str:
    terms = [f"{_sql_at('j', circular)} * 0.214607e0"]
    for s in ("+", "-"):
        cond = []
        for k, w in enumerate((0.189879, 0.131514, 0.071303), 1):
            y = _sql_at(f"(j {s} {k})", circular)
            cond.append(f"({y}) > 0")
            terms.append(f"(CASE WHEN {' AND '.join(cond)} THEN ({y}) * {w}e0 ELSE 0e0 END)")
    return f"WITH {_E} SELECT vec_id, list_transform(range(0, n), lambda j: CASE WHEN {_sql_at('j', circular)} > 0 THEN round({' + '.join(terms)}, 6) ELSE 0e0 END) AS blurred FROM v"


@query(_sql_blur(True))
def circular_blur(spark, sf_dir):
    """The masked smoothing of vectors on a circle."""
    return _vectors(spark, sf_dir).select("vec_id", _rounded(V.blur_circular(F.col("e"))).alias("blurred"))


@query(_sql_blur(False))
def linear_blur(spark, sf_dir):
    """The same on a line."""
    return _vectors(spark, sf_dir).select("vec_id", _rounded(V.blur_linear(F.col("e"))).alias("blurred"))


_PEAK = "({x}) > ({a}) AND ({a}) > 0 AND ({x}) > ({b}) AND ({b}) > 0".format(x=_sql_at("j", True, "e"), a=_sql_at("(j + 1)", True, "e"), b=_sql_at("(j - 1)", True, "e"))


@query(f"WITH {_E}, pl AS (SELECT *, list_transform(range(-9, 9), lambda i: (i + 5 + n) % n) AS places FROM v), k AS (SELECT vec_id, e, n, list_filter(places, lambda j: {_PEAK}) AS c, list_filter(range(1, n - 1), lambda j: {_PEAK}) AS l FROM pl) SELECT vec_id, list_transform(c, lambda x: CAST(x AS INT)) AS circular, list_transform(l, lambda x: CAST(x AS INT)) AS linear, CAST(len(c) AS INT) AS n, round(coalesce(list_sum(list_transform(c, lambda j: e[j + 1])), 0e0), 6) AS total FROM k")
def peaks(spark, sf_dir):
    """Strict peaks around place 5 of a circle, and on a line."""
    e = F.col("e")
    count = V.count_peaks(e, 5, 10)
    return _vectors(spark, sf_dir).select("vec_id", V.peaks_circular(e, 5, 10).alias("circular"), V.peaks_linear(e).alias("linear"), count["n"].alias("n"), F.round(count["total"], 6).alias("total"))


_TOP = "({x}) > 0 AND ({x}) >= ({a}) AND ({a}) > 0 AND ({x}) >= ({b}) AND ({b}) > 0".format(x=_sql_at("j", True, "e"), a=_sql_at("(j + 1)", True, "e"), b=_sql_at("(j - 1)", True, "e"))


@query(f"WITH {_E} SELECT vec_id, list_transform(range(0, n), lambda j: CASE WHEN {_TOP} THEN round(e[j + 1], 6) ELSE 0e0 END) AS next FROM v")
def next_nodes(spark, sf_dir):
    """Values at peaks, else 0."""
    return _vectors(spark, sf_dir).select("vec_id", _rounded(V.next_directions(F.col("e"))).alias("next"))


@query(f"WITH {_E}, b AS (SELECT vec_id, e, lead(e) OVER (PARTITION BY vec_id % 7 ORDER BY vec_id) AS o, n FROM v) SELECT vec_id, list_transform(range(0, n), lambda j: round(greatest(e[j + 1], o[j + 1]), 6)) AS greater FROM b WHERE o IS NOT NULL")
def score_zip_max(spark, sf_dir):
    """The greater values of a vector and the next one of its group; of vectors with one id, whose order SQL leaves open, the least is first."""
    w = Window.partitionBy(F.col("vec_id") % 7).orderBy("vec_id", "e")
    rows = _vectors(spark, sf_dir).withColumn("o", F.lead("e").over(w)).filter("o is not null")
    return rows.select("vec_id", _rounded(V.greater_of(F.col("e"), F.col("o"))).alias("greater"))


@query(f"""WITH {_E}, d AS (SELECT *, list_position(e, list_max(e)) - 1 AS dir FROM v)
SELECT vec_id, CAST(dir AS INT) AS direction, list_transform(range(0, n), lambda j: CASE WHEN ((j - (n // 2 + dir - n // 6)) % n + n) % n < n // 3 THEN 0e0 ELSE round(e[j + 1], 6) END) AS ahead,
 list_transform(range(0, n), lambda j: CASE WHEN least(((j - dir) % n + n) % n, ((dir - j) % n + n) % n) <= 1 THEN -1e0 ELSE round(e[j + 1], 6) END) AS used,
 len(list_filter(range(0, n), lambda j: ({_sql_at('j', True, 'e')}) > 0 AND ({_sql_at('(j + 1)', True, 'e')}) > 0 AND ({_sql_at('(j + 2)', True, 'e')}) > 0)) > 0 AS three FROM d""")
def direction_masks(spark, sf_dir):
    """The best direction, the vector without the way back, with the direction marked used, and whether three neighbours are positive."""
    e = F.col("e")
    rows = _vectors(spark, sf_dir).withColumn("direction", V.best_direction(e))
    return rows.select("vec_id", "direction", _rounded(V.suppress_reverse(e, F.col("direction"))).alias("ahead"), _rounded(V.mark_used(e, F.col("direction"))).alias("used"), V.three_in_row(e).alias("three"))


# --- rasters ---------------------------------------------------------------------------------------

_REGION = (42.347, -71.104, 42.353, -71.096)


def _sql_dda(segments: str, keys: str) -> str:
    """Pixels of a relation of segments (keys, row1, col1, row2, col2)."""
    return f"""hit AS (SELECT {keys}CASE WHEN tall THEN row1 + (CASE WHEN row2 > row1 THEN k ELSE -k END) ELSE CAST(trunc(row1 * (1e0 - k / m) + row2 * (k / m)) AS INT) END AS row,
 CASE WHEN tall THEN CAST(trunc(col1 * (1e0 - k / m) + col2 * (k / m)) AS INT) ELSE col1 + (CASE WHEN col2 > col1 THEN k ELSE -k END) END AS col
 FROM (SELECT *, unnest(range(0, CAST(m AS BIGINT))) AS k FROM (SELECT *, abs(row2 - row1) > abs(col2 - col1) AS tall, CAST(greatest(abs(row2 - row1), abs(col2 - col1)) AS DOUBLE) AS m FROM {segments}) WHERE m > 0))"""


_A, _B, _C, _D = _REGION
_SEG = f"""seg AS (SELECT trip_id, CAST(trunc((lat - {_A}e0) / ({_C}e0 - {_A}e0) * 300e0) AS INT) AS row1, CAST(trunc((lon - ({_B}e0)) / ({_D}e0 - ({_B}e0)) * 400e0) AS INT) AS col1,
 CAST(trunc((lat2 - {_A}e0) / ({_C}e0 - {_A}e0) * 300e0) AS INT) AS row2, CAST(trunc((lon2 - ({_B}e0)) / ({_D}e0 - ({_B}e0)) * 400e0) AS INT) AS col2 FROM nxt WHERE idx2 = idx + 1)"""
_UNIT = "unit AS (SELECT trip_id, CAST(idx // 5 AS BIGINT) AS idx, lat, lon, clat, clon FROM samples)"


@query(W + _UNIT + ", " + _NEXT.replace("FROM samples", "FROM unit") + ", " + _SEG + ", " + _sql_dda("seg", "") + " SELECT CAST(row AS INT) AS row, CAST(col AS INT) AS col, count(*) * 32 AS weight FROM hit WHERE row BETWEEN 0 AND 299 AND col BETWEEN 0 AND 399 GROUP BY row, col")
def segment_dda_raster(spark, sf_dir):
    """The weighted density of all trips over a region."""
    s = samples(spark, sf_dir).withColumn("idx", F.expr("idx div 5"))
    return raster.region_density(s, _REGION, 300, 400)


@query(
    W
    + _UNIT.replace("unit AS", "unit0 AS")
    + ", unit AS (SELECT * FROM unit0), "
    + sql_values(THREE, "qid INT, lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, lat3 DOUBLE, lon3 DOUBLE, r1 DOUBLE, r2 DOUBLE, r3 DOUBLE, d1 DOUBLE, d2 DOUBLE", "req")
    + ", "
    + _THREE_LEGS
    + ", "
    + sql_match("legs", "qid, leg")
    + f""", t3 AS (SELECT qid, trip_id, max(CASE WHEN leg = 2 THEN i2 END) AS mid, max(CASE WHEN leg = 1 THEN i2 END) AS i_mid FROM matched GROUP BY qid, trip_id HAVING count(*) = 2),
near AS (SELECT * FROM t3 WHERE abs(i_mid - mid) < 300),
rows0 AS (SELECT n.qid, n.mid, d.* FROM near n JOIN dense0 d USING (trip_id) WHERE CAST(floor(d.lat / 1e-3) AS INT) BETWEEN CAST(floor(({_A}e0 - 2e-5) / 1e-3) AS INT) AND CAST(floor(({_C}e0 + 2e-5) / 1e-3) AS INT) AND CAST(floor(-d.lon / 1e-3) AS INT) BETWEEN CAST(floor((-({_D}e0) - 2e-5) / 1e-3) AS INT) AND CAST(floor((-({_B}e0) + 2e-5) / 1e-3) AS INT)),
nxt AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(idx) OVER w AS idx2 FROM rows0 WINDOW w AS (PARTITION BY qid, trip_id ORDER BY idx)),
seg AS (SELECT qid, CAST(trunc((lat - {_A}e0) / ({_C}e0 - {_A}e0) * 256e0) AS INT) AS row1, CAST(trunc((lon - ({_B}e0)) / ({_D}e0 - ({_B}e0)) * 256e0) AS INT) AS col1, CAST(trunc((lat2 - {_A}e0) / ({_C}e0 - {_A}e0) * 256e0) AS INT) AS row2, CAST(trunc((lon2 - ({_B}e0)) / ({_D}e0 - ({_B}e0)) * 256e0) AS INT) AS col2 FROM nxt WHERE idx2 = idx + 1 AND abs(idx - mid) <= 300),
"""
    + _sql_dda("seg", "qid, ")
    + " SELECT qid, CAST(row AS INT) AS row, CAST(col AS INT) AS col, count(*) AS cnt FROM hit WHERE row BETWEEN 0 AND 255 AND col BETWEEN 0 AND 255 GROUP BY qid, row, col"
)
def passthrough_histogram(spark, sf_dir):
    """How often trips through three circles touch each pixel near where they pass the last."""
    from .queries import THREE_SCHEMA, dense

    req = values(spark, THREE, THREE_SCHEMA).withColumn("radius", F.col("r1"))
    box = {"lat_min": _A, "lon_min": _B, "lat_max": _C, "lon_max": _D, "size": 256}
    for k, v in box.items():
        req = req.withColumn(k, F.lit(v))
    return raster.passthrough(grid.with_cells(dense(spark, sf_dir)), req)


# the matches of that query are made on the dense trips
SQL["passthrough_histogram"] = SQL["passthrough_histogram"].replace("unit AS (SELECT * FROM unit0)", "dense0 AS (SELECT a.trip_id, a.idx + j AS idx, a.lat * (1 - j / 5e0) + b.lat * (j / 5e0) AS lat, a.lon * (1 - j / 5e0) + b.lon * (j / 5e0) AS lon FROM samples a JOIN samples b ON a.trip_id = b.trip_id AND b.idx = a.idx + 5 CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS j) t)").replace("FROM samples s JOIN legs", "FROM dense0 s JOIN legs")


def kde_similarity(spark, sf_dir):
    """How much of one path's traffic lies where another's does."""
    from .queries import dense

    rows = [(0, 42.3500, -71.1, 42.3500, -71.1), (1, 42.3500, -71.1, 42.35, -71.1003)]
    asked = values(spark, rows, "pid INT, la DOUBLE, lo DOUBLE, lb DOUBLE, ob DOUBLE")
    path = lambda lat, lon, dlat, dlon: F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.struct((F.col(lat) - i * F.lit(dlat)).alias("lat"), (F.col(lon) - i * F.lit(dlon)).alias("lon")))
    pairs = asked.select("pid", path("la", "lo", 1e-4, 0.0).alias("path_a"), F.when(F.col("pid") == 0, path("lb", "ob", 1e-4, 0.0)).otherwise(path("lb", "ob", 0.0, -1e-4)).alias("path_b"))
    return raster.merge_similarity(grid.with_cells(dense(spark, sf_dir)), pairs).select("pid", F.round("similarity", 6).alias("similarity"))


query()(kde_similarity)

# --- similarity ------------------------------------------------------------------------------------

_PATHS = "w AS (SELECT trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY idx) AS idx, lat, lon FROM samples)"


def _path_pairs(s):
    """Neighbouring trips on one heading, all samples of ``s``."""
    paths = s.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("idx", "lat", "lon"))).alias("p"))  # a trip's own samples
    paths = paths.select("trip_id", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("path"))
    other = paths.select((F.col("trip_id") - 4).alias("trip_id"), F.col("path").alias("path_b"))
    return paths.join(other, "trip_id").select(F.col("trip_id").alias("pid"), F.col("path").alias("path_a"), "path_b")


@query(
    W
    + _PATHS
    + """, j AS (SELECT a.trip_id AS pid, a.idx, a.lat AS al, a.lon AS ao, b.lat AS bl, b.lon AS bo FROM w a JOIN w b ON b.trip_id = a.trip_id + 4 AND a.idx = b.idx),
m AS (SELECT pid, avg(bl - al) AS x, avg(bo - ao) AS y FROM j GROUP BY pid)
SELECT j.pid, round(sum(sqrt(pow(al - bl, 2) + pow(ao - bo, 2))), 7) AS total, round(sum(al - bl), 7) AS dlat, round(sum(ao - bo), 7) AS dlon,
 round(sum(CASE WHEN sqrt(pow(al - bl, 2) + pow((ao - bo) * cos(radians(al)), 2)) > 1e-5 THEN 1000e0 ELSE sqrt(pow(al - bl, 2) + pow((ao - bo) * cos(radians(al)), 2)) END), 5) AS cut, round(avg(sqrt(pow(al - bl + x, 2) + pow(ao - bo + y, 2))), 8) AS unbiased FROM j JOIN m USING (pid) GROUP BY j.pid"""
)
def path_raw_similarity(spark, sf_dir):
    """Sums of distances of whole trips in pairs of points (as many as the shorter has), plain, cut off and without their mean difference."""
    n = F.least(F.size("path_a"), F.size("path_b"))
    a, b = F.slice("path_a", F.lit(1), n), F.slice("path_b", F.lit(1), n)
    plain, cut = similarity.raw(a, b), similarity.raw_latlon(a, b, 1e-5)
    return _path_pairs(samples(spark, sf_dir)).select("pid", F.round(plain["total"], 7).alias("total"), F.round(plain["dlat"], 7).alias("dlat"), F.round(plain["dlon"], 7).alias("dlon"), F.round(cut["total"], 5).alias("cut"), F.round(similarity.unbiased(a, b), 8).alias("unbiased"))


@query()
def path_window_similarity(spark, sf_dir):
    """The least sum of distances between windows of resampled paths, of whole trips of any lengths."""
    return similarity.window_similarities(_path_pairs(samples(spark, sf_dir))).withColumn("similarity", F.round("similarity", 9))


# --- lateral and merge checks ------------------------------------------------------------------------

_NODES = [(0, 42.3495, -71.1, 42.35, -71.1, 0.0), (1, 42.35, -71.1005, 42.35, -71.1, 90.0)]
_NODE_SCHEMA = "node INT, lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, bearing DOUBLE"


@query(
    W
    + sql_values(_NODES, _NODE_SCHEMA, "node_")
    + """, req AS (SELECT node * 1000 + k AS qid, node, CAST(k AS INT) AS k, lat1, lon1, lat2, lon2,
  lat2 + abs(k) * 0.000015e0 * cos(radians(bearing + CASE WHEN k < 0 THEN -90e0 ELSE 90e0 END)) AS lat3, lon2 + abs(k) * 0.000015e0 * sin(radians(bearing + CASE WHEN k < 0 THEN -90e0 ELSE 90e0 END)) / cos(radians(lat2)) AS lon3,
  0.0001e0 AS r1, 0.0001e0 AS r2, 0.00002e0 AS r3, -1e0 AS d1, -1e0 AS d2 FROM node_ CROSS JOIN (SELECT unnest(range(-35, 36)) AS k) t), """
    + _THREE_LEGS
    + ", "
    + sql_match("legs", "qid, leg")
    + ", "
    + _THREE_TRIPS
    + ", c AS (SELECT req.node, req.k, (SELECT count(*) FROM trips t WHERE t.qid = req.qid) AS n_trips FROM req) SELECT node, k, n_trips, CASE WHEN n_trips >= 1 THEN round(ln(n_trips + 1e-8), 9) ELSE -1000e0 END AS score FROM c"
)
def lateral_profile(spark, sf_dir):
    """Trips through points across two nodes' ways."""
    nodes = values(spark, _NODES, _NODE_SCHEMA)
    return trace.lateral_profile(samples(spark, sf_dir), nodes).withColumn("score", F.round("score", 9))


@query()
def merge_checker(spark, sf_dir):
    """Whether trips of either of two paths go on to the other's newest point."""
    rows = [(0, 42.3502, -71.1, 42.3503, -71.1), (1, 42.3502, -71.1, 42.35, -71.0998)]
    asked = values(spark, rows, "pid INT, la DOUBLE, lo DOUBLE, lb DOUBLE, ob DOUBLE")
    path = lambda lat, lon, a, b: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((F.col(lat) - i * F.lit(a)).alias("lat"), (F.col(lon) - i * F.lit(b)).alias("lon")))
    pairs = asked.select("pid", path("la", "lo", 1e-4, 0.0).alias("path_a"), F.when(F.col("pid") == 0, path("lb", "ob", 1e-4, 0.0)).otherwise(path("lb", "ob", 0.0, 1e-4)).alias("path_b"))
    return trace.merge_check(samples(spark, sf_dir), pairs)

