"""Registered queries on the library's own operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .operators import grid, trace
from .sources import surrogate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL of the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.samples(table(spark, sf_dir, "events"))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table without a Python worker."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = [c.strip().split()[1] for c in schema.split(",")]
    body = ", ".join("(" + ", ".join(f"CAST('{v}' AS {k})" for v, k in zip(r, kinds)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def sql_values(rows: list[tuple], schema: str, name: str) -> str:
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = [c.strip().split()[1] for c in schema.split(",")]
    body = ", ".join("(" + ", ".join(f"CAST('{v}' AS {k})" for v, k in zip(r, kinds)) + ")" for r in rows)
    return f"{name}({', '.join(names)}) AS (SELECT * FROM (VALUES {body}) t)"


W = "WITH " + surrogate.SQL + ", "
PI2 = "3.1415926e0 * 2e0"


def sql_dist(a: str, b: str, c: str, d: str) -> str:
    """Distance with longitudes shrunk at the first latitude."""
    return f"sqrt(pow({a} - {c}, 2) + pow(({b} - {d}) * cos({a} / 360e0 * ({PI2})), 2))"


# --- requests that several queries ask -------------------------------------------------------

CIRCLES = [(0, 42.35, -71.1, 6e-5), (1, 42.3493, -71.1, 9e-5), (2, 42.3508, -71.1, 3e-4), (3, 42.40, -71.1, 1e-4)]
CIRCLE_SCHEMA = "qid INT, lat DOUBLE, lon DOUBLE, radius DOUBLE"
P2P = [(0, 42.3493, -71.1, 42.3506, -71.1, 6e-5), (1, 42.35, -71.1006, 42.35, -71.0994, 6e-5), (2, 42.35, -71.1, 42.35, -71.09995, 6e-5), (3, 42.4, -71.1, 42.41, -71.1, 6e-5)]
P2P_SCHEMA = "qid INT, lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, radius DOUBLE"
THREE = [
    (0, 42.3493, -71.1, 42.35, -71.1, 42.3506, -71.1, 6e-5, 6e-5, 6e-5, -1.0, -1.0),
    (1, 42.35, -71.1006, 42.35, -71.1, 42.35, -71.0994, 6e-5, 6e-5, 6e-5, -1.0, -1.0),
    (2, 42.40, -71.1, 42.41, -71.1, 42.42, -71.1, 6e-5, 6e-5, 6e-5, -1.0, -1.0),
]
THREE_SCHEMA = "qid INT, lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, lat3 DOUBLE, lon3 DOUBLE, r1 DOUBLE, r2 DOUBLE, r3 DOUBLE, d1 DOUBLE, d2 DOUBLE"
PATH = [(0, 0, 42.3502, -71.1, 6e-5, 1.5e-4), (0, 1, 42.3498, -71.1, 6e-5, 4e-4), (0, 2, 42.3493, -71.1, 6e-5, 5e-4), (1, 0, 42.35, -71.0998, 6e-5, 1.5e-4), (1, 1, 42.35, -71.1002, 6e-5, 4e-4)]
PATH_SCHEMA = "qid INT, k INT, lat DOUBLE, lon DOUBLE, radius DOUBLE, dist DOUBLE"


def paths(spark: SparkSession) -> DataFrame:
    rows = values(spark, PATH, PATH_SCHEMA).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("k", "lat", "lon", "radius", "dist"))).alias("p"))
    return rows.select("qid", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"), x["radius"].alias("radius"), x["dist"].alias("dist"))).alias("path"))


def sql_match(legs: str, keys: str, name: str = "matched") -> str:
    """Directed matches of a relation of legs (keys, lat1, lon1, r1, lat2, lon2, r2, dist)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    pick = ", ".join(f"l.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    group = ", ".join(f"l.{k.strip()}" for k in keys.split(","))
    end = lambda i, n: (
        f"{name}_{n} AS (SELECT {pick}, s.trip_id, min(s.idx) AS lo, max(s.idx) AS hi, any_value(l.lat1) AS lat1, any_value(l.lon1) AS lon1, any_value(l.lat2) AS lat2, any_value(l.lon2) AS lon2, any_value(l.r1) AS r1, any_value(l.r2) AS r2, any_value(l.dist) AS dist "
        f"FROM samples s JOIN {legs} l ON sqrt(pow(l.lat{i} - s.lat, 2) + pow(l.lon{i} - s.lon, 2)) < l.r{i} GROUP BY {group}, s.trip_id HAVING max(s.idx) - min(s.idx) <= 100)"
    )
    d = sql_dist("a.lat1", "a.lon1", "a.lat2", "a.lon2")
    return f"""{end(1, 'a')}, {end(2, 'b')},
{name} AS (SELECT {picked}, a.trip_id, (a.lo + a.hi) // 2 AS i1, (b.lo + b.hi) // 2 AS i2 FROM {name}_a a JOIN {name}_b b ON {on} AND a.trip_id = b.trip_id
  WHERE {d} <= a.r1 + a.r2 OR (a.hi <= b.lo AND (b.lo - a.hi) * 1e-5 < (CASE WHEN a.dist < 0 THEN {d} ELSE a.dist END) * 2e0 + a.r1 + a.r2))"""


_THREE_LEGS = """legs AS (SELECT qid, 1 AS leg, lat1, lon1, r1, lat2, lon2, r2, d1 AS dist FROM req UNION ALL SELECT qid, 2, lat2, lon2, r2, lat3, lon3, r3, d2 FROM req)"""
_THREE_TRIPS = "trips AS (SELECT qid, trip_id, max(CASE WHEN leg = 2 THEN i1 END) AS i1, max(CASE WHEN leg = 2 THEN i2 END) AS i2 FROM matched GROUP BY qid, trip_id HAVING count(*) = 2)"


# --- scans and joins -------------------------------------------------------------------------


@query(W[:-2] + " SELECT clat, clon, count(*) AS n_samples, count(DISTINCT trip_id) AS n_trips FROM samples GROUP BY clat, clon")
def grid_cell_histogram(spark, sf_dir):
    """Samples and trips of each grid cell."""
    return samples(spark, sf_dir).groupBy("clat", "clon").agg(F.count("*").alias("n_samples"), F.count_distinct("trip_id").alias("n_trips"))


@query(W + sql_values(CIRCLES, CIRCLE_SCHEMA, "c") + " SELECT qid, trip_id, idx FROM samples s JOIN c ON sqrt(pow(c.lat - s.lat, 2) + pow(c.lon - s.lon, 2)) < c.radius")
def circle_range_join(spark, sf_dir):
    """Samples strictly inside circles, by the planar metric."""
    return grid.circle_join(samples(spark, sf_dir), values(spark, CIRCLES, CIRCLE_SCHEMA)).select("qid", "trip_id", "idx")


@query(W + sql_values(CIRCLES, CIRCLE_SCHEMA, "c") + f" SELECT qid, count(*) AS n_samples FROM samples s JOIN c ON {sql_dist('c.lat', 'c.lon', 's.lat', 's.lon')} < c.radius GROUP BY qid")
def circle_range_join_equirect(spark, sf_dir):
    """Number of samples inside circles, longitudes shrunk."""
    found = grid.circle_join(samples(spark, sf_dir), values(spark, CIRCLES, CIRCLE_SCHEMA), "equirect")
    return found.groupBy("qid").agg(F.count("*").alias("n_samples"))


@query(W[:-2] + " SELECT trip_id, idx, clat, clon FROM samples WHERE clat BETWEEN 42349 AND 42350 AND clon BETWEEN 71099 AND 71100")
def rect_cell_scan(spark, sf_dir):
    """All samples of the cells that a rectangle touches."""
    return grid.scan_rectangle(samples(spark, sf_dir), 42.3495, -71.1004, 42.3505, -71.0995).select("trip_id", "idx", "clat", "clon")


_P2P_DIST = sql_dist("r.lat1", "r.lon1", "r.lat2", "r.lon2")


@query(
    W
    + sql_values(P2P, P2P_SCHEMA, "req")
    + f""", a AS (SELECT qid, trip_id, min(idx) AS lo, max(idx) AS hi FROM samples s JOIN req r ON sqrt(pow(r.lat1 - s.lat, 2) + pow(r.lon1 - s.lon, 2)) < r.radius GROUP BY qid, trip_id),
b AS (SELECT qid, trip_id, min(idx) AS lo, max(idx) AS hi FROM samples s JOIN req r ON sqrt(pow(r.lat2 - s.lat, 2) + pow(r.lon2 - s.lon, 2)) < r.radius GROUP BY qid, trip_id),
j AS (SELECT r.qid, {_P2P_DIST} AS d, r.radius * 2 AS rr, a.lo AS alo, a.hi AS ahi, b.lo AS blo, b.hi AS bhi FROM a JOIN b USING (qid, trip_id) JOIN req r USING (qid))
SELECT req.qid, (SELECT count(*) FROM a WHERE a.qid = req.qid) AS n_a, (SELECT count(*) FROM b WHERE b.qid = req.qid) AS n_b, (SELECT count(*) FROM j WHERE j.qid = req.qid) AS n_both,
 (SELECT CAST(coalesce(sum((CASE WHEN d <= rr THEN 1 ELSE 0 END) + (CASE WHEN ahi < blo AND (blo - ahi) * 1e-5 > d - rr AND (blo - ahi) * 1e-5 < d * 2e0 + rr THEN 1 ELSE 0 END)), 0) AS BIGINT) FROM j WHERE j.qid = req.qid) AS dir_ab,
 (SELECT CAST(coalesce(sum((CASE WHEN d <= rr THEN 1 ELSE 0 END) + (CASE WHEN alo > bhi AND (alo - bhi) * 1e-5 > d - rr AND (alo - bhi) * 1e-5 < d * 2e0 + rr THEN 1 ELSE 0 END)), 0) AS BIGINT) FROM j WHERE j.qid = req.qid) AS dir_ba
FROM req"""
)
def p2p_pair_counts(spark, sf_dir):
    """Trips at either and both of two circles, and in each direction."""
    return trace.p2p(samples(spark, sf_dir), values(spark, P2P, P2P_SCHEMA))


@query(W + sql_values(THREE, THREE_SCHEMA, "req") + ", " + _THREE_LEGS + ", " + sql_match("legs", "qid, leg") + " SELECT qid, leg, trip_id, i1, i2 FROM matched")
def directed_trip_match(spark, sf_dir):
    """Trips from one circle to another, with their middle indexes there."""
    legs = trace._legs_of_three(values(spark, THREE, THREE_SCHEMA))
    return trace.match(samples(spark, sf_dir), legs, ["qid", "leg"]).select("qid", "leg", "trip_id", "i1", "i2")


@query(W + sql_values(THREE, THREE_SCHEMA, "req") + ", " + _THREE_LEGS + ", " + sql_match("legs", "qid, leg") + ", " + _THREE_TRIPS + " SELECT req.qid, (SELECT count(*) FROM trips t WHERE t.qid = req.qid) AS n_trips FROM req")
def three_point_count(spark, sf_dir):
    """Trips through three circles in order."""
    return trace.three_point(samples(spark, sf_dir), values(spark, THREE, THREE_SCHEMA))


_DENSE = """dense AS (SELECT a.trip_id, a.idx + j AS idx, a.lat * (1 - j / 5e0) + b.lat * (j / 5e0) AS lat, a.lon * (1 - j / 5e0) + b.lon * (j / 5e0) AS lon
  FROM samples a JOIN samples b ON a.trip_id = b.trip_id AND b.idx = a.idx + 5 CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS j) t)"""


def dense(spark, sf_dir):
    """The surrogate's samples, four more between each two."""
    s = samples(spark, sf_dir).select("trip_id", "idx", "lat", "lon")
    after = s.select("trip_id", (F.col("idx") - 5).alias("idx"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    rows = s.join(after, ["trip_id", "idx"]).withColumn("j", F.explode(F.array(*(F.lit(i) for i in range(5)))))
    alpha = F.col("j") / F.lit(5.0)
    return rows.select("trip_id", (F.col("idx") + F.col("j")).alias("idx"), geo.lerp(F.col("lat"), F.col("lat2"), alpha).alias("lat"), geo.lerp(F.col("lon"), F.col("lon2"), alpha).alias("lon"))


@query(
    W
    + _DENSE
    + ", "
    + sql_values(THREE, THREE_SCHEMA, "req")
    + ", "
    + _THREE_LEGS
    + ", "
    + sql_match("legs", "qid, leg")
    + ", "
    + _THREE_TRIPS
    + """, bad AS (SELECT DISTINCT qid FROM trips WHERE i1 + 8 >= i2),
rows_ AS (SELECT t.qid, t.trip_id, (d.idx - t.i1 - 8) // 8 AS pos, d.lat, d.lon FROM trips t JOIN dense d ON d.trip_id = t.trip_id AND d.idx >= t.i1 + 8 AND d.idx < t.i2 AND (d.idx - t.i1 - 8) % 8 = 0 WHERE t.qid NOT IN (SELECT qid FROM bad)),
last_ AS (SELECT qid, min(l) AS l FROM (SELECT qid, trip_id, max(pos) AS l FROM rows_ GROUP BY qid, trip_id) GROUP BY qid)
SELECT r.qid, CAST(r.pos AS INT) AS pos, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n_trips FROM rows_ r JOIN last_ USING (qid) WHERE pos <= l GROUP BY r.qid, r.pos"""
)
def three_point_mean_path(spark, sf_dir):
    """The mean path between the second and third circle."""
    s = samples(spark, sf_dir)
    trips = trace.three_point_trips(s, values(spark, THREE, THREE_SCHEMA))
    return trace.mean_path_of(dense(spark, sf_dir), trips)


SPEEDS = [(0, 42.35, -71.1, 3e-4, 0.2), (1, 42.35, -71.1, 3e-4, 0.5), (2, 42.3493, -71.1, 9e-5, 1.0), (3, 42.4, -71.1, 1e-4, 0.5)]
SPEED_SCHEMA = "qid INT, lat DOUBLE, lon DOUBLE, radius DOUBLE, ranking DOUBLE"


@query(
    W
    + sql_values(SPEEDS, SPEED_SCHEMA, "req")
    + """, f AS (SELECT r.qid, r.ranking, s.speed_inv AS v FROM samples s JOIN req r ON sqrt(pow(r.lat - s.lat, 2) + pow(r.lon - s.lon, 2)) < r.radius),
g AS (SELECT qid, count(*) AS n, count(*) FILTER (v > 0.07) AS m, list_sort(list(v) FILTER (v > 0.07)) AS l, any_value(ranking) AS k FROM f GROUP BY qid)
SELECT req.qid, coalesce(n, 0) AS n_samples, coalesce(m, 0) AS n_moving, CASE WHEN coalesce(n, 0) < 5 OR coalesce(m, 0) < 5 THEN 100e0 ELSE l[least(CAST(floor(k * m) AS BIGINT), m - 1) + 1] END AS speed FROM req LEFT JOIN g USING (qid)"""
)
def speed_rank(spark, sf_dir):
    """The inverse speed at a rank among the samples of a circle."""
    return trace.speed_rank(samples(spark, sf_dir), values(spark, SPEEDS, SPEED_SCHEMA))


_HISTORY = """legs AS (SELECT a.qid, a.k AS leg, a.lat AS lat1, a.lon AS lon1, a.radius AS r1, b.lat AS lat2, b.lon AS lon2, b.radius AS r2, a.dist FROM path a JOIN path b ON a.qid = b.qid AND a.k = b.k + 1
 UNION ALL SELECT a.qid, 100 + a.k, a.lat, a.lon, a.radius, b.lat, b.lon, b.radius, a.dist + m.dist FROM path a JOIN path b ON a.qid = b.qid AND a.k = b.k + 2 JOIN path m ON a.qid = m.qid AND m.k = b.k + 1)"""
_HISTORY_TRIPS = """need AS (SELECT qid, count(*) AS n FROM legs GROUP BY qid),
history AS (SELECT m.qid, m.trip_id, max(CASE WHEN leg = 1 THEN i1 END) AS i1, max(CASE WHEN leg = 1 THEN i2 END) AS i2 FROM matched m JOIN need ON need.qid = m.qid GROUP BY m.qid, m.trip_id HAVING count(*) = any_value(need.n))"""


def _directions(bins: int) -> str:
    step = 360.0 / bins
    return (
        W
        + sql_values(PATH, PATH_SCHEMA, "path")
        + ", "
        + _HISTORY
        + ", "
        + sql_match("legs", "qid, leg")
        + ", "
        + _HISTORY_TRIPS
        + f""", ring AS (SELECT a.qid, bin, a.lat AS alat, a.lon AS alon, a.radius AS ar, a.dist AS ad, b.lat AS blat, b.lon AS blon, b.radius AS br, b.dist AS bd,
   a.lat + a.dist * cos(radians(bin * {step}e0)) AS plat, a.lon + a.dist * sin(radians(bin * {step}e0)) / cos(radians(a.lat)) AS plon
   FROM path a JOIN path b ON a.qid = b.qid AND b.k = 1 AND a.k = 0 CROSS JOIN (SELECT CAST(unnest(generate_series(0, {bins - 1})) AS INT) AS bin) t),
probes AS (SELECT qid, bin, 1 AS leg, alat AS lat1, alon AS lon1, ar AS r1, plat AS lat2, plon AS lon2, ar AS r2, ad AS dist FROM ring UNION ALL SELECT qid, bin, 2, blat, blon, ar, plat, plon, br, ad + bd FROM ring),
"""
        + sql_match("probes", "qid, bin, leg", "probed")
        + """, hits AS (SELECT qid, bin, trip_id FROM probed GROUP BY qid, bin, trip_id HAVING count(*) = 2),
scored AS (SELECT h.qid, h.bin, count(*) AS n FROM hits h JOIN history USING (qid, trip_id) GROUP BY h.qid, h.bin)
SELECT r.qid, r.bin, coalesce(n, 0) AS n_trips"""
    )


@query(_directions(72) + " FROM ring r LEFT JOIN scored s ON s.qid = r.qid AND s.bin = r.bin")
def path_direction_scores(spark, sf_dir):
    """Trips with a path's history that go on in each of 72 directions."""
    return trace.direction_scores(samples(spark, sf_dir), paths(spark))


@query(_directions(360) + " FROM ring r LEFT JOIN scored s ON s.qid = r.qid AND s.bin = r.bin")
def path_direction_scores_fine(spark, sf_dir):
    """The same for 360 directions."""
    return trace.direction_scores(samples(spark, sf_dir), paths(spark), 360)


@query(_directions(72) + ", CASE WHEN coalesce(n, 0) >= 2 THEN round(ln(coalesce(n, 0) + 1e-8), 9) ELSE -1000e0 END AS score FROM ring r LEFT JOIN scored s ON s.qid = r.qid AND s.bin = r.bin")
def score_activation(spark, sf_dir):
    """Direction scores with their activation."""
    return trace.scored_directions(samples(spark, sf_dir), paths(spark), 2).withColumn("score", F.round("score", 9))


_SHARES = ", ".join(f"({i}, {v!r})" for i, v in enumerate([0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6, 0.7, 0.7999999999999999, 0.8999999999999999, 0.9999999999999999]))


@query(
    W
    + _DENSE
    + ", "
    + sql_values(PATH, PATH_SCHEMA, "path")
    + ", "
    + _HISTORY
    + ", "
    + sql_match("legs", "qid, leg")
    + ", "
    + _HISTORY_TRIPS
    + f""", sh AS (SELECT pos, CAST(v AS DOUBLE) AS share FROM (VALUES {_SHARES}) t(pos, v)),
ends AS (SELECT trip_id, max(idx) AS last FROM dense GROUP BY trip_id),
w AS (SELECT h.qid, h.trip_id, sh.pos, sh.share, h.i1 + 2 AS b, CAST(h.i2 - h.i1 - 2 AS DOUBLE) AS len, last, CAST(floor(sh.share * CAST(h.i2 - h.i1 - 2 AS DOUBLE) + (h.i1 + 2)) AS BIGINT) AS n FROM history h JOIN ends USING (trip_id) CROSS JOIN sh WHERE h.i2 > h.i1 + 2),
x AS (SELECT qid, trip_id, pos, least(n, last) AS n1, least(n + 1, last) AS n2, share - (least(n, last) - b) / len AS al FROM w)
SELECT x.qid, x.pos, round(avg(p.lat * (1 - al) + q.lat * al), 6) AS lat, round(avg(p.lon * (1 - al) + q.lon * al), 6) AS lon, count(*) AS n_trips
FROM x JOIN dense p ON p.trip_id = x.trip_id AND p.idx = n1 JOIN dense q ON q.trip_id = x.trip_id AND q.idx = n2 GROUP BY x.qid, x.pos"""
)
def path_mean_fraction(spark, sf_dir):
    """The mean path of a history's trips at eleven shares of the way."""
    trips = trace.history_trips(samples(spark, sf_dir), paths(spark))
    return trace.mean_of_shares(dense(spark, sf_dir), trips)
