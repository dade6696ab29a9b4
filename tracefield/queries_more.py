"""Registered queries on links between places and graphs, turns, curves, masks and clusters, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import geo
from .functions import vector as V
from .operators import cluster, graph, raster, similarity, trace
from .queries import CIRCLES, P2P, P2P_SCHEMA, PATH, PI2, SQL, THREE, THREE_SCHEMA, W, _P2P_DIST, _THREE_LEGS, _THREE_TRIPS, query, samples, sql_dist, sql_match, sql_values, values
from .queries_graph import G, _SHAPES, _USE, _WALK, _distances, _sources, road_graph, table
from .queries_vector import _E, _REGION, _sql_at, _sql_blur, _vectors, merge_checker
from .sources import graphs, requests

# --- whether trips link places -------------------------------------------------------------------

#: The body of the SQL of :func:`trace.p2p`, for requests in a relation ``req``.
_P2P_BODY = f"""a AS (SELECT qid, trip_id, min(idx) AS lo, max(idx) AS hi FROM samples s JOIN req r ON sqrt(pow(r.lat1 - s.lat, 2) + pow(r.lon1 - s.lon, 2)) < r.radius GROUP BY qid, trip_id),
b AS (SELECT qid, trip_id, min(idx) AS lo, max(idx) AS hi FROM samples s JOIN req r ON sqrt(pow(r.lat2 - s.lat, 2) + pow(r.lon2 - s.lon, 2)) < r.radius GROUP BY qid, trip_id),
j AS (SELECT r.qid, {_P2P_DIST} AS d, r.radius * 2 AS rr, a.lo AS alo, a.hi AS ahi, b.lo AS blo, b.hi AS bhi FROM a JOIN b USING (qid, trip_id) JOIN req r USING (qid)),
cnt AS (SELECT req.qid, (SELECT count(*) FROM a WHERE a.qid = req.qid) AS n_a, (SELECT count(*) FROM b WHERE b.qid = req.qid) AS n_b,
 (SELECT CAST(coalesce(sum((CASE WHEN d <= rr THEN 1 ELSE 0 END) + (CASE WHEN ahi < blo AND (blo - ahi) * 1e-5 > d - rr AND (blo - ahi) * 1e-5 < d * 2e0 + rr THEN 1 ELSE 0 END)), 0) AS BIGINT) FROM j WHERE j.qid = req.qid) AS dir_ab,
 (SELECT CAST(coalesce(sum((CASE WHEN d <= rr THEN 1 ELSE 0 END) + (CASE WHEN alo > bhi AND (alo - bhi) * 1e-5 > d - rr AND (alo - bhi) * 1e-5 < d * 2e0 + rr THEN 1 ELSE 0 END)), 0) AS BIGINT) FROM j WHERE j.qid = req.qid) AS dir_ba FROM req)"""

_PAIRS = [(0, 42.3493, -71.1, 42.3506, -71.1), (1, 42.35, -71.1006, 42.35, -71.0994), (2, 42.35, -71.1, 42.35, -71.09995), (3, 42.4, -71.1, 42.41, -71.1), (4, 42.3493, -71.1, 42.35, -71.0994), (5, 42.3495, -71.1, 42.3505, -71.1003)]
_PAIR_SCHEMA = "qid INT, lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"
_APART = sql_dist("lat1", "lon1", "lat2", "lon2")


@query(
    W
    + sql_values(_PAIRS, _PAIR_SCHEMA, "asked")
    + f", req AS (SELECT *, {_APART} AS apart, least(greatest({_APART} * 0.1e0, 0.00005e0), 0.00012e0) AS radius FROM asked), "
    + _P2P_BODY
    + " SELECT qid, n_a, n_b, dir_ab, dir_ba, apart < radius * 2 OR n_a < 5 OR n_b < 5 OR dir_ab + dir_ba >= 3 AS connected FROM cnt JOIN req USING (qid)"
)
def connected_places(spark, sf_dir):
    """Whether trips join pairs of places."""
    return trace.connected(samples(spark, sf_dir), values(spark, _PAIRS, _PAIR_SCHEMA))


_TRIPLES = [(0, 42.3493, -71.1, 42.35, -71.1, 42.3506, -71.1), (1, 42.35, -71.1006, 42.35, -71.1, 42.35, -71.0994), (2, 42.40, -71.1, 42.41, -71.1, 42.42, -71.1), (3, 42.3496, -71.1, 42.35, -71.1, 42.35, -71.0996), (4, 42.3497, -71.1, 42.3503, -71.1, 42.35, -71.0997)]
_TRIPLE_SCHEMA = "qid INT, lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE, lat3 DOUBLE, lon3 DOUBLE"


@query(
    W
    + sql_values(_TRIPLES, _TRIPLE_SCHEMA, "asked")
    + """, pts AS (SELECT qid, unnest([lat1, lat2, lat3]) AS lat, unnest([lon1, lon2, lon3]) AS lon, unnest([1, 2, 3]) AS k FROM asked),
f AS (SELECT r.qid, r.k, s.speed_inv AS v FROM samples s JOIN pts r ON sqrt(pow(r.lat - s.lat, 2) + pow(r.lon - s.lon, 2)) < 0.0003e0),
g AS (SELECT qid, k, count(*) AS n, count(*) FILTER (v > 0.07) AS m, list_sort(list(v) FILTER (v > 0.07)) AS l FROM f GROUP BY qid, k),
sp AS (SELECT pts.qid, bool_and(5e0 / (CASE WHEN coalesce(n, 0) < 5 OR coalesce(m, 0) < 5 THEN 100e0 ELSE l[least(CAST(floor(0.2e0 * m) AS BIGINT), m - 1) + 1] END) * 3.6e0 / 1.6e0 < 40) AS slow FROM pts LEFT JOIN g USING (qid, k) GROUP BY pts.qid),
direct AS (WITH req AS (SELECT qid, lat1, lon1, lat2, lon2, 0.00005e0 AS radius FROM asked), """
    + _P2P_BODY
    + """ SELECT qid, n_a, dir_ab + dir_ba AS n FROM cnt),
over_ AS (WITH req AS (SELECT qid * 2 AS qid, lat1, lon1, lat2, lon2, lat3, lon3, 5e-5 AS r1, 5e-5 AS r2, 5e-5 AS r3, -1e0 AS d1, -1e0 AS d2 FROM asked UNION ALL SELECT qid * 2 + 1, lat3, lon3, lat2, lon2, lat1, lon1, 5e-5, 5e-5, 5e-5, -1e0, -1e0 FROM asked), """
    + _THREE_LEGS
    + ", "
    + sql_match("legs", "qid, leg")
    + ", "
    + _THREE_TRIPS
    + """ SELECT q.qid // 2 AS qid, max((SELECT count(*) FROM trips t WHERE t.qid = q.qid)) AS n FROM req q GROUP BY q.qid // 2)
SELECT qid, slow, n_a, greatest(d.n, o.n) AS n_trips, slow OR n_a < 5 OR (d.n >= 3 AND greatest(d.n, o.n) > 2) AS connected FROM sp JOIN direct d USING (qid) JOIN over_ o USING (qid)"""
)
def connected_roads(spark, sf_dir):
    """Whether trips and speeds confirm links over three places."""
    return trace.connected_roads(samples(spark, sf_dir), values(spark, _TRIPLES, _TRIPLE_SCHEMA))


# The paths of this query go down from a place, or westwards, by 1e-4 a node.
SQL["merge_checker"] = (
    W
    + """paths AS (SELECT pid, side, list_transform(range(0, 8), lambda i: lat - i * dlat) AS la, list_transform(range(0, 8), lambda i: lon - i * dlon) AS lo
 FROM (VALUES (0, 1, 42.3502e0, -71.1e0, 1e-4, 0e0), (0, 2, 42.3503e0, -71.1e0, 1e-4, 0e0), (1, 1, 42.3502e0, -71.1e0, 1e-4, 0e0), (1, 2, 42.35e0, -71.0998e0, 0e0, 1e-4)) t(pid, side, lat, lon, dlat, dlon)),
req AS (SELECT p.pid * 10 + p.side AS qid, p.la[8] AS lat1, p.lo[8] AS lon1, p.la[6] AS lat2, p.lo[6] AS lon2, o.la[1] AS lat3, o.lo[1] AS lon3, 0.00005e0 AS r1, 0.00005e0 AS r2, 0.00005e0 AS r3, -1e0 AS d1, -1e0 AS d2 FROM paths p JOIN paths o ON p.pid = o.pid AND p.side <> o.side), """
    + _THREE_LEGS
    + ", "
    + sql_match("legs", "qid, leg")
    + ", "
    + _THREE_TRIPS
    + ", c AS (SELECT qid // 10 AS pid, (SELECT count(*) FROM trips t WHERE t.qid = req.qid) AS n FROM req) SELECT CAST(pid AS INT) AS pid, bool_and(n > 2) AS same, min(n) AS n_least FROM c GROUP BY pid"
)
assert merge_checker.__name__ in SQL

# --- graphs ----------------------------------------------------------------------------------------

_CROSSED = (
    _SHAPES
    + """, x AS (SELECT a.id AS id1, b.id AS id2, a.lat1 AS ax, a.lon1 AS ay, a.lat2 AS bx, a.lon2 AS by_, b.lat1 AS cx, b.lon1 AS cy, b.lat2 AS dx, b.lon2 AS dy FROM s a JOIN s b ON a.c = b.c AND a.id < b.id WHERE a.src <> b.src AND a.src <> b.dst AND a.dst <> b.src AND a.dst <> b.dst),
cr AS (SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / ((bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx)) AS t FROM x WHERE ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * ((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) < 0 AND ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * ((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) < 0)"""
)


@query(
    G
    + _CROSSED
    + """, e8 AS (SELECT id1, id2, ax + t * (bx - ax) AS lat2, ay + t * (by_ - ay) AS lon2, unnest(range(0, 8)) AS turn, [ax, bx] AS alat, [ay, by_] AS alon, [cx, dx] AS clat, [cy, dy] AS clon FROM cr)
SELECT id1, id2, CAST(turn AS INT) AS turn, CASE WHEN turn < 4 THEN alat[turn // 2 % 2 + 1] ELSE clat[turn // 2 % 2 + 1] END AS lat1, CASE WHEN turn < 4 THEN alon[turn // 2 % 2 + 1] ELSE clon[turn // 2 % 2 + 1] END AS lon1,
 round(lat2, 9) AS lat2, round(lon2, 9) AS lon2, CASE WHEN turn < 4 THEN clat[turn % 2 + 1] ELSE alat[turn % 2 + 1] END AS lat3, CASE WHEN turn < 4 THEN clon[turn % 2 + 1] ELSE alon[turn % 2 + 1] END AS lon3 FROM e8"""
)
def crossing_turns(spark, sf_dir):
    """The eight turns at every crossing of two edges."""
    v, e = road_graph(spark, sf_dir)
    e = graph.dedupe_edges(e)
    asked = graph.turn_requests(graph.crossings(e, v), e, v)
    return asked.select("qid.id1", "qid.id2", "qid.turn", "lat1", "lon1", F.round("lat2", 9).alias("lat2"), F.round("lon2", 9).alias("lon2"), "lat3", "lon3")


SQL["nearest_edge"] = (
    G
    + _SHAPES
    + """, d AS (SELECT *, sqrt(pow(lat2 - lat1, 2) + pow((lon2 - lon1) * cos(radians(lat2)), 2)) AS n FROM s),
q AS (SELECT a.id, b.id AS other, (a.lat1 + a.lat2) / 2 AS ox, (a.lon1 + a.lon2) / 2 AS oy, (a.lat2 - a.lat1) / a.n AS ux, (a.lon2 - a.lon1) * cos(radians(a.lat2)) / a.n AS uy, b.lat1 AS ax, b.lon1 AS ay, b.lat2 AS bx, b.lon2 AS by_,
  sqrt(pow(b.lat2 - b.lat1, 2) + pow((b.lon2 - b.lon1) * cos(radians(a.lat2)), 2)) AS m, cos(radians(a.lat2)) AS k FROM d a JOIN d b ON a.c = b.c AND a.id <> b.id),
w AS (SELECT *, sqrt(pow(ux - (bx - ax) / m, 2) + pow(uy - (by_ - ay) * k / m, 2)) AS turn, -uy * (by_ - ay) - ux * (bx - ax) AS t FROM q),
h AS (SELECT *, ((ax - ox) * (by_ - ay) - (ay - oy) * (bx - ax)) / t AS along, ((ax - ox) * ux - (ay - oy) * -uy) / t AS share FROM w WHERE t <> 0 AND (turn <= 0.1e0 OR turn >= 1.9e0)),
z AS (SELECT id, other, abs(along) AS distance FROM h WHERE share >= 0 AND share <= 1 AND abs(along) < 0.001e0)
SELECT id, other, round(distance, 8) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 12), other) AS r FROM z) x WHERE r = 1"""
)

SQL["marble_walk"] = (
    G
    + """, b2 AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
l AS (SELECT b2.src, b2.dst, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, sqrt((a.lat - b.lat) * (a.lat - b.lat) + ((a.lon - b.lon) * cos(radians(a.lat))) * ((a.lon - b.lon) * cos(radians(a.lat)))) AS length FROM b2 JOIN v a ON a.id = b2.src JOIN v b ON b.id = b2.dst),
walk(source, id, distance, before) AS (SELECT id, id, 0e0, CAST(-1 AS BIGINT) FROM v WHERE k = 1 UNION SELECT w.source, l.dst, w.distance + l.length, w.id FROM walk w JOIN l ON l.src = w.id WHERE w.distance + l.length <= 0.001e0),
near AS (SELECT source, id, min(distance) AS distance, arg_min(before, {'a': distance, 'b': before}) AS before FROM walk GROUP BY source, id),
p AS (SELECT n.source, n.distance, l.*, ceil(round(n.distance / 0.0001e0, 6)) * 0.0001e0 - n.distance AS first_ FROM near n JOIN l ON l.src = n.id WHERE l.dst <> n.before AND l.length > 0),
c AS (SELECT *, CAST(floor(round((least(length, 0.001e0 - distance) - first_) / 0.0001e0, 6)) AS INT) AS n FROM p WHERE first_ < length),
x AS (SELECT *, (first_ + k * 0.0001e0) / length AS alpha FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM c WHERE n >= 0) u)
SELECT DISTINCT source AS start, round(lat1 * (1e0 - alpha) + lat2 * alpha, 8) AS lat, round(lon1 * (1e0 - alpha) + lon2 * alpha, 8) AS lon FROM x WHERE alpha < 1 - 1e-9"""
)

_CURVE = "({a}1 * 2e0 + ({a}2 - coalesce({a}0, {a}1)) * t + (coalesce({a}0, {a}1) * 2e0 - {a}1 * 5e0 + {a}2 * 4e0 - coalesce({a}3, {a}2)) * t * t + ({a}1 * 3e0 - coalesce({a}0, {a}1) - {a}2 * 3e0 + coalesce({a}3, {a}2)) * t * t * t) / 2e0"


@query(
    G
    + ", bf AS (SELECT dst AS src, min(src) AS prev FROM u GROUP BY dst), af AS (SELECT src AS dst, min(dst) AS next FROM u GROUP BY src), c AS (SELECT u.id, s.k, s.k / 4e0 AS t, p.lat AS lat0, p.lon AS lon0, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2, q.lat AS lat3, q.lon AS lon3 FROM u JOIN v a ON a.id = u.src JOIN v b ON b.id = u.dst LEFT JOIN bf ON bf.src = u.src LEFT JOIN af ON af.dst = u.dst LEFT JOIN v p ON p.id = bf.prev LEFT JOIN v q ON q.id = af.next CROSS JOIN (SELECT CAST(unnest([1, 2, 3]) AS INT) AS k) s)"
    + f" SELECT id, k, round({_CURVE.format(a='lat')}, 11) AS lat, round({_CURVE.format(a='lon')}, 11) AS lon FROM c"
)
def smooth_edges(spark, sf_dir):
    """Points on a curve along each edge, bent by its neighbours."""
    v, e = road_graph(spark, sf_dir)
    return graph.smooth(graph.dedupe_edges(e), v).select("id", "k", F.round("lat", 11).alias("lat"), F.round("lon", 11).alias("lon"))


@query(G + _WALK + _USE + " SELECT src AS id FROM trail WHERE src % 20 = 0 UNION SELECT dst FROM trail WHERE dst % 20 = 0 UNION SELECT source FROM trail UNION SELECT target FROM trail")
def path_locations(spark, sf_dir):
    """Sampled vertices on shortest paths to terminals, and their ends."""
    d, v = _distances(spark, sf_dir)
    return graph.locations(graph.paths_to(d, v.filter("terminate").select("id")))


# A road of each customer with a gap after every fourth vertex, and bars across the gaps.
_ROAD = """WITH g AS (SELECT o_orderkey AS id, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
v AS (SELECT id, c, k, 42e0 + (c % 50) * 1e-2 + k * 2e-4 AS lat, -71e0 - (c // 50) * 1e-2 AS lon FROM g),
e AS (SELECT b.id, a.id AS src, b.id AS dst FROM v a JOIN v b ON a.c = b.c AND a.k = b.k - 1 WHERE b.k % 4 <> 1),
nb AS (SELECT src AS id, dst AS other FROM e UNION SELECT dst, src FROM e),
one AS (SELECT id, max(other) AS from_ FROM nb GROUP BY id HAVING count(*) = 1),
d AS (SELECT one.id, x.c, x.lat AS lat1, x.lon AS lon1, y.lat AS lat0, y.lon AS lon0 FROM one JOIN v x ON x.id = one.id JOIN v y ON y.id = one.from_)"""


def road_with_gaps(spark, sf_dir):
    """Vertices and edges of the roads, and of the bars across."""
    g = road_graph(spark, sf_dir)[0].select("id", "c", "k")
    v = g.select("id", "c", "k", (F.lit(42.0) + F.pmod("c", F.lit(50)) * F.lit(1e-2) + F.col("k") * F.lit(2e-4)).alias("lat"), (F.lit(-71.0) - F.expr("c div 50") * F.lit(1e-2)).alias("lon"))
    before = g.select("c", (F.col("k") + 1).alias("k"), F.col("id").alias("src"))
    e = g.filter("k % 4 <> 1").join(before, ["c", "k"]).select("id", "src", F.col("id").alias("dst"), F.lit(1.0).alias("score"))
    end = lambda n, shift: v.select((-2 * F.col("id") - n).alias("id"), "c", "k", (F.col("lat") + F.lit(1e-4)).alias("lat"), (F.col("lon") + F.lit(shift)).alias("lon"))
    bars = v.select((-F.col("id") - 1).alias("id"), (-2 * F.col("id") - 2).alias("src"), (-2 * F.col("id") - 3).alias("dst"), F.lit(1.0).alias("score"))
    return v, e, end(2, -1.5e-4).unionByName(end(3, 1e-4)), bars


@query(
    _ROAD
    + """, q AS (SELECT a.id AS src, b.id AS dst, a.lat1 - a.lat0 AS x1, a.lon1 - a.lon0 AS y1, b.lat1 - a.lat1 AS x2, b.lon1 - a.lon1 AS y2, b.lat0 - b.lat1 AS x3, b.lon0 - b.lon1 AS y3, a.lat1 AS la, a.lon1 AS lo, b.lat1 AS lb, b.lon1 AS ob FROM d a JOIN d b ON a.c = b.c AND a.id <> b.id WHERE abs(a.lat1 - b.lat1) <= 0.0005e0),
n AS (SELECT *, sqrt(x1 * x1 + pow(y1 * cos(radians(40e0)), 2)) AS m1, sqrt(x2 * x2 + pow(y2 * cos(radians(40e0)), 2)) AS m2, sqrt(x3 * x3 + pow(y3 * cos(radians(40e0)), 2)) AS m3 FROM q),
k AS (SELECT src, dst, """
    + sql_dist("la", "lo", "lb", "ob")
    + """ AS distance FROM n WHERE sqrt(pow(x1 / m1 - x2 / m2, 2) + pow(y1 / m1 - y2 / m2, 2)) < 1.4 AND sqrt(pow(x2 / m2 - x3 / m3, 2) + pow(y2 / m2 - y3 / m3, 2)) < 1.4)
SELECT src, dst, round(distance, 8) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(distance, 12), dst) AS r FROM k) t WHERE r = 1"""
)
def gap_links(spark, sf_dir):
    """For each dead end of roads with gaps the next one straight ahead, over the gap."""
    v, e, _, _ = road_with_gaps(spark, sf_dir)
    return graph.dead_end_links(v, e).select("src", "dst", F.round("distance", 8).alias("distance"))


_HITS = """, bar AS (SELECT -id - 1 AS edge, c, lat + 1e-4 AS lat, lon - 1.5e-4 AS west, lon + 1e-4 AS east FROM v),
h AS (SELECT d.id, bar.edge, bar.lat, d.lon1 + (bar.lat - d.lat1) / (d.lat1 - d.lat0) * (d.lon1 - d.lon0) AS lon, abs(bar.lat - d.lat1) AS distance FROM d JOIN bar USING (c) WHERE (bar.lat - d.lat1) / (d.lat1 - d.lat0) >= 0 AND abs(bar.lat - d.lat1) <= 0.0005e0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(distance, 9), edge) AS r FROM h) t WHERE r = 1)"""


@query(_ROAD + _HITS + " SELECT id, edge, round(lat, 8) AS lat, round(lon, 8) AS lon, round(distance, 8) AS distance FROM best")
def graph_bridges(spark, sf_dir):
    """Where dead ends of one graph, prolonged, first hit another graph's edges."""
    v, e, bar_ends, bars = road_with_gaps(spark, sf_dir)
    return graph.bridge(bar_ends, bars, v, e).select("id", "edge", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), F.round("distance", 8).alias("distance"))


@query(_ROAD + _HITS + """, link AS (SELECT id AS src, 2 * (edge + 1) - 2 AS dst FROM best)
SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT -2 * id - 2, -2 * id - 3 FROM v UNION ALL SELECT src, dst FROM link UNION ALL SELECT dst, src FROM link) t""")
def joined_graphs(spark, sf_dir):
    """The union of two graphs with edges both ways over their bridges, each to the edge's first end."""
    v, e, bar_ends, bars = road_with_gaps(spark, sf_dir)
    found = graph.bridge(bar_ends, bars, v, e).join(bars.select(F.col("id").alias("edge"), F.col("src").alias("to")), "edge")
    return graph.join_graphs(bars, e, found.select(F.col("id").alias("src"), F.col("to").alias("dst"))).select("src", "dst")


# --- geometry and vectors ------------------------------------------------------------------------------

_NEXT = "nxt AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM samples WINDOW w AS (PARTITION BY trip_id ORDER BY idx))"


@query(
    W
    + _NEXT
    + """, r AS (SELECT trip_id, idx, lat - 42.35e0 AS x1, lon + 71.1e0 AS y1, lat2 - lat AS dx, lon2 - lon AS dy FROM nxt WHERE lat2 IS NOT NULL),
q AS (SELECT *, dx * dx + dy * dy AS a, 2e0 * (x1 * dx + y1 * dy) AS b, x1 * x1 + y1 * y1 - 3e-4 * 3e-4 AS c FROM r)
SELECT trip_id, idx, round((-b + sqrt(b * b - 4e0 * a * c)) / (2e0 * a), 5) AS a1, round((-b - sqrt(b * b - 4e0 * a * c)) / (2e0 * a), 5) AS a2 FROM q WHERE a > 0 AND b * b - 4e0 * a * c > 1e-18"""
)
def circle_line_roots(spark, sf_dir):
    """Where the lines of the trips' segments meet a circle."""
    from .queries_vector import _pairs

    c = F.col
    x1, y1 = c("lat") - F.lit(42.35), c("lon") + F.lit(71.1)
    roots = geo.circle_line(x1, y1, x1 + (c("lat2") - c("lat")), y1 + (c("lon2") - c("lon")), F.lit(3e-4))
    dx, dy = c("lat2") - c("lat"), c("lon2") - c("lon")
    a, b = dx * dx + dy * dy, 2.0 * (x1 * dx + y1 * dy)
    clear = b * b - 4.0 * a * (x1 * x1 + y1 * y1 - F.lit(3e-4) * F.lit(3e-4)) > 1e-18  # not merely touched
    rows = _pairs(spark, sf_dir).filter((a > 0) & clear)
    return rows.select("trip_id", "idx", F.round(roots["a1"], 5).alias("a1"), F.round(roots["a2"], 5).alias("a2"))


@query(W + " p AS (SELECT trip_id, count(*) AS n FROM samples WHERE lat BETWEEN 42.347e0 + 0.001e0 AND 42.353e0 - 0.001e0 AND lon BETWEEN -71.104e0 + 0.001e0 AND -71.096e0 - 0.001e0 GROUP BY trip_id) SELECT trip_id, n FROM p")
def samples_in_region(spark, sf_dir):
    """Samples of each trip inside a region, less a margin."""
    inside = geo.in_region(F.col("lat"), F.col("lon"), (42.347, -71.104, 42.353, -71.096), 0.001)
    return samples(spark, sf_dir).filter(inside).groupBy("trip_id").agg(F.count("*").alias("n"))


@query(W + " t AS (SELECT trip_id, list(DISTINCT CAST(clat AS BIGINT) * 100000 + clon) AS cells FROM samples GROUP BY trip_id) SELECT a.trip_id, list_has_any(a.cells, b.cells) AS shared FROM t a JOIN t b ON b.trip_id = a.trip_id + 1")
def shared_cells(spark, sf_dir):
    """Whether successive trips have a cell in common."""
    cells = samples(spark, sf_dir).groupBy("trip_id").agg(F.collect_set(F.col("clat").cast("long") * 100000 + F.col("clon")).alias("cells"))  # a trip's own cells
    other = cells.select((F.col("trip_id") - 1).alias("trip_id"), F.col("cells").alias("others"))
    return cells.join(other, "trip_id").select("trip_id", similarity.shares_node(F.col("cells"), F.col("others")).alias("shared"))


_SIDE = lambda sign: f"list_transform(list_filter(range(0, n // 3 - 2), lambda i: i < coalesce(list_min(list_filter(range(0, n // 3 - 2), lambda j: e[((dir {sign} (j + 2)) % n + n) % n + 1] > 0.1e0)), n)), lambda i: ((dir {sign} (i + 2)) % n + n) % n)"


@query(f"WITH {_E}, d AS (SELECT *, list_position(e, list_max(e)) - 1 AS dir FROM v) SELECT vec_id, list_sort(list_distinct(list_concat(list_transform(range(-2, 3), lambda i: ((dir + i) % n + n) % n), list_concat({_SIDE('+')}, {_SIDE('-')})))) AS places FROM d")
def allowed_sector(spark, sf_dir):
    """Places a node may go on to between its siblings."""
    e = F.col("e")
    rows = _vectors(spark, sf_dir).withColumn("direction", V.best_direction(e)).withColumn("n", F.size("e"))
    return rows.select("vec_id", F.array_sort(F.transform(V.sector(F.col("direction"), e, 64), lambda x: x.cast("long"))).alias("places"))


@query(f"WITH {_E}, c AS (SELECT vec_id, list_transform(range(0, 72), lambda i: e[i % n + 1]) AS c, CASE WHEN vec_id % 5 = 0 THEN -1e0 ELSE CAST(vec_id % 360 AS DOUBLE) END AS deg FROM v) SELECT vec_id, list_transform(range(0, 72), lambda i: CASE WHEN deg = -1 OR list_contains(list_transform(range(-2, 3), lambda j: ((CAST(floor(deg / 5e0) AS BIGINT) + j) % 72 + 72) % 72), i) THEN round(c[i + 1], 6) ELSE 0e0 END) AS kept FROM c")
def entrance_mask(spark, sf_dir):
    """Scores limited to the heading of an entrance."""
    circle = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.element_at(F.col("e"), (F.pmod(i, F.size("e")) + 1).cast("int")))
    degrees = F.when(F.col("vec_id") % 5 == 0, F.lit(-1.0)).otherwise((F.col("vec_id") % 360).cast("double"))
    return _vectors(spark, sf_dir).select("vec_id", V.rounded(V.entrance(circle, degrees)).alias("kept"))


_LP = "({x}) > ({a}) AND ({a}) > 0 AND ({x}) > ({b}) AND ({b}) > 0".format(x="e[j + 1]", a="e[j + 2]", b="e[j]")


@query(f"""WITH {_E}, f63 AS (SELECT vec_id, e[1:63] AS e, 63 AS n FROM v), t AS (SELECT vec_id, e, n, 31 AS half, coalesce(list_max(list_transform(list_filter(range(1, n - 1), lambda j: {_LP}), lambda j: e[j + 1])), 0e0) / 2 AS top FROM f63),
w AS (SELECT vec_id, coalesce(list_min(list_filter(range(0, half + 1), lambda i: NOT e[half + i + 1] > top)), half + 1) + coalesce(list_min(list_filter(range(0, half - 1), lambda i: NOT e[half - 1 - i + 1] > top)), half - 1) AS width FROM t)
SELECT vec_id, CAST(width AS INT) AS width, round(least(greatest((width - 1) * 0.000015e0 / 2, 0.00005e0), 0.000125e0), 9) AS radius FROM w""")
def profile_width(spark, sf_dir):
    """The half-maximum width of profiles and the radius that it makes."""
    e, half = F.slice("e", 1, 63), 31
    return _vectors(spark, sf_dir).select("vec_id", V.road_width(e, half).cast("int").alias("width"), F.round(V.radius_of(e, half), 9).alias("radius"))


# --- clusters ------------------------------------------------------------------------------------------


def _sql_rounds(rounds: int) -> str:
    """The rounds of centres one after the other."""
    near = f"arg_min(c.j, {{'d': {sql_dist('p.lat', 'p.lon', 'c.lat', 'c.lon')}, 'j': c.j}})"
    parts = ["p AS (SELECT lat, lon, row_number() OVER (ORDER BY trip_id * 1000000 + idx) - 1 AS at FROM samples)", "c0 AS (SELECT j, p.lat, p.lon FROM (SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS j) s JOIN p ON p.at = s.j * 70667 % (SELECT count(*) FROM p))"]
    for k in range(rounds):
        parts.append(f"a{k} AS (SELECT p.lat, p.lon, {near} AS j, min({sql_dist('p.lat', 'p.lon', 'c.lat', 'c.lon')}) AS d FROM p CROSS JOIN c{k} c GROUP BY p.at, p.lat, p.lon)")
        parts.append(f"c{k + 1} AS (SELECT c.j, coalesce(m.lat, c.lat) AS lat, coalesce(m.lon, c.lon) AS lon, coalesce(m.n, 0) AS n, coalesce(m.d + 0.00005e0, 0e0) AS d FROM c{k} c LEFT JOIN (SELECT j, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n, avg(d) AS d FROM a{k} GROUP BY j) m USING (j))")
    return W + ", ".join(parts) + f" SELECT j AS cluster, n, round(lat, 9) AS lat, round(lon, 9) AS lon, round(d, 9) AS distance FROM c{rounds}"


SQL["kmeans_fixed_iter"] = _sql_rounds(10)


@query(_sql_rounds(3).replace(" SELECT j AS cluster, n, round(lat, 9) AS lat, round(lon, 9) AS lon, round(d, 9) AS distance FROM c3", f", q AS (SELECT p.at, min({sql_dist('p.lat', 'p.lon', 'c.lat', 'c.lon')}) AS d FROM p CROSS JOIN c3 c GROUP BY p.at) SELECT CAST(4 AS INT) AS k, round(count(*) * -2e0 * ln(1e0 / ({PI2} * 0.0005e0 * 0.0005e0)) + 2e0 * sum(d * d) / (2e0 * 0.0005e0 * 0.0005e0) + ln(count(*)) * 4, 4) AS information FROM q"))
def cluster_information(spark, sf_dir):
    """The information criterion of four centres after three rounds."""
    points = samples(spark, sf_dir).select((F.col("trip_id") * 1_000_000 + F.col("idx")).alias("pid"), "lat", "lon")
    centres = [(r["lat"], r["lon"]) for r in cluster.kmeans(points, 4, 3).orderBy("cluster").collect()]  # four rows
    return spark.range(1).select(F.lit(4).alias("k"), F.round(F.lit(cluster.information(points, centres)), 4).alias("information"))


# --- request lines -----------------------------------------------------------------------------------

_LINES = (
    [(0, "".join(f"{x!r}," for r in THREE for x in r[1:]) + "7,"), (1, "".join(f"{x!r}," for x in THREE[1][1:])), (2, ""), (3, "1,2,x")]
    + [(4, "S," + "".join(f"{la!r},{lo!r},0.0003,{k / 4!r}," for k, la, lo, _ in CIRCLES))]
    + [(5 + q, f"{tag},{len(p)}," + "".join(f"{x!r}," for r in p for x in r[2:])) for q, (tag, p) in enumerate((t, [r for r in PATH if r[0] == i]) for t, i in (("N", 0), ("N", 1)))]
)


def _lines(spark):
    return spark.createDataFrame(_LINES, "line int, text string")


@query(SQL["three_point_count"].replace("SELECT req.qid, (SELECT count(*) FROM trips t WHERE t.qid = req.qid) AS n_trips FROM req", ", n AS (SELECT req.qid, (SELECT count(*) FROM trips t WHERE t.qid = req.qid) AS n FROM req) SELECT 0 AS line, string_agg(n, ' ' ORDER BY qid) || ' ' AS text FROM n UNION ALL SELECT 1, n || ' ' FROM n WHERE qid = 1"))
def request_lines_three_point(spark, sf_dir):
    """The answers to lines of three-point requests."""
    asked = requests.three_points(_lines(spark))
    return requests.replies(trace.three_point(samples(spark, sf_dir), asked), value=F.col("n_trips"))


@query(SQL["path_direction_scores"].join(("SELECT CAST(qid + 5 AS INT) AS line, string_agg(n_trips, ' ' ORDER BY bin) || ' ' AS text FROM (", ") GROUP BY qid")))
def request_lines_directions(spark, sf_dir):
    """The answers to lines with the newest points of paths: trips in each direction."""
    asked = requests.paths(_lines(spark)).filter("tag = 'N'")
    return requests.replies(trace.direction_scores(samples(spark, sf_dir), asked), "bin", value=F.col("n_trips"))


# --- smoothing until peaks part, ways of pixels, masks and drawings -------------------------------------

_PLACES = "list_transform(range(-23, 23), lambda i: (i + n) % n)"
_PEAKS = "list_filter({places}, lambda j: ({x}) > ({a}) AND ({a}) > 0 AND ({x}) > ({b}) AND ({b}) > 0)".format(places=_PLACES, x=_sql_at("j", True), a=_sql_at("(j + 1)", True), b=_sql_at("(j - 1)", True))
_ONCE = _sql_blur(True).split("list_transform(range(0, n)", 1)[1].rsplit(" AS blurred", 1)[0].replace("round(", "(").replace(", 6)", ")")
_ONCE = "list_transform(range(0, n)" + _ONCE


@query(
    f"""WITH RECURSIVE {_E}, r(vec_id, n, k, p, done) AS (SELECT vec_id, n, 0, {_ONCE}, FALSE FROM v
 UNION ALL SELECT vec_id, n, k + 1, p, len(c) < 2 OR list_min(list_transform(range(1, len(c) + 1), lambda i: least(abs(c[i] - c[CASE WHEN i = 1 THEN len(c) ELSE i - 1 END]), n - abs(c[i] - c[CASE WHEN i = 1 THEN len(c) ELSE i - 1 END])))) > 4
  FROM (SELECT *, {_PEAKS} AS c FROM (SELECT vec_id, n, k, {_ONCE} AS p FROM r WHERE NOT done AND k < 11)))
SELECT vec_id, list_transform(arg_max(p, k), lambda x: round(x, 6)) AS blurred FROM r GROUP BY vec_id"""
)
def blur_until_apart(spark, sf_dir):
    """Vectors smoothed on the circle until their peaks are more than four places apart."""
    return _vectors(spark, sf_dir).select("vec_id", F.transform(V.blur_apart(F.col("e")), lambda x: F.round(x, 6)).alias("blurred"))


_WAYS = [(0, 150, 200, 180, 200), (1, 150, 200, 150, 260), (2, 10, 10, 20, 20), (3, 150, 200, 250, 200), (4, 151, 201, 150, 200), (5, 150, 200, 190, 240)]
_WAY_SCHEMA = "qid INT, row INT, col INT, row2 INT, col2 INT"


@query(
    "WITH px AS (SELECT row, col FROM ("
    + SQL["segment_dda_raster"]
    + ")), "
    + sql_values(_WAYS, _WAY_SCHEMA, "req")
    + """, f AS (WITH RECURSIVE f(qid, row, col) AS (SELECT qid, px.row, px.col FROM req JOIN px ON abs(px.row - req.row) <= 1 AND abs(px.col - req.col) <= 1
 UNION SELECT f.qid, px.row, px.col FROM f JOIN px ON abs(px.row - f.row) <= 1 AND abs(px.col - f.col) <= 1 JOIN req ON req.qid = f.qid WHERE (px.row - req.row) * (px.row - req.row) + (px.col - req.col) * (px.col - req.col) <= 6400) SELECT * FROM f)
SELECT qid, EXISTS (SELECT 1 FROM f WHERE f.qid = req.qid AND (f.row - row2) * (f.row - row2) + (f.col - col2) * (f.col - col2) <= 144) AS linked FROM req"""
)
def pixel_links(spark, sf_dir):
    """Whether the pixels that trips touch lead from one place to another."""
    density = raster.region_density(samples(spark, sf_dir).withColumn("idx", F.expr("idx div 5")), _REGION, 300, 400)
    return raster.pixels_linked(density, values(spark, _WAYS, _WAY_SCHEMA))


_A, _B, _C, _D = _REGION


@query(
    W
    + f"""placed AS (SELECT trip_id, idx, CASE WHEN lat BETWEEN {_A}e0 AND {_C}e0 AND lon BETWEEN {_B}e0 AND {_D}e0 THEN CAST(trunc((1e0 - (lat - {_A}e0) / ({_C}e0 - {_A}e0)) * 30e0) AS INT) * 40 + CAST(trunc((lon - ({_B}e0)) / ({_D}e0 - ({_B}e0)) * 40e0) AS INT) END AS place FROM samples)
SELECT trip_id, idx, CAST(CASE WHEN place BETWEEN 0 AND 1199 THEN place * 7 % 5 ELSE 0 END AS INT) AS value FROM placed"""
)
def masked_samples(spark, sf_dir):
    """What a mask says at each sample."""
    mask = spark.range(1200).select(F.expr("id div 40").cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"), (F.col("id") * 7 % 5).cast("int").alias("value"))
    return raster.mask_values(samples(spark, sf_dir).select("trip_id", "idx", "lat", "lon"), mask, _REGION, 30, 40).select("trip_id", "idx", "value")


@query(
    G
    + """, b AS (SELECT min(lat) AS a, max(lat) AS c, min(lon) AS b, max(lon) AS d FROM v),
k AS (SELECT a - (c - a) * 0.1e0 AS la, b - (d - b) * 0.1e0 AS lo, 111111e0 / 100 AS ky, 111111e0 * cos(radians(a)) / 100 AS kx FROM b),
p AS (SELECT DISTINCT CAST(trunc((lat - la) * ky) AS INT) AS row, CAST(trunc((lon - lo) * kx) AS INT) AS col FROM v, k),
o AS (SELECT y, x FROM (SELECT unnest(range(-3, 4)) AS y), (SELECT unnest(range(-3, 4)) AS x) WHERE y * y + x * x <= 9)
SELECT DISTINCT CAST(row + y AS INT) AS row, CAST(col + x AS INT) AS col FROM p, o"""
)
def vertex_discs(spark, sf_dir):
    """The pixels of a drawing's vertices, 100 metres a pixel."""
    v, _ = road_graph(spark, sf_dir)
    return graphs.vertex_pixels(v, 100.0)
