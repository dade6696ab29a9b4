"""Registered queries on road graphs, over a graph made from the orders of each customer.

A customer's orders, in order of their keys, are the vertices of a small road
network: each but the first hangs on the one at half its place, every third on
the one three places before as well, and every sixth edge is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import cluster, graph
from .queries import SQL, query, samples, table
from .sources import graphs

G = """WITH RECURSIVE g AS (SELECT o_orderkey AS id, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
v AS (SELECT id, c, k, 42e0 + (c % 50) * 1e-2 + k * 2e-4 AS lat, -71e0 - (c // 50) * 1e-2 + ((k * k) % 7) * 1e-4 AS lon, CAST(k % 4 AS DOUBLE) AS score, k % 5 = 0 AS terminate FROM g),
e AS (SELECT b.id * 4 AS id, a.id AS src, b.id AS dst, CAST(b.k % 3 AS DOUBLE) AS score FROM g a JOIN g b ON a.c = b.c AND a.k = b.k // 2
 UNION ALL SELECT b.id * 4 + 1, a.id, b.id, 2e0 FROM g a JOIN g b ON a.c = b.c AND a.k = b.k - 3 WHERE b.k % 3 = 0
 UNION ALL SELECT b.id * 4 + 2, a.id, b.id, 5e0 FROM g a JOIN g b ON a.c = b.c AND a.k = b.k // 2 WHERE b.k % 6 = 0),
u AS (SELECT id, src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY id) AS r FROM e) t WHERE r = 1),
nb AS (SELECT src AS id, dst AS other FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
deg AS (SELECT v.id, (SELECT count(*) FROM nb WHERE nb.id = v.id) AS n_neighbours, (SELECT count(DISTINCT dst) FROM e WHERE e.src = v.id) AS n_out, (SELECT count(DISTINCT src) FROM e WHERE e.dst = v.id) AS n_in FROM v)
"""
_LENGTH = "l AS (SELECT u.*, sqrt(pow(a.lat - b.lat, 2) + pow((a.lon - b.lon) / cos(radians(a.lat)), 2)) AS length FROM u JOIN v a ON a.id = u.src JOIN v b ON b.id = u.dst)"


def road_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The graph's vertices (id, c, k, lat, lon, score, terminate) and edges (id, src, dst, score)."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    g = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), k.alias("k"))
    lat = F.lit(42.0) + F.pmod("c", F.lit(50)) * F.lit(1e-2) + F.col("k") * F.lit(2e-4)
    lon = F.lit(-71.0) - F.expr("c div 50") * F.lit(1e-2) + (F.col("k") * F.col("k")) % 7 * F.lit(1e-4)
    v = g.select("id", "c", "k", lat.alias("lat"), lon.alias("lon"), (F.col("k") % 4).cast("double").alias("score"), (F.col("k") % 5 == 0).alias("terminate"))
    b = g.select("c", F.col("k").alias("bk"), F.col("id").alias("dst"))

    def edges(up, keep, plus, score):
        down = b.filter(keep).withColumn("k", up)
        return g.select("c", "k", F.col("id").alias("src")).join(down, ["c", "k"]).select((F.col("dst") * 4 + plus).alias("id"), "src", "dst", score.cast("double").alias("score"))

    half, back = F.expr("bk div 2"), F.col("bk") - 3
    e = edges(half, F.lit(True), 0, F.col("bk") % 3).unionByName(edges(back, F.col("bk") % 3 == 0, 1, F.lit(2.0))).unionByName(edges(half, F.col("bk") % 6 == 0, 2, F.lit(5.0)))
    return v, e


@query(G + "SELECT id, src, dst, score FROM u")
def edge_dedup(spark, sf_dir):
    """One edge of each pair."""
    return graph.dedupe_edges(road_graph(spark, sf_dir)[1])


@query(G + "SELECT id, n_neighbours, n_out, n_in FROM deg")
def degree(spark, sf_dir):
    """Neighbours, ways out and ways in of each vertex."""
    v, e = road_graph(spark, sf_dir)
    return graph.degrees(e, v)


_GONE = ", gone AS (SELECT deg.id FROM deg JOIN v USING (id) WHERE (n_neighbours = 1 OR n_out = 0 OR n_in = 0) AND NOT terminate)"


@query(G + _GONE + " SELECT id, src, dst, score FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def dead_end_prune(spark, sf_dir):
    """Edges that stay when dead ends are taken away once."""
    v, e = road_graph(spark, sf_dir)
    return graph.remove_dead_ends(v, e)[1]


@query(G + ", a AS (SELECT id AS id_ FROM v WHERE score <= 1) SELECT id, src, dst, score FROM e WHERE NOT (score <= 1 AND src IN (SELECT id_ FROM a) AND dst IN (SELECT id_ FROM a))")
def weak_edge_prune(spark, sf_dir):
    """Edges that stay when weak ones between weak vertices go."""
    v, e = road_graph(spark, sf_dir)
    return graph.remove_weak_edges(e, v, 1.0)


@query(G + ", f AS (SELECT c, min(id) AS component, count(*) AS size FROM v WHERE k > 1 OR c IN (SELECT c FROM v WHERE k > 1) GROUP BY c) SELECT v.id, coalesce(f.component, v.id) AS component, coalesce(f.size, 1) AS size FROM v LEFT JOIN f USING (c)")
def connected_components(spark, sf_dir):
    """The component of each vertex (a customer's network hangs together)."""
    return graph.components(*road_graph(spark, sf_dir))


@query(SQL["connected_components"])
def connected_components_by_stars(spark, sf_dir):
    """The same by the steps that larger graphs take."""
    return graph.components(*road_graph(spark, sf_dir), local=0)


@query(G + ", big AS (SELECT c FROM v GROUP BY c HAVING count(*) >= 12) SELECT id, k FROM v WHERE c IN (SELECT c FROM big)")
def small_component_prune(spark, sf_dir):
    """Vertices of components of at least 12."""
    return graph.remove_small_components(*road_graph(spark, sf_dir), least=12)[0].select("id", "k")


def _sources(v: DataFrame) -> DataFrame:
    return v.filter("k = 1").select("id")


_WALK = f""", {_LENGTH}, walk(source, id, distance) AS (SELECT id, id, 0e0 FROM v WHERE k = 1 UNION SELECT w.source, l.dst, w.distance + l.length FROM walk w JOIN l ON l.src = w.id),
sp AS (SELECT source, id, min(distance) AS distance FROM walk GROUP BY source, id)"""


def _distances(spark, sf_dir):
    v, e = road_graph(spark, sf_dir)
    lengths = graph.lengths(graph.dedupe_edges(e), v, stretched=True).select("src", "dst", "length")
    return graph.shortest_paths(lengths, _sources(v)), v


@query(G + _WALK + " SELECT source, id, round(distance, 9) AS distance FROM sp")
def sssp(spark, sf_dir):
    """Shortest distances from every network's first vertex."""
    d, _ = _distances(spark, sf_dir)
    return d.select("source", "id", F.round("distance", 9).alias("distance"))


_USE = """, bef AS (SELECT source, id, src FROM (SELECT s.source, s.id, l.src, row_number() OVER (PARTITION BY s.source, s.id ORDER BY p.distance + l.length, l.src) AS r FROM sp s JOIN l ON l.dst = s.id JOIN sp p ON p.source = s.source AND p.id = l.src) t WHERE r = 1),
trail(source, target, src, dst) AS (SELECT b.source, b.id, b.src, b.id FROM bef b JOIN v ON v.id = b.id WHERE v.terminate UNION ALL SELECT t.source, t.target, b.src, b.id FROM trail t JOIN bef b ON b.source = t.source AND b.id = t.src)"""


@query(G + _WALK + _USE + " SELECT src, dst, count(*) AS n_paths FROM trail GROUP BY src, dst")
def edge_usage(spark, sf_dir):
    """How many shortest paths to terminals use each edge."""
    d, v = _distances(spark, sf_dir)
    return graph.edge_usage(graph.paths_to(d, v.filter("terminate").select("id")))[0]


@query(G + _WALK + _USE + ", n AS (SELECT src, dst, count(*) AS n FROM trail GROUP BY src, dst), x AS (SELECT src AS id, n FROM n UNION ALL SELECT dst, n FROM n) SELECT id, max(n) AS score FROM x GROUP BY id")
def vertex_usage(spark, sf_dir):
    """Each vertex's greatest use by such paths."""
    d, v = _distances(spark, sf_dir)
    return graph.edge_usage(graph.paths_to(d, v.filter("terminate").select("id")))[1]


@query()
def marble_walk(spark, sf_dir):
    """Points every 0.0001 degrees on edges near the first vertices."""
    v, e = road_graph(spark, sf_dir)
    return graph.marbles(v.withColumn("score", F.col("score") + 1), e.withColumn("score", F.col("score") + 1), _sources(v), 0.0001, 0.001)


@query(G + "SELECT id, src, dst, score FROM e UNION ALL SELECT -id - 1, dst, src, score FROM e")
def reverse_bidirection_edges(spark, sf_dir):
    """Every edge and its reverse."""
    return graph.both_ways(road_graph(spark, sf_dir)[1])


_MERGES = """, m AS (SELECT b.id, CASE WHEN b.k % 4 = 1 THEN b.id ELSE a.id END AS to_ FROM g b LEFT JOIN g a ON a.c = b.c AND a.k = b.k - 1),
chain(id, last_) AS (SELECT id, to_ FROM m UNION SELECT c.id, m.to_ FROM chain c JOIN m ON m.id = c.last_),
ends AS (SELECT c.id, c.last_ AS target FROM chain c JOIN m ON m.id = c.last_ WHERE m.to_ = m.id)"""


def _merges(v: DataFrame) -> DataFrame:
    """Each vertex points to the one before it, but for every fourth, which points to itself."""
    before = v.select("c", (F.col("k") + 1).alias("k"), F.col("id").alias("before"))
    return v.join(before, ["c", "k"], "left").select("id", F.when(F.col("k") % 4 == 1, F.col("id")).otherwise(F.col("before")).alias("to"))


@query(G + _MERGES + " SELECT id, target FROM ends")
def merge_chain_resolve(spark, sf_dir):
    """Where chains of merges end."""
    return graph.resolve_chains(_merges(road_graph(spark, sf_dir)[0]))


@query(G + _MERGES + """, r AS (SELECT e.id, a.target AS src, b.target AS dst FROM e JOIN ends a ON a.id = e.src JOIN ends b ON b.id = e.dst WHERE a.target <> b.target)
SELECT min(id) AS id, src, dst FROM r GROUP BY src, dst""")
def merge_relabel(spark, sf_dir):
    """Edges after chains of vertices have been merged."""
    v, e = road_graph(spark, sf_dir)
    return graph.relabel(v.drop("terminate"), e, graph.resolve_chains(_merges(v)))[1].select("id", "src", "dst")


@query(G + ", a AS (SELECT *, 0 AS gg FROM e WHERE score < 2), b AS (SELECT *, 1 AS gg FROM e WHERE score >= 1), ab AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT id, src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY gg, id) AS r FROM ab) t WHERE r = 1")
def graph_union(spark, sf_dir):
    """The union of two graphs, one edge of each pair."""
    e = road_graph(spark, sf_dir)[1]
    return graph.graph_union(e.filter("score < 2"), e.filter("score >= 1"))


@query(G + """SELECT 'vertex' AS kind, id AS a, CAST(-1 AS BIGINT) AS b, '"' || id || '":[' || printf('%.6f', lat) || ',' || printf('%.6f', lon) || ']' AS text FROM v UNION ALL SELECT 'edge', src, dst, '["' || src || '","' || dst || '"]' FROM e WHERE src <> dst""")
def graph_json(spark, sf_dir):
    """The members of the graph's JSON form."""
    return graphs.graph_rows(*road_graph(spark, sf_dir))


@query(G + """SELECT e.id, '{"type":"Feature","properties":{"id":' || e.id || ',"type":"residential"},"geometry":{"type":"LineString","coordinates":[[' || printf('%.6f', a.lon) || ',' || printf('%.6f', a.lat) || '],[' || printf('%.6f', b.lon) || ',' || printf('%.6f', b.lat) || ']]}}' AS feature
FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst WHERE a.lat BETWEEN 42.1 AND 42.4 AND b.lat BETWEEN 42.1 AND 42.4 AND a.lon BETWEEN -71.2 AND -71.0 AND b.lon BETWEEN -71.2 AND -71.0""")
def graph_geojson(spark, sf_dir):
    """GeoJSON features of the edges in a region."""
    v, e = road_graph(spark, sf_dir)
    return graphs.edge_features(e, v, (42.1, -71.2, 42.4, -71.0))


_SHAPES = ", s AS (SELECT u.id, a.c, u.src, u.dst, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM u JOIN v a ON a.id = u.src JOIN v b ON b.id = u.dst)"


@query(G + _SHAPES + """, p AS (SELECT a.id AS id1, b.id AS id2, a.lat1 AS ax, a.lon1 AS ay, a.lat2 AS bx, a.lon2 AS by_, b.lat1 AS cx, b.lon1 AS cy, b.lat2 AS dx, b.lon2 AS dy FROM s a JOIN s b ON a.c = b.c AND a.id < b.id WHERE a.src <> b.src AND a.src <> b.dst AND a.dst <> b.src AND a.dst <> b.dst)
SELECT id1, id2 FROM p WHERE ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * ((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) < 0 AND ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * ((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) < 0""")
def segment_crossing(spark, sf_dir):
    """Pairs of edges that cross (networks lie apart, so pairs are within one)."""
    v, e = road_graph(spark, sf_dir)
    return graph.crossings(graph.dedupe_edges(e), v).select("id1", "id2")


@query()
def nearest_edge(spark, sf_dir):
    """The nearest parallel edge of each edge."""
    v, e = road_graph(spark, sf_dir)
    return graph.parallel_edges(graph.dedupe_edges(e), v, 0.0, 0.001).select("id", "other", F.round("distance", 8).alias("distance"))


@query(G + """, t AS (SELECT nb.id, count(*) AS n, max(other) AS from_ FROM nb GROUP BY nb.id HAVING count(*) = 1),
d AS (SELECT t.id, x.c, x.lat AS lat1, x.lon AS lon1, y.lat AS lat0, y.lon AS lon0 FROM t JOIN v x ON x.id = t.id JOIN v y ON y.id = t.from_),
q AS (SELECT a.id AS src, b.id AS dst, a.lat0 AS x0, a.lon0 AS y0, a.lat1 AS x1, a.lon1 AS y1, b.lat1 AS x2, b.lon1 AS y2, b.lat0 AS x3, b.lon0 AS y3, a.lat1 AS la FROM d a JOIN d b ON a.c = b.c AND a.id <> b.id WHERE abs(a.lat1 - b.lat1) <= 0.0035e0 AND abs(a.lon1 - b.lon1) <= 0.0035e0 / cos(radians(a.lat1))),
n1 AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow((y1 - y0) * cos(radians(40e0)), 2)) AS m1, sqrt(pow(x2 - x1, 2) + pow((y2 - y1) * cos(radians(40e0)), 2)) AS m2, sqrt(pow(x3 - x2, 2) + pow((y3 - y2) * cos(radians(40e0)), 2)) AS m3 FROM q),
k AS (SELECT src, dst, sqrt(pow(x1 - x2, 2) + pow((y1 - y2) * cos(x1 / 360e0 * (3.1415926e0 * 2e0)), 2)) AS distance FROM n1 WHERE sqrt(pow((x1 - x0) / m1 - (x2 - x1) / m2, 2) + pow((y1 - y0) / m1 - (y2 - y1) / m2, 2)) < 1.4 AND sqrt(pow((x2 - x1) / m2 - (x3 - x2) / m3, 2) + pow((y2 - y1) / m2 - (y3 - y2) / m3, 2)) < 1.4)
SELECT src, dst, round(distance, 8) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(distance, 12), dst) AS r FROM k) t WHERE r = 1""")
def dead_end_links(spark, sf_dir):
    """For each dead end the nearest one straight ahead."""
    v, e = road_graph(spark, sf_dir)
    return graph.dead_end_links(v, e, 0.0035).select("src", "dst", F.round("distance", 8).alias("distance"))


@query(G + ", p AS (SELECT a.src AS start, a.src AS s1, a.dst AS s2, b.dst AS s3, c.dst AS s4 FROM u a JOIN u b ON b.src = a.dst AND b.dst <> a.src JOIN u c ON c.src = b.dst AND c.dst <> b.src JOIN v ON v.id = a.src WHERE v.k = 1) SELECT start, [s1, s2, s3, s4] AS path FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY s1, s2, s3, s4) AS r FROM p) t WHERE r <= 41")
def simple_paths(spark, sf_dir):
    """Paths of four vertices from each network's first."""
    v, e = road_graph(spark, sf_dir)
    return graph.simple_paths(graph.dedupe_edges(e), _sources(v), 4)


@query()
def kmeans_fixed_iter(spark, sf_dir):
    """Four centres of all samples."""
    points = samples(spark, sf_dir).select((F.col("trip_id") * 1_000_000 + F.col("idx")).alias("pid"), "lat", "lon")
    return cluster.kmeans(points, 4, 10).select("cluster", "n", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.round("distance", 9).alias("distance"))


@query()
def explore_invariants(spark, sf_dir):
    """An exploration of the crossing from its four arms, to the region's border: each tree's size, and whether what must hold of every node does."""
    from .operators.trace import TraceDataset
    from .plans.explore import Forest
    from .queries import dense
    from .operators.grid import with_cells
    from .sources.config import Config, Entrance
    from .storage import save

    arms = [(42.3497, -71.1, 0.0), (42.35, -71.1004, 90.0), (42.3503, -71.1, 180.0), (42.35, -71.0996, 270.0)]
    config = Config([Entrance(a, b, i, h) for i, (a, b, h) in enumerate(arms)], region=(42.3493, -71.1009, 42.3507, -71.0991), least_trips=2)
    forest = Forest(TraceDataset(save(with_cells(dense(spark, sf_dir)), "samples")), config)
    forest.explore()
    nodes = forest.table()
    parents = nodes.select("tree", F.col("node").alias("parent"), F.col("lat").alias("plat"), F.col("lon").alias("plon"), F.col("depth").alias("pdepth"))
    rows = nodes.join(parents, ["tree", "parent"])
    away = F.sqrt(F.pow(F.col("lat") - F.col("plat"), 2) + F.pow((F.col("lon") - F.col("plon")) * F.cos(F.radians("plat")), 2))
    ok = (F.col("node") == F.col("parent")) | ((F.col("parent") < F.col("node")) & (F.col("depth") == F.col("pdepth") + 1) & (F.abs(away - 0.000075) < 1e-9))
    return rows.groupBy("tree").agg(F.count("*").alias("n_nodes"), F.bool_and(ok).alias("grown_by_steps"), F.bool_and(~F.col("outside") | F.col("removed")).alias("inside"))
