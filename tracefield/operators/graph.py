"""Road graphs as two tables: vertices (id, key, lat, lon, score, terminate) and edges (id, src, dst, score).

Operators use the columns that they need and keep no state; what several of
them delete one by one is a join here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.components import SHARES, connected_components
from ..storage import save
from .grid import segment_pairs

# Metres to both sides of a parallel pair's middle; bounds of angles; reach of dead ends and their chord test.
WINDOW_METERS, SAME, OPPOSITE = 12.5, 0.1, 1.9
DEAD_END_REACH, CHORD = 0.0005, 1.4
#: Degrees by which boxes are widened, so that rounding loses no pair that the exact test admits.
SLACK = 1e-9
NEAR_ROAD = 0.00035
MERGED_SCORE = 10.0
#: Rounds of shortest paths after which outdated labels are dropped.
COMPACT = 8


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge, and its reverse under the negative id after it (-id - 1)."""
    return edges.unionByName(edges.select(*((-F.col("id") - 1).alias("id") if c == "id" else F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns)))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(*(F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns))


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair (src, dst): that of the least id."""
    first = Window.partitionBy("src", "dst").orderBy("id")
    return edges.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def neighbours(edges: DataFrame) -> DataFrame:
    """Distinct (id, other), in both directions, without self-loops."""
    pair = lambda a, b: edges.select(F.col(a).alias("id"), F.col(b).alias("other"))
    return pair("src", "dst").unionByName(pair("dst", "src")).filter("id <> other").distinct()


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """id, n_neighbours, n_out and n_in; with ``vertices`` isolated ones too."""
    n = neighbours(edges).groupBy("id").agg(F.count("*").alias("n_neighbours"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n_in"))
    base = out.join(into, "id", "full_outer") if vertices is None else vertices.select("id").join(out, "id", "left").join(into, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return base.join(n, "id", "left").select("id", *(zero(c) for c in ("n_neighbours", "n_out", "n_in")))


def remove_vertices(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the vertices of ``gone`` (id) and their edges."""
    gone = gone.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return vertices.join(gone, "id", "left_anti"), left.select(*edges.columns)


def dead_ends(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with one neighbour, or without a way in or out, that are not marked to be kept (terminate)."""
    d = degrees(edges, vertices)
    keep = vertices.filter(F.coalesce(F.col("terminate"), F.lit(False))).select("id") if "terminate" in vertices.columns else None
    out = d.filter("n_neighbours = 1 or n_out = 0 or n_in = 0").select("id")
    return out if keep is None else out.join(keep, "id", "left_anti")


def remove_dead_ends(vertices: DataFrame, edges: DataFrame, rounds: int = 1) -> tuple[DataFrame, DataFrame]:
    """Take dead ends away, ``rounds`` times (0: until there are none)."""
    k = 0
    while rounds == 0 or k < rounds:
        gone = dead_ends(vertices, edges)
        if rounds == 0 and gone.limit(1).count() == 0:
            break
        vertices, edges = remove_vertices(vertices, edges, gone)
        if rounds != 1:
            vertices, edges = save(vertices, "vertices"), save(edges, "edges")
        k += 1
    return vertices, edges


def remove_weak_edges(edges: DataFrame, vertices: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Edges, without those whose score and both of whose ends' scores are at most the threshold."""
    score = vertices.select("id", F.col("score").alias("_s"))
    rows = edges.join(score.select(F.col("id").alias("src"), F.col("_s").alias("_a")), "src", "left").join(score.select(F.col("id").alias("dst"), F.col("_s").alias("_b")), "dst", "left")
    weak = (F.col("score") <= threshold) & (F.coalesce("_a", F.lit(0.0)) <= threshold) & (F.coalesce("_b", F.lit(0.0)) <= threshold)
    return rows.filter(~F.coalesce(weak, F.lit(False))).select(*edges.columns)


def components(vertices: DataFrame, edges: DataFrame, **how) -> DataFrame:
    """id, component (the least id reachable in any direction) and its size; one component may hold most vertices, so each is dealt over groups."""
    known = connected_components(edges.select("src", "dst"), **how)
    labelled = vertices.select("id").join(known.withColumnRenamed("vertex", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    dealt = labelled.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)))
    parts = dealt.groupBy("component", "share").agg(F.count("*").alias("n"))
    sizes = parts.select("component", "share").join(parts.groupBy("component").agg(F.sum("n").alias("size")), "component")
    return dealt.join(sizes, ["component", "share"]).select("id", "component", "size")


def remove_small_components(vertices: DataFrame, edges: DataFrame, least: int = 20) -> tuple[DataFrame, DataFrame]:
    return remove_vertices(vertices, edges, components(vertices, edges).filter(F.col("size") < least))


def with_ends(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with lat1, lon1, lat2 and lon2."""
    end = lambda c, k: vertices.select(F.col("id").alias(c), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    return edges.join(end("src", 1), "src").join(end("dst", 2), "dst")


def lengths(edges: DataFrame, vertices: DataFrame, stretched: bool = False) -> DataFrame:
    """Edges with ``length``: distances; ``stretched`` divides longitudes by the cosine, as shortest paths weigh them."""
    lon = F.col("lon1") - F.col("lon2")
    k = F.cos(F.radians("lat1"))
    dx, dy = F.col("lat1") - F.col("lat2"), lon / k if stretched else lon * k
    return with_ends(edges, vertices).withColumn("length", F.sqrt(dx * dx + dy * dy))


def shortest_paths(edges: DataFrame, sources: DataFrame, limit: int = 100_000, bound: float | None = None) -> DataFrame:
    """Distances along edges (src, dst, length) from every source (id): source, id, distance and before (the vertex before it; null at the source).

    Labels are corrected round by round: only vertices that came nearer in the
    last round are extended, and only what they reach is compared with the
    labels so far. Nearer labels are added to these; every few rounds the
    outdated ones are dropped. Equal distances go to the least vertex before.
    ``bound``: no path goes beyond this distance.
    """
    hop = edges.select(F.col("src").alias("id"), F.col("dst").alias("next"), "length")
    front = save(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("before")).distinct(), "distances")
    labels = [front]
    together = lambda: reduce(DataFrame.unionByName, labels)
    nearest = lambda rows: rows.groupBy("source", "id").agg(F.min(F.struct("distance", "before")).alias("m")).select("source", "id", "m.*")
    for _ in range(limit):
        step = front.join(hop, "id").select("source", F.col("next").alias("id"), (F.col("distance") + F.col("length")).alias("distance"), F.col("id").alias("before"))
        if bound is not None:
            step = step.filter(F.col("distance") <= bound)
        # A label so far that is no farther stands in the way.
        known = together().select("source", "id", F.col("distance").alias("had"))
        best = nearest(step)
        front = save(best.join(known, (best["source"] == known["source"]) & (best["id"] == known["id"]) & (known["had"] <= best["distance"]), "left_anti"), "nearer")
        if front.limit(1).count() == 0:
            break
        labels.append(front)
        if len(labels) > COMPACT:
            labels = [save(nearest(together()), "distances")]
    return nearest(together())


def paths_to(distances: DataFrame, targets: DataFrame) -> DataFrame:
    """The edges of the shortest paths to targets (id; or source, id): source, target, src, dst and hop counted from the target."""
    on = [c for c in ("source", "id") if c in targets.columns]
    now = distances.join(targets.select(*on).distinct(), on).filter("before is not null").select("source", F.col("id").alias("target"), F.col("before").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("hop"))
    back = distances.filter("before is not null").select("source", F.col("id").alias("src"), F.col("before").alias("up"))
    out = now = save(now, "trail")
    while True:
        now = save(now.join(back, ["source", "src"]).select("source", "target", F.col("up").alias("src"), F.col("src").alias("dst"), (F.col("hop") + 1).alias("hop")), "trail")
        if now.limit(1).count() == 0:
            return out
        out = out.unionByName(now)


def edge_usage(trails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many paths use each edge (src, dst, n_paths), and each vertex's greatest use (id, score)."""
    edges = trails.groupBy("src", "dst").agg(F.count("*").alias("n_paths"))
    ends = edges.select(F.col("src").alias("id"), "n_paths").unionByName(edges.select(F.col("dst").alias("id"), "n_paths"))
    return edges, ends.groupBy("id").agg(F.max("n_paths").alias("score"))


def locations(trails: DataFrame, every: int = 20) -> DataFrame:
    """Vertices on paths whose id is a multiple of ``every``, and all ends of paths."""
    on = trails.select(F.explode(F.array("src", "dst")).alias("id")).filter(F.pmod(F.col("id"), F.lit(every)) == 0)
    return on.unionByName(trails.select(F.col("source").alias("id"))).unionByName(trails.select(F.col("target").alias("id"))).distinct()


def simple_paths(edges: DataFrame, starts: DataFrame, length: int = 6, limit: int = 41) -> DataFrame:
    """Paths of ``length`` vertices from each start (id) that never go straight back, at most ``limit`` a start in order of their vertices: start and path."""
    hop = edges.select(F.col("src").alias("last"), F.col("dst").alias("next"))
    # Edges after which as many more can follow: every beginning that is kept can be finished,
    # so that the first ones of each hop have the first paths in them.
    ways = [hop]
    for _ in range(length - 2):
        more = ways[-1].select(F.col("last").alias("_via"), F.col("next").alias("_to"))
        ways.append(save(hop.join(more, (F.col("next") == F.col("_via")) & (F.col("last") != F.col("_to")), "left_semi"), "ways"))
    now = starts.select(F.col("id").alias("start"), F.array("id").alias("path"))
    rank = F.row_number().over(Window.partitionBy("start").orderBy("path"))
    for k in range(1, length):
        now = now.withColumn("last", F.element_at("path", -1)).join(ways[length - 1 - k], "last")
        if k > 1:
            now = now.filter(F.col("next") != F.element_at("path", -2))
        now = now.select("start", F.array_append("path", F.col("next")).alias("path"))
        now = now.withColumn("_k", rank).filter(F.col("_k") <= limit).drop("_k")
    return now


def resolve_chains(merges: DataFrame, limit: int = 60) -> DataFrame:
    """Where pointers (id, to) end: id and target, by pointer jumping. A pointer to itself ends a chain; a cycle ends at its least member."""
    now = save(merges.select("id", "to"), "chain")
    for _ in range(limit):
        far = now.select(F.col("id").alias("to"), F.col("to").alias("next"))
        jumped = save(now.join(far, "to", "left").select("id", F.coalesce("next", "to").alias("to"), "to").toDF("id", "to", "old"), "chain")
        if jumped.filter("to <> old").limit(1).count() == 0:
            return jumped.select("id", F.col("to").alias("target"))
        now = jumped.select("id", "to")
    # What still moves goes round a cycle.
    rings = connected_components(merges.select("id", "to"))
    moving = jumped.filter("to <> old").select("id").join(rings, F.col("id") == F.col("vertex")).select("id", F.col("component").alias("target"))
    return jumped.filter("to = old").select("id", F.col("to").alias("target")).unionByName(moving)


def relabel(vertices: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge vertices into others (id, target): a target lies at the mean of all that it stands for; edges move to it, self-loops go, one edge of each pair stays (the least id; ``MERGED_SCORE`` where it moved)."""
    to = merges.select("id", "target")
    named = vertices.join(to, "id", "left").withColumn("id", F.coalesce("target", "id"))
    others = [c for c in vertices.columns if c not in ("id", "lat", "lon")]
    v = named.groupBy("id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), *((F.bool_or(c) if c == "terminate" else F.max(c)).alias(c) for c in others)).select(*vertices.columns)
    e = edges
    for c in ("src", "dst"):
        e = e.join(to.select(F.col("id").alias(c), F.col("target").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c))
    if "score" in edges.columns:
        e = e.withColumn("score", F.when(F.col("_src").isNotNull() | F.col("_dst").isNotNull(), F.lit(MERGED_SCORE)).otherwise(F.col("score")))
    return v, dedupe_edges(e.filter("src <> dst").select(*edges.columns))


def graph_union(edges_a: DataFrame, edges_b: DataFrame) -> DataFrame:
    """Edges of both graphs, one for each pair; a's come first."""
    both = edges_a.withColumn("_g", F.lit(0)).unionByName(edges_b.withColumn("_g", F.lit(1)))
    first = Window.partitionBy("src", "dst").orderBy("_g", "id")
    return both.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "_g")


def marbles(vertices: DataFrame, edges: DataFrame, starts: DataFrame, step: float = 0.00005, reach: float = 0.003, directed: bool = False) -> DataFrame:
    """Points every ``step`` along all edges within ``reach`` of each start (id): start, lat and lon.

    Only edges and next vertices with a score above 0 are walked. Places are
    measured along the shortest way to the edge's nearer end; one way is not
    walked straight back.
    """
    e = lengths(edges if directed else both_ways(edges), vertices)
    alive = vertices.filter("score > 0").select(F.col("id").alias("dst"))
    e = dedupe_edges(e.filter("score > 0")).join(alive, "dst").select("src", "dst", "length", "lat1", "lon1", "lat2", "lon2")
    near = shortest_paths(e, starts, bound=reach)
    rows = near.join(e, near["id"] == e["src"]).filter(F.col("before").isNull() | (F.col("dst") != F.col("before"))).filter("length > 0")
    # Rounded, so that a place which falls on a vertex is not lost or doubled by the last bit.
    first = F.ceil(F.round(F.col("distance") / step, 6)) * step - F.col("distance")
    most = F.least(F.col("length"), reach - F.col("distance"))
    n = F.floor(F.round((most - first) / step, 6)).cast("int")
    rows = rows.withColumn("_first", first).withColumn("_most", most).filter(F.col("_first") < F.col("length")).filter(n >= 0)
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), n)))
    alpha = (F.col("_first") + F.col("_k") * step) / F.col("length")
    rows = rows.filter(alpha < 1 - 1e-9)
    at = lambda c: F.round(geo.lerp(F.col(f"{c}1"), F.col(f"{c}2"), alpha), 8).alias(c)
    return rows.select(F.col("source").alias("start"), at("lat"), at("lon")).distinct()


def _boxes(edges: DataFrame) -> DataFrame:
    return edges.select("*", F.least("lat1", "lat2").alias("lat_min"), F.greatest("lat1", "lat2").alias("lat_max"), F.least("lon1", "lon2").alias("lon_min"), F.greatest("lon1", "lon2").alias("lon_max"))


def _direction(lat1: Column, lon1: Column, lat2: Column, lon2: Column, at: Column) -> Column:
    k = F.cos(F.radians(at))
    n = F.nullif(F.sqrt((lat2 - lat1) * (lat2 - lat1) + (lon2 - lon1) * k * (lon2 - lon1) * k), F.lit(0.0))
    return F.struct(((lat2 - lat1) / n).alias("x"), ((lon2 - lon1) * k / n).alias("y"))


def parallel_edges(edges: DataFrame, vertices: DataFrame, threshold: float = 1.0, reach: float = NEAR_ROAD) -> DataFrame:
    """For each edge the nearest parallel one: id, other and distance, of edges with a score of ``threshold`` or more.

    The other is met at right angles to the edge's middle within ``reach``, and
    points the same or the opposite way.
    """
    e = with_ends(edges.filter(F.col("score") >= threshold), vertices).select("id", "lat1", "lon1", "lat2", "lon2")
    mid_lat, mid_lon = (F.col("lat1") + F.col("lat2")) / 2, (F.col("lon1") + F.col("lon2")) / 2
    own = e.select("id", *(F.col(f"{c}{k}").alias(f"{c}{k}") for k in (1, 2) for c in ("lat", "lon")), mid_lat.alias("lat_min"), mid_lat.alias("lat_max"), mid_lon.alias("lon_min"), mid_lon.alias("lon_max"), mid_lat.alias("mid_lat"), mid_lon.alias("mid_lon"))
    other = _boxes(e.select(F.col("id").alias("other"), "lat1", "lon1", "lat2", "lon2")).select("other", F.col("lat1").alias("a_lat"), F.col("lon1").alias("a_lon"), F.col("lat2").alias("b_lat"), F.col("lon2").alias("b_lon"), "lat_min", "lat_max", "lon_min", "lon_max")
    pairs = segment_pairs(own, other, reach).filter("id <> other")
    c = F.col
    pairs = pairs.withColumn("u", _direction(c("lat1"), c("lon1"), c("lat2"), c("lon2"), c("lat2"))).withColumn("v", _direction(c("a_lat"), c("a_lon"), c("b_lat"), c("b_lon"), c("lat2")))
    turn = geo.planar(c("u.x"), c("u.y"), c("v.x"), c("v.y"))
    hit = lambda sign: geo.ray_segment(c("mid_lat"), c("mid_lon"), -sign * c("u.y"), sign * c("u.x"), c("a_lat"), c("a_lon"), c("b_lat"), c("b_lon"))
    pairs = pairs.filter((turn <= SAME) | (turn >= OPPOSITE)).withColumn("left", hit(1.0)).withColumn("right", hit(-1.0))
    length = F.when(c("left.ok"), c("left.length")).when(c("right.ok"), c("right.length"))
    pairs = pairs.withColumn("distance", length).filter(F.col("distance") < reach)
    near = F.struct(F.round("distance", 12).alias("near"), F.col("other"), F.col("distance"))
    return pairs.groupBy("id").agg(F.min(near).alias("best")).select("id", "best.other", "best.distance")


def crossings(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs of edges (id1 < id2) that cross, without a common end: id1, id2, lat and lon of the crossing."""
    e = _boxes(with_ends(edges, vertices).select("id", "src", "dst", "lat1", "lon1", "lat2", "lon2"))
    a = e.select(F.col("id").alias("id1"), F.col("src").alias("s1"), F.col("dst").alias("d1"), *(F.col(f"{c}{k}").alias(f"a_{c}{k}") for k in (1, 2) for c in ("lat", "lon")), "lat_min", "lat_max", "lon_min", "lon_max")
    b = e.select(F.col("id").alias("id2"), F.col("src").alias("s2"), F.col("dst").alias("d2"), *(F.col(f"{c}{k}").alias(f"b_{c}{k}") for k in (1, 2) for c in ("lat", "lon")), "lat_min", "lat_max", "lon_min", "lon_max")
    pairs = segment_pairs(a, b, 0.001).filter("id1 < id2 and s1 <> s2 and s1 <> d2 and d1 <> s2 and d1 <> d2")
    point = lambda p, k: (F.col(f"{p}_lat{k}"), F.col(f"{p}_lon{k}"))
    pairs = pairs.filter(geo.segments_cross(point("a", 1), point("a", 2), point("b", 1), point("b", 2)))
    hit = geo.ray_segment(F.col("a_lat1"), F.col("a_lon1"), F.col("a_lat2") - F.col("a_lat1"), F.col("a_lon2") - F.col("a_lon1"), *point("b", 1), *point("b", 2))
    return pairs.withColumn("_hit", hit).select("id1", "id2", F.col("_hit.x").alias("lat"), F.col("_hit.y").alias("lon"))


def turn_requests(crossed: DataFrame, edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The eight turns between each pair of crossing edges as three-point requests over the crossing (qid: id1, id2, turn)."""
    e = with_ends(edges, vertices).select("id", "lat1", "lon1", "lat2", "lon2")
    side = lambda k: e.select(F.col("id").alias(f"id{k}"), F.array(F.struct(F.col("lat1").alias("lat"), F.col("lon1").alias("lon")), F.struct(F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))).alias(f"e{k}"))
    rows = crossed.join(side(1), "id1").join(side(2), "id2")
    turns = [(x, y, i, j) for x, y in ((1, 2), (2, 1)) for i in (0, 1) for j in (0, 1)]
    asked = F.array(*(F.struct(F.lit(k).alias("turn"), F.col(f"e{x}")[i].alias("a"), F.col(f"e{y}")[j].alias("b")) for k, (x, y, i, j) in enumerate(turns)))
    rows = rows.withColumn("t", F.explode(asked))
    points = [c for k, v in ((1, "t.a"), (3, "t.b")) for c in (F.col(f"{v}.lat").alias(f"lat{k}"), F.col(f"{v}.lon").alias(f"lon{k}"))]
    return rows.select(F.struct("id1", "id2", "t.turn").alias("qid"), *points, F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.lit(0.00005).alias("r1"), F.lit(0.00008).alias("r2"), F.lit(0.00005).alias("r3"), F.lit(-1.0).alias("d1"), F.lit(-1.0).alias("d2"))


def dead_end_links(vertices: DataFrame, edges: DataFrame, reach: float = DEAD_END_REACH) -> DataFrame:
    """For each vertex with one neighbour the nearest other such vertex straight ahead: src, dst and distance."""
    one = neighbours(edges).groupBy("id").agg(F.count("*").alias("n"), F.max("other").alias("from")).filter("n = 1")
    at = vertices.select("id", "lat", "lon")
    ends = one.join(at, "id").join(at.select(F.col("id").alias("from"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), "from").select("id", "lat", "lon", "lat0", "lon0")
    k = F.cos(F.radians("lat"))
    box = lambda df, pad: df.withColumn("lat_min", F.col("lat") - pad).withColumn("lat_max", F.col("lat") + pad).withColumn("lon_min", F.col("lon") - F.lit(pad) / k).withColumn("lon_max", F.col("lon") + F.lit(pad) / k)
    other = box(ends, 0.0).select(F.col("id").alias("to"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("lat0").alias("lat3"), F.col("lon0").alias("lon3"), "lat_min", "lat_max", "lon_min", "lon_max")
    # Cells as wide as the box: an end lies in two or three cells each way, whatever the reach.
    pairs = segment_pairs(box(ends, reach).select("id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "lat0", "lon0", "lat_min", "lat_max", "lon_min", "lon_max"), other, SLACK, 2 * reach).filter("id <> to")
    c = F.col
    unit = lambda a, b: geo.unit(c(f"lat{b}") - c(f"lat{a}"), c(f"lon{b}") - c(f"lon{a}"))
    pairs = pairs.withColumn("u", unit(0, 1)).withColumn("v", unit(1, 2)).withColumn("w", unit(2, 3))
    bend = lambda a, b: geo.planar(c(f"{a}.dlat"), c(f"{a}.dlon"), c(f"{b}.dlat"), c(f"{b}.dlon")) < CHORD
    distance = geo.latlon_distance(c("lat1"), c("lon1"), c("lat2"), c("lon2"))
    inside = (F.abs(c("lat2") - c("lat1")) <= reach) & (F.abs(c("lon2") - c("lon1")) <= F.lit(reach) / F.cos(F.radians("lat1")))
    best = pairs.filter(inside & bend("u", "v") & bend("v", "w")).groupBy("id").agg(F.min(F.struct(F.round(distance, 12).alias("near"), "to", distance.alias("distance"))).alias("best"))
    return best.select(F.col("id").alias("src"), F.col("best.to").alias("dst"), "best.distance")


def bridge(vertices_a: DataFrame, edges_a: DataFrame, vertices_b: DataFrame, edges_b: DataFrame, reach: float = DEAD_END_REACH) -> DataFrame:
    """Where dead ends of graph b, prolonged, first hit an edge of a within ``reach``: id (of b), edge (of a), lat, lon and distance.

    What is found is to be confirmed by trips (see ``trace.connected``) before
    the graphs are joined.
    """
    one = neighbours(edges_b).groupBy("id").agg(F.count("*").alias("n"), F.max("other").alias("from")).filter("n = 1")
    at = vertices_b.select("id", "lat", "lon")
    ends = one.join(at, "id").join(at.select(F.col("id").alias("from"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), "from")
    ends = ends.select("id", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), (F.col("lat") - F.col("lat0")).alias("d_lat"), (F.col("lon") - F.col("lon0")).alias("d_lon"), F.col("lat").alias("lat_min"), F.col("lat").alias("lat_max"), F.col("lon").alias("lon_min"), F.col("lon").alias("lon_max"))
    roads = _boxes(with_ends(edges_a, vertices_a).select(F.col("id").alias("edge"), "lat1", "lon1", "lat2", "lon2"))
    c = F.col
    pairs = segment_pairs(ends, roads, 2 * reach)
    hit = geo.ray_segment(c("p_lat"), c("p_lon"), c("d_lat"), c("d_lon"), c("lat1"), c("lon1"), c("lat2"), c("lon2"))
    pairs = pairs.withColumn("_hit", hit).filter("_hit.ok").withColumn("distance", geo.latlon_distance(c("p_lat"), c("p_lon"), c("_hit.x"), c("_hit.y"))).filter(F.col("distance") <= reach)
    best = pairs.groupBy("id").agg(F.min(F.struct(F.round("distance", 9).alias("near"), "edge", "distance", F.col("_hit.x").alias("lat"), F.col("_hit.y").alias("lon"))).alias("best"))
    return best.select("id", "best.edge", "best.lat", "best.lon", "best.distance")


def join_graphs(edges_a: DataFrame, edges_b: DataFrame, bridges: DataFrame) -> DataFrame:
    """The union of both graphs' edges and, for each confirmed bridge (src, dst), an edge both ways."""
    extra = bridges.select("src", "dst").unionByName(bridges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("id", -F.xxhash64("src", "dst")).withColumn("score", F.lit(MERGED_SCORE))
    return graph_union(graph_union(edges_a, edges_b), extra.select(*(c for c in edges_a.columns)))


def smooth(edges: DataFrame, vertices: DataFrame, n: int = 3) -> DataFrame:
    """``n`` points on a Catmull-Rom curve for each edge, bent by the least neighbour before and after it: id, k, lat and lon."""
    before = edges.groupBy(F.col("dst").alias("src")).agg(F.min("src").alias("prev"))
    after = edges.groupBy(F.col("src").alias("dst")).agg(F.min("dst").alias("next"))
    place = lambda c, k: vertices.select(F.col("id").alias(c), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    e = with_ends(edges, vertices).join(before, "src", "left").join(after, "dst", "left").join(place("prev", 0), "prev", "left").join(place("next", 3), "next", "left")
    e = e.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    t = F.col("k") / F.lit(float(n + 1))

    def curve(c: str) -> Column:
        p1, p2 = F.col(f"{c}1"), F.col(f"{c}2")
        p0, p3 = F.coalesce(F.col(f"{c}0"), p1), F.coalesce(F.col(f"{c}3"), p2)
        return (p1 * 2.0 + (p2 - p0) * t + (p0 * 2.0 - p1 * 5.0 + p2 * 4.0 - p3) * t * t + (p1 * 3.0 - p0 - p2 * 3.0 + p3) * t * t * t) / 2.0

    return e.select("id", "k", curve("lat").alias("lat"), curve("lon").alias("lon"))


def combine_similar(vertices: DataFrame, edges: DataFrame, length: int = 6, reach: float = 0.0003, cut: float = 0.00006) -> DataFrame:
    """Vertices to merge because paths from them run alike: id and target (the lesser id), the three nearest others of each considered.

    Chains are resolved, so the result can be given to :func:`relabel`.
    """
    from .similarity import window_similarities

    at = vertices.select("id", "lat", "lon")
    box = lambda df: df.select("*", F.col("lat").alias("lat_min"), F.col("lat").alias("lat_max"), F.col("lon").alias("lon_min"), F.col("lon").alias("lon_max"))
    pairs = segment_pairs(box(at), box(at.select(F.col("id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))).drop("lat", "lon"), reach).filter("other < id")
    pairs = pairs.withColumn("d", geo.latlon_distance(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    near = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))).filter("_k <= 3").select("id", "other")
    one = simple_paths(edges, vertices.select("id"), length, 1)
    point = at.select(F.col("id").alias("v"), "lat", "lon")
    drawn = one.select("start", F.posexplode("path").alias("k", "v")).join(point, "v").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("k", "lat", "lon"))).alias("p"))
    drawn = drawn.select("start", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("path"))
    asked = near.join(drawn.select(F.col("start").alias("id"), F.col("path").alias("path_a")), "id").join(drawn.select(F.col("start").alias("other"), F.col("path").alias("path_b")), "other")
    asked = save(asked.withColumn("pid", F.xxhash64("id", "other")), "alike")
    alike = window_similarities(asked).filter(F.col("similarity") / 32 < cut)
    found = asked.select("pid", "id", "other").join(alike, "pid").groupBy("id").agg(F.min("other").alias("to"))
    return resolve_chains(found)
