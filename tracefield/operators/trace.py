"""Trip queries over indexed samples.

Every query takes a table of requests (keyed by ``qid``) and gives a table of
results; requests without a match are kept. The legs of all requests are laid
over the grid in one join, reduced to each trip's first and last index in each
circle, and joined by request and trip. ``samples`` has trip_id, idx, lat, lon,
clat and clon, and speed_inv where speeds are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .grid import circle_join

# Degrees an index step stands for, the longest visit of a circle in steps,
# the stride of mean paths, and the least speed, least number and reply of speed ranks.
STEP = 0.00001
VISIT = 100
STRIDE = 8
SPEED_FLOOR, SPEED_LEAST, SPEED_NONE = 0.07, 5, 100.0
CHECK_RADIUS, CHECK_COUNT = 0.00005, 2


def visits(samples: DataFrame, circles: DataFrame, metric: str = "planar") -> DataFrame:
    """The circles' key columns, trip_id, and the trip's first (lo) and last (hi) index in each circle."""
    keys = [c for c in circles.columns if c not in ("lat", "lon", "radius")]
    # Equal circles are looked up once.
    sites = circles.select("lat", "lon", "radius").distinct()
    sites = sites.withColumn("site", F.struct("lat", "lon", "radius"))
    found = circle_join(samples.select("trip_id", "idx", "lat", "lon", "clat", "clon"), sites, metric)
    found = found.groupBy("site", "trip_id").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    asked = circles.select(*keys, F.struct("lat", "lon", "radius").alias("site"))
    return found.join(asked, "site").select(*keys, "trip_id", "lo", "hi")


def _ends(legs: DataFrame, keys: list[str]) -> DataFrame:
    side = lambda k: legs.select(*keys, F.lit(k).alias("side"), F.col(f"lat{k}").alias("lat"), F.col(f"lon{k}").alias("lon"), F.col(f"r{k}").alias("radius"))
    return side(1).unionByName(side(2))


def _both_ends(samples: DataFrame, legs: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """One row for each leg and trip that visits an end: a_lo, a_hi, b_lo, b_hi (null where not visited)."""
    at = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    found = visits(samples, _ends(legs, keys), metric)
    return found.groupBy(*keys, "trip_id").agg(at(1, "lo").alias("a_lo"), at(1, "hi").alias("a_hi"), at(2, "lo").alias("b_lo"), at(2, "hi").alias("b_hi"))


def p2p(samples: DataFrame, requests: DataFrame, metric: str = "planar") -> DataFrame:
    """Trips between two circles (qid, lat1, lon1, lat2, lon2, radius): n_a, n_b, n_both, dir_ab and dir_ba."""
    legs = requests.withColumn("r1", F.col("radius")).withColumn("r2", F.col("radius"))
    wide = _both_ends(samples, legs, ["qid"], metric).join(legs.select("qid", "lat1", "lon1", "lat2", "lon2", "radius"), "qid")
    dist = geo.latlon_distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    r2 = F.col("radius") * 2
    both = F.col("a_lo").isNotNull() & F.col("b_lo").isNotNull()
    gap = lambda late, early: ((F.col(late) - F.col(early)) * F.lit(STEP)).cast("double")
    fits = lambda g: (g > dist - r2) & (g < dist * 2.0 + r2)
    near = F.when(both & (dist <= r2), 1).otherwise(0)
    ab = near + F.when(both & (F.col("a_hi") < F.col("b_lo")) & fits(gap("b_lo", "a_hi")), 1).otherwise(0)
    ba = near + F.when(both & (F.col("a_lo") > F.col("b_hi")) & fits(gap("a_lo", "b_hi")), 1).otherwise(0)
    counts = wide.groupBy("qid").agg(F.count("a_lo").alias("n_a"), F.count("b_lo").alias("n_b"), F.count_if(both).alias("n_both"), F.sum(ab).alias("dir_ab"), F.sum(ba).alias("dir_ba"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return requests.select("qid").join(counts, "qid", "left").select("qid", *(zero(c) for c in ("n_a", "n_b", "n_both", "dir_ab", "dir_ba")))


def match(samples: DataFrame, legs: DataFrame, keys: list[str], metric: str = "planar") -> DataFrame:
    """Trips that go from circle 1 to circle 2 of each leg, and their middle index in each (i1, i2).

    legs: the key columns, lat1, lon1, r1, lat2, lon2, r2 and dist (below zero:
    as far as the points are apart). Trips that stay in a circle for more than
    ``VISIT`` steps are left out. Circles that touch take any order.
    """
    wide = _both_ends(samples, legs, keys, metric).filter("a_hi - a_lo <= {0} and b_hi - b_lo <= {0}".format(VISIT))
    wide = wide.join(legs.select(*keys, "lat1", "lon1", "r1", "lat2", "lon2", "r2", "dist"), keys)
    apart = geo.latlon_distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    dist = F.when(F.col("dist") < 0, apart).otherwise(F.col("dist"))
    slack = F.col("r1") + F.col("r2")
    gap = (F.col("b_lo") - F.col("a_hi")) * F.lit(STEP)
    ok = (apart <= slack) | ((F.col("a_hi") <= F.col("b_lo")) & (gap < dist * 2.0 + slack))
    middle = lambda a, b: F.expr(f"({a} + {b}) div 2").cast("long")
    return wide.filter(ok).select(*keys, "trip_id", middle("a_lo", "a_hi").alias("i1"), middle("b_lo", "b_hi").alias("i2"))


def _legs_of_three(requests: DataFrame) -> DataFrame:
    c = F.col
    leg = lambda k: requests.select("qid", F.lit(k).alias("leg"), *(c(f"{x}{k + i}").alias(f"{x}{1 + i}") for i in (0, 1) for x in ("lat", "lon", "r")), c(f"d{k}").alias("dist"))
    return leg(1).unionByName(leg(2))


def three_point_trips(samples: DataFrame, requests: DataFrame, metric: str = "planar") -> DataFrame:
    """qid, trip_id and i1, i2 of the second leg, of the trips that make both legs of a three-point request."""
    found = match(samples, _legs_of_three(requests), ["qid", "leg"], metric)
    second = lambda x: F.max(F.when(F.col("leg") == 2, F.col(x))).alias(x)
    first = F.max(F.when(F.col("leg") == 1, F.col("i2"))).alias("i_mid")
    return found.groupBy("qid", "trip_id").agg(F.count("*").alias("legs"), second("i1"), second("i2"), first).filter("legs = 2").drop("legs")


def three_point(samples: DataFrame, requests: DataFrame, metric: str = "planar") -> DataFrame:
    """Number of trips through three circles in order (qid, lat1..lon3, r1..r3, d1, d2)."""
    counts = three_point_trips(samples, requests, metric).groupBy("qid").agg(F.count("*").alias("n"))
    return requests.select("qid").join(counts, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n_trips"))


def _mean_by_position(rows: DataFrame, digits: int) -> DataFrame:
    """qid, pos and mean lat and lon of rows (qid, trip_id, pos, lat, lon), up to the shortest trip's end."""
    last = rows.groupBy("qid", "trip_id").agg(F.max("pos").alias("last")).groupBy("qid").agg(F.min("last").alias("last"))
    mean = rows.groupBy("qid", "pos").agg(F.round(F.avg("lat"), digits).alias("lat"), F.round(F.avg("lon"), digits).alias("lon"), F.count("*").alias("n_trips"))
    return mean.join(last, "qid").filter("pos <= last").drop("last")


def mean_path(samples: DataFrame, requests: DataFrame, metric: str = "planar", digits: int = 6) -> DataFrame:
    """The mean path of the trips of each three-point request: every ``STRIDE``-th sample of the second leg.

    Trips without a sample there end the path at once, as the shortest trip does.
    """
    return mean_path_of(samples, three_point_trips(samples, requests, metric), digits)


def mean_path_of(samples: DataFrame, trips: DataFrame, digits: int = 6) -> DataFrame:
    """The mean path of trips (qid, trip_id, i1, i2)."""
    # `sequence` would count downwards where the end comes first.
    empty = trips.filter(F.col("i1") + STRIDE >= F.col("i2")).select("qid").distinct()
    rows = trips.join(empty, "qid", "left_anti").select("qid", "trip_id", F.posexplode(F.sequence(F.col("i1") + STRIDE, F.col("i2") - 1, F.lit(STRIDE).cast("long"))).alias("pos", "idx"))
    rows = rows.join(samples.select("trip_id", "idx", "lat", "lon"), ["trip_id", "idx"])
    return _mean_by_position(rows, digits)


def speed_rank(samples: DataFrame, requests: DataFrame, metric: str = "planar") -> DataFrame:
    """The inverse speed at a rank (0 to 1) among the samples of each circle (qid, lat, lon, radius, ranking) that are above the floor; 100 where there are too few."""
    found = circle_join(samples.select("speed_inv", "lat", "lon", "clat", "clon"), requests.select("qid", "lat", "lon", "radius"), metric)
    moving = F.when(F.col("speed_inv") > SPEED_FLOOR, F.col("speed_inv"))
    # A histogram first: speeds repeat, and no list of all samples is made.
    counts = found.select("qid", moving.alias("v")).groupBy("qid", "v").agg(F.count("*").alias("n"))
    by = counts.groupBy("qid").agg(F.sum("n").alias("n_all"), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("n_moving"))
    upto = F.sum("n").over(Window.partitionBy("qid").orderBy("v"))
    ordered = counts.filter("v is not null").withColumn("upto", upto).join(by, "qid").join(requests.select("qid", "ranking"), "qid")
    rank = F.least((F.col("ranking") * F.col("n_moving")).cast("long"), F.col("n_moving") - 1)
    value = ordered.filter(F.col("upto") > rank).groupBy("qid").agg(F.min("v").alias("v"))
    out = requests.select("qid").join(by, "qid", "left").join(value, "qid", "left")
    enough = (F.coalesce("n_all", F.lit(0)) >= SPEED_LEAST) & (F.coalesce("n_moving", F.lit(0)) >= SPEED_LEAST)
    return out.select("qid", F.coalesce("n_all", F.lit(0)).cast("long").alias("n_samples"), F.coalesce("n_moving", F.lit(0)).cast("long").alias("n_moving"), F.when(enough, F.col("v")).otherwise(F.lit(SPEED_NONE)).alias("speed"))


def _path_points(paths: DataFrame) -> DataFrame:
    return paths.select("qid", F.size("path").alias("n"), F.posexplode("path").alias("k", "p")).select("qid", "n", "k", "p.*")


def history_legs(paths: DataFrame) -> DataFrame:
    """The legs of path histories (qid, path: array of lat, lon, radius, dist, newest first): next neighbours, then every other."""
    p = F.col("path")
    at = lambda i: F.element_at(p, i.cast("int"))
    one = paths.select("qid", "path", F.explode(F.sequence(F.lit(2), F.size("path"))).alias("i"), F.lit(1).alias("skip"))
    two = paths.filter(F.size("path") > 2).select("qid", "path", F.explode(F.sequence(F.lit(3), F.size("path"))).alias("i"), F.lit(2).alias("skip"))
    legs = one.unionByName(two)
    a, b = at(F.col("i")), at(F.col("i") - F.col("skip"))
    dist = F.when(F.col("skip") == 1, a["dist"]).otherwise(a["dist"] + at(F.col("i") - 1)["dist"])
    return legs.select("qid", (F.col("skip") * 100000 + F.col("i")).alias("leg"), *(v[x].alias(f"{y}{k}") for k, v in ((1, a), (2, b)) for x, y in (("lat", "lat"), ("lon", "lon"), ("radius", "r"))), dist.alias("dist"))


def history_trips(samples: DataFrame, paths: DataFrame, metric: str = "planar") -> DataFrame:
    """qid and trip_id of the trips that make every leg of a path's history, with i1 and i2 of the newest leg."""
    legs = history_legs(paths)
    needed = legs.groupBy("qid").agg(F.count("*").alias("needed"))
    newest = lambda x: F.max(F.when(F.col("leg") == 100002, F.col(x))).alias(x)
    found = match(samples, legs, ["qid", "leg"], metric).groupBy("qid", "trip_id").agg(F.count("*").alias("made"), newest("i1"), newest("i2"))
    return found.join(needed, "qid").filter("made = needed").select("qid", "trip_id", "i1", "i2")


def direction_scores(samples: DataFrame, paths: DataFrame, bins: int = geo.BINS, metric: str = "planar") -> DataFrame:
    """qid, bin and n_trips: trips with a path's history that go on in each direction; every bin has a row.

    Paths need two points. The probes leave the newest point by its ``dist``;
    the second leg takes the newest point's radius at the older point and the
    older one's at the probe.
    """
    p = F.col("path")
    p0, p1 = F.element_at(p, 1), F.element_at(p, 2)
    ring = paths.filter(F.size("path") > 1).select("qid", p0.alias("p0"), p1.alias("p1"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    ring = ring.withColumn("to", geo.probe(F.col("p0.lat"), F.col("p0.lon"), F.col("p0.dist"), F.col("bin") * F.lit(360.0 / bins)))
    leg = lambda k, a, r1, r2, d: ring.select("qid", "bin", F.lit(k).alias("leg"), F.col(f"{a}.lat").alias("lat1"), F.col(f"{a}.lon").alias("lon1"), F.col(r1).alias("r1"), F.col("to.lat").alias("lat2"), F.col("to.lon").alias("lon2"), F.col(r2).alias("r2"), d.alias("dist"))
    probes = leg(1, "p0", "p0.radius", "p0.radius", F.col("p0.dist")).unionByName(leg(2, "p1", "p0.radius", "p1.radius", F.col("p0.dist") + F.col("p1.dist")))
    # Legs of the history and of the probes are matched at once; each trip has its history and the bins of either probe leg.
    legs = history_legs(paths)
    needed = legs.groupBy("qid").agg(F.count("*").alias("needed"))
    found = match(samples, probes.unionByName(legs.withColumn("bin", F.lit(-1))), ["qid", "bin", "leg"], metric)
    of = lambda k: F.collect_list(F.when((F.col("bin") >= 0) & (F.col("leg") == k), F.col("bin"))).alias(f"bins{k}")  # noqa: E731  (a bin once at most)
    trips = found.groupBy("qid", "trip_id").agg(F.count_if(F.col("bin") < 0).alias("made"), of(1), of(2))
    trips = trips.join(needed, "qid").filter("made = needed")
    counts = trips.select("qid", F.explode(F.array_intersect("bins1", "bins2")).alias("bin")).groupBy("qid", "bin").agg(F.count("*").alias("n"))
    return ring.select("qid", "bin").join(counts, ["qid", "bin"], "left").select("qid", "bin", F.coalesce("n", F.lit(0)).alias("n_trips"))


def scored_directions(samples: DataFrame, paths: DataFrame, threshold: int = 2, bins: int = geo.BINS) -> DataFrame:
    """``direction_scores`` with their activation as ``score``."""
    return direction_scores(samples, paths, bins).withColumn("score", geo.activation(F.col("n_trips"), threshold))


def mean_along_history(samples: DataFrame, paths: DataFrame, metric: str = "planar", digits: int = 6) -> DataFrame:
    """qid, pos and mean lat and lon at eleven shares of the way from 2 steps after i1 to i2 of each history trip.

    The shares are 0.1 apart as they add up in floating point, so that the
    eleventh stays just below 1. Between two samples the share itself is what
    is left over from whole steps, in units of the way.
    """
    return mean_of_shares(samples, history_trips(samples, paths, metric), digits)


def mean_of_shares(samples: DataFrame, trips: DataFrame, digits: int = 6) -> DataFrame:
    """The same for trips (qid, trip_id, i1, i2)."""
    # Ten additions of 0.1.
    shares, s = [], 0.0
    while s < 1.0:
        shares.append(s)
        s += 0.1
    trips = trips.withColumn("begin", F.col("i1") + 2).filter("i2 > begin")
    length = (F.col("i2") - F.col("begin")).cast("double")
    rows = trips.select("qid", "trip_id", "begin", "i2", F.posexplode(F.array(*(F.lit(x) for x in shares))).alias("pos", "share"))
    ends = samples.groupBy("trip_id").agg(F.max("idx").alias("end"))
    rows = rows.join(ends, "trip_id").withColumn("n", (F.col("share") * length + F.col("begin")).cast("long"))
    alpha = F.col("share") - (F.least("n", "end") - F.col("begin")) / length
    rows = rows.select("qid", "trip_id", "pos", F.least("n", "end").alias("n1"), F.least(F.col("n") + 1, F.col("end")).alias("n2"), alpha.alias("alpha"))
    pick = lambda k: samples.select("trip_id", F.col("idx").alias(f"n{k}"), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    rows = rows.join(pick(1), ["trip_id", "n1"]).join(pick(2), ["trip_id", "n2"])
    rows = rows.select("qid", "trip_id", "pos", *(geo.lerp(F.col(f"{c}1"), F.col(f"{c}2"), F.col("alpha")).alias(c) for c in ("lat", "lon")))
    return _mean_by_position(rows, digits)


def lateral_requests(nodes: DataFrame, half: int = 35, step: float = 0.000015, r: float = 0.0001, r3: float = 0.00002, style: str = "straight") -> DataFrame:
    """Three-point requests on a line across each node's way (node, lat1, lon1, lat2, lon2: where it comes from and where it is; bearing in degrees).

    straight: points at right angles to the bearing. v: two rays at 120 degrees
    from it, one on either side.
    """
    k = F.col("k")
    rows = nodes.withColumn("k", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    turn = F.when(k < 0, F.lit(-90.0 if style == "straight" else -120.0)).otherwise(F.lit(90.0 if style == "straight" else 120.0))
    to = geo.probe(F.col("lat2"), F.col("lon2"), F.abs(k) * F.lit(step), F.col("bearing") + turn)
    rows = rows.withColumn("to", to)
    return rows.select("node", "k", "lat1", "lon1", "lat2", "lon2", F.col("to.lat").alias("lat3"), F.col("to.lon").alias("lon3"), F.lit(r).alias("r1"), F.lit(r).alias("r2"), F.lit(r3).alias("r3"), F.lit(-1.0).alias("d1"), F.lit(-1.0).alias("d2"))


def lateral_profile(samples: DataFrame, nodes: DataFrame, threshold: int = 1, **shape) -> DataFrame:
    """node, k, n_trips and score of the points across each node's way."""
    requests = lateral_requests(nodes, **shape).withColumn("qid", F.struct("node", "k"))
    return three_point(samples, requests).select("qid.node", "qid.k", "n_trips", geo.activation(F.col("n_trips"), threshold).alias("score"))


def merge_check(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether trips of either path go on to the other's newest point (pid, path_a, path_b: arrays of lat, lon, newest first)."""

    def ask(one: str, other: str, side: int) -> DataFrame:
        a = F.col(one)
        middle = F.size(F.col(other)).cast("int").bitwiseAND(-2) / 2 + 1  # half the other's length, rounded down, and one
        at = lambda i: F.try_element_at(a, i.cast("int"))
        last, mid, end = at(F.size(a)), at(F.least(middle + 1, F.size(a))), F.try_element_at(F.col(other), F.lit(1))
        points = [v[x].alias(f"{x}{k}") for k, v in ((1, last), (2, mid), (3, end)) for x in ("lat", "lon")]
        return pairs.select(F.struct("pid", F.lit(side).alias("side")).alias("qid"), *points, *(F.lit(CHECK_RADIUS).alias(f"r{k}") for k in (1, 2, 3)), F.lit(-1.0).alias("d1"), F.lit(-1.0).alias("d2"))

    counts = three_point(samples, ask("path_a", "path_b", 1).unionByName(ask("path_b", "path_a", 2)))
    return counts.groupBy("qid.pid").agg(F.bool_and(F.col("n_trips") > CHECK_COUNT).alias("same"), F.min("n_trips").alias("n_least"))


def connected(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether two points (qid, lat1, lon1, lat2, lon2) are joined by trips: close ones are, places with few trips can't be told and are, others need three trips either way."""
    dist = geo.latlon_distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    radius = F.least(F.greatest(dist * 0.1, F.lit(0.00005)), F.lit(0.00012))
    asked = pairs.withColumn("radius", radius).withColumn("apart", dist)
    counts = p2p(samples, asked.select("qid", "lat1", "lon1", "lat2", "lon2", "radius")).join(asked.select("qid", "radius", "apart"), "qid")
    ok = (F.col("apart") < F.col("radius") * 2) | (F.col("n_a") < 5) | (F.col("n_b") < 5) | (F.col("dir_ab") + F.col("dir_ba") >= 3)
    return counts.select("qid", "n_a", "n_b", "dir_ab", "dir_ba", ok.alias("connected"))


def mph(speed_inv):
    """Miles an hour of an inverse speed in seconds for 5 metres."""
    return F.lit(5.0) / speed_inv * 3.6 / 1.6


def connected_roads(samples: DataFrame, triples: DataFrame, radius: float = 0.00005) -> DataFrame:
    """Whether trips confirm a link over three points (qid, lat1..lon3): slow places are linked, as are places with few trips; others need three trips between the first two points, one way or over all three.

    qid, slow, n_a, n_trips and connected.
    """
    at = lambda k: triples.select(F.struct("qid", F.lit(k).alias("k")).alias("qid"), F.col(f"lat{k}").alias("lat"), F.col(f"lon{k}").alias("lon"), F.lit(0.0003).alias("radius"), F.lit(0.2).alias("ranking"))
    speeds = speed_rank(samples, at(1).unionByName(at(2)).unionByName(at(3))).groupBy("qid.qid").agg(F.bool_and(mph(F.col("speed")) < 40).alias("slow"))
    pairs = p2p(samples, triples.select("qid", "lat1", "lon1", "lat2", "lon2", F.lit(radius).alias("radius"))).select("qid", "n_a", (F.col("dir_ab") + F.col("dir_ba")).alias("direct"))
    way = lambda side, order: triples.select(F.struct("qid", F.lit(side).alias("side")).alias("qid"), *(F.col(f"{c}{k}").alias(f"{c}{i}") for i, k in enumerate(order, 1) for c in ("lat", "lon")), *(F.lit(radius).alias(f"r{i}") for i in (1, 2, 3)), F.lit(-1.0).alias("d1"), F.lit(-1.0).alias("d2"))
    three = three_point(samples, way(1, (1, 2, 3)).unionByName(way(2, (3, 2, 1)))).groupBy("qid.qid").agg(F.max("n_trips").alias("over"))
    rows = speeds.join(pairs, "qid").join(three, "qid")
    n = F.greatest("direct", "over")
    ok = F.col("slow") | (F.col("n_a") < 5) | ((F.col("direct") >= 3) & (n > 2))
    return rows.select("qid", "slow", "n_a", n.alias("n_trips"), ok.alias("connected"))


class TraceDataset:
    """Indexed samples, up to a greatest trip id, and the queries on them."""

    def __init__(self, samples: DataFrame, trip_bound: int | None = None, metric: str = "planar"):
        self.samples = samples if trip_bound is None else samples.filter(F.col("trip_id") <= trip_bound)
        self.metric = metric

    def cached(self) -> "TraceDataset":
        self.samples = self.samples.persist()
        return self

    def p2p(self, requests: DataFrame) -> DataFrame:
        return p2p(self.samples, requests, self.metric)

    def three_point(self, requests: DataFrame) -> DataFrame:
        return three_point(self.samples, requests, self.metric)

    def mean_path(self, requests: DataFrame) -> DataFrame:
        return mean_path(self.samples, requests, self.metric)

    def speed_rank(self, requests: DataFrame) -> DataFrame:
        return speed_rank(self.samples, requests, self.metric)

    def direction_scores(self, paths: DataFrame, bins: int = geo.BINS) -> DataFrame:
        return direction_scores(self.samples, paths, bins, self.metric)

    def mean_along_history(self, paths: DataFrame) -> DataFrame:
        return mean_along_history(self.samples, paths, self.metric)

    def trip(self, trip_id: int) -> DataFrame:
        """The samples of one trip, in order."""
        return self.samples.filter(F.col("trip_id") == trip_id).orderBy("idx")


