"""Exploration of road trees from entrances.

The state of an exploration (its nodes) is a small tree on the driver; what is
asked of the samples is not. In every round the frontier of all trees, one new
node each, is scored by one job: the direction scores of all histories, their
lateral profiles and, where nodes come near one another, their merge checks are
each one table of requests. Rounds end when no node has a way to go on.

Ties are broken by node and bin, so that a run is determined by its input.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import raster, similarity, trace, trip_match
from ..operators.cluster import lateral_peaks
from ..sources.config import Config
from ..sources.graphs import read_checkpoint, write_checkpoint
from ..storage import save

# Probe distance, a new node's distance, radii, border, nearness and similarity cuts, bounds.
STEP, NODE_STEP, RANGE, NODE_RADIUS = 0.00015, 0.000075, 0.00003, 0.00005
BORDER = 0.00025
NEAR_NODE, BOX = 0.00015, (0.0003, 0.0005)
ALIKE, ALIKE_FAR, OVERLAP = 0.00006, 0.00025, 0.7
ROUNDS, CHECKPOINT = 500_000, 1_000
# Radii tried for a history, the first that gives three neighbouring directions is taken.
NOISE = (0.00005, 0.00007, 0.00009, 0.00011, 0.00013, 0.00015)
# Lateral profiles (ancestors they come from, radii, spacing, places on either side, places around the
# middle that count as the road itself), the least share of a branch's peak, its longest gap, and its reach.
LATERAL, LATERAL_RADIUS, LATERAL_END, LATERAL_STEP, HALF, OWN = ((18, 12), (24, 18), (29, 18)), 0.0001, 0.00002, 0.000015, 35, 10
BRANCH_SHARE, BRANCH_GAP, BRANCH_REACH, BRANCH_WAIT = 0.05, 0.0005, 0.00015, 5
# Bounds of a node's radius; places on either side of a node's direction that are always open, and the value of
# a sibling that ends a side.
RADIUS, AHEAD, SIBLING = (0.00005, 0.000125), 2, 0.1
#: Degrees of a cell of the driver's index of nodes; no segment is longer.
CELL = 0.0005
BINS = geo.BINS
KERNEL = (0.214607, 0.189879, 0.131514, 0.071303)

NODES = "tree int, node int, parent int, lat double, lon double, direction int, depth int, scores array<double>, merged_tree int, merged_node int, kind int, references int, removed boolean, dead boolean, outside boolean, init double, radius double, ways array<int>, jumped boolean"

BRANCHES = "tree int, start int, seen int, wait int, shape array<array<double>>, state string"


@dataclass
class Node:
    """A place on a road tree; its parent is itself for a root."""

    tree: int
    node: int
    parent: int
    lat: float
    lon: float
    direction: int = -1
    depth: int = 0
    scores: list[float] = field(default_factory=lambda: [0.0] * BINS)
    merged_tree: int = -1
    merged_node: int = -1
    kind: int = 0
    references: int = 0
    removed: bool = False
    dead: bool = False
    outside: bool = False
    init: float = -1.0
    radius: float = NODE_RADIUS
    ways: list[int] = field(default_factory=list)  # directions open to it, once it has been looked at
    jumped: bool = False  # from a branch's shape

    def row(self) -> tuple:
        return tuple(getattr(self, c.split()[0]) for c in NODES.split(", "))


@dataclass
class Branch:
    """A way off a road that was seen from the side, to be taken up once its tree is deeper than ``wait``: the shape from ``start`` on."""

    tree: int
    start: int
    seen: int
    wait: int
    shape: list[tuple[float, float]]
    state: str = "active"


def thinned(path: list["Node"], noise: float) -> list[tuple[float, float, float, float]]:
    """The path query (lat, lon, radius, distance to the next newer point) of a node and its ancestors.

    Points whose circle would overlap the one before are left out; the oldest
    always stays, in place of the one before it.
    """
    along = [0.0]
    for x, y in zip(path, path[1:]):
        along.append(along[-1] + math.hypot(x.lat - y.lat, (x.lon - y.lon) * math.cos(math.radians(x.lat))))
    out, last = [(path[0].lat, path[0].lon, path[0].radius, STEP)], 0
    for i, x in enumerate(path[1:], 1):
        d = along[i] - along[last]
        r = max(x.radius, noise)
        if d != 0 and out[-1][2] + r > d:
            if i < len(path) - 1:
                continue
            if len(out) > 1:
                out.pop()
        out.append((x.lat, x.lon, r, d))
        last = i
    return out


def smoothed(scores: list[float], circular: bool = True) -> list[float]:
    """The masked smoothing of one vector of scores on a circle or a line."""
    v, n = [max(0.0, x) for x in scores], len(scores)
    out = [0.0] * n
    for j in range(n):
        if v[j] <= 0:
            continue
        total = v[j] * KERNEL[0]
        for sign in (1, -1):
            for k, w in enumerate(KERNEL[1:], 1):
                y = v[(j + sign * k) % n] if circular or 0 <= j + sign * k < n else 0.0
                if y <= 0:
                    break
                total += y * w
        out[j] = total
    return out


def tops(v: list[float]) -> list[float]:
    """Values at peaks (ties included) between positive neighbours, else 0."""
    n = len(v)
    return [v[i] if v[i] > 0 and v[(i + 1) % n] > 0 and v[i - 1] > 0 and v[i] >= v[i - 1] and v[i] >= v[(i + 1) % n] else 0.0 for i in range(n)]


def half_width(v: list[float], half: int = HALF) -> float:
    """A node's radius: half the way over which a profile stays above half its highest peak around the middle, within bounds."""
    top = max((v[i] for i in range(1, len(v) - 1) if v[i] > v[i - 1] > 0 and v[i] > v[i + 1] > 0), default=0.0) / 2
    run = lambda places: next((k for k, p in enumerate(places) if not v[p] > top), len(places))
    width = run(range(half, 2 * half + 1)) + run(range(half - 1, 0, -1))
    return min(max((width - 1) * LATERAL_STEP / 2, RADIUS[0]), RADIUS[1])


def sector(direction: int, siblings: list[float]) -> list[int]:
    """Directions open to a node: beside its own, and on either side a third of the circle up to the first sibling that still waits."""
    out = {(direction + i) % BINS for i in range(-AHEAD, AHEAD + 1)}
    for sign in (1, -1):
        for i in range(AHEAD, BINS // 3 - 2 + AHEAD):
            at = (direction + sign * i) % BINS
            if siblings[at] > SIBLING:
                break
            out.add(at)
    return sorted(out)


class Forest:
    """Road trees of a configuration over a dataset of samples."""

    def __init__(self, dataset: trace.TraceDataset, config: Config):
        self.data, self.config = dataset, config
        self.spark: SparkSession = dataset.samples.sparkSession
        self.trees: list[list[Node]] = []
        self.branches: list[Branch] = []
        self.rounds = 0
        self.cells: dict[tuple[int, int], list[Node]] = {}
        self.open: dict[int, list[tuple[int, int]]] = {}
        self._trips: DataFrame | None = None

    def _by_trip(self) -> DataFrame:
        """The samples trip by trip, written once."""
        if self._trips is None:
            self._trips = trip_match.by_trip(self.data.samples)
        return self._trips

    def _add(self, n: Node) -> None:
        """Enter a node in the index of places and among those that may grow."""
        self.cells.setdefault((math.floor(n.lat / CELL), math.floor(n.lon / CELL)), []).append(n)
        heapq.heappush(self.open.setdefault(n.tree, []), (n.depth, n.node))

    def _near(self, lat: float, lon: float, reach: int = 2) -> list[Node]:
        """All nodes within some cells of a place."""
        a, b = math.floor(lat / CELL), math.floor(lon / CELL)
        return [n for i in range(a - reach, a + reach + 1) for j in range(b - reach, b + reach + 1) for n in self.cells.get((i, j), ())]

    # --- state ---------------------------------------------------------------------------------

    def plant(self) -> None:
        """One root for each entrance, scored at once."""
        for e in self.config.entrances:
            self.trees.append([Node(len(self.trees), 0, 0, e.lat, e.lon, init=e.heading)])
            self._add(self.trees[-1][0])
        self._score([t[0] for t in self.trees])

    def path(self, n: Node, most: int) -> list[Node]:
        """A node and its ancestors, newest first."""
        out = [n]
        while len(out) < most and out[-1].parent != out[-1].node:
            out.append(self.trees[n.tree][out[-1].parent])
        return out

    def between(self, n: Node, ancestor: int) -> list[Node]:
        """From a node up to an ancestor of its tree (or the root)."""
        out = [n]
        while out[-1].node != ancestor and out[-1].parent != out[-1].node:
            out.append(self.trees[n.tree][out[-1].parent])
        return out

    def common_root(self, a: Node, b: Node) -> int | None:
        """The last common ancestor of two nodes of one tree."""
        if a.tree != b.tree:
            return None
        up = {x.node for x in self.path(a, 1 << 30)}
        return next((x.node for x in self.path(b, 1 << 30) if x.node in up), None)

    def table(self) -> DataFrame:
        """All nodes."""
        return self.spark.createDataFrame([n.row() for t in self.trees for n in t], NODES)

    def save(self, folder: str) -> None:
        rows = [(b.tree, b.start, b.seen, b.wait, [list(p) for p in b.shape], b.state) for b in self.branches]
        write_checkpoint({"nodes": self.table(), "branches": self.spark.createDataFrame(rows, BRANCHES)}, folder, self.rounds)

    def load(self, folder: str) -> bool:
        """Take up the newest checkpoint; False if there is none."""
        found = read_checkpoint(self.spark, folder, ["nodes", "branches"])
        if found is None:
            return False
        self.rounds, tables = found[0], found[1]
        names = [c.split()[0] for c in NODES.split(", ")]
        trees: dict[int, list[Node]] = {}
        for r in tables["nodes"].orderBy("tree", "node").toLocalIterator():
            trees.setdefault(r["tree"], []).append(Node(**{c: list(r[c]) if c in ("scores", "ways") else r[c] for c in names}))
        self.trees = [trees[k] for k in sorted(trees)]
        self.cells, self.open = {}, {}
        for t in self.trees:
            for n in t:
                self._add(n)
        self.branches = [Branch(r["tree"], r["start"], r["seen"], r["wait"], [tuple(p) for p in r["shape"]], r["state"]) for r in tables["branches"].orderBy("wait", "tree", "seen").toLocalIterator()]
        return True

    # --- queries of a frontier ---------------------------------------------------------------------

    def _score(self, nodes: list[Node]) -> None:
        """Direction scores of nodes, by their histories; roots, which have none, by trips from the node to each probe.

        All radii are asked in one job; each node takes the first that finds
        three neighbouring directions, or else the last.
        """
        asked = trip_match.Requests()
        paths, roots = {}, {}
        for k, n in enumerate(nodes):
            h = self.path(n, 2 * self.config.history_length + 1)
            if len(h) > 1:
                for j, r in enumerate(NOISE):
                    p = thinned(h, r)
                    shared = asked.share(trip_match.history_legs(p))
                    paths[k, j] = [asked.ask(legs, shared) for legs in trip_match.probe_legs(p)]
            else:
                lat, lon = n.lat, n.lon
                turns = [math.radians(b * geo.BIN_DEGREES) for b in range(BINS)]
                roots[k] = [asked.ask([(lat, lon, NODE_RADIUS, lat + STEP * math.cos(a), lon + STEP * math.sin(a) / math.cos(math.radians(lat)), RANGE, -1.0)]) for a in turns]
        found = asked.counts(self._by_trip(), self.data.metric)
        counts: dict[int, list[int]] = {k: found[at].tolist() for k, at in roots.items()}
        for k in {k for k, _ in paths}:
            for j in range(len(NOISE)):
                counts[k] = found[paths[k, j]].tolist()
                above = [c >= self.config.least_trips and c > 1 for c in counts[k]]
                if any(above[i] and above[i - 1] and above[i - 2] for i in range(BINS)):
                    break
        least = self.config.least_trips
        for k, n in enumerate(nodes):
            raw = [math.log(c + geo.TINY) if c >= least else geo.LOW_SCORE for c in counts[k]]
            v = smoothed(raw)
            if n.parent != n.node:
                back = BINS // 2 + n.direction
                for i in range(BINS // 3):
                    v[(back + i - BINS // 6) % BINS] = 0.0
            elif n.init != -1:
                at = int(n.init / geo.BIN_DEGREES)
                v = [x if min((i - at) % BINS, (at - i) % BINS) <= 2 else 0.0 for i, x in enumerate(v)]
            n.scores = v

    def _covered(self, lat: float, lon: float, tree: int) -> bool:
        """Whether a segment of a tree passes a place."""
        k = math.cos(math.radians(lat))
        for x in self._near(lat, lon, 3):
            if x.tree != tree:
                continue
            y = self.trees[tree][x.parent]
            dx, dy = x.lat - y.lat, (x.lon - y.lon) * k
            px, py = lat - y.lat, (lon - y.lon) * k
            length = dx * dx + dy * dy
            t = min(1.0, max(0.0, (px * dx + py * dy) / length)) if length else 0.0
            if math.hypot(px - t * dx, py - t * dy) <= BRANCH_REACH:
                return True
        return False

    def _profiles(self, new: list[Node]) -> tuple[dict[int, list[float]], dict[tuple[int, int], tuple[float, float]]]:
        """Smoothed profiles across the way at new nodes far enough along, by their places in ``new``, and the points asked for; a profile sets its node's radius."""
        asked, bins, places = trip_match.Requests(), [], {}
        for k, n in enumerate(new):
            up = self.path(n, LATERAL[-1][0] + 1)
            if len(up) <= LATERAL[-1][0]:
                continue
            heading = n.direction * geo.BIN_DEGREES
            for j, (old, mid) in enumerate(LATERAL):
                for i in range(-HALF, HALF + 1):
                    a = math.radians(heading + (120.0 if i > 0 else -120.0))
                    d = abs(i) * LATERAL_STEP
                    lat, lon = n.lat + d * math.cos(a), n.lon + d * math.sin(a) / math.cos(math.radians(n.lat))
                    places[k, i] = (lat, lon)
                    asked.ask(trip_match.three_legs((up[old].lat, up[old].lon, up[mid].lat, up[mid].lon, lat, lon, LATERAL_RADIUS, LATERAL_RADIUS, LATERAL_END, -1.0, -1.0)))
                    bins.append((k, i + HALF))
        if not bins:
            return {}, places
        profiles: dict[int, list[float]] = {k: [0.0] * (2 * HALF + 1) for k, _ in bins}
        for (k, i), n_trips in zip(bins, asked.counts(self._by_trip(), self.data.metric).tolist()):
            if n_trips >= self.config.least_trips_branch:
                profiles[k][i] += n_trips / len(LATERAL)
        for k in profiles:
            profiles[k] = smoothed(profiles[k], circular=False)
            new[k].radius = half_width(profiles[k])
        return profiles, places

    def _look_aside(self, new: list[Node], found: tuple[dict, dict] | None = None) -> None:
        """A peak of a profile beside the road makes a branch, with the mean path of the trips that go there; ``found``: the profiles, if they are there."""
        profiles, places = found or self._profiles(new)
        schema = "qid int, lat1 double, lon1 double, lat2 double, lon2 double, lat3 double, lon3 double, r1 double, r2 double, r3 double, d1 double, d2 double"
        shapes, waiting = [], []
        for k, v in profiles.items():
            n, up = new[k], self.path(new[k], LATERAL[-1][0] + 1)
            found = [p for p in lateral_peaks(np.array(v))[0] if 0 <= p <= 2 * HALF]
            top = max((v[p] for p in found), default=0.0)
            for p in found:
                if abs(p - HALF) > OWN and v[p] >= BRANCH_SHARE * top and not self._covered(*places[k, p - HALF], n.tree):
                    shapes.append((len(shapes), up[18].lat, up[18].lon, up[12].lat, up[12].lon, *places[k, p - HALF], LATERAL_RADIUS, LATERAL_RADIUS, NODE_RADIUS, -1.0, -1.0))
                    waiting.append((n, up[12], places[k, p - HALF]))
        if not shapes:
            return
        drawn: dict[int, list] = {}
        for r in self.data.mean_path(self.spark.createDataFrame(shapes, schema)).orderBy("qid", "pos").toLocalIterator():
            drawn.setdefault(r["qid"], []).append((r["lat"], r["lon"]))
        for k, (n, start, place) in enumerate(waiting):
            shape = [(start.lat, start.lon), *drawn.get(k, []), place]
            if all(math.hypot(a[0] - b[0], (a[1] - b[1]) * math.cos(math.radians(a[0]))) <= BRANCH_GAP for a, b in zip(shape, shape[1:])):
                depth = max(x.depth for x in self.trees[n.tree])
                wait = max([depth + BRANCH_WAIT, *(b.wait + 2 for b in self.branches if b.tree == n.tree and b.seen == n.parent)])
                self.branches.append(Branch(n.tree, start.node, n.node, wait, shape))

    def _take_up(self) -> list[Node]:
        """The last waiting branch of each tree that is deep enough, as nodes along its shape; the ends, to be scored."""
        ends = []
        for t in self.trees:
            depth = max(x.depth for x in t)
            due = [b for b in self.branches if b.tree == t[0].tree and b.state == "active" and b.wait < depth]
            if not due:
                continue
            branch = due[-1]
            if self._covered(*branch.shape[-1], branch.tree):
                branch.state = "covered"
                continue
            parent = t[branch.start]
            for a, b in zip(branch.shape, branch.shape[1:]):
                east = (b[1] - a[1]) * math.cos(math.radians(a[0]))
                direction = int(math.degrees(math.atan2(east, b[0] - a[0])) % 360 / geo.BIN_DEGREES)
                n = Node(parent.tree, len(t), parent.node, *b, direction, parent.depth + 1, dead=True, jumped=True)
                parent.references += 1
                t.append(n)
                self._add(n)
                parent = n
            parent.dead = False
            heapq.heappush(self.open[parent.tree], (parent.depth, parent.node))
            branch.state = "taken"
            ends.append(parent)
        return ends

    def _similar(self, new: list[Node]) -> dict[tuple[int, int], tuple[int, int, int]]:
        """For new nodes the nearest earlier node that runs alike, and how that was found: 1 by trips, 2 and 3 by traffic."""
        fresh = {(n.tree, n.node) for n in new}
        pairs = []
        for n in new:
            own = {x.node for x in self.path(n, self.config.path_length * 2)}
            near = []
            for x in self._near(n.lat, n.lon, 1):
                if x.removed or x.merged_tree >= 0 or (x.tree, x.node) in fresh or (x.tree == n.tree and x.node in own):
                    continue
                if abs(x.lat - n.lat) <= BOX[0] and abs(x.lon - n.lon) <= BOX[1]:
                    d = math.hypot(x.lat - n.lat, (x.lon - n.lon) * math.cos(math.radians(n.lat)))
                    if d <= NEAR_NODE:
                        near.append((d, x.tree, x.node))
            near.sort()
            for d, tree, node in near if self.config.evaluate_all else near[:3]:
                a, b = self.path(n, self.config.path_length), self.path(self.trees[tree][node], self.config.path_length)
                if len(a) >= 6 and len(b) >= 6:
                    pairs.append((len(pairs), n, self.trees[tree][node], d, a, b))
        if not pairs:
            return {}
        place = lambda p: [{"lat": x.lat, "lon": x.lon} for x in p]
        kind = "array<struct<lat:double,lon:double>>"
        asked = save(self.spark.createDataFrame([(k, place(a), place(b)) for k, _, _, _, a, b in pairs], f"pid int, path_a {kind}, path_b {kind}"), "alike")
        close = {r["pid"]: r["similarity"] / similarity.WINDOW for r in similarity.window_similarities(asked).collect()}  # one row a pair of the frontier
        ways = [tuple([(x.lat, x.lon) for x in p] for p in pair[4:]) for pair in pairs]
        agreed = dict(enumerate(trip_match.merge_check(self._by_trip(), ways)))
        unsure = [k for k, *_ in pairs if close[k] < ALIKE_FAR and not (close[k] < ALIKE and agreed.get(k))]
        overlap = {}
        if unsure and self.config.merge_detector == "kde_based":
            overlap = {r["pid"]: r["similarity"] for r in raster.merge_similarity(self.data.samples, asked.filter(F.col("pid").isin(unsure))).collect()}
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k, n, x, d, _, _ in pairs:
            if (n.tree, n.node) in out:
                continue
            if close[k] < ALIKE and agreed.get(k):
                out[n.tree, n.node] = (x.tree, x.node, 1)
            elif self.config.merge_detector == "distance_only" and d < self.config.search_threshold and close[k] < ALIKE:
                out[n.tree, n.node] = (x.tree, x.node, 1)
            elif overlap.get(k, 0.0) > OVERLAP:
                out[n.tree, n.node] = (x.tree, x.node, 2 if close[k] < ALIKE else 3)
        return out

    # --- growth ------------------------------------------------------------------------------------------

    def _ways(self, n: Node) -> list[float]:
        """A node's peaks in the directions open to it, which are settled when it is first looked at: those between the siblings that wait then."""
        v = tops(n.scores)
        if n.parent == n.node or n.jumped:
            return v
        if not n.ways:
            n.ways = sector(n.direction, tops(self.trees[n.tree][n.parent].scores))
        allowed = set(n.ways)
        return [x if i in allowed else 0.0 for i, x in enumerate(v)]

    def _choose(self, tree: list[Node]) -> tuple[Node, int] | None:
        """The first node, by depth and number, with a way on, and its best direction (the first of equals)."""
        waiting = self.open.get(tree[0].tree, [])
        while waiting:
            n = tree[waiting[0][1]]
            if not (n.removed or n.outside or n.merged_tree >= 0 or n.dead):
                v = self._ways(n)
                best = max(v)
                if best > 0:
                    return n, v.index(best)
                if not self.config.keep_dead_ends and n.references == 0 and n.parent != n.node:
                    n.dead = True
            heapq.heappop(waiting)  # it comes back if a merge gives it more
        return None

    def _prune(self, n: Node) -> None:
        """Give up a leaf, and ancestors that only led to it."""
        while n.parent != n.node and n.references == 0:
            n.removed = True
            n = self.trees[n.tree][n.parent]
            n.references -= 1
            if n.references > 0 or max(tops(n.scores)) > 0:
                return

    def step(self, one_by_one: bool = False) -> int:
        """One node for each tree that can grow, or, one by one, for the first such tree alone; how many."""
        new: list[Node] = []
        a, b, c, d = self.config.region
        for t in self.trees:
            chosen = None if one_by_one and new else self._choose(t)
            if chosen is None:
                continue
            parent, k = chosen
            angle = math.radians(k * geo.BIN_DEGREES)
            n = Node(parent.tree, len(t), parent.node, parent.lat + NODE_STEP * math.cos(angle), parent.lon + NODE_STEP * math.sin(angle) / math.cos(math.radians(parent.lat)), k, parent.depth + 1)
            n.outside = not (a + BORDER <= n.lat <= c - BORDER and b + BORDER <= n.lon <= d - BORDER)
            parent.references += 1
            for i in (-1, 0, 1):
                parent.scores[(k + i) % BINS] = -1.0
            t.append(n)
            self._add(n)
            new.append(n)
        new += self._take_up()
        if new:
            profiles = self._profiles(new)
            self._score(new)
            self._look_aside(new, profiles)
            for (tree, node), (to_tree, to_node, kind) in self._similar(new).items():
                n, x = self.trees[tree][node], self.trees[to_tree][to_node]
                x.scores = [y if y > z and z > -0.5 else z for y, z in zip(n.scores, x.scores)]
                n.scores = [0.0] * BINS
                n.merged_tree, n.merged_node, n.kind = to_tree, to_node, kind
                heapq.heappush(self.open[x.tree], (x.depth, x.node))
        self.rounds += 1
        return len(new)

    def explore(self, rounds: int = ROUNDS, folder: str | None = None, every: int = CHECKPOINT, one_by_one: bool = False) -> int:
        """Grow until nothing is left or ``rounds`` have been made, with a checkpoint in ``folder`` every so often; the number of nodes.

        ``one_by_one``: a tree is grown to its end before the next one, in place of all at a time.
        """
        if not self.trees and not (folder and self.load(folder)):
            self.plant()
        for _ in range(rounds):
            if not self.step(one_by_one):
                break
            if folder and self.rounds % every == 0:
                self.save(folder)
        if folder:
            self.save(folder)
        return sum(len(t) for t in self.trees)


def close_merges(nodes: DataFrame, threshold: float = 0.0001) -> DataFrame:
    """``nodes`` (of NODES) with merges carried on: as long as the ancestors of a merged node, one after the other and up to eight, lie within ``threshold`` of the target's way, they merge into its nearest node there."""
    live = nodes.filter("not removed")

    def ancestors(start: DataFrame, most: int) -> DataFrame:
        """start's key columns, tree, node, step and the place of the ancestor at each step."""
        up = nodes.select("tree", F.col("node").alias("at"), F.col("parent").alias("up"), "lat", "lon", F.col("removed").alias("gone"))
        now = start.withColumn("step", F.lit(0)).join(up, ["tree", "at"])
        out = now
        for k in range(1, most):
            now = now.filter("at <> up").select(*[c for c in start.columns if c != "at"], F.col("up").alias("at"), F.lit(k).alias("step")).join(up, ["tree", "at"])
            out = out.unionByName(now)
        return out

    merged = live.filter("merged_tree >= 0").select(F.struct("tree", "node").alias("key"), "tree", F.col("parent").alias("at"), "merged_tree", "merged_node")
    own = ancestors(merged.select("key", "tree", "at"), 8)
    target = ancestors(merged.select("key", F.col("merged_tree").alias("tree"), F.col("merged_node").alias("at")), 8)
    whole = target.groupBy("key").agg(F.count("*").alias("n"), F.max(F.when(F.col("step") == 0, F.col("gone"))).alias("gone")).filter("n = 8 and not gone").select("key")
    piece = target.select("key", F.col("step").alias("j"), F.col("tree").alias("to_tree"), F.col("at").alias("to_node"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    after = target.select("key", (F.col("step") - 1).alias("j"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    lines = piece.join(after, ["key", "j"]).join(whole, "key")
    k = F.cos(F.radians("lat"))
    d = geo.point_segment(F.col("lat"), F.col("lon") * k, F.col("a_lat"), F.col("a_lon") * k, F.col("b_lat"), F.col("b_lon") * k)
    best = own.join(lines, "key").groupBy("key", "step", "tree", "at").agg(F.min(F.struct(d.alias("d"), "j", "to_tree", "to_node")).alias("best"))
    miss = best.filter(F.col("best.d") >= threshold).groupBy("key").agg(F.min("step").alias("miss"))
    hits = best.join(miss, "key", "left").filter(F.col("miss").isNull() | (F.col("step") < F.col("miss")))
    one = hits.groupBy("tree", F.col("at").alias("node")).agg(F.min(F.struct(F.col("best.d").alias("d"), F.col("best.to_tree").alias("t"), F.col("best.to_node").alias("n"))).alias("m"))
    out = nodes.join(one, ["tree", "node"], "left")
    pick = lambda c, v: F.when(F.col("m").isNotNull(), F.col(v)).otherwise(F.col(c)).alias(c)
    return out.select(*(pick(c, {"merged_tree": "m.t", "merged_node": "m.n"}[c]) if c in ("merged_tree", "merged_node") else F.col(c) for c in nodes.columns))


def forest_graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The road graph of a forest: vertices (id, key, lat, lon, terminate) and edges (id, src, dst, score).

    A merged node's edge ends at the node; a second edge leads on to what it is
    merged into, at the end of its chain. A parent that is merged is stood for
    by its target. ids are tree * 10,000,000 + node.
    """
    from ..operators.graph import dedupe_edges, resolve_chains

    ident = lambda t, n: F.col(t).cast("long") * 10_000_000 + F.col(n)
    rows = nodes.withColumn("id", ident("tree", "node")).withColumn("up", F.col("tree").cast("long") * 10_000_000 + F.col("parent"))
    merged = rows.filter("merged_tree >= 0").select("id", ident("merged_tree", "merged_node").alias("to"))
    chains = resolve_chains(merged.unionByName(rows.filter("merged_tree < 0").select("id", F.col("id").alias("to"))))
    live = rows.filter("not removed").select("id", "up")
    to = chains.select(F.col("id").alias("up"), F.col("target").alias("src"))
    grown = live.filter("id <> up").join(to, "up").select("src", F.col("id").alias("dst"))
    over = live.join(chains, "id").filter("id <> target").select(F.col("id").alias("src"), F.col("target").alias("dst"))
    edges = grown.unionByName(over).filter("src <> dst").withColumn("id", F.xxhash64("src", "dst")).withColumn("score", F.lit(0.0)).select("id", "src", "dst", "score")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    vertices = rows.join(ends, "id").select("id", F.concat_ws("_", "tree", "node").alias("key"), "lat", "lon", F.col("outside").alias("terminate"))
    return vertices, dedupe_edges(edges)
