"""Trip preparation, sources and sinks on small hand-made trips."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefield.operators import cluster, graph, grid, prep, raster, similarity, trace
from tracefield.plans import components
from tracefield.plans.explore import Forest, Node, close_merges, forest_graph, half_width, sector, smoothed, tops
from tracefield.sources import config, graphs, trips

LINES = "1,42.354546,-71.109656,1\n2,42.364546,-71.099656,2\n3,42.374546,-71.089656,3\n4,42.384546,-71.079656,4\n"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("trips")
    for i in (1, 2):
        (folder / f"trip_{i}.txt").write_text(LINES + "5,1,2\n")  # the last line is short
    (folder / "trip_3.txt").write_text("")
    return prep.build_index(trips.read_trips(spark, str(folder))).persist()


def test_index_of_a_known_trip(index):
    rows = index.filter("trip_id = 1").orderBy("idx").collect()
    assert len(rows) == 4151 and index.count() == 2 * 4151
    assert [r["idx"] for r in rows] == list(range(4151))
    known = {
        0: (42.354582, -71.109620, 0.0, 0.003597, 53.54),
        1: (42.354589, -71.109613, 0.000010173523, 0.003597, 53.54),
        5: (42.354618, -71.109584, 0.000050867615, 0.003597, 53.54),
        1381: (42.364542, -71.099660, 0.014085265754, 0.003597, 53.54),
        2075: (42.369547, -71.094655, 0.021164202913, 0.003611, 53.54),
        4150: (42.384515, -71.079687, 0.042331736670, 0.0, 53.55),
    }
    for i, (lat, lon, total, speed, angle) in known.items():
        r = rows[i]
        assert (round(r["lat"], 6), round(r["lon"], 6), round(r["speed_inv"], 6), round(r["angle"], 2)) == (lat, lon, speed, angle)
        assert abs(r["total_distance"] - total) < 1e-11
    assert (rows[0]["clat"], rows[0]["clon"], rows[-1]["clat"], rows[-1]["clon"]) == (42354, 71109, 42384, 71079)


def test_queries_on_it(spark, index):
    a, b, c = (42.364546, -71.099656), (42.365546, -71.098656), (42.366546, -71.097656)
    circle = spark.createDataFrame([(0, *a, 5e-5)], "qid int, lat double, lon double, radius double")
    rounded = index.select("trip_id", "idx", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "speed_inv")
    rounded = grid.with_cells(rounded)
    assert grid.circle_join(rounded, circle).count() == 20
    assert grid.circle_join(rounded, circle, "equirect").count() == 24
    leg = lambda p, q: spark.createDataFrame([(0, *p, 5e-5, *q, 5e-5, -1.0)], "qid int, lat1 double, lon1 double, r1 double, lat2 double, lon2 double, r2 double, dist double")
    assert {tuple(r)[1:] for r in trace.match(rounded, leg(a, b), ["qid"]).collect()} == {(1, 1381, 1520), (2, 1381, 1520)}
    assert trace.match(rounded, leg(b, a), ["qid"]).collect() == []
    three = spark.createDataFrame([(0, *a, *b, *c, 5e-5, 5e-5, 5e-5, -1.0, -1.0)], "qid int, lat1 double, lon1 double, lat2 double, lon2 double, lat3 double, lon3 double, r1 double, r2 double, r3 double, d1 double, d2 double")
    assert trace.three_point(rounded, three).first()["n_trips"] == 2
    ranked = trace.speed_rank(rounded, spark.createDataFrame([(0, *a, 3e-4, 0.5)], "qid int, lat double, lon double, radius double, ranking double")).first()
    assert (ranked["n_samples"], ranked["n_moving"], ranked["speed"]) == (118, 0, 100.0)
    pair = spark.createDataFrame([(0, *a, *b, 5e-5), (1, *b, *a, 5e-5)], "qid int, lat1 double, lon1 double, lat2 double, lon2 double, radius double")
    one, two = sorted(trace.p2p(rounded, pair).collect(), key=lambda r: r["qid"])
    assert (one["dir_ab"], one["dir_ba"]) == (two["dir_ba"], two["dir_ab"]) and one["n_both"] == 2


def test_cells_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(1)
    points = [(i, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform([-0.004, -0.004], [0.004, 0.004], (600, 2)).round(4))]
    samples = grid.with_cells(spark.createDataFrame(points, "trip_id long, idx int, lat double, lon double"))
    asked = [(k, float(x), float(y), float(r)) for k, (x, y, r) in enumerate(zip(*rng.uniform([[-0.004], [-0.004], [1e-5]], [[0.004], [0.004], [0.0025]], (3, 12)).round(4)))]
    got = {(r["qid"], r["trip_id"]) for r in grid.circle_join(samples, spark.createDataFrame(asked, "qid int, lat double, lon double, radius double")).collect()}
    assert got == {(k, i) for k, x, y, r in asked for i, _, a, b in points if math.sqrt((x - a) ** 2 + (y - b) ** 2) < r}


def test_index_files_round_trip(spark, index, tmp_path):
    trips.write_index(index, f"{tmp_path}/p")
    assert trips.read_index(spark, f"{tmp_path}/p", 1).count() == 4151
    trips.write_index_text(index.filter("idx < 50"), f"{tmp_path}/t")
    back = trips.read_index_text(spark, f"{tmp_path}/t")
    assert back.count() == 100 and back.filter("trip_id = 1 and idx = 5").first()["lat"] == 42.354618


def test_blur_and_peaks_by_hand(spark):
    v = [0.0, 1.0, 3.0, 1.0, 0.0, 0.0, 2.0, 5.0, 5.0]
    assert tops(v) == [0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0, 5.0, 0.0]
    s = smoothed(v)
    assert s[0] == 0 and abs(s[2] - (3 * 0.214607 + 2 * 0.189879)) < 1e-12


def test_spline_and_similarity():
    a = np.array([[1, 1], [2, 2], [3, 2.5], [4, 3]], float)
    assert np.allclose(similarity.spline(a, np.array([0.0, 1.0])), a[[0, -1]])
    assert similarity.spline_similarity(a, a, 1e6)[0] == 0
    assert similarity.spline_similarity(a, a + 10, 1.0)[0] == 1000
    line = np.stack([np.linspace(0, 1e-3, 30), np.zeros(30)], 1)
    assert len(similarity.resample(line)) in (40, 41)
    assert similarity.window_similarity(line, line) < 1e-12
    assert similarity.window_similarity(line[:1], line) == similarity.NEVER


def test_raster_blur_equals_dense(spark):
    rng = np.random.default_rng(3)
    img = np.zeros((40, 40))
    img[rng.integers(0, 40, 30), rng.integers(0, 40, 30)] = rng.integers(1, 9, 30)
    rows = [(0, int(r), int(c), int(img[r, c])) for r, c in zip(*np.nonzero(img))]
    got = raster.dense(raster.blur(spark.createDataFrame(rows, "qid int, row int, col int, cnt long"), ["qid"], 40), 40, 40)
    w = raster.kernel()
    r = len(w) // 2
    padded = np.pad(img, r, mode="symmetric")
    dense = sum(w[k] * padded[k : k + 40, :] for k in range(2 * r + 1))
    dense = sum(w[k] * dense[:, k : k + 40] for k in range(2 * r + 1))
    assert np.allclose(got, dense)


def test_components_both_ways(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6), (7, 7), (6, 5), (8, 20), (20, 21), (21, 22), (22, 1)], "a long, b long")
    one, two = (sorted(map(tuple, components.connected_components(edges, local=n).collect())) for n in (10**6, 0))
    assert one == two and dict(one)[22] == 1 and dict(one)[6] == 5 and 7 not in dict(one)
    assert components.connected_components(edges.limit(0)).collect() == []
    rng = np.random.default_rng(7)
    a, b = np.r_[np.full(300, 500), rng.integers(1000, 1600, 400)], np.r_[np.arange(501, 801), rng.integers(1000, 1600, 400)]  # a hub, and a sparse random graph
    found = components.connected_components(spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long"), local=0)
    apart = a != b
    assert sorted(map(tuple, found.collect())) == sorted(zip(*(x.tolist() for x in components.label(a[apart], b[apart]))))


def test_clusters(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(c, 1e-5, (40, 2)) for c in ((42, -71), (42.001, -71), (42, -71.002))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "pid long, lat double, lon double")
    found = sorted((round(r["lat"], 3), round(r["lon"], 3), r["n"]) for r in cluster.kmeans(df, 3).collect())
    assert sum(n for *_, n in found) == 120
    peaks, _, weights = cluster.lateral_peaks(np.r_[np.zeros(10), [2, 9, 2], np.zeros(20), [3, 8, 3], np.zeros(5)])
    assert len(peaks) == 2 and abs(peaks[0] - 11) <= 1 and abs(sum(weights) - 1) < 1e-9
    assert cluster.lateral_peaks(np.ones(5)) == ([], [], [])


def test_marbles_and_paths(spark):
    v = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.001, 0.0, 1.0), (3, 0.001, 0.001, 1.0)], "id long, lat double, lon double, score double")
    e = spark.createDataFrame([(1, 1, 2, 1.0), (2, 2, 3, 1.0)], "id long, src long, dst long, score double")
    got = graph.marbles(v, e, v.filter("id = 1").select("id"), 0.0004, 0.0015)
    assert {(round(r["lat"], 6), round(r["lon"], 6)) for r in got.collect()} == {(0.0, 0.0), (0.0004, 0.0), (0.0008, 0.0), (0.001, 0.0002)}
    d = {r["id"]: r["distance"] for r in graph.shortest_paths(graph.lengths(e, v).select("src", "dst", "length"), v.filter("id = 1").select("id")).collect()}
    assert abs(d[3] - 0.002) < 1e-6 and d[1] == 0
    assert graph.resolve_chains(spark.createDataFrame([(1, 2), (2, 3), (3, 3), (7, 8), (8, 7)], "id long, to long")).count() == 5


def test_graph_files(spark, tmp_path):
    v = spark.createDataFrame([(1, 42.0, -71.0), (2, 42.1, -71.1)], "id long, lat double, lon double")
    e = spark.createDataFrame([(1, 1, 2), (2, 2, 2)], "id long, src long, dst long")
    text = graphs.graph_json(v, e)
    assert json.loads(text) == {"vertices": {"1": [42.0, -71.0], "2": [42.1, -71.1]}, "edges": [["1", "2"]]}
    (tmp_path / "g.json").write_text(text)
    back = graphs.read_graph_json(spark, f"{tmp_path}/g.json")
    assert back[0].count() == 2 and back[1].count() == 1
    assert json.loads(graphs.geojson(e, v))["features"][0]["geometry"]["coordinates"] == [[-71.0, 42.0], [-71.1, 42.1]]
    assert graphs.svg(e, v).startswith("<svg") and graphs.png(np.ones((2, 3)))[:4] == b"\x89PNG"
    graphs.write_graph(v, e, f"{tmp_path}/graph")
    assert graphs.read_graph(spark, f"{tmp_path}/graph")[0].count() == 2


def test_config_defaults():
    c = config.parse('{"Entrances": [{"Lat": 1, "Lon": 2, "ID": 7}], "Region": [0, 0, 1, 1], "history_length": 5}')
    assert (c.entrances[0].heading, c.history_length, c.least_trips, c.merge_detector) == (-1.0, 5, 2, "kde_based")


@pytest.fixture(scope="module")
def straight(spark):
    """Six trips due north along one road, a sample for each metre."""
    rows = [(t, i, 42.0 + i * 1e-5, -71.0 + t * 2e-6) for t in range(6) for i in range(400)]
    return grid.with_cells(spark.createDataFrame(rows, "trip_id long, idx int, lat double, lon double")).withColumn("speed_inv", F.lit(0.5)).persist()


def test_exploration_follows_the_road(spark, straight, tmp_path):
    c = config.Config([config.Entrance(42.0005, -71.0, 0, 0.0)], region=(41.99, -71.01, 42.01, -70.99))
    forest = Forest(trace.TraceDataset(straight), c)
    forest.explore(rounds=5, folder=f"{tmp_path}/forest")
    nodes = forest.trees[0]
    assert len(nodes) == 6 and all(n.lat > nodes[0].lat for n in nodes[1:])
    assert all(abs(n.lon + 71.0) < 1e-4 for n in nodes)
    again = Forest(trace.TraceDataset(straight), c)
    assert again.load(f"{tmp_path}/forest") and again.rounds == 5 and again.trees[0][-1] == nodes[-1]
    v, e = forest_graph(close_merges(forest.table()))
    assert v.count() == 6 and e.count() == 5


def test_one_tree_after_the_other(straight):
    two = [config.Entrance(42.0005, -71.0, 0, 0.0), config.Entrance(42.0020, -71.0, 1, 0.0)]
    region = (41.99, -71.01, 42.01, -70.99)
    both, one = (Forest(trace.TraceDataset(straight), config.Config(two, region=region)) for _ in range(2))
    both.explore(rounds=2)
    one.explore(rounds=2, one_by_one=True)
    assert [len(t) for t in both.trees] == [3, 3] and [len(t) for t in one.trees] == [3, 1]
    assert [(n.lat, n.lon) for n in one.trees[0]] == [(n.lat, n.lon) for n in both.trees[0]]


def test_sectors_and_widths_equal_the_column_expressions(spark):
    from tracefield.functions import vector as V

    rng = np.random.default_rng(5)
    rows = [(k, int(rng.integers(0, 72)), (rng.random(72) * (rng.random(72) < 0.1)).tolist(), np.maximum(rng.normal(1, 1, 71), 0).tolist()) for k in range(40)]
    table = spark.createDataFrame(rows, "id int, direction int, siblings array<double>, profile array<double>")
    got = {r["id"]: (sorted(r["places"]), r["radius"], r["line"]) for r in table.select("id", V.sector(F.col("direction"), F.col("siblings")).alias("places"), V.radius_of(F.col("profile")).alias("radius"), V.blur_linear(F.col("profile")).alias("line")).collect()}
    for k, direction, siblings, profile in rows:
        places, radius, line = got[k]
        assert places == sector(direction, siblings) and abs(radius - half_width(profile)) < 1e-12
        assert np.allclose(line, smoothed(profile, circular=False))


def test_a_branch_is_seen_from_the_side_and_taken_up(spark, tmp_path):
    """Half of the trips leave the road to the east at 0.0025 degrees; the road's tree is planted past the fork."""
    rows = []
    for t in range(12):
        for i in range(600):
            lat, lon = 42.0 + i * 1e-5, -71.0 + t * 1e-6
            if t % 2 and i > 250:
                lat, lon = 42.0025 + (i - 250) * 0.7e-5, lon + (i - 250) * 0.5e-5
            rows.append((t, i, lat, lon))
    samples = grid.with_cells(spark.createDataFrame(rows, "trip_id long, idx int, lat double, lon double"))
    forest = Forest(trace.TraceDataset(samples), config.Config(region=(41.9, -71.1, 42.1, -70.9)))
    forest.trees = [[Node(0, k, max(0, k - 1), 42.0010 + k * 7.5e-5, -71.0, 0, k) for k in range(36)]]
    forest._look_aside([forest.trees[0][24 + 8]])
    assert forest.branches and all(b.state == "active" and b.shape[-1][1] > -71.0 for b in forest.branches)
    forest.branches = forest.branches[:1]
    forest.branches[0].wait = 10
    ends = forest._take_up()
    assert len(ends) == 1 and forest.branches[0].state == "taken" and not ends[0].dead
    forest.save(f"file://{tmp_path}/b")
    again = Forest(trace.TraceDataset(samples), config.Config())
    assert again.load(f"file://{tmp_path}/b") and again.branches == forest.branches


def test_links_between_roads(spark, straight):
    asked = spark.createDataFrame([(0, 42.0005, -71.0, 42.001, -71.0, 42.0015, -71.0), (1, 42.0005, -71.0, 42.5, -71.0, 42.6, -71.0)], "qid int, lat1 double, lon1 double, lat2 double, lon2 double, lat3 double, lon3 double")
    fast = straight.withColumn("speed_inv", F.lit(0.2))
    got = {r["qid"]: r for r in trace.connected_roads(fast, asked).collect()}
    assert not got[0]["slow"] and got[0]["connected"] and got[0]["n_trips"] >= 3
    assert got[1]["connected"] == got[1]["slow"]


def test_counts_trip_by_trip_equal_those_of_joins(spark, sf):
    """The requests of an exploration, asked of whole trips by each task, count what the joins of ``trace`` count."""
    from tracefield import queries
    from tracefield.operators import trip_match
    from tracefield.operators.grid import with_cells

    samples = with_cells(queries.dense(spark, sf)).cache()
    trips = trip_match.by_trip(samples)
    paths = [[r[2:] for r in queries.PATH if r[0] == q] for q in (0, 1)]
    three = [r[1:] for r in queries.THREE]
    asked = trip_match.Requests()
    for p in paths:
        shared = asked.share(trip_match.history_legs(p))
        for legs in trip_match.probe_legs(p):
            asked.ask(legs, shared)
    for r in three:
        asked.ask(trip_match.three_legs(r))
    expected = {(r["qid"], r["bin"]): r["n_trips"] for r in trace.direction_scores(samples, queries.paths(spark)).collect()}
    tripled = {r["qid"]: r["n_trips"] for r in trace.three_point(samples, queries.values(spark, queries.THREE, queries.THREE_SCHEMA)).collect()}
    got = asked.counts(trips).tolist()
    assert got == [expected[q, b] for q in (0, 1) for b in range(72)] + [tripled[q] for q in (0, 1, 2)] and any(got[:144]) and any(got[144:])
    ways = [([(42.35 + s * i * 7.5e-5, -71.1) for i in range(8)], [(42.35 + s * (i * 7.5e-5 + 2e-5), -71.1 + off) for i in range(8)]) for s in (1, -1) for off in (0.0, 1e-5, 1e-3)]
    place = lambda p: [{"lat": a, "lon": b} for a, b in p]
    kind = "array<struct<lat:double,lon:double>>"
    pairs = spark.createDataFrame([(k, place(a), place(b)) for k, (a, b) in enumerate(ways)], f"pid int, path_a {kind}, path_b {kind}")
    same = {r["pid"]: r["same"] for r in trace.merge_check(samples, pairs).collect()}
    assert trip_match.merge_check(trips, ways) == [same[k] for k in range(len(ways))]
