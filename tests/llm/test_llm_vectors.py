"""Clusters and neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from screeline.llm import hnsw
from screeline.llm.clusters import cluster_report, grid_clusters
from screeline.llm.neighbors import kd_tree, mutual_pairs, nearest_neighbours, node_boxes, reached_leaves, shard_of
from screeline.llm.vectors import route_vectors


def frame(spark, x, extra=()):
    rows = [(f"{i:05}", [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "id string, x array<double>")


def chains(x, radius):
    label = np.arange(len(x))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= radius
    while True:
        new = np.where(d, label[None], len(x)).min(1)
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_clusters_are_the_chains(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.uniform(0, 8, (250, 3)), rng.normal(4, 0.3, (200, 3)), np.repeat(rng.uniform(0, 8, (2, 3)), 40, 0), np.linspace([10, 10, 10], [20, 11, 10], 40)])
    x = np.concatenate([x, rng.integers(0, 2, (len(x), 1)) * 2.5], 1)
    members, cells = grid_clusters(frame(spark, x), "id", "x", radius=0.6, dims=4, stepped=1, least=4)
    label = chains(x, 0.6)
    want = {f"{i:05}": f"{c:05}" for i, c in enumerate(label) if (label == c).sum() >= 4}
    got = {r.id: (r.head, r["size"]) for r in members.collect()}
    assert {i: h for i, (h, _) in got.items()} == want
    assert all(n == list(want.values()).count(h) for h, n in got.values())
    report = {r.head: r for r in cluster_report(members, cells, "id").collect()}
    assert set(report) == set(want.values()) and all(1 <= len(r.typical) <= 3 and all(want[t] == h for t in r.typical) for h, r in report.items())


@pytest.mark.parametrize("heavy", [1, 30])
def test_clusters_by_halved_boxes(spark, heavy):
    """The same chains where pairs of cells are halved down to a few members."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.uniform(0, 5, (120, 2)), rng.normal(2, 0.2, (120, 2)), rng.normal([2.9, 2], 0.15, (120, 2)), np.repeat([[4.4, 4.4]], 30, 0)])
    members, _ = grid_clusters(frame(spark, x), "id", "x", radius=0.3, dims=2, least=3, heavy=heavy)
    label = chains(x, 0.3)
    want = {f"{i:05}": f"{c:05}" for i, c in enumerate(label) if (label == c).sum() >= 3}
    assert {r.id: r.head for r in members.collect()} == want


def test_clusters_without_steps_nulls_and_empty(spark):
    d = frame(spark, np.zeros((6, 2)), [("n", None), (None, [0.0, 0.0])])
    members, _ = grid_clusters(d, "id", "x", radius=1.0, dims=2, least=5)
    assert {r.head for r in members.collect()} == {"00000"} and members.count() == 6
    members, cells = grid_clusters(d.limit(0), "id", "x", radius=1.0, dims=2)
    assert members.count() == cells.count() == 0


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, 1)


def test_boxes_down_the_tree_are_all_boxes():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (500, 3))
    nodes = kd_tree(x, 9)
    leaf = shard_of(x, nodes)
    low, high = {int(i): x[leaf == i].min(0) for i in set(leaf) - {4}}, {int(i): x[leaf == i].max(0) for i in set(leaf) - {4}}
    reach = rng.uniform(0, 1, 500)
    r, c = reached_leaves(x, reach, nodes, *node_boxes(nodes, low, high, 3))
    want = {(i, j) for i in range(500) for j in low if (np.maximum(0, np.maximum(low[j] - x[i], x[i] - high[j])) ** 2).sum() < reach[i]}
    assert set(zip(r.tolist(), c.tolist())) == want and len(r) == len(want)


def test_leaves_that_turn_out_large_are_cut(spark):
    """A dense cloud that a tiny sample misses: its leaf becomes several shards."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 3, (60, 3)), rng.normal(9, 0.1, (540, 3))])
    near = nearest_neighbours(frame(spark, x), "id", "x", dims=3, k=4, shards=2, shard_rows=100, sample=6, sample_shard=1)
    want, far = brute(x, 4)
    got = {r.id: [(n.d, n.id) for n in r.neighbours] for r in near.collect()}
    hits = sum(len({n for _, n in got[f"{i:05}"]} & {f"{j:05}" for j in w}) for i, w in enumerate(want))
    assert len(got) == 600 and hits > 0.97 * 2400


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (1500, 6)), rng.normal(8, 0.05, (500, 6))])
    level = hnsw.levels(rng.random(len(x)), 8)
    order = np.argsort(-level, kind="stable")
    x, level = x[order], level[order]
    layers = hnsw.build(x, level, 8, 32, batch=256)
    number, dist = hnsw.search(x, layers, x, 11, 32)
    want, _ = brute(x, 10)
    hits = [len(set(n[n != i][:10]) & set(w)) for i, (n, w) in enumerate(zip(number, want))]
    assert np.mean(hits) > 9.7 and (np.diff(dist, axis=1) >= 0).all()
    assert all((a < len(a)).all() and a.shape[1] in (8, 16) for a in layers)


def test_tree_cuts_everything():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 3)), np.ones((50, 3))])
    shard = shard_of(x, kd_tree(x, 8))
    assert set(shard) == set(range(8)) and np.bincount(shard).max() < 120
    assert set(shard_of(x, kd_tree(np.ones((5, 3)), 4))) == {0}


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 3, (500, 4)), rng.normal(5, 0.02, (100, 4)), np.repeat(rng.normal(0, 3, (3, 4)), [2, 5, 40], 0)])
    d = frame(spark, x, [("n", None), ("s", [1.0]), (None, [0.0] * 4), ("m", [None, 1.0, 1.0, 1.0])])
    got = {r.id: r.neighbours for r in nearest_neighbours(d, "id", "x", dims=4, k=10, shards=5).collect()}
    assert len(got) == len(x) and all(len(n) == 10 for n in got.values())
    order, dist = brute(x, 10)
    hits = np.mean([len({n.id for n in got[f"{i:05}"]} & {f"{j:05}" for j in order[i]}) / 10 for i in range(len(x))])
    assert hits > 0.97
    assert all(n.id != i and n.d == pytest.approx(np.sqrt(((x[int(i)] - x[int(n.id)]) ** 2).sum()), abs=1e-9) for i, ns in got.items() for n in ns)
    last = got["00646"]  # one of forty equal vectors: the least of the others, in order
    assert [n.id for n in last] == [f"{607 + i:05}" for i in range(10)] and last[0].d == 0
    pairs = {(r.a, r.b) for r in mutual_pairs(nearest_neighbours(d, "id", "x", dims=4, k=10, shards=5), "id", 0.05).collect()}
    near = [{j for j, v in zip(o, dd) if v <= 0.05} for o, dd in zip(order, dist)]
    want = {(f"{i:05}", f"{j:05}") for i in range(len(x)) for j in near[i] if i < j and i in near[j]}
    assert len(pairs & want) >= 0.97 * len(want) and len(pairs - want) <= 0.03 * len(want)


def test_few_points(spark):
    assert nearest_neighbours(frame(spark, np.zeros((0, 2))), "id", "x", dims=2).count() == 0
    one = nearest_neighbours(frame(spark, np.zeros((1, 2))), "id", "x", dims=2).collect()
    assert [(r.id, r.neighbours) for r in one] == [("00000", [])]
    three = nearest_neighbours(frame(spark, np.array([[0.0, 0], [0, 0], [3, 4]])), "id", "x", dims=2, k=5).collect()
    assert {r.id: [(n.d, n.id) for n in r.neighbours] for r in three} == {"00000": [(0, "00001"), (5, "00002")], "00001": [(0, "00000"), (5, "00002")], "00002": [(5, "00000"), (5, "00001")]}


def test_route_vectors(spark):
    names = "gpx_distance_mi, gpx_gain_ft, crux_density_medium, crux_density_extreme, longest_medium_section_mi, longest_extreme_section_mi".split(", ")
    schema = "route_id string, exported_at int, " + ", ".join(f"{n} double" for n in names) + ", yds_class int, exposure string, rockfall string, route_finding string, commitment string"
    rows = [("a", 1, *[0.0] * 6, 1, *["Low"] * 4), ("a", 2, 1.0, 250.0, 2.5, 1.5, 0.04, 0.02, 2, " LOW", "Moderate", "high ", "Extreme"), ("b", 1, *[1.0] * 6, None, *["Low"] * 4), ("c", 1, *[1.0] * 6, 1, "unknown", *["Low"] * 3)]
    got = route_vectors(spark.createDataFrame(rows, schema)).collect()
    assert [r.route_id for r in got] == ["a"] and got[0].x == pytest.approx([1, 1, 1, 1, 1, 1, 5, 0, 2.5, 7.5, 10])
    assert route_vectors(spark.createDataFrame(rows, schema).filter(F.lit(False))).count() == 0
