"""Rank fusion, pairwise strengths and splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF, against_sql
from screeline.llm import queries
from screeline.llm.fusion import fused_ranking, leaders, reciprocal_rank_fusion
from screeline.llm.pairwise import counted_votes, pairwise_strengths
from screeline.llm.splits import assign_splits, related_groups, route_keys, spanning_forest
from screeline.staging import Staging


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    against_sql(spark, SF, queries.QUERIES[name], queries.ORACLES[name])


def scores(spark, rows):
    return spark.createDataFrame(rows, "id string, a double, b double, `rank` string, `_item` string")


def test_fusion_by_hand(spark):
    d = scores(spark, [("x", 3.0, 1000.0, "", ""), ("y", 2.0, 2000.0, "", ""), ("z", 2.0, None, "", ""), ("w", None, float("nan"), "", ""), (None, 1.0, 1.0, "", "")])
    r = {x.id: x for x in reciprocal_rank_fusion(d, "id", ["a", "b"]).collect()}
    assert r["x"].fused == pytest.approx(1 / 61 + 1 / 62) and r["y"].fused == pytest.approx(1 / 62 + 1 / 61)
    assert r["z"].n_scores == 1 and r["z"].rank_a == 2 and r["z"].rank_b is None
    assert (r["w"].n_scores, r["w"].fused) == (0, 0.0) and r[None].n_scores == 2 and r[None].rank_a == 4
    p = {x.id: x.position for x in fused_ranking(d, "id", ["a", "b"]).collect()}
    assert p["x"] == p["y"] == 1 and p["w"] == 5
    assert reciprocal_rank_fusion(d.limit(0), "id", ["a", "b"]).count() == 0


def test_fusion_is_blind_to_scale(spark):
    rng = np.random.default_rng(0)
    rows = [(str(i), float(rng.normal()), float(rng.normal()), "", "") for i in range(300)]
    one = {x.id: x.position for x in fused_ranking(scores(spark, rows), "id", ["a", "b"]).collect()}
    wide = scores(spark, rows).withColumn("b", F.exp(F.col("b") * 20))
    assert one == {x.id: x.position for x in fused_ranking(wide, "id", ["a", "b"]).collect()}


def test_leaders_come_from_the_fused_ranking(spark):
    rng = np.random.default_rng(1)
    names = ["a", "b", "c", "d"]
    level = rng.normal(size=400)
    rows = [(str(i), *[float(level[i] + 0.4 * rng.normal()) if rng.random() > 0.15 else None for _ in names]) for i in range(400)]
    d = spark.createDataFrame(rows, "id string, a double, b double, c double, d double")
    want = reciprocal_rank_fusion(d, "id", names).filter("n_scores >= 3 and worst_share < 0.1")
    got = leaders(d, "id", names, 3, 0.1)
    assert {r.id for r in got.collect()} == {r.id for r in want.collect()} and want.count() > 5 and "position" in got.columns
    plan = queries.QUERIES["p3_found"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "fused" in plan


VOTE = "voter string, a string, b string, o string, t int, n int"


def test_counted_votes(spark):
    v = spark.createDataFrame(
        [("v", "x", "y", "A", 1, 1), ("v", "x", "y", "A", 1, 1), ("v", "y", "x", "A", 2, 2), ("w", "y", "x", "B", 1, 3), (None, "x", "y", "B", 1, 4), (None, "x", "y", "A", 2, 5), ("v", "x", "x", "A", 1, 6), ("v", None, "x", "A", 1, 7)], VOTE
    )
    assert [tuple(r) for r in counted_votes(v, "voter", "a", "b", F.col("o") == "A", "t", "n").collect()] == [("x", "y", 3, 2)]


def newton(pairs, items, ridge):
    at = {x: i for i, x in enumerate(items)}
    a, b = np.array([at[p[0]] for p in pairs]), np.array([at[p[1]] for p in pairs])
    n, w = np.array([p[2] for p in pairs], float), np.array([p[3] for p in pairs], float)
    s = np.zeros(len(items))
    for _ in range(50):
        p = 1 / (1 + np.exp(s[b] - s[a]))
        c = n * p * (1 - p)
        h = np.diag(np.bincount(a, c, len(s)) + np.bincount(b, c, len(s)) + ridge)
        np.add.at(h, (a, b), -c)
        np.add.at(h, (b, a), -c)
        s = s + np.linalg.solve(h, np.bincount(a, w - n * p, len(s)) - np.bincount(b, w - n * p, len(s)) - ridge * s)
    return dict(zip(items, s))


@pytest.mark.parametrize("blocks", [1, 5])
def test_strengths_equal_a_dense_solution(spark, blocks):
    rng = np.random.default_rng(1)
    true = rng.normal(0, 1.5, 40)
    rows = []
    for i in range(40):
        for j in {0, *rng.integers(0, 40, 3)} - {i}:  # item 0 meets everyone
            n = int(rng.integers(1, 6))
            lo, hi = min(i, j), max(i, j)
            rows.append((f"r{lo:02}", f"r{hi:02}", n, int(rng.binomial(n, 1 / (1 + np.exp(true[hi] - true[lo]))))))
    rows = list({r[:2]: r for r in rows}.values()) + [("z1", "z2", 3, 3)]
    d = spark.createDataFrame(rows, "lo string, hi string, n long, wins long")
    got = {r["item"]: r for r in pairwise_strengths(d, blocks=blocks, settled=1e-5, tolerance=1e-8).collect()}
    want = newton(rows, sorted({x for r in rows for x in r[:2]}), 0.1)
    assert {k: r.strength for k, r in got.items()} == pytest.approx(want, abs=1e-3)
    assert got["z1"].votes == got["z1"].wins == 3 and got["z2"].wins == 0 and got["z1"].cyclic < 0.2
    assert pairwise_strengths(d.limit(0)).count() == 0


def test_cycles_show(spark):
    def share(rows):
        d = spark.createDataFrame(rows, "lo string, hi string, n long, wins long")
        return {r["item"]: r.cyclic for r in pairwise_strengths(d, ridge=1e-6, blocks=2).collect()}

    ring = share([("a", "b", 20, 18), ("b", "c", 20, 18), ("a", "c", 20, 2)])
    line = share([("a", "b", 20, 18), ("b", "c", 20, 18)])
    assert all(v > 0.9 for v in ring.values()) and all(v < 0.05 for v in line.values())


def union_find(rows):
    head = {i: i for i, _ in rows}
    owner = {}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, keys in rows:
        for k in keys or []:
            if k is not None:
                a, b = find(i), find(owner.setdefault(k, i))
                head[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_groups_equal_union_find(spark):
    rng = np.random.default_rng(2)
    rows = [(f"{i:04}", [f"k{k}" for k in rng.integers(0, 700, rng.integers(0, 3))]) for i in range(600)]
    rows += [(f"h{i:04}", ["hot"]) for i in range(300)] + [(f"c{i:04}", [f"l{i}", f"l{i + 1}"]) for i in range(150)] + [("n1", None), ("n2", [None, "", ""]), ("n3", [""])]
    d = spark.createDataFrame(rows, "id string, keys array<string>")
    got = {r.id: r for r in related_groups(d, "id", F.col("keys")).collect()}
    want = union_find(rows)
    assert {i: r.head for i, r in got.items()} == want
    sizes = {h: list(want.values()).count(h) for h in want.values()}
    assert all(r["size"] == sizes[r.head] for r in got.values())
    assert related_groups(d.limit(0), "id", F.col("keys")).count() == 0


def test_forest_spans_without_cycles(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (120, 2))]
    forest, labels = spanning_forest(spark.createDataFrame([*edges, *edges[:9]], "u int, v int"), Staging(spark, "t"))
    picked = [(r.u, r.v) for r in forest.collect()]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    roots = {r.node: r.root for r in labels.collect()}
    assert set(roots) == nodes and len(picked) == len(set(picked)) == len(nodes) - len(set(roots.values()))
    assert set(picked) <= {(min(e), max(e)) for e in edges} and all(roots[a] == roots[b] for a, b in picked)


def test_splits_keep_groups_and_proportions(spark):
    rng = np.random.default_rng(4)
    sizes = np.concatenate([[900, 300], rng.integers(1, 12, 500)])
    rows = [(f"{g:04}-{i}", f"{g:04}", int(n)) for g, n in enumerate(sizes) for i in range(n)]
    d = spark.createDataFrame(rows, "id string, head string, size long")
    s = assign_splits(d, "id", {"train": 0.7, "validation": 0.1, "test": 0.2})
    assert s.count() == len(rows) and s.groupBy("head").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    share = {r.split: r["count"] / len(rows) for r in s.groupBy("split").count().collect()}
    assert share == pytest.approx({"train": 0.7, "validation": 0.1, "test": 0.2}, abs=0.02)
    assert assign_splits(d.limit(0), "id", {"a": 1.0}).count() == 0


def test_keys_of_a_status_row(spark):
    row = (" RT1", "https://h/route.php?route=q1#x", "0" * 64, " rt2 ;Grp-1|-", "N/A,rt3")
    d = spark.createDataFrame([row, (None,) * 5], "route_id string, source_url string, geometry_sha256 string, evaluation_group string, related_itinerary_group string")
    got = [r[0] for r in d.select(route_keys()).collect()]
    assert sorted(got[0]) == ["name:grp-1", "name:rt1", "name:rt2", "name:rt3", "page:q1"]
    assert [k for k in got[1] if k] == []
