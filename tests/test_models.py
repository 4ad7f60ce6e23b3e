import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from screeline.operators import pairs, ratings, stats
from screeline.staging import Staging
from screeline.streaming import votes as stream


def votes(spark, rows):
    """(voter, a, b, outcome) rows in order."""
    full = [(i, f"e{i}", v, a, b, a, o, 1, "dry_summer", "training", dt.datetime(2025, 6, 1) + dt.timedelta(minutes=i), f"h{i}") for i, (v, a, b, o) in enumerate(rows)]
    return spark.createDataFrame(full, "seq long, id string, voter string, route_a string, route_b string, left_route string, outcome string, completed_both int, conditions string, lane string, received timestamp, payload_hash string")


def test_elo_replay_equals_a_plain_fold(spark):
    rng = np.random.default_rng(0)
    rows = [("v", f"r{a}", f"r{b}", o) for a, b, o in zip(rng.integers(0, 12, 400), rng.integers(0, 12, 400), rng.choice(["A", "b ", "tie", "skip"], 400))]
    got = {r["item"]: r.rating for r in ratings.elo_replay(ratings.qualified(votes(spark, rows))).collect()}
    want = {}
    for _, a, b, o in rows:
        if a == b or o == "skip":
            continue
        ra, rb = want.get(a, 1500.0), want.get(b, 1500.0)
        d = 24 * ({"A": 1, "b ": 0, "tie": 0.5}[o] - 1 / (1 + 10 ** ((rb - ra) / 400)))
        want[a], want[b] = ra + d, rb - d
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1500 * len(got))
    first = {r["item"]: r.rating for r in ratings.elo_replay(votes(spark, [("v", "a", "b", "A")])).collect()}
    assert first == {"a": 1512.0, "b": 1488.0}
    assert ratings.elo_replay(votes(spark, []).limit(0)).count() == 0


def test_strengths_solve_the_gradient_and_order(spark):
    v = votes(spark, [(w, "a", "b", "A") for w in "xyz"] + [(w, "b", "c", "A") for w in "xyz"])
    ids, e = ratings.cohort_votes(v, spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "r string"), "r")
    at = {r: i for i, r in enumerate(ids)}
    s, cov = ratings.fit_strengths(4, e.route_a.map(at).to_numpy(int), e.route_b.map(at).to_numpy(int), e.w.to_numpy(float), e.win.to_numpy(float))
    assert s[0] > s[1] > s[2] and s.sum() == pytest.approx(0) and e.w.sum() == pytest.approx(3)
    assert np.allclose(cov.sum(0), 0, atol=1e-9) and (np.diag(cov) > 0).all()
    b = {r["item"]: (r.low, r.high) for r in ratings.voter_bootstrap(v, ids, 40).collect()}
    assert b["a"][0] > b["c"][1]


def test_hourly_counts_exclude_the_edge(spark):
    t0 = dt.datetime(2025, 1, 1)
    d = spark.createDataFrame([("v", t0 + dt.timedelta(seconds=s)) for s in (0, 1, 3600, 3601)], "voter string, received timestamp")
    assert [r.before for r in ratings.hourly_counts(d).orderBy("received").collect()] == [0, 1, 1, 1]


def test_once_conflicts_and_outcomes(spark):
    v = votes(spark, [("v", "a", "b", "left"), ("v", "a", "b", "right"), ("v", "a", "b", "Tie "), ("v", "a", "b", "?")])
    v = v.withColumn("left_route", F.col("route_b"))
    o = [r[0] for r in v.orderBy("seq").select(ratings.outcome_of(F.col("outcome"), F.col("left_route"), F.col("route_a"))).collect()]
    assert o == ["B", "A", "tie", None]
    twice = v.unionByName(v.filter("seq = 0")).unionByName(v.filter("seq = 1").withColumn("payload_hash", F.lit("x")))
    assert ratings.delivered_once(twice).count() == 4
    assert {r.id: r.verdict for r in ratings.event_conflicts(twice).collect()} == {"e0": "replay", "e1": "conflict"}


def test_pair_choice():
    p = ratings.pair_priority(["a", "b", "c"], {"a": "a", "b": "a", "c": "c"}, {"a": 3, "b": 1}, {("a", "b"): 2}, {"a": "g", "b": "g", "c": "h"}, None, {"a": [1.0, 2], "c": [5.0, 0]})
    want = [(1 + 1 / math.sqrt(8)) / 3, 1 + 1 + 1 / 2 + 2 + 0.25, 1 + 1 + 1 / math.sqrt(2) + 0.25]
    assert p.priority.tolist() == pytest.approx(want) and p.probability.sum() == pytest.approx(1)
    assert ratings.draw_pair(p, 0.0, 0.7) == {"a": "a", "b": "b", "left": "b", "probability": pytest.approx(p.probability[0] / 2)}
    assert ratings.draw_pair(p, 0.999999, 0.1)["b"] == "c"


def test_evaluation_pool_size(spark):
    pool = ratings.evaluation_pool(spark.createDataFrame([(f"r{i}",) for i in range(8)], "r string"), "r")
    assert pool.count() == round(28 * 0.2) and pool.filter("a >= b").count() == 0


def test_components_and_loadings():
    x = np.random.default_rng(3).normal(size=(60, 4)) @ np.random.default_rng(4).normal(size=(4, 4))
    z = stats.standardised(x)
    p = stats.pca(z)
    w = np.linalg.eigvalsh(np.cov(z.T, ddof=0))[::-1]
    assert np.allclose(p["share"], w / w.sum()) and (p["components"][np.arange(4), np.abs(p["components"]).argmax(1)] > 0).all()
    corr = np.array([[np.corrcoef(z[:, j], p["scores"][:, i])[0, 1] for i in range(4)] for j in range(4)])
    assert np.allclose(p["loadings"], corr)
    low, high = stats.bootstrap_loadings(x, p["components"], 50)
    assert (low <= high).all()


def test_embedding_measures():
    line = np.array([[0.0], [1], [3], [10], [20], [30]])
    assert stats.exact_neighbours(line, 2).tolist() == [[1, 2], [0, 2], [1, 0], [2, 1], [3, 5], [4, 3]]
    assert stats.trustworthiness(line, line, 2) == 1 and stats.neighbour_agreement(line, -line, 2) == 1
    rng = np.random.default_rng(0)
    two = np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (20, 3))])
    label, s = stats.chosen_clusters(two)
    assert len(set(label[:20])) == 1 and label[0] != label[-1] and s > 0.9
    assert (stats.stability(two, label, 10) == 1).all()
    for e in (stats.tsne(two), stats.umap(two)):
        assert stats.trustworthiness(two, e, 5) > 0.8
    low, high = stats.padded_domain(np.array([[0.0, 1], [10, 1]]))
    assert low.tolist() == pytest.approx([-0.8, 0.92]) and high.tolist() == pytest.approx([10.8, 1.08])


def test_linear_scorer_recovers_its_target():
    rng = np.random.default_rng(0)
    z, w = rng.normal(size=(30, 3)), np.array([0.3, -0.4, 0.5])
    every = pairs.Comparisons.under(z @ w)
    e = pairs.judged(z @ pairs.linear_weights(z, every, 1e-8), z @ w)
    assert e["excess"] < 1e-8 and e["spearman"] > 0.999 and e["accuracy"] == 1 and e["pairs"] == 435
    flat = pairs.judged(np.zeros(30), z @ w)
    assert flat["spearman"] is None and flat["accuracy"] == 0.5
    scorer, epoch = pairs.train_scorer(z, every, 1, check=(z, every))
    assert pairs.judged(scorer(z), z @ w)["spearman"] > 0.9 and epoch > 1


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    z, ref = rng.normal(size=(7, 3)), rng.normal(size=7)
    every = pairs.Comparisons.under(ref, rng.integers(1, 4, 7))
    s = rng.normal(size=7)
    slope, laplacian = every.slope(s)
    bump = np.eye(7) * 1e-5
    assert np.allclose(slope, [(every.loss(s + d) - every.loss(s - d)) / 2e-5 for d in bump], atol=1e-8)
    assert np.allclose(laplacian, [(every.slope(s + d)[0] - every.slope(s - d)[0]) / 2e-5 for d in bump], atol=1e-7)
    scorer, mask = pairs.Scorer(3, 4, 5), rng.binomial(1, 0.7, (7, 4)) / 0.7

    def penalised(flat):
        into, offset, out = scorer.parts(flat)
        return every.loss((np.tanh(z @ into + offset) * mask) @ out) + 0.05 * ((into**2).sum() + (out**2).sum())

    base = scorer.flat.copy()
    want = [(penalised(base + d) - penalised(base - d)) / 2e-5 for d in np.eye(len(base)) * 1e-5]
    assert np.allclose(scorer.slope(z, every, mask, 0.1), want, atol=1e-7)


def test_resamples_weigh_pairs_by_copies():
    """The weighted pairs of a resample are the pairs of its rows, written out, but for a row's copies."""
    rng = np.random.default_rng(2)
    ref, s, copies = rng.normal(size=6), rng.normal(size=6), np.array([2, 0, 1, 3, 1, 0])
    there = copies > 0
    weighed = pairs.Comparisons.under(ref[there], copies[there])
    rows = np.repeat(np.arange(6), copies)
    plain = [(ref[i] - ref[j], s[i] - s[j]) for n, i in enumerate(rows) for j in rows[n + 1 :] if i != j]
    assert weighed.pairs == len(plain)
    assert weighed.loss(s[there]) == pytest.approx(np.mean([np.logaddexp(0, d) - d / (1 + np.exp(-r)) for r, d in plain]))
    low, high = pairs.excess_interval(s, ref, np.array(list("aabbcc")), 50)
    assert low <= high and pairs.excess_interval(s[:2], ref[:2], np.array(["a", "a"])) is None


def test_rank_agreement_by_hand():
    assert pairs.rank_agreement(np.array([1.0, 2, 3]), np.array([10.0, 20, 5])) == (pytest.approx(-0.5), pytest.approx(-1 / 3))
    assert pairs.rank_agreement(np.array([1.0, 1, 3]), np.array([1.0, 2, 3]))[1] == pytest.approx(2 / math.sqrt(6))
    assert pairs.rank_agreement(np.ones(3), np.arange(3.0)) == (None, None)


def test_cohorts_too_large_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(pairs, "LARGEST_COHORT", 3)
    many = spark.createDataFrame([(f"r{i}", 1.0) for i in range(4)], "r string, x double")
    for form in (lambda: pairs.unordered_pairs(many, "r", ["x"]), lambda: ratings.evaluation_pool(many, "r"), lambda: pairs.Comparisons.under(np.zeros(4))):
        with pytest.raises(ValueError):
            form()


def test_neighbours_by_blocks_are_those_of_one():
    x = np.random.default_rng(3).integers(0, 4, (50, 2)).astype(float)
    assert (stats.exact_neighbours(x, 6, 7) == stats.exact_neighbours(x, 6)).all()
    assert stats.neighbour_agreement(x, x, 4) == 1


def test_grouped_split_keeps_groups():
    groups = [f"g{i // 2}" for i in range(40)]
    s = pairs.grouped_split(groups, 1)
    parts = [{groups[i] for i in rows} for rows in s.values()]
    assert not parts[0] & parts[1] and not parts[0] & parts[2] and not parts[1] & parts[2] and sum(map(len, s.values())) == 40
    with pytest.raises(ValueError):
        pairs.teacher_weights(["a"], {"k": 0.5}, {"a": "k"})


def test_answers_in_time(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1, 10)
    a = spark.createDataFrame([("x", "v", t0), ("y", "v", t0)], "assignment_id string, owner string, created timestamp")
    b = spark.createDataFrame([("1", "x", "v", t0 + dt.timedelta(minutes=5)), ("2", "y", "v", t0 + dt.timedelta(hours=2)), ("3", "x", "w", t0)], "id string, assignment_id string, voter string, received timestamp")
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    s = stream.answered_in_time(spark.readStream.schema(a.schema).parquet(str(tmp_path / "a")), spark.readStream.schema(b.schema).parquet(str(tmp_path / "b")), "1 day", 1900)
    assert [r.id for r in stream.drain(s, "timely", "append", Staging(spark, "t")).collect()] == ["1"]


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 1, 0, 2]])
def test_running_elo_equals_the_replay(spark, tmp_path, order):
    """Files in order and shuffled, components that a later file joins, rows delivered again."""
    rng = np.random.default_rng(5)
    rows = [("v", f"r{a}", f"r{b}", o) for a, b, o in zip(rng.integers(0, 3, 30), rng.integers(3, 6, 30), rng.choice(["A", "B", "tie"], 30))]
    rows += [("v", f"s{a}", f"s{b}", o) for a, b, o in zip(rng.integers(0, 3, 30), rng.integers(3, 6, 30), rng.choice(["A", "B", "tie"], 30))]
    rows = [rows[i] for i in rng.permutation(60)] + [("v", "r1", "s1", "A")] + rows[:9] + [("v", "t1", "t2", "B")]
    v = votes(spark, rows)
    staging = Staging(spark, "t")
    elo = stream.RunningElo(spark, staging)
    log = stream.OnceLog(spark, staging, v.schema, "id", "received", lambda new, n: elo(ratings.qualified(new), n))
    for n, i in enumerate(order):
        part = v.filter(F.floor(F.col("seq") / 18) == i)
        log(part.unionByName(v.filter("seq % 25 = 0")) if n else part, n)
    log(part, n)  # the last batch is run again after a failure
    log(v, n + 1)
    got = {r["item"]: (pytest.approx(r.rating), r.votes) for r in elo.ratings().collect()}
    assert got == {r["item"]: (r.rating, r.votes) for r in ratings.elo_replay(v).collect()} and len(got) == 14
    assert log.log().count() == v.count()


def test_stream_of_files_is_drained_once(spark, tmp_path):
    v = votes(spark, [("v", "a", "b", "A"), ("w", "a", "c", "B"), ("v", "b", "c", "tie")])
    v = v.withColumn("received", F.when(F.col("seq") > 0, F.col("received")))
    for part in (v, v.filter("seq > 0"), v.limit(0)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
    staging = Staging(spark, "t")
    log = stream.OnceLog(spark, staging, v.schema, "id", "received")
    stream.drain(stream.vote_stream(spark, str(tmp_path / "v"), v.schema, 1), "log", "append", staging, log)
    assert sorted(r.id for r in log.log().collect()) == ["e0", "e1", "e2"]


def test_repetitions_are_those_of_the_reference(monkeypatch):
    """50 starts, 100 resamples of 50 starts, 1500 rounds."""
    import inspect

    real, starts = stats.kmeans, []

    def counted(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        starts.append(bound.arguments["starts"])
        return real(*args, **kwargs | {"starts": 1})

    monkeypatch.setattr(stats, "kmeans", counted)
    two = np.random.default_rng(0).normal(0, 1, (20, 3)) + np.repeat([[0], [8]], 10, 0)
    label, _ = stats.chosen_clusters(two)
    assert set(starts) == {50}
    starts.clear()
    stats.stability(two, label)
    assert starts == [50] * 100
    assert inspect.signature(stats.tsne).parameters["rounds"].default == 1500


def test_hourly_counts_keep_votes_without_a_time(spark):
    import duckdb

    t0 = dt.datetime(2025, 1, 1)
    d = spark.createDataFrame([(1, "v", None), (2, "v", None), (3, "v", t0), (4, "v", t0 + dt.timedelta(seconds=9)), (5, "w", None), (6, None, t0), (7, None, None)], "id int, voter string, received timestamp")
    votes = d.toPandas()  # noqa: F841 - read by the SQL
    want = duckdb.sql("SELECT id, count(*) OVER (PARTITION BY voter ORDER BY epoch_us(received::TIMESTAMP) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS before FROM votes").fetchall()
    assert sorted((r.id, r.before) for r in ratings.hourly_counts(d).collect()) == sorted(want) and len(want) == 7
