"""Ratings from an append-only log of votes: replay, batch fits, coverage and pair choice."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screeline.operators.graph import min_label_components
from screeline.operators.pairs import checked_cohort, expit
from screeline.staging import Staging

LARGEST_COHORT = 2_000


def delivered_once(votes: DataFrame, event: str = "id") -> DataFrame:
    """One row for each event id: of rows that differ the one that was received first."""
    rest = [c for c in votes.columns if c != event]
    first = votes.groupBy(event).agg(F.min(F.struct("received", "seq", *[c for c in rest if c not in ("received", "seq")])).alias("v"))
    return first.select(event, "v.*")


def event_conflicts(votes: DataFrame, event: str = "id", payload: str = "payload_hash") -> DataFrame:
    """(event, rows, payloads, verdict): ids delivered again, as replays or with another payload."""
    g = votes.groupBy(event).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(payload).alias("payloads"))
    return g.filter("rows > 1").withColumn("verdict", F.when(F.col("payloads") > 1, "conflict").otherwise("replay"))


def outcome_of(choice: Column, left: Column, a: Column) -> Column:
    """'A' or 'B' for the side that was chosen, given which item stood left; ties and skips and
    outcomes already given pass."""
    c = F.lower(F.trim(choice))
    return F.when(c == "left", F.when(left == a, "A").otherwise("B")).when(c == "right", F.when(left == a, "B").otherwise("A")).when(c.isin("a", "b"), F.upper(c)).when(c.isin("tie", "skip"), c)


def qualified(votes: DataFrame) -> DataFrame:
    """Training votes of voters who completed both items in dry summer and didn't skip."""
    v = votes.withColumn("outcome", outcome_of(F.col("outcome"), F.col("left_route"), F.col("route_a")))
    return v.filter((F.col("completed_both") == 1) & (F.col("conditions") == "dry_summer") & (F.col("lane") == "training") & F.col("outcome").isin("A", "B", "tie") & (F.col("route_a") != F.col("route_b")))


def vote_components(votes: DataFrame, staging: Staging) -> DataFrame:
    """(item, component, size): the parts of the comparison graph, named by their least item."""
    edges = votes.select(F.least("route_a", "route_b").alias("u"), F.greatest("route_a", "route_b").alias("v")).distinct()
    labels = min_label_components(edges, staging)
    size = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return labels.join(size, "label").select(F.col("node").alias("item"), F.col("label").alias("component"), "size")


def elo_replay(votes: DataFrame, staging: Staging | None = None, initial: float = 1500.0, k: float = 24.0) -> DataFrame:
    """(item, rating, votes) after replaying qualified votes in order of seq.

    The fold depends on the order, so it can be split by components of the comparison graph
    and no further: each component streams through one task in order, which holds its
    ratings but never its votes.
    """
    staging = staging or Staging(votes.sparkSession, "elo")
    v = staging.put("votes", votes.select("seq", "route_a", "route_b", "outcome"))
    parts = vote_components(v, staging).select(F.col("item").alias("route_a"), "component")
    scale = math.log(10) / 400

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rating: dict[str, float] = {}
        count: dict[str, int] = {}
        for batch in batches:
            for a, b, outcome in zip(*(batch.column(c).to_pylist() for c in ("route_a", "route_b", "outcome"))):
                ra, rb = rating.get(a, initial), rating.get(b, initial)
                expected = 1 / (1 + math.exp(-(ra - rb) * scale))
                change = k * ((1.0 if outcome == "A" else 0.0 if outcome == "B" else 0.5) - expected)
                rating[a], rating[b] = ra + change, rb - change
                count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
        items = list(rating)
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array([rating[i] for i in items], pa.float64()), pa.array([count[i] for i in items], pa.int64())], ["item", "rating", "votes"])

    # a component's votes stand together and in order in one partition
    ordered = v.join(parts, "route_a").repartition("component").sortWithinPartitions("seq", "route_a", "route_b")
    return ordered.select("route_a", "route_b", "outcome").mapInArrow(fold, "item string, rating double, votes long")


def cohort_items(cohort: DataFrame, item: str) -> list[str]:
    """The items of a cohort in order; an error if they are more than ``LARGEST_COHORT``."""
    ids = [r[0] for r in cohort.select(item).filter(F.col(item).isNotNull()).distinct().orderBy(item).limit(LARGEST_COHORT + 1).collect()]
    if len(ids) > LARGEST_COHORT:
        raise ValueError(f"a cohort has at most {LARGEST_COHORT} items")
    return ids


def cohort_votes(votes: DataFrame, cohort: DataFrame, item: str) -> tuple[list[str], pd.DataFrame]:
    """(items, edges) of binary votes among a bounded cohort: per pair and outcome the voters'
    weights, a voter's votes weighing 1 in all."""
    ids = cohort_items(cohort, item)
    inside = votes.filter(F.col("route_a").isin(ids) & F.col("route_b").isin(ids) & F.col("outcome").isin("A", "B"))
    share = inside.groupBy("voter", "route_a", "route_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "A").alias("wins"))
    per_voter = share.groupBy(F.col("voter").alias("_v")).agg(F.sum("n").alias("_all"))
    weighed = share.join(per_voter, F.col("voter").eqNullSafe(F.col("_v")))
    edges = weighed.groupBy("route_a", "route_b").agg(F.sum(F.col("n") / F.col("_all")).alias("w"), F.sum(F.col("wins") / F.col("_all")).alias("win"), F.sum("n").alias("n"))
    return ids, edges.orderBy("route_a", "route_b").toPandas()


def fit_strengths(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, win: np.ndarray, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(strengths, covariance) of regularised pairwise strengths by Newton's method, centred;
    the covariance is the projected inverse curvature."""
    s = np.zeros(n)
    for _ in range(100):
        p = expit(s[a] - s[b])
        error, curve = w * p - win, w * p * (1 - p)
        g = l2 * s + np.bincount(a, error, n) - np.bincount(b, error, n)
        h = l2 * np.eye(n) + np.diag(np.bincount(a, curve, n) + np.bincount(b, curve, n))
        np.add.at(h, (a, b), -curve)
        np.add.at(h, (b, a), -curve)
        step = np.linalg.solve(h, g)
        s = s - step
        if np.abs(step).max(initial=0.0) < 1e-12:
            break
    else:
        raise RuntimeError("the strengths did not settle")
    s = s - s.mean()
    flat = np.eye(n) - 1 / n
    return s, flat @ np.linalg.inv(h) @ flat


def voter_bootstrap(votes: DataFrame, ids: list[str], repeats: int = 100, l2: float = 1.0, seed: int = 42) -> DataFrame:
    """(item, low, high): 2.5 and 97.5 percentiles of a cohort's strengths over resamples of the
    voters.  A voter counts in a replicate as often as a Poisson draw by hash says; each
    copy weighs 1 in all.  Edges are summed per replicate before any model is fitted."""
    spark = votes.sparkSession
    inside = votes.filter(F.col("route_a").isin(ids) & F.col("route_b").isin(ids) & F.col("outcome").isin("A", "B"))
    share = inside.groupBy("voter", "route_a", "route_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "A").alias("wins"))
    total = share.groupBy("voter").agg(F.sum("n").alias("all"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "rep", "voter"), F.lit(1_000_003)) + 0.5) / 1_000_003
    copies, upto, level = F.lit(0), 0.0, math.exp(-1)
    for i in range(8):  # the inverse of the Poisson distribution of mean 1
        upto += level
        copies = copies + F.when(u > upto, 1).otherwise(0)
        level /= i + 1
    drawn = share.join(total, "voter").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("c", copies).filter("c > 0")
    edges = drawn.groupBy("rep", "route_a", "route_b").agg(F.sum(F.col("c") * F.col("n") / F.col("all")).alias("w"), F.sum(F.col("c") * F.col("wins") / F.col("all")).alias("win"))
    at = {r: i for i, r in enumerate(ids)}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s, _ = fit_strengths(len(ids), pdf.route_a.map(at).to_numpy(), pdf.route_b.map(at).to_numpy(), pdf.w.to_numpy(), pdf.win.to_numpy(), l2)
        return pd.DataFrame({"item": ids, "s": s})

    fitted = edges.groupBy("rep").applyInPandas(fit, "item string, s double")
    q = fitted.groupBy("item").agg(F.percentile("s", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return q.select("item", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")) if ids else spark.createDataFrame([], "item string, low double, high double")


def hourly_counts(votes: DataFrame, voter: str = "voter", at: str = "received", seconds: int = 3600) -> DataFrame:
    """Each vote with the voter's votes in the ``seconds`` before it, not counting itself nor any
    at exactly that distance.

    A voter's votes are cut into spans of that length; a span also sees the one before, which
    is as far back as any count reaches, so a busy voter is spread over as many tasks as spans.
    Votes without a time are kept; as in SQL, each counts the voter's votes without a time.
    """
    span = seconds * 1_000_000
    v = votes.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_own", F.floor(F.col("_us") / span))
    v = v.withColumn("_span", F.explode(F.when(F.col("_own").isNull(), F.array("_own")).otherwise(F.array("_own", F.col("_own") + 1))))
    w = Window.partitionBy(voter, "_span").orderBy("_us").rangeBetween(-(span - 1), -1)
    return v.withColumn("before", F.count(F.lit(1)).over(w)).filter(F.col("_span").eqNullSafe(F.col("_own"))).drop("_us", "_own", "_span")


def evaluation_pool(items: DataFrame, item: str, fraction: float = 0.2, seed: str = "pool") -> DataFrame:
    """The pairs (a, b) of a cohort reserved for evaluation: those with the least digests,
    round(n * fraction) of them; an error if the cohort is too large for its pairs."""
    checked_cohort(items.select(item).distinct())
    a, b = items.select(F.col(item).alias("a")).distinct(), items.select(F.col(item).alias("b")).distinct()
    pairs = a.join(b, F.col("a") < F.col("b")).withColumn("_d", F.md5(F.concat_ws("|", F.lit(seed), "a", "b")))
    n = pairs.count()
    ranked = pairs.withColumn("_r", F.row_number().over(Window.orderBy("_d", "a", "b")))
    return ranked.filter(F.col("_r") <= round(n * fraction)).select("a", "b")


def unseen_pairs(pairs: DataFrame, votes: DataFrame, voters: DataFrame) -> DataFrame:
    """(voter, unseen): how many of the pairs each voter hasn't answered."""
    done = votes.select("voter", F.least("route_a", "route_b").alias("a"), F.greatest("route_a", "route_b").alias("b")).distinct()
    seen = done.join(pairs, ["a", "b"], "left_semi").groupBy("voter").agg(F.count(F.lit(1)).alias("_seen"))
    total = pairs.count()
    return voters.select("voter").distinct().join(seen, "voter", "left").select("voter", (F.lit(total) - F.coalesce("_seen", F.lit(0))).alias("unseen"))


def pair_priority(ids: list[str], component: dict[str, str], count: dict[str, int], pair_count: dict[tuple, int], group: dict[str, str], covariance: np.ndarray | None, scores: dict[str, list[float]], l2: float = 1.0, mix: float = 0.2, reserved: set[tuple] = frozenset()) -> pd.DataFrame:
    """(a, b, priority, probability) of a cohort's pairs: bridges between components, little
    compared, disputed and uncertain pairs and those of different groups come first; the
    probability is mixed with a uniform one.  ``reserved`` pairs (a, b), a < b, are for evaluation
    and left out."""
    n, (i, j) = len(ids), np.triu_indices(len(ids), 1)
    of = lambda known, default: np.array([known.get(r, default(r)) for r in ids], dtype=object)
    part, team = of(component, lambda r: r), of(group, lambda r: None)
    met = 1 + of(count, lambda r: 0).astype(float)
    drawn = np.zeros((n, n))
    place = {r: k for k, r in enumerate(ids)}
    for (a, b), times in pair_count.items():
        if a in place and b in place:
            drawn[place[a], place[b]] = drawn[place[b], place[a]] = times
    priority = 1 + (part[i] != part[j]) + 1 / np.sqrt(met[i] * met[j]) + 0.25 * (team[i] != team[j])
    known = np.array([r in scores for r in ids], bool)
    if known.any():  # models differ on a pair as much as their differences of its scores scatter
        models = np.zeros((n, len(next(iter(scores.values())))))
        models[known] = [scores[r] for r in ids if r in scores]
        split = np.minimum((models[i] - models[j]).std(1), 2)
        priority = priority + np.where(known[i] & known[j], split, 0)
    if covariance is not None:
        own = np.diag(covariance)
        priority = priority + np.sqrt(np.maximum(0, own[i] + own[j] - 2 * covariance[i, j])) / math.sqrt(2 / l2)
    names = np.array(ids, dtype=object)
    p = pd.DataFrame({"a": names[i], "b": names[j], "priority": (priority / (1 + drawn[i, j])).astype(float)})
    if reserved:
        p = p[[(a, b) not in reserved for a, b in zip(p.a, p.b)]].reset_index(drop=True)
    if len(p):
        p["probability"] = mix / len(p) + (1 - mix) * p.priority / p.priority.sum()
    return p


def draw_pair(pairs: pd.DataFrame, u: float, side: float) -> dict:
    """The pair at ``u`` in [0, 1) of the cumulative probabilities, the item shown left by
    ``side``, and the joint probability of both."""
    at = min(int(np.searchsorted(np.cumsum(pairs.probability.to_numpy()), u, side="right")), len(pairs) - 1)
    row = pairs.iloc[at]
    return {"a": row.a, "b": row.b, "left": row.a if side < 0.5 else row.b, "probability": float(row.probability) / 2}
