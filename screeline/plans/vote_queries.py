"""Queries over the vote log, in batch and as a stream, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from screeline.operators import ratings
from screeline.operators.pairs import checked_cohort
from screeline.plans.catalog_queries import manifest, status
from screeline.plans.cohort_queries import scenario_scores
from screeline.plans.registry import ORACLES, query
from screeline.session import table
from screeline.staging import Staging
from screeline.streaming import votes as stream

_ONCE = """once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received, seq) AS nth FROM vote_events) WHERE nth = 1),
clean AS (SELECT *, CASE WHEN upper(trim(outcome)) IN ('A', 'B') THEN upper(trim(outcome)) WHEN lower(trim(outcome)) IN ('tie', 'skip') THEN lower(trim(outcome)) END AS o FROM once),
qualified AS (
  SELECT * FROM clean WHERE completed_both = 1 AND conditions = 'dry_summer' AND lane = 'training' AND o IN ('A', 'B', 'tie') AND route_a <> route_b)"""


def once(spark, folder):
    return ratings.delivered_once(table(spark, folder, "vote_events"))


def qualified(spark, folder):
    return ratings.qualified(once(spark, folder))


@query("qualified_votes", f"WITH {_ONCE} SELECT id, seq, route_a, route_b, o AS outcome FROM qualified")
def qualified_votes(spark, folder):
    return qualified(spark, folder).select("id", "seq", "route_a", "route_b", "outcome")


@query("event_conflicts", "SELECT id, count(*) AS rows, count(DISTINCT payload_hash) AS payloads, CASE WHEN count(DISTINCT payload_hash) > 1 THEN 'conflict' ELSE 'replay' END AS verdict FROM vote_events GROUP BY id HAVING count(*) > 1")
def event_conflicts(spark, folder):
    return ratings.event_conflicts(table(spark, folder, "vote_events"))


@query("rejected_votes", """WITH r AS (SELECT id, CASE WHEN NOT regexp_matches(id, '^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$') THEN 'id_not_canonical' WHEN route_a = route_b THEN 'same_item'
  WHEN coalesce(lower(trim(outcome)), '') NOT IN ('a', 'b', 'tie', 'skip') THEN 'outcome_unknown' WHEN conditions IS NULL THEN 'conditions_missing' WHEN left_route NOT IN (route_a, route_b) THEN 'left_unknown' END AS reason FROM vote_events)
SELECT reason, count(*) AS rows FROM r WHERE reason IS NOT NULL GROUP BY reason""")
def rejected_votes(spark, folder):
    v = table(spark, folder, "vote_events")
    reason = (
        F.when(~F.col("id").rlike("^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"), "id_not_canonical").when(F.col("route_a") == F.col("route_b"), "same_item")
        .when(~F.coalesce(F.lower(F.trim("outcome")), F.lit("")).isin("a", "b", "tie", "skip"), "outcome_unknown").when(F.col("conditions").isNull(), "conditions_missing")
        .when(~((F.col("left_route") == F.col("route_a")) | (F.col("left_route") == F.col("route_b"))), "left_unknown")
    )
    return v.withColumn("reason", reason).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query("vote_counts", f"""WITH {_ONCE}, sides AS (SELECT route_a AS item, voter, o FROM qualified UNION ALL SELECT route_b, voter, o FROM qualified)
SELECT item, count(*) AS comparisons, count(*) FILTER (o <> 'tie') AS binary_comparisons, count(DISTINCT voter) FILTER (o <> 'tie') AS voters,
  count(*) FILTER (o <> 'tie') >= 5 AND count(DISTINCT voter) FILTER (o <> 'tie') >= 2 AS supported FROM sides GROUP BY item""")
def vote_counts(spark, folder):
    """Coverage of each item, and whether it suffices for an interval."""
    q = qualified(spark, folder)
    sides = q.select(F.explode(F.array("route_a", "route_b")).alias("item"), "voter", "outcome")
    binary = F.col("outcome") != "tie"
    g = sides.groupBy("item").agg(F.count(F.lit(1)).alias("comparisons"), F.count_if(binary).alias("binary_comparisons"), F.count_distinct(F.when(binary, F.col("voter"))).alias("voters"))
    return g.withColumn("supported", (F.col("binary_comparisons") >= 5) & (F.col("voters") >= 2))


@query("voter_weights", f"WITH {_ONCE} SELECT id, 1.0::DOUBLE / count(*) OVER (PARTITION BY voter) AS weight FROM qualified WHERE o <> 'tie'")
def voter_weights(spark, folder):
    q = qualified(spark, folder).filter("outcome <> 'tie'")
    per = q.groupBy(F.col("voter").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return q.join(per, F.col("voter").eqNullSafe(F.col("_v"))).select("id", (1.0 / F.col("_n")).alias("weight"))


@query("vote_components", f"""WITH RECURSIVE {_ONCE}, both_ways AS (SELECT route_a AS a, route_b AS b FROM qualified UNION SELECT route_b, route_a FROM qualified),
reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
labels AS (SELECT node AS item, min(seen) AS component FROM reach GROUP BY node) SELECT item, component, count(*) OVER (PARTITION BY component) AS size FROM labels""")
def vote_components(spark, folder):
    return ratings.vote_components(qualified(spark, folder), Staging(spark, "votes"))


_REPLAY = f"""WITH RECURSIVE {_ONCE}, ids AS (SELECT item, row_number() OVER (ORDER BY item) AS i FROM (SELECT route_a AS item FROM qualified UNION SELECT route_b FROM qualified)),
log AS (SELECT row_number() OVER (ORDER BY seq, route_a, route_b) AS n, a.i AS ia, b.i AS ib, CASE o WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.0 ELSE 0.5 END::DOUBLE AS y FROM qualified JOIN ids a ON a.item = route_a JOIN ids b ON b.item = route_b),
state(n, r) AS (
  SELECT 0::BIGINT, list_transform(range((SELECT count(*) FROM ids)), lambda x: 1500.0::DOUBLE)
  UNION ALL SELECT n, list_transform(r, lambda v, i: CASE WHEN i = ia THEN v + d WHEN i = ib THEN v - d ELSE v END)
  FROM (SELECT log.n, r, ia, ib, 24 * (y - 1 / (1 + exp(-(r[ia] - r[ib]) * ln(10.0::DOUBLE) / 400))) AS d FROM state JOIN log ON log.n = state.n + 1)),
counts AS (SELECT item, count(*) AS votes FROM (SELECT route_a AS item FROM qualified UNION ALL SELECT route_b FROM qualified) GROUP BY item)
SELECT item, round((SELECT arg_max(r, n) FROM state)[i], 6) AS rating, votes FROM ids JOIN counts USING (item)"""


@query("elo_replay", _REPLAY)
def elo_replay(spark, folder):
    r = ratings.elo_replay(qualified(spark, folder))
    return r.select("item", F.round("rating", 6).alias("rating"), "votes")


@query("elo_audit", f"""WITH replayed AS ({_REPLAY}),
both_ AS (SELECT e.route_id AS item, round(e.rating, 6) AS stored, coalesce(r.rating, 1500.0::DOUBLE) AS replayed, e.votes AS stored_votes, coalesce(r.votes, 0) AS votes FROM elo e LEFT JOIN replayed r ON r.item = e.route_id)
SELECT * FROM both_ WHERE stored IS NULL OR abs(stored - replayed) > 1e-3 OR stored_votes <> votes""")
def elo_audit(spark, folder):
    """Stored ratings against the replay, beyond rounding."""
    stored = table(spark, folder, "elo").select(F.col("route_id").alias("item"), F.col("rating").alias("stored"), F.col("votes").alias("stored_votes"))
    both = stored.join(ratings.elo_replay(qualified(spark, folder)), "item", "left")
    both = both.select("item", "stored", F.coalesce("rating", F.lit(1500.0)).alias("replayed"), "stored_votes", F.coalesce("votes", F.lit(0)).alias("votes"))
    both = both.withColumn("stored", F.round("stored", 6)).withColumn("replayed", F.round("replayed", 6))
    return both.filter(F.col("stored").isNull() | (F.abs(F.col("stored") - F.col("replayed")) > 1e-3) | (F.col("stored_votes") != F.col("votes")))


@query("hourly_limits", f"WITH {_ONCE} SELECT id, count(*) OVER (PARTITION BY voter ORDER BY epoch_us(received) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS before FROM once")
def hourly_limits(spark, folder):
    return ratings.hourly_counts(once(spark, folder)).select("id", "before")


@query("evaluation_pool", """WITH p AS (SELECT a.route_id AS a, b.route_id AS b FROM route_manifest a JOIN route_manifest b ON a.route_id < b.route_id),
r AS (SELECT *, row_number() OVER (ORDER BY md5('pool|' || a || '|' || b), a, b) AS n, count(*) OVER () AS total FROM p) SELECT a, b FROM r WHERE n <= round_even(total * 0.2, 0)""")
def evaluation_pool(spark, folder):
    return ratings.evaluation_pool(manifest(spark, folder), "route_id")


@query("unseen_pairs", f"""WITH {_ONCE}, pairs AS (SELECT a.route_id AS a, b.route_id AS b FROM route_manifest a JOIN route_manifest b ON a.route_id < b.route_id),
done AS (SELECT DISTINCT voter, least(route_a, route_b) AS a, greatest(route_a, route_b) AS b FROM once),
seen AS (SELECT voter, count(*) AS n FROM done SEMI JOIN pairs USING (a, b) GROUP BY voter)
SELECT v.voter, (SELECT count(*) FROM pairs) - coalesce(n, 0) AS unseen FROM (SELECT DISTINCT voter FROM once WHERE voter IS NOT NULL) v LEFT JOIN seen USING (voter)""")
def unseen_pairs(spark, folder):
    m = manifest(spark, folder).select("route_id").distinct()
    checked_cohort(m)
    pairs = m.select(F.col("route_id").alias("a")).join(m.select(F.col("route_id").alias("b")), F.col("a") < F.col("b"))
    v = once(spark, folder)
    return ratings.unseen_pairs(pairs, v, v.filter("voter is not null"))


@query("cohort_strengths")
def cohort_strengths(spark, folder):
    """Regularised strengths of the manifest's routes with intervals where enough votes support them."""
    import numpy as np

    ids, e = ratings.cohort_votes(qualified(spark, folder), manifest(spark, folder), "route_id")
    at = {r: i for i, r in enumerate(ids)}
    a, b = e.route_a.map(at).to_numpy(dtype=int), e.route_b.map(at).to_numpy(dtype=int)
    s, cov = ratings.fit_strengths(len(ids), a, b, e.w.to_numpy(float), e.win.to_numpy(float))
    sd = np.sqrt(np.maximum(0, np.diag(cov)))
    rows = [(r, float(s[i]), float(s[i] - 1.96 * sd[i]), float(s[i] + 1.96 * sd[i])) for r, i in at.items()]
    fitted = spark.createDataFrame(rows, "item string, strength double, low double, high double")
    f = fitted.join(vote_counts(spark, folder), "item", "left")
    ok = F.coalesce("supported", F.lit(False))
    return f.select("item", F.round("strength", 6).alias("strength"), F.round(F.when(ok, F.col("low")), 6).alias("low"), F.round(F.when(ok, F.col("high")), 6).alias("high"))


@query("cohort_bootstrap")
def cohort_bootstrap(spark, folder):
    ids = ratings.cohort_items(manifest(spark, folder), "route_id")
    b = ratings.voter_bootstrap(qualified(spark, folder), ids)
    return b.select("item", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("pair_priority")
def pair_priority(spark, folder):
    """Priority and draw probability of the manifest's pairs that aren't reserved for evaluation;
    models that disagree on a pair, the scores of both weight scenarios, raise it."""
    import numpy as np

    q = qualified(spark, folder)
    ids, e = ratings.cohort_votes(q, manifest(spark, folder), "route_id")
    at = {r: i for i, r in enumerate(ids)}
    a, b = e.route_a.map(at).to_numpy(dtype=int), e.route_b.map(at).to_numpy(dtype=int)
    _, cov = ratings.fit_strengths(len(ids), a, b, e.w.to_numpy(float), e.win.to_numpy(float))
    pair_count: dict = {}
    for x, y, n in zip(e.route_a, e.route_b, e.n):
        k = (min(x, y), max(x, y))
        pair_count[k] = pair_count.get(k, 0) + int(n)
    inside = q.filter(F.col("route_a").isin(ids) & F.col("route_b").isin(ids))
    component = {r["item"]: r["component"] for r in ratings.vote_components(inside, Staging(spark, "votes")).collect()}
    count = {r["item"]: r["comparisons"] for r in vote_counts(spark, folder).filter(F.col("item").isin(ids)).collect()}
    group = {r[0]: r[1] for r in status(spark, folder).filter(F.col("route_id").isin(ids)).select("route_id", "evaluation_group").collect()}
    scores = {r.route_id: [r.main, r.steep] for r in scenario_scores(spark, folder).filter(F.col("route_id").isin(ids)).collect()}
    pool = {(r.a, r.b) for r in ratings.evaluation_pool(manifest(spark, folder), "route_id").collect()}  # of a cohort's pairs
    p = ratings.pair_priority(ids, component, count, pair_count, group, cov if len(a) else None, scores, reserved=pool)
    return spark.createDataFrame(p.round({"priority": 9, "probability": 9}), "a string, b string, priority double, probability double")


@query("holdout_metrics", f"""WITH {_ONCE}, held AS (SELECT route_a, route_b, (o = 'A')::INT AS y FROM clean WHERE lane = 'evaluation' AND completed_both = 1 AND conditions = 'dry_summer' AND o IN ('A', 'B') AND route_a <> route_b),
d AS (SELECT y, ((a.rating - b.rating) * ln(10.0::DOUBLE) / 400) AS d FROM held h JOIN elo a ON a.route_id = h.route_a JOIN elo b ON b.route_id = h.route_b WHERE a.rating IS NOT NULL AND b.rating IS NOT NULL)
SELECT count(*) AS votes, round(avg(greatest(d, 0) + ln(1 + exp(-abs(d))) - y * d), 6) AS log_loss, round(avg(pow(1 / (1 + exp(-d)) - y, 2)), 6) AS brier FROM d""")
def holdout_metrics(spark, folder):
    """Loss of the stored ratings on the votes of the evaluation lane."""
    from screeline.operators.pairs import soft_loss

    v = once(spark, folder).withColumn("outcome", ratings.outcome_of(F.col("outcome"), F.col("left_route"), F.col("route_a")))
    held = v.filter((F.col("lane") == "evaluation") & (F.col("completed_both") == 1) & (F.col("conditions") == "dry_summer") & F.col("outcome").isin("A", "B") & (F.col("route_a") != F.col("route_b")))
    r = table(spark, folder, "elo").filter("rating is not null").select("route_id", "rating")
    ra, rb = r.select(F.col("route_id").alias("route_a"), F.col("rating").alias("ra")), r.select(F.col("route_id").alias("route_b"), F.col("rating").alias("rb"))
    d = held.join(ra, "route_a").join(rb, "route_b").select(((F.col("ra") - F.col("rb")) * F.log(F.lit(10.0)) / 400).alias("d"), (F.col("outcome") == "A").cast("int").alias("y"))
    p = 1 / (1 + F.exp(-F.col("d")))
    return d.agg(F.count(F.lit(1)).alias("votes"), F.round(F.avg(soft_loss(F.col("d"), F.col("y"))), 6).alias("log_loss"), F.round(F.avg(F.pow(p - F.col("y"), 2)), 6).alias("brier"))


@query("elo_ranks", "SELECT route_id, rating, row_number() OVER (ORDER BY rating DESC NULLS LAST, route_id) AS place FROM elo")
def elo_ranks(spark, folder):
    """Every rating's place, ties by id; numbered range by range, not in one task."""
    staging = Staging(spark, "ranks")
    e = table(spark, folder, "elo").select("route_id", "rating")
    ranged = staging.put("ranged", e.repartitionByRange(F.col("rating").desc_nulls_last(), F.col("route_id")).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")  # a row a partition
    n = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("rating").desc_nulls_last(), "route_id"))
    return ranged.join(F.broadcast(before), "_p").select("route_id", "rating", (F.col("_before") + n).alias("place"))


def _once_stream(spark, folder, staging, then=None, files=4):
    """Runs the log through as a stream; what comes out is each row once."""
    schema = table(spark, folder, "vote_events").schema
    log = stream.OnceLog(spark, staging, schema, "id", "received", then)
    stream.drain(stream.vote_stream(spark, f"{folder}/vote_events.parquet", schema, files), "log", "append", staging, log)
    return log


@query("stream_daily_votes", "SELECT date_trunc('day', received)::TIMESTAMP AS start, lane, count(DISTINCT id) AS events FROM vote_events GROUP BY ALL")
def stream_daily_votes(spark, folder):
    """Votes a day and lane, from the log read as a stream; repeats count once.  Each batch adds
    its counts to a table that is summed at the end."""
    staging = Staging(spark, "stream")
    schema = "start timestamp_ntz, lane string, events long"
    parts = spark.createDataFrame([], schema)

    def count(new, number):
        nonlocal parts
        day = F.date_trunc("day", F.col("received").cast("timestamp")).cast("timestamp_ntz")
        new.groupBy(day.alias("start"), "lane").agg(F.count(F.lit(1)).alias("events")).write.mode("overwrite").parquet(f"{staging.root}/daily/{number}")
        parts = parts.unionByName(spark.read.schema(schema).parquet(f"{staging.root}/daily/{number}"))

    _once_stream(spark, folder, staging, count)
    return parts.groupBy("start", "lane").agg(F.sum("events").alias("events"))


@query("stream_votes_once", "SELECT DISTINCT id, route_a, route_b FROM vote_events")
def stream_votes_once(spark, folder):
    """The log's events once each, by a stream."""
    return _once_stream(spark, folder, Staging(spark, "stream")).log().select("id", "route_a", "route_b")


@query("stream_elo", ORACLES["elo_replay"])
def stream_elo(spark, folder):
    """Running ratings after the log went by in micro-batches."""
    staging = Staging(spark, "stream")
    elo = stream.RunningElo(spark, staging)
    _once_stream(spark, folder, staging, lambda new, number: elo(ratings.qualified(new), number))
    return elo.ratings().select("item", F.round("rating", 6).alias("rating"), "votes")
