"""Queries over standardised features: whole tables where sums suffice, else the cohort of
the frozen manifest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from screeline.functions.text import class_weight, risk_level
from screeline.operators import pairs, stats
from screeline.plans.catalog_queries import latest_sql, manifest
from screeline.plans.registry import query

NUMBERS = ["gpx_distance_mi", "gpx_gain_ft", "crux_density_medium", "crux_density_extreme", "longest_medium_section_mi", "longest_extreme_section_mi"]
RISKS = ["exposure", "rockfall", "route_finding", "commitment"]
COLUMNS = [*NUMBERS, "weight", *RISKS]
KINDS = dict(zip(COLUMNS, ["distance", "gain", "medium", "extreme", "longest_medium", "longest_extreme", "class", "risk", "risk", "risk", "risk"]))
#: The kinds' weights of the reference score and of an alternative; parameters, not findings.
MAIN = {"distance": 0.2, "gain": 0.2, "medium": 0.15, "extreme": 0.15, "longest_medium": 0.05, "longest_extreme": 0.05, "class": 0.1, "risk": 0.1}
STEEP = {"distance": 0.1, "gain": 0.1, "medium": 0.2, "extreme": 0.25, "longest_medium": 0.1, "longest_extreme": 0.1, "class": 0.1, "risk": 0.05}

_LEVEL = "(list_position(['low', 'moderate', 'considerable', 'high', 'extreme'], lower(trim({0}))) - 1)::DOUBLE AS {0}"
_LATEST = latest_sql("latest", "route_features_full", "route_id", "exported_at", [*NUMBERS, "yds_class", *RISKS])
_VALUES = f"""{_LATEST},
vals AS (SELECT * FROM (SELECT route_id, {', '.join(NUMBERS)}, CASE yds_class WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 WHEN 3 THEN 4.0 WHEN 4 THEN 8.0 WHEN 5 THEN 16.0 END::DOUBLE AS weight, {', '.join(_LEVEL.format(r) for r in RISKS)} FROM latest)
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in COLUMNS)})"""
_COHORT = f"{_VALUES}, cohort AS (SELECT * FROM vals SEMI JOIN route_manifest USING (route_id))"


def _z(source: str) -> str:
    return f"z AS (SELECT route_id, {', '.join(f'({c} - avg({c}) OVER ()) / (CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END) AS {c}' for c in COLUMNS)} FROM {source})"


def values(spark, folder):
    """The latest complete features of every route, labels as numbers."""
    from screeline.operators.latest import latest_rows
    from screeline.session import table

    f = latest_rows(table(spark, folder, "route_features_full"), "route_id", "exported_at", [*NUMBERS, "yds_class", *RISKS])
    f = f.select("route_id", *NUMBERS, class_weight(F.col("yds_class")).alias("weight"), *[risk_level(F.col(r)).cast("double").alias(r) for r in RISKS])
    return f.dropna(subset=COLUMNS)


def cohort(spark, folder):
    return values(spark, folder).join(manifest(spark, folder).select("route_id").distinct(), "route_id", "left_semi")


def matrix(spark, folder):
    ids, x = stats.cohort_matrix(cohort(spark, folder), "route_id", COLUMNS)
    return ids, x, stats.standardised(x)


def _score(weights: dict[str, float]) -> list[float]:
    return pairs.teacher_weights(COLUMNS, weights, KINDS).tolist()


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("zscores", f"WITH {_VALUES}, {_z('vals')} SELECT route_id, {', '.join(f'round({c}, 6) AS {c}' for c in COLUMNS)} FROM z")
def zscores(spark, folder):
    return _rounded(stats.zscores(values(spark, folder), "route_id", COLUMNS))


_PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]


@query("correlations", f"WITH {_VALUES} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM vals" for a, b in _PAIRS))
def correlations(spark, folder):
    return _rounded(stats.correlations(values(spark, folder), COLUMNS))


@query("quantiles", f"WITH {_VALUES} " + " UNION ALL ".join(f"SELECT '{c}' AS field, {q}::DOUBLE AS q, round(quantile_cont({c}, {q}), 6) AS value FROM vals" for c in COLUMNS for q in (0.025, 0.5, 0.975)))
def quantiles(spark, folder):
    return _rounded(stats.quantiles(values(spark, folder), COLUMNS))


def _sum(weights: dict[str, float]) -> str:
    return " + ".join(f"{w!r}::DOUBLE * {c}" for c, w in zip(COLUMNS, _score(weights)))


def scenario_scores(spark, folder):
    """(route_id, main, steep): the cohort's scores under both weight scenarios."""
    z = stats.zscores(cohort(spark, folder), "route_id", COLUMNS)
    total = lambda ws: sum((F.lit(w) * F.col(c) for c, w in zip(COLUMNS[1:], ws[1:])), F.lit(ws[0]) * F.col(COLUMNS[0]))
    return z.select("route_id", total(_score(MAIN)).alias("main"), total(_score(STEEP)).alias("steep"))


@query(
    "reference_scores",
    f"""WITH {_COHORT}, {_z('cohort')}, s AS (SELECT route_id, {_sum(MAIN)} AS main, {_sum(STEEP)} AS steep FROM z),
r AS (SELECT *, row_number() OVER (ORDER BY main DESC, route_id) AS rm, row_number() OVER (ORDER BY steep DESC, route_id) AS rs FROM s)
SELECT route_id, round(main, 6) AS score, rm::INT AS place, least(rm, rs)::INT AS best_place, greatest(rm, rs)::INT AS worst_place FROM r""",
)
def reference_scores(spark, folder):
    """The cohort's reference score, place, and places over the weight scenarios."""
    s = scenario_scores(spark, folder)
    place = lambda c: F.row_number().over(Window.orderBy(F.desc(c), "route_id"))  # noqa: E731 - a bounded cohort
    r = s.withColumn("rm", place("main")).withColumn("rs", place("steep"))
    return r.select("route_id", F.round("main", 6).alias("score"), F.col("rm").alias("place"), F.least("rm", "rs").alias("best_place"), F.greatest("rm", "rs").alias("worst_place"))


@query(
    "soft_pair_loss",
    f"""WITH {_COHORT}, {_z('cohort')}, s AS (SELECT route_id, {_sum(MAIN)} AS main, {_sum(STEEP)} AS steep FROM z),
d AS (SELECT a.steep - b.steep AS d, 1 / (1 + exp(-(a.main - b.main))) AS y FROM s a JOIN s b ON a.route_id < b.route_id)
SELECT count(*) AS pairs, round(avg(greatest(d, 0) + ln(1 + exp(-abs(d))) - y * d), 6) AS loss, round(avg(pow(1 / (1 + exp(-d)) - y, 2)), 6) AS squared_error FROM d""",
)
def soft_pair_loss(spark, folder):
    """The loss of one scenario's scores against the other's over all pairs of the cohort."""
    z = stats.zscores(cohort(spark, folder), "route_id", COLUMNS)
    total = lambda ws: sum((F.lit(w) * F.col(c) for c, w in zip(COLUMNS[1:], ws[1:])), F.lit(ws[0]) * F.col(COLUMNS[0]))
    s = z.select("route_id", total(_score(MAIN)).alias("main"), total(_score(STEEP)).alias("steep"))
    p = pairs.unordered_pairs(s, "route_id", ["main", "steep"])
    d, y = F.col("steep_a") - F.col("steep_b"), 1 / (1 + F.exp(-(F.col("main_a") - F.col("main_b"))))
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(pairs.soft_loss(d, y)), 6).alias("loss"), F.round(F.avg(F.pow(1 / (1 + F.exp(-d)) - y, 2)), 6).alias("squared_error"))


@query(
    "cohort_neighbours",
    f"""WITH {_COHORT}, {_z('cohort')}, d AS (SELECT a.route_id, b.route_id AS neighbour, sqrt({' + '.join(f'pow(a.{c} - b.{c}, 2)' for c in COLUMNS)}) AS distance FROM z a JOIN z b ON a.route_id <> b.route_id),
r AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY round(distance, 9), neighbour) AS place FROM d) SELECT route_id, place::INT AS place, neighbour, round(distance, 6) AS distance FROM r WHERE place <= 5""",
)
def cohort_neighbours(spark, folder):
    z = stats.zscores(cohort(spark, folder), "route_id", COLUMNS)
    a, b = z.select(F.col("route_id"), F.array(*COLUMNS).alias("x")), z.select(F.col("route_id").alias("neighbour"), F.array(*COLUMNS).alias("y"))
    d = a.join(b, F.col("route_id") != F.col("neighbour"))
    d = d.withColumn("distance", F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)))
    w = Window.partitionBy("route_id").orderBy(F.round("distance", 9), "neighbour")
    return d.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("route_id", "place", "neighbour", F.round("distance", 6).alias("distance"))


@query("component_variance")
def component_variance(spark, folder):
    _, _, z = matrix(spark, folder)
    p = stats.pca(z)
    return stats.as_frame(spark, {"component": np.arange(1, len(p["share"]) + 1), "share": p["share"].round(9), "upto": p["share"].cumsum().round(9)})


@query("component_scores")
def component_scores(spark, folder):
    """First two components, biplot coordinates and how much of a route two components show."""
    ids, _, z = matrix(spark, folder)
    p = stats.pca(z)
    t, f = p["scores"][:, :2], p["scores"][:, :2] / np.where(p["deviation"][:2] > 0, p["deviation"][:2], 1)
    shown = (t**2).sum(1) / np.maximum((z**2).sum(1), 1e-300)
    return stats.as_frame(spark, {"route_id": ids, "t1": t[:, 0].round(6), "t2": t[:, 1].round(6), "f1": f[:, 0].round(6), "f2": f[:, 1].round(6), "shown": shown.round(6)})


@query("component_loadings")
def component_loadings(spark, folder):
    """Loadings with bootstrap bounds, contributions in percent, and the representation of features."""
    _, x, z = matrix(spark, folder)
    p = stats.pca(z)
    low, high = stats.bootstrap_loadings(x, p["components"])
    c = p["loadings"][:, :2]
    columns = {"field": COLUMNS, "representation": (c**2).sum(1).round(6)}
    for i in range(2):
        columns |= {f"loading{i + 1}": c[:, i].round(6), f"low{i + 1}": low[:, i].round(6), f"high{i + 1}": high[:, i].round(6), f"percent{i + 1}": (100 * p["components"][i] ** 2).round(6)}
    return stats.as_frame(spark, columns)


@query("embeddings")
def embeddings(spark, folder):
    """The cohort's neighbour embeddings and the bounds of a plot of each."""
    ids, _, z = matrix(spark, folder)
    t, u = stats.tsne(z), stats.umap(z)
    return stats.as_frame(spark, {"route_id": ids, "tsne_x": t[:, 0].round(4), "tsne_y": t[:, 1].round(4), "umap_x": u[:, 0].round(4), "umap_y": u[:, 1].round(4)})


@query("embedding_metrics")
def embedding_metrics(spark, folder):
    """Trustworthiness and neighbour overlap of each embedding, and what is left of the
    neighbours with linear classes and without the longest sections."""
    _, x, z = matrix(spark, folder)
    k = min(5, (len(z) - 1) // 3)
    linear = x.copy()
    linear[:, COLUMNS.index("weight")] = np.log2(np.maximum(linear[:, COLUMNS.index("weight")], 1))
    rows = [(n, stats.trustworthiness(z, e, k), stats.neighbour_agreement(z, e, k)) for n, e in (("components", stats.pca(z)["scores"][:, :2]), ("tsne", stats.tsne(z)), ("umap", stats.umap(z)))]
    kept = [i for i, c in enumerate(COLUMNS) if not c.startswith("longest")]
    rows += [("linear_class", None, stats.neighbour_agreement(z, stats.standardised(linear), k)), ("without_longest", None, stats.neighbour_agreement(z, z[:, kept], k))]
    return spark.createDataFrame([(n, t, float(a)) for n, t, a in rows], "space string, trustworthiness double, overlap double")


@query("cohort_clusters")
def cohort_clusters(spark, folder):
    """The cohort's k-means clusters, k by silhouette, with each route's stability."""
    ids, _, z = matrix(spark, folder)
    label, s = stats.chosen_clusters(z)
    return stats.as_frame(spark, {"route_id": ids, "cluster": label, "stability": stats.stability(z, label).round(4), "silhouette": np.full(len(ids), round(s, 6))})


_GIVEN = latest_sql("given", "route_features_full", "route_id", "exported_at", ["cluster_id", "cluster_stability"])


@query(
    "cluster_summary",
    f"""WITH {_VALUES}, {_z('vals')}, {_GIVEN}, long AS (SELECT cluster_id, field, v FROM (SELECT cluster_id, {', '.join(f'z.{c}' for c in COLUMNS)} FROM z JOIN given USING (route_id) WHERE cluster_id IS NOT NULL) UNPIVOT (v FOR field IN ({', '.join(COLUMNS)}))),
m AS (SELECT cluster_id, field, count(*) AS routes, round(avg(v), 6) AS mean FROM long GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY abs(mean) DESC, field) AS place FROM m) SELECT cluster_id, field, routes, mean, place::INT AS place FROM r WHERE place <= 4""",
)
def cluster_summary(spark, folder):
    """The delivered clusters' sizes and their four most telling features."""
    from screeline.operators.latest import latest_rows
    from screeline.session import table

    z = stats.zscores(values(spark, folder), "route_id", COLUMNS)
    given = latest_rows(table(spark, folder, "route_features_full"), "route_id", "exported_at", ["cluster_id", "cluster_stability"]).filter("cluster_id is not null")
    long = z.join(given, "route_id").select("cluster_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in COLUMNS])).alias("p"))
    m = long.groupBy("cluster_id", F.col("p.field").alias("field")).agg(F.count(F.lit(1)).alias("routes"), F.round(F.avg("p.v"), 6).alias("mean"))
    w = Window.partitionBy("cluster_id").orderBy(F.abs("mean").desc(), "field")
    return m.withColumn("place", F.row_number().over(w)).filter("place <= 4")


def _grouped(spark, folder):
    from screeline.plans.catalog_queries import connected_groups

    ids, x, _ = matrix(spark, folder)
    head = {r["route_id"]: r["head"] for r in connected_groups(spark, folder).filter(F.col("route_id").isin(ids)).collect()}
    return ids, x, [head.get(i, i) for i in ids]


@query("experiment_grid")
def experiment_grid(spark, folder):
    """Held-out metrics of linear and neural scorers and of a constant, over feature sets and
    seeds, each cell of the grid a task."""
    import pandas as pd

    ids, x, groups = _grouped(spark, folder)
    weights = np.array(_score(MAIN))
    grid = spark.createDataFrame([(seed, n) for seed in (42, 43, 44) for n in (len(COLUMNS), len(COLUMNS) - 2)], "seed int, features int")
    kept = {len(COLUMNS): list(range(len(COLUMNS))), len(COLUMNS) - 2: [i for i, c in enumerate(COLUMNS) if not c.startswith("longest")]}

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, n = int(pdf.seed[0]), int(pdf.features[0])
        part = pairs.grouped_split(groups, seed)
        tr, va, te = part["train"], part["validation"], part["test"]
        m, s = x[tr].mean(0), x[tr].std(0)
        z = (x - m) / np.where(s == 0, 1, s)
        ref, zf = z @ weights, z[:, kept[n]]
        under = lambda rows: pairs.Comparisons.under(ref[rows])
        linear = pairs.linear_weights(zf[tr], under(tr), 1e-3)
        scorer, epoch = pairs.train_scorer(zf[tr], under(tr), seed, check=(zf[va], under(va)))
        scores = {"linear": zf[te] @ linear, "neural": scorer(zf[te]), "constant": np.zeros(len(te))}
        rows = []
        for name, sc in scores.items():
            e = pairs.judged(sc, ref[te])
            b = pairs.excess_interval(sc, ref[te], np.array(groups, dtype=object)[te].astype(str), seed=seed) if name != "constant" else None
            rows.append({"seed": seed, "features": n, "model": name, "epoch": epoch, **{k: e[k] for k in ("pairs", "loss", "excess", "squared_error", "accuracy", "spearman", "kendall")}, "excess_low": b[0] if b else None, "excess_high": b[1] if b else None})
        return pd.DataFrame(rows)

    schema = "seed int, features int, model string, epoch int, pairs int, loss double, excess double, squared_error double, accuracy double, spearman double, kendall double, excess_low double, excess_high double"
    return _rounded(grid.groupBy("seed", "features").applyInPandas(cell, schema))


@query("final_ranks")
def final_ranks(spark, folder):
    """The cohort's places under the reference, the refitted linear and the neural scorer, the
    latter trained for the median of the epochs that validation chose."""
    ids, x, groups = _grouped(spark, folder)
    z = stats.standardised(x)
    ref = z @ np.array(_score(MAIN))
    epochs = []
    for seed in (42, 43, 44):
        part = pairs.grouped_split(groups, seed)
        tr, va = part["train"], part["validation"]
        under = lambda rows: pairs.Comparisons.under(ref[rows])
        epochs.append(pairs.train_scorer(z[tr], under(tr), seed, check=(z[va], under(va)))[1])
    every = pairs.Comparisons.under(ref)
    neural = pairs.train_scorer(z, every, 42, epochs=max(1, int(np.median(epochs))))[0](z)
    place = lambda s: np.argsort(np.argsort(-s, kind="stable"), kind="stable") + 1
    linear = z @ pairs.linear_weights(z, every, 1e-3)
    return stats.as_frame(spark, {"route_id": ids, "reference": place(ref), "linear": place(linear), "neural": place(neural), "linear_score": linear.round(6)})


@query("frozen_scores")
def frozen_scores(spark, folder):
    """Every route's score under the linear model frozen on the cohort."""
    _, x, z = matrix(spark, folder)
    ref = z @ np.array(_score(MAIN))
    w = pairs.linear_weights(z, pairs.Comparisons.under(ref), 1e-3)
    s = x.std(0)
    v = values(spark, folder)
    score = pairs.linear_score(v, COLUMNS, x.mean(0).tolist(), np.where(s == 0, 1, s).tolist(), w.tolist())
    return v.select("route_id", F.round(score, 6).alias("score"))


