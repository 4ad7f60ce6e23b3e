"""Queries on provenance and gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from screeline.operators import provenance
from screeline.plans.catalog_queries import _FEATURES, _STATUS, features, manifest, status
from screeline.plans.registry import query
from screeline.plans.vote_queries import _ONCE, qualified, vote_components, vote_counts
from screeline.session import table


@query("manifest_changes", f"""WITH {_STATUS}, m AS (SELECT route_id, canonical_name AS a0, source_url AS a1, start_name AS a2 FROM route_manifest),
j AS (SELECT m.*, s.canonical_name AS b0, s.source_url AS b1, s.start_name AS b2 FROM m JOIN status s USING (route_id))
SELECT route_id, 'canonical_name' AS field, a0 AS old, b0 AS new FROM j WHERE a0 IS DISTINCT FROM b0 UNION ALL SELECT route_id, 'source_url', a1, b1 FROM j WHERE a1 IS DISTINCT FROM b1
UNION ALL SELECT route_id, 'start_name', a2, b2 FROM j WHERE a2 IS DISTINCT FROM b2""")
def manifest_changes(spark, folder):
    """Fields of the frozen manifest that the status table has otherwise."""
    return provenance.changes(manifest(spark, folder), status(spark, folder), "route_id", ["canonical_name", "source_url", "start_name"])


@query("pending_routes", f"WITH {_STATUS}, {_FEATURES} SELECT s.route_id, CASE WHEN s.status <> 'downloaded' THEN 'not_downloaded' WHEN s.geometry_sha256 IS NULL OR NOT regexp_matches(s.geometry_sha256, '[^0]') THEN 'no_track' WHEN f.gpx_distance_mi IS NULL THEN 'no_distance' WHEN f.crux_density_medium IS NULL THEN 'no_density' END AS reason FROM status s LEFT JOIN features f USING (route_id) WHERE reason IS NOT NULL")
def pending_routes(spark, folder):
    """Routes without complete features and the first reason."""
    s = status(spark, folder).join(features(spark, folder).select("route_id", "gpx_distance_mi", "crux_density_medium"), "route_id", "left")
    rules = {
        "not_downloaded": F.coalesce(F.col("status") == "downloaded", F.lit(True)), "no_track": F.col("geometry_sha256").rlike("[^0]"),
        "no_distance": F.col("gpx_distance_mi").isNotNull(), "no_density": F.col("crux_density_medium").isNotNull(),
    }
    return s.select("route_id", provenance.first_failure(rules).alias("reason")).filter("reason is not null")


@query("cohorts", f"WITH {_FEATURES} SELECT count(*) AS routes, count(*) FILTER (coalesce(quality_flags, '') = '') AS without_flags, count(*) FILTER (gpx_distance_mi IS NOT NULL AND gpx_gain_ft IS NOT NULL AND crux_density_medium IS NOT NULL AND crux_density_extreme IS NOT NULL) AS measured, count(*) FILTER (crux_density_medium IS NULL) AS without_density, count(*) FILTER (provisional_rank IS NOT NULL) AS ranked FROM features")
def cohorts(spark, folder):
    f = features(spark, folder)
    whole = F.lit(True)
    for c in ("gpx_distance_mi", "gpx_gain_ft", "crux_density_medium", "crux_density_extreme"):
        whole = whole & F.col(c).isNotNull()
    return f.agg(
        F.count(F.lit(1)).alias("routes"), F.count_if(F.coalesce("quality_flags", F.lit("")) == "").alias("without_flags"), F.count_if(whole).alias("measured"),
        F.count_if(F.col("crux_density_medium").isNull()).alias("without_density"), F.count_if(F.col("provisional_rank").isNotNull()).alias("ranked"),
    )


@query("ranking_readiness", f"""WITH RECURSIVE {_ONCE}, both_ways AS (SELECT route_a AS a, route_b AS b FROM qualified UNION SELECT route_b, route_a FROM qualified),
reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen), labels AS (SELECT node, min(seen) AS c FROM reach GROUP BY node),
sides AS (SELECT route_a AS item, voter FROM qualified WHERE o <> 'tie' UNION ALL SELECT route_b, voter FROM qualified WHERE o <> 'tie'), n AS (SELECT item, count(*) >= 5 AND count(DISTINCT voter) >= 2 AS ok FROM sides GROUP BY item)
SELECT (SELECT count(*) FROM qualified) AS votes, (SELECT count(DISTINCT c) FROM labels) AS components, (SELECT count(*) FROM labels) AS items, (SELECT count(*) FROM n WHERE ok) AS supported""")
def ranking_readiness(spark, folder):
    """One row: what a global ranking needs is one component and support for every item."""
    q = qualified(spark, folder).agg(F.count(F.lit(1)).alias("votes"))
    c = vote_components(spark, folder).agg(F.count_distinct("component").alias("components"), F.count(F.lit(1)).alias("items"))
    n = vote_counts(spark, folder).agg(F.count_if("supported").alias("supported"))
    return q.join(c).join(n)  # three rows of one


@query("table_digests")
def table_digests(spark, folder):
    """The content digests of the tables that results depend on."""
    out = None
    for name in ("trkpt", "route_features_full", "route_status", "vote_events", "elo", "route_manifest", "documents"):
        d = provenance.table_digest(table(spark, folder, name)).select(F.lit(name).alias("name"), "rows", "digest")
        out = d if out is None else out.unionByName(d)
    return out
