"""Queries of this subpackage, with the SQL that checks those SQL can express."""

from __future__ import annotations

from screeline.llm import sql
from screeline.llm.clusters import cluster_report, grid_clusters
from screeline.llm.fusion import fused_ranking, leaders
from screeline.llm.leakage import find_leaks
from screeline.llm.mixture import draw, drawn_report, margin_report, mixture_plan, plan_report
from screeline.llm.neighbors import mutual_pairs, nearest_neighbours
from screeline.llm.pairwise import counted_votes, pairwise_strengths
from screeline.llm.residue import find_residue, validate
from screeline.llm.splits import assign_splits, related_groups, route_keys
from screeline.llm.vectors import route_vectors
from screeline.operators.latest import latest_rows
from screeline.operators.ranking import global_rank
from screeline.session import table
from screeline.staging import Staging
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = sql.ORACLES

CLUSTERING = {"radius": 1.5, "dims": 11, "stepped": 5, "least": 5}
SCORES = ["provisional_score", "yds_encoded", "gpx_gain_ft", "crux_density_medium"]


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def p2_found(spark, folder):
    members, _ = grid_clusters(route_vectors(table(spark, folder, "route_features_full")), "route_id", "x", **CLUSTERING)
    return members.filter("route_id <> head").select(F.col("head").alias("head_route_id"), "route_id")


@query
def p2_clusters(spark, folder):
    members, cells = grid_clusters(route_vectors(table(spark, folder, "route_features_full")), "route_id", "x", **CLUSTERING)
    report = cluster_report(members, cells, "route_id")
    return report.select(F.col("head").alias("head_route_id"), "size", "cells", "densest", F.concat_ws("|", "typical").alias("typical"))


def _scored(spark, folder):
    return latest_rows(table(spark, folder, "route_features_full"), "route_id", "exported_at", SCORES)


@query
def p3_found(spark, folder):
    return leaders(_scored(spark, folder), "route_id", SCORES, least=3, share=0.1).select("route_id")


@query
def p3_ranking(spark, folder):
    ranked = fused_ranking(_scored(spark, folder), "route_id", SCORES)
    return ranked.select("route_id", "n_scores", F.round("fused", 9).alias("fused"), "position")


def _related(spark, folder):
    columns = ["geometry_sha256", "source_url", "evaluation_group", "related_itinerary_group"]
    status = latest_rows(table(spark, folder, "route_status"), "route_id", "updated_at", columns)
    return related_groups(status, "route_id", route_keys())


@query
def p5_found(spark, folder):
    groups = _related(spark, folder)
    return groups.filter("size > 1 and route_id <> head").select(F.col("head").alias("head_route_id"), "route_id")


@query
def p5_splits(spark, folder):
    return assign_splits(_related(spark, folder), "route_id", {"train": 0.8, "validation": 0.1, "test": 0.1})


def _neighbours(spark, folder):
    return nearest_neighbours(route_vectors(table(spark, folder, "route_features_full")), "route_id", "x", dims=11, k=10)


@query
def p6_found(spark, folder):
    pairs = mutual_pairs(_neighbours(spark, folder), "route_id", 0.05)
    return pairs.select(F.col("a").alias("route_a"), F.col("b").alias("route_b"))


@query
def p6_neighbours(spark, folder):
    near = _neighbours(spark, folder).select("route_id", F.posexplode("neighbours").alias("place", "n"))
    return near.select("route_id", (F.col("place") + 1).alias("place"), F.col("n.id").alias("neighbour"), F.round("n.d", 9).alias("distance"))


def _strengths(spark, folder):
    votes = table(spark, folder, "vote_events")
    outcome = F.upper(F.trim("outcome"))
    counted = votes.filter(outcome.isin("A", "B") & (F.col("completed_both") == 1) & (F.col("conditions") == "dry_summer") & (F.col("lane") == "training"))
    return pairwise_strengths(counted_votes(counted, "voter", "route_a", "route_b", outcome == "A", "received", "seq"))


@query
def p4_found(spark, folder):
    strengths = _strengths(spark, folder)
    known = table(spark, folder, "route_manifest").select(F.col("route_id").alias("item")).distinct()
    best = strengths.join(known, "item", "left_semi").agg(F.max("strength")).collect()[0][0]
    rivals = strengths.join(known, "item", "left_anti").filter(F.col("votes") >= 20)
    if best is not None:
        rivals = rivals.filter(F.col("strength") > best)
    return rivals.select(F.col("item").alias("route_id"))


@query
def p4_ranking(spark, folder):
    strengths = _strengths(spark, folder)
    long = strengths.withColumn("_all", F.lit(0))
    ranked = global_rank(long, "item", "_all", "strength", Staging(spark, "pairwise"), "position")
    stored = table(spark, folder, "elo").select(F.col("route_id").alias("item"), F.col("rating").alias("stored_rating"))
    ranked = ranked.join(stored, "item", "left")
    return ranked.select(F.col("item").alias("route_id"), "strength", "votes", "wins", "cyclic", F.col("rank").alias("position"), "stored_rating")


def _leaks(spark, folder):
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items"))


@query
def p7_found(spark, folder):
    return _leaks(spark, folder).select("doc_id", "item_id")


@query
def p7_items(spark, folder):
    """Each item that leaked, with the documents that hold it."""
    found = _leaks(spark, folder)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest"), F.min("doc_id").alias("first_doc_id"))


@query
def p9_found(spark, folder):
    return find_residue(table(spark, folder, "documents")).select("doc_id")


@query
def p9_validation(spark, folder):
    return validate(table(spark, folder, "documents"))


def _plan(spark, folder):
    return mixture_plan(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


@query
def p8_found(spark, folder):
    _, plan = _plan(spark, folder)
    return plan_report(spark, plan).filter("not reachable").select("source")


@query
def p8_mixture(spark, folder):
    return draw(*_plan(spark, folder)).withColumnRenamed("doc", "doc_id")


@query
def p8_report(spark, folder):
    return drawn_report(*_plan(spark, folder))


@query
def p8_margins(spark, folder):
    return margin_report(spark, _plan(spark, folder)[1])
