"""One ranking from several differently scaled scores: reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screeline.operators.ranking import global_rank
from screeline.staging import Staging


def reciprocal_rank_fusion(items: DataFrame, item: str, scores: list[str], k: float = 60.0, staging: Staging | None = None) -> DataFrame:
    """Items with the sum of 1 / (k + rank) over their scores, each score ranked apart.

    Columns: the item, n_scores (scores present), fused (the sum), worst_share (over the
    present scores the greatest share of rows with a strictly higher value), and for each
    score its rank.  Only ranks enter, so no score outweighs another by its range or shape;
    a missing score adds nothing.  Items without any score are kept with fused 0.

    Nulls and NaN are missing scores; equal values share a rank; ``items`` must hold one row
    per item (a null item is an item like any other); an empty table gives an empty result;
    other columns are ignored.
    """
    staging = staging or Staging(items.sparkSession, "fusion")
    narrow = items.select(F.col(f"`{item}`").alias("_item"), *[F.col(f"`{s}`").cast("double").alias(f"_s{i}") for i, s in enumerate(scores)])
    narrow = staging.put("scores", narrow)  # read for the counts, the common values and the rare ones
    long = narrow.select("_item", F.posexplode(F.array(*[F.col(f"_s{i}") for i in range(len(scores))])).alias("_series", "_value"))
    ranked = global_rank(long, "_item", "_series", "_value", staging, "ranks")
    share = (F.col("rank") - 1) / F.col("of")
    fused = ranked.groupBy("_item").agg(
        F.count(F.lit(1)).alias("n_scores"),
        # summed in the order of the scores: the same items give the same bits
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("_series", "rank"))), F.lit(0.0), lambda total, x: total + 1.0 / (F.lit(float(k)) + x["rank"])
        ).alias("fused"),
        F.max(share).alias("worst_share"),
        *[F.max(F.when(F.col("_series") == i, F.col("rank"))).alias(f"rank_{s}") for i, s in enumerate(scores)],
    )
    rest = narrow.filter(F.forall(F.array(*[F.col(f"_s{i}") for i in range(len(scores))]), lambda x: x.isNull() | F.isnan(x)))
    rest = rest.select("_item", F.lit(0).cast("long").alias("n_scores"), F.lit(0.0).alias("fused"))
    return fused.unionByName(rest, allowMissingColumns=True).withColumnRenamed("_item", item)


def _positions(items: DataFrame, item: str, scores: list[str], k: float) -> DataFrame:
    """The fused items with their ``position`` and, in ``of``, the number of all items."""
    staging = Staging(items.sparkSession, "fusion")
    fused = staging.put("fused", reciprocal_rank_fusion(items, item, scores, k, staging))
    long = fused.withColumn("_all", F.lit(0))
    return global_rank(long, item, "_all", "fused", staging, "position").withColumnRenamed("rank", "position").drop("_all")


def fused_ranking(items: DataFrame, item: str, scores: list[str], k: float = 60.0) -> DataFrame:
    """The fused items with their position: 1 plus the items with a strictly greater sum."""
    return _positions(items, item, scores, k).drop("of")


def leaders(items: DataFrame, item: str, scores: list[str], least: int, share: float, k: float = 60.0) -> DataFrame:
    """Of the fused ranking, the items with ``least`` scores or more whose ``worst_share`` is under
    ``share``; the columns are those of ``fused_ranking``.

    Such an item has ranks under 1 + share * all items in each of its scores, so its sum is over
    least / (k + 1 + share * all items): the ranking is read down to there, then the shares are tested.
    """
    bound = F.lit(float(least)) / (F.lit(k + 1.0) + F.lit(share) * F.col("of"))
    head = _positions(items, item, scores, k).filter(F.col("fused") >= bound * (1 - 1e-9)).drop("of")
    return head.filter((F.col("n_scores") >= least) & (F.col("worst_share") < share))
