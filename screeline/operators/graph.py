"""Connected components by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screeline.staging import Staging


def shared_key_edges(members: DataFrame, item: str, key: str, salts: int = 32) -> DataFrame:
    """Edges (u, v), u < v, that join all items holding a key to the least of them.

    A key held by m items gives m - 1 edges rather than all pairs.  Items first meet the
    least item of their salted share of the key, then the shares' least items meet, so
    a key held by a third of all rows is spread over ``salts`` join keys.  Null items and
    keys join nothing.
    """
    held = members.select(F.col(item).alias("_i"), F.col(key).alias("_k")).filter("_i is not null and _k is not null")
    held = held.withColumn("_s", F.pmod(F.xxhash64("_i"), F.lit(salts)))
    least = held.groupBy("_k", "_s").agg(F.min("_i").alias("_h"), F.count(F.lit(1)).alias("_n"))
    near = held.join(least.filter("_n > 1").drop("_n"), ["_k", "_s"]).select(F.col("_h").alias("u"), F.col("_i").alias("v"))
    heads = least.groupBy("_k").agg(F.min("_h").alias("_top"), F.count(F.lit(1)).alias("_m")).filter("_m > 1").drop("_m")
    far = least.join(heads, "_k").select(F.col("_top").alias("u"), F.col("_h").alias("v"))
    return near.unionByName(far).filter("u < v").distinct()


def min_label_components(edges: DataFrame, staging: Staging, rounds: int = 60, name: str = "components") -> DataFrame:
    """(node, label) for every node of an edge (u, v); the label is the component's least node.

    Each round every node takes the least label among itself and its neighbours, and then
    the label of that label (pointer jumping), so that long chains take logarithmically many
    rounds.  Labels are written after each round; the loop ends when none changes.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v")
    both = staging.put(f"{name}-edges", both.distinct())
    labels = staging.put(f"{name}-labels", both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    for _ in range(rounds):
        told = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("told"))
        # the old label also hears, so that a whole tree moves when one of its nodes does
        moved = labels.join(told, labels["node"] == told["u"]).select("node", "label", F.least("label", "told").alias("new"))
        hooks = moved.filter("new < label").groupBy(F.col("label").alias("root")).agg(F.min("new").alias("hook"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        moved = moved.join(hooks, moved["label"] == hooks["root"], "left").select("node", "label", F.least("new", F.coalesce("hook", "new")).alias("new"))
        moved = moved.join(jump, moved["new"] == jump["_n"], "left").select(
            "node", F.least("new", F.coalesce("_l", "new")).alias("label"), (F.least("new", F.coalesce("_l", "new")) < F.col("label")).alias("changed")
        )
        labels = staging.put(f"{name}-labels", moved)
        if labels.filter("changed").limit(1).count() == 0:
            break
        labels = labels.drop("changed")
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    return labels.select("node", "label")
