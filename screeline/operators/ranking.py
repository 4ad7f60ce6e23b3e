"""Ranks over whole tables without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screeline.staging import Staging


def global_rank(long: DataFrame, item: str, series: str, value: str, staging: Staging, name: str = "rank") -> DataFrame:
    """Adds to each (item, series, value) its rank within the series, highest value first.

    The columns added are ``rank`` (1 plus the rows with a strictly higher value, so ties
    share a rank) and ``of`` (the rows of the series).  Rows with a null or NaN value are
    left out.

    Equal values are counted first; the distinct values are range-partitioned once, written,
    and numbered by a running sum within each partition plus the sum of the partitions
    before.  Values held by more than a thousandth of a series (at most a thousand a series)
    are joined by broadcast, so that a common value doesn't make a hot join key.
    """
    long = long.filter(F.col(value).isNotNull() & ~F.isnan(value)).withColumn(value, F.col(value).cast("double") + F.lit(0.0))
    counts = long.groupBy(series, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = counts.repartitionByRange(F.col(series), F.col(value).desc()).withColumn("_part", F.spark_partition_id())
    ranged = staging.put(name, ranged)
    by_series = Window.partitionBy(series)
    sums = ranged.groupBy(series, "_part").agg(F.sum("_n").alias("_size"))
    sums = sums.withColumn("_before", F.sum("_size").over(by_series.orderBy("_part")) - F.col("_size"))
    sums = sums.withColumn("of", F.sum("_size").over(by_series)).drop("_size")
    within = Window.partitionBy(series, "_part").orderBy(F.col(value).desc())
    # at most one row for each series and partition of the range partitioning
    ranks = ranged.join(F.broadcast(sums), [series, "_part"]).withColumn("rank", F.col("_before") + F.sum("_n").over(within) - F.col("_n") + 1)
    ranks = ranks.select(series, value, "rank", "of", (F.col("_n") * 1000 > F.col("of")).alias("_hot"))
    hot = ranks.filter("_hot").drop("_hot")
    cold = ranks.filter("not _hot").drop("_hot")
    keys = [series, value]
    common = long.join(F.broadcast(hot), keys)
    rare = long.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return common.unionByName(rare)
