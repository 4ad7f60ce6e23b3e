"""Matching rows of a table to a catalog by address, by name, or nearly by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screeline.functions.text import normal_name

LARGEST_CATALOG = 50_000


def match_by_name(rows: DataFrame, item: str, names: list[str], catalog: DataFrame, title: str, entry: str) -> DataFrame:
    """(item, entry, matches): the catalog entry whose normalised title is one of the item's
    normalised names, null unless exactly one entry is; ``matches`` says how many are.

    Equi-join on the normalised names; an item's name may hold several, split by a bar.
    """
    each = rows.select(item, F.explode(F.split(F.concat_ws("|", *names), r"\|")).alias("_n")).select(item, normal_name(F.col("_n")).alias("_name"))
    each = each.filter("_name <> ''").distinct()
    titles = catalog.select(F.col(entry).alias("_entry"), normal_name(F.col(title)).alias("_name")).distinct()
    hits = each.join(titles, "_name").groupBy(item).agg(F.count_distinct("_entry").alias("matches"), F.min("_entry").alias("_one"))
    out = rows.select(item).distinct().join(hits, item, "left")
    return out.select(item, F.when(F.col("matches") == 1, F.col("_one")).alias("entry"), F.coalesce("matches", F.lit(0)).alias("matches"))


def nearest_names(rows: DataFrame, item: str, name: str, catalog: DataFrame, title: str, entry: str, k: int = 5) -> DataFrame:
    """(item, place, entry, ratio): the k catalog entries with the most similar normalised names.

    The ratio is 1 - edit distance / length of the longer name; ties go to the lesser entry.
    The rows are those that no exact rule matched, few or many; each is compared to the whole
    catalog, which is sent to every task in one row and may hold ``LARGEST_CATALOG`` entries;
    beyond that it is compared in blocks, each giving its own k best. Only these are shuffled.
    """
    q = rows.select(item, normal_name(F.col(name)).alias("_q")).filter("_q is not null")
    c = catalog.select(F.col(entry).alias("entry"), normal_name(F.col(title)).alias("_t")).filter("_t is not null").distinct()
    blocks = -(-max(1, c.count()) // LARGEST_CATALOG)

    def rated(x):
        ratio = 1 - F.levenshtein(F.col("_q"), x["_t"]) / F.greatest(F.length("_q"), F.length(x["_t"]), F.lit(1))
        return F.struct((-ratio).alias("r"), x["entry"].alias("entry"))

    best = None
    for b in range(blocks):
        part = c.filter(F.pmod(F.xxhash64("entry"), F.lit(blocks)) == b).agg(F.collect_list(F.struct("entry", "_t")).alias("_catalog"))
        top = q.join(F.broadcast(part), F.lit(True)).select(item, F.slice(F.array_sort(F.transform("_catalog", rated)), 1, k).alias("top"))
        best = top if best is None else best.unionByName(top)
    best = best.groupBy(item).agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return best.select(item, F.posexplode("top").alias("p", "t")).select(item, (F.col("p") + 1).alias("place"), F.col("t.entry").alias("entry"), (-F.col("t.r")).alias("ratio"))


def best_per_item(df: DataFrame, item: str, order: list, k: int = 1) -> DataFrame:
    """The first k rows of each item in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")
