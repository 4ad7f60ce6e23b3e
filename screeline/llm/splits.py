"""Splits that keep related records together: a spanning forest by Borůvka's contraction.

Records that share a key (a group label, a hash, an address) are joined by edges; every
component picks its least edge, the picked edges are contracted, and so on until no edge
joins two components.  The picked edges are written as a spanning forest.  The trees'
roots, in bands of like size, are then dealt to the splits one after the other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screeline.operators.graph import shared_key_edges
from screeline.staging import Staging


def spanning_forest(edges: DataFrame, staging: Staging, rounds: int = 40) -> tuple[DataFrame, DataFrame]:
    """(forest, labels) of the undirected edges (u, v).

    ``forest`` holds the picked edges (u, v, round); ``labels`` holds (node, root) for every
    node of an edge, the root being the node that stands for the tree.  Edges are ordered by
    (least end, greatest end), a total order, so the picked edges form no cycle but pairs that
    pick each other, of which the smaller becomes the root.  A component at least halves
    their number each round.  Both tables are written; loops and repeated edges do nothing.
    """
    alive = edges.select(F.least("u", "v").alias("ou"), F.greatest("u", "v").alias("ov")).filter("ou < ov").distinct()
    alive = staging.put("alive", alive.select(F.col("ou").alias("a"), F.col("ov").alias("b"), "ou", "ov"))
    labels, forest = None, None
    for turn in range(rounds):
        ends = alive.select(F.col("a").alias("c"), "ou", "ov", F.col("b").alias("other")).unionByName(
            alive.select(F.col("b").alias("c"), "ou", "ov", F.col("a").alias("other"))
        )
        picked = ends.groupBy("c").agg(F.min(F.struct("ou", "ov", "other")).alias("p")).select("c", "p.ou", "p.ov", "p.other")
        picked = staging.put(f"picked-{turn}", picked)
        if picked.limit(1).count() == 0:
            staging.drop(f"picked-{turn}")
            break
        tree = picked.select(F.col("ou").alias("u"), F.col("ov").alias("v"), F.lit(turn).alias("round")).distinct()
        forest = tree if forest is None else forest.unionByName(tree)
        back = picked.select(F.col("c").alias("_c"), F.col("other").alias("_o"))
        point = picked.join(back, picked["other"] == back["_c"]).select(
            "c", F.when((F.col("_o") == F.col("c")) & (F.col("c") < F.col("other")), F.col("c")).otherwise(F.col("other")).alias("root")
        )
        point = staging.put("point", point)
        for _ in range(64):  # pointer jumping: a path of length n takes log2(n) steps
            up = point.select(F.col("c").alias("_c"), F.col("root").alias("_r"))
            jumped = point.join(up, point["root"] == up["_c"]).select("c", F.col("_r").alias("root"), (F.col("_r") != F.col("root")).alias("moved"))
            jumped = staging.put("point", jumped)
            point = jumped.drop("moved")
            if jumped.filter("moved").limit(1).count() == 0:
                break
        to = point.select(F.col("c").alias("_c"), F.col("root").alias("_r"))
        if labels is None:
            labels = staging.put("labels", to.select(F.col("_c").alias("node"), F.col("_r").alias("root")))
        else:
            labels = labels.join(to, labels["root"] == to["_c"], "left").select("node", F.coalesce("_r", "root").alias("root"))
            labels = staging.put("labels", labels)
        to_b = to.select(F.col("_c").alias("_c2"), F.col("_r").alias("_r2"))
        alive = alive.join(to, alive["a"] == to["_c"]).join(to_b, alive["b"] == to_b["_c2"])
        alive = alive.filter("_r <> _r2").groupBy(F.least("_r", "_r2").alias("a"), F.greatest("_r", "_r2").alias("b"))
        alive = staging.put("alive", alive.agg(F.min(F.struct("ou", "ov")).alias("e")).select("a", "b", "e.ou", "e.ov"))
    else:
        raise RuntimeError(f"edges still join components after {rounds} rounds")
    if forest is None:
        name = edges.schema["u"].dataType.simpleString()
        empty = edges.sparkSession.createDataFrame([], f"u {name}, v {name}, round int, node {name}, root {name}")
        return empty.select("u", "v", "round"), empty.select("node", "root")
    return forest, labels


def related_groups(records: DataFrame, item: str, keys: Column, staging: Staging | None = None) -> DataFrame:
    """(item, head, size): the group of each item, named by its least item.

    ``keys`` is an array of strings; items tie if they hold a common key, and ties carry over.
    ``records`` holds one row an item; items that are null are left out, null keys tie
    nothing, and an item without a key that another holds is a group of one.
    """
    staging = staging or Staging(records.sparkSession, "related")
    held = records.select(F.col(f"`{item}`").alias("_item"), F.array_distinct(F.coalesce(keys, F.array().cast("array<string>"))).alias("_keys")).filter("_item is not null")
    held = staging.put("held", held)
    members = held.select("_item", F.explode("_keys").alias("_key")).filter("_key is not null")
    edges = shared_key_edges(members, "_item", "_key")
    _, labels = spanning_forest(edges, staging)
    rooted = held.select("_item").join(labels, held["_item"] == labels["node"], "left").select("_item", F.coalesce("root", "_item").alias("root"))
    # many items may share a root: the sums are taken apart and joined as a table of roots
    sizes = rooted.groupBy("root").agg(F.min("_item").alias("head"), F.count(F.lit(1)).alias("size"))
    many = sizes.filter("size > 1")
    grouped = rooted.join(many, "root", "left").select("_item", F.coalesce("head", "_item").alias("head"), F.coalesce("size", F.lit(1)).cast("long").alias("size"))
    return grouped.withColumnRenamed("_item", item)


def assign_splits(groups: DataFrame, item: str, proportions: dict[str, float], seed: int = 7, large: float = 0.01, staging: Staging | None = None) -> DataFrame:
    """(item, head, size, split): all items of a head in one split, the splits' sizes near
    ``proportions``.

    Groups above the share ``large`` of all items, of which there are at most 1 / large, go
    one by one, the largest first, to the split that lacks most; the others are dealt, within
    bands of like size (powers of two) and cells of some ten thousand groups, in the order
    of a hash, by a golden-ratio sequence over the proportions that are left.
    """
    staging = staging or Staging(groups.sparkSession, "splits")
    groups = staging.put("groups", groups.select(F.col(f"`{item}`").alias("_item"), "head", "size"))
    roots = groups.groupBy("head").agg(F.count(F.lit(1)).alias("size"))
    roots = roots.withColumn("band", F.floor(F.log2("size")).cast("int"))
    roots = staging.put("roots", roots)
    bands = roots.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("items")).collect()  # at most 63 rows
    total = sum(b["items"] for b in bands)
    names = list(proportions)
    whole = sum(proportions.values())
    lack = {s: proportions[s] / whole * total for s in names}
    big = roots.filter(F.col("size") > large * total).orderBy(F.desc("size"), "head").limit(math.ceil(1 / large)).collect() if total else []
    given = []
    for row in big:
        split = max(names, key=lambda s: lack[s])
        lack[split] -= row["size"]
        given.append((row["head"], split))
    rest = {s: max(0.0, lack[s]) for s in names}
    left = sum(rest.values()) or 1.0
    edge, upto = 0.0, []
    for s in names:
        edge += rest[s] / left
        upto.append((edge, s))
    cells = {b["band"]: max(1, b["n"] // 10_000) for b in bands} or {0: 1}
    width = F.element_at(F.create_map(*[F.lit(x) for pair in cells.items() for x in pair]), F.col("band"))
    order = F.xxhash64(F.lit(seed), F.col("head"))
    dealt = roots.filter(~(F.col("size") > large * total)).withColumn("_h", order).withColumn("_cell", F.pmod(F.col("_h"), width.cast("long")))
    place = F.row_number().over(Window.partitionBy("band", "_cell").orderBy("_h", "head"))
    start = F.pmod(F.xxhash64(F.lit(seed), F.col("band"), F.col("_cell")), F.lit(1_000_003)) / 1_000_003
    u = F.pmod(start + place * F.lit((5**0.5 - 1) / 2), F.lit(1.0))
    split = F.lit(upto[-1][1])
    for bound, s in reversed(upto[:-1]):
        split = F.when(u < bound, F.lit(s)).otherwise(split)
    dealt = dealt.select("head", split.alias("split"))
    kind = groups.schema["head"].dataType.simpleString()
    if given:
        dealt = dealt.unionByName(groups.sparkSession.createDataFrame(given, f"head {kind}, split string"))
    return groups.join(dealt, "head").select(F.col("_item").alias(item), "head", "size", "split")


def named_tokens(text: Column, placeholders: list[str]) -> Column:
    """The ids and labels named in a text, in lower case, without padding and placeholders."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[|;,]"), lambda x: F.lower(F.trim(x)))
    return F.filter(parts, lambda x: ~x.isin("", *placeholders))


def route_keys(placeholders: tuple[str, ...] = ("-", "none", "n/a", "unassigned")) -> Column:
    """The keys by which routes of a status table tie: their own and the named ids and labels,
    the hash of the track and the ``route`` parameter of the address."""
    prefix = lambda p, keys: F.transform(keys, lambda x: F.concat(F.lit(p), x))
    marks = list(placeholders)
    named = F.array_union(named_tokens(F.col("evaluation_group"), marks), named_tokens(F.col("related_itinerary_group"), marks))
    own = F.array(F.lower(F.trim("route_id")))
    digest = F.lower(F.trim("geometry_sha256"))
    track = F.when(digest.rlike("[^0]") & ~digest.isin("", *marks), digest)
    address = F.regexp_extract("source_url", r"[?&]route=([^&#\s]+)", 1)
    page = F.when(F.length(address) > 0, address)
    return F.concat(
        prefix("name:", F.array_union(named, own)),
        prefix("track:", F.array_compact(F.array(track))),
        prefix("page:", F.array_compact(F.array(page))),
    )
