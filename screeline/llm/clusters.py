"""Similarity clusters: grid density clustering in SQL.

Vectors are quantised into cells so fine that all members of a cell lie within the
radius of each other; cells are counted, near cells are joined, and the least label is
passed along the joins until nothing changes.  The clusters are exactly the chains of
vectors with no step above the radius: two cells are joined by their bounding boxes where
these decide it, else by their members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screeline.operators.graph import min_label_components
from screeline.staging import Staging


def _square(x: Column) -> Column:
    return x * x


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _covers(low: Column, high: Column, width: float, reach: float) -> Column:
    """The grid steps of ``width`` that [low - reach, high + reach] touches."""
    return F.sequence(F.floor((low - reach) / width), F.floor((high + reach) / width))


def _met(inside: DataFrame, smooth: int, side: float, radius: float, heavy: int, staging: Staging) -> DataFrame:
    """(u, v): the open pairs (a, b) of which some two members lie within the radius.

    ``inside`` is (a, b, left, x0, ...), the members that may.  Pairs of few members are compared
    outright.  Of the others each side is one box, then its halves along each axis, and so on:
    two boxes whose farthest points are near enough decide their pair, two whose nearest are not
    drop out, the rest is halved, or compared outright once it is small.
    """
    limit = radius * radius
    axes = range(smooth)
    sides = inside.groupBy("a", "b").agg(F.count_if("left").alias("n"), F.count_if(~F.col("left")).alias("m"))
    sides = sides.filter("n > 0 and m > 0").select("a", "b", (F.col("n") * F.col("m") > heavy).alias("big"))
    sides = staging.put("sides", sides)

    def compared(points: DataFrame, key: list[str], pairs: DataFrame) -> DataFrame:
        one = points.filter("left").drop("left").join(pairs.select("a", "b", *[F.col(f"p{c}").alias(c) for c in key], *[f"o{c}" for c in key]), ["a", "b", *key])
        two = points.filter("not left").select("a", "b", *[F.col(c).alias(f"o{c}") for c in key], *[F.col(f"x{i}").alias(f"y{i}") for i in axes])
        met = one.join(two, ["a", "b", *[f"o{c}" for c in key]]).filter(_sum([_square(F.col(f"x{i}") - F.col(f"y{i}")) for i in axes]) <= limit)
        return met.select("a", "b").distinct()

    found = compared(inside, [], sides.filter("not big").select("a", "b"))
    open_pairs = staging.put("open-0", sides.filter("big").select("a", "b"))
    level, parts = 0, [found]
    keys = [f"k{i}" for i in axes]
    while not open_pairs.isEmpty():
        level += 1
        width = side / 2 ** (level - 1)
        points = inside.join(open_pairs.select("a", "b").distinct(), ["a", "b"]).withColumns({f"k{i}": F.floor(F.col(f"x{i}") / width) for i in axes})
        boxes = points.groupBy("a", "b", "left", *keys).agg(F.count(F.lit(1)).alias("n"), *[f(f"x{i}").alias(f"{c}{i}") for i in axes for c, f in (("l", F.min), ("h", F.max))])
        boxes = staging.put(f"boxes-{level}", boxes)
        up = [f"u{i}" for i in axes] if level > 1 else []
        lifted = boxes.withColumns({f"u{i}": F.floor(F.col(f"k{i}") / 2) for i in axes})
        left = lifted.filter("left").select("a", "b", *[F.col(u).alias(f"p{u}") for u in up], F.col("n").alias("pn"), *[F.col(f"{c}{i}").alias(f"p{c}{i}") for i in axes for c in "klh"])
        right = lifted.filter("not left").select("a", "b", *[F.col(u).alias(f"o{u}") for u in up], F.col("n").alias("on"), *[F.col(f"{c}{i}").alias(f"o{c}{i}") for i in axes for c in "klh"])
        parents = open_pairs.select("a", "b", *[F.col(f"{q}k{u[1:]}").alias(f"{q}{u}") for u in up for q in "po"])
        both = parents.join(left, ["a", "b", *[f"p{u}" for u in up]]).join(right, ["a", "b", *[f"o{u}" for u in up]])
        apart = _sum([_square(F.greatest(F.lit(0.0), F.col(f"ol{i}") - F.col(f"ph{i}"), F.col(f"pl{i}") - F.col(f"oh{i}"))) for i in axes])
        across = _sum([_square(F.greatest(F.col(f"oh{i}") - F.col(f"pl{i}"), F.col(f"ph{i}") - F.col(f"ol{i}"))) for i in axes])
        both = both.withColumn("near", apart).withColumn("far", across).filter(F.col("near") <= limit)
        both = staging.put(f"both-{level}", both.select("a", "b", "pn", "on", "far", *[f"{q}{k}" for k in keys for q in "po"]))
        sure = staging.put(f"sure-{level}", both.filter(F.col("far") <= limit).select("a", "b").distinct())
        rest = both.filter(F.col("far") > limit).join(sure, ["a", "b"], "left_anti")
        small = rest.filter(F.col("pn") * F.col("on") <= heavy)
        parts += [sure, compared(points, keys, small)]
        open_pairs = staging.put(f"open-{level}", rest.filter(F.col("pn") * F.col("on") > heavy))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def grid_clusters(
    vectors: DataFrame,
    item: str,
    vector: str,
    *,
    radius: float,
    dims: int,
    stepped: int = 0,
    least: int = 5,
    anchors: int = 3,
    heavy: int = 10_000,
    staging: Staging | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(members, cells) of the clusters of at least ``least`` vectors.

    ``vector`` is an array of ``dims`` doubles, of which the last ``stepped`` lie on steps
    wider than the radius, so that vectors can only be near each other where they are equal
    there.  ``members`` is (item, head, size, cell): each clustered item with its cluster,
    named by its least item.  ``cells`` is (cell, n, centre, head, size) of those clusters.

    Equal vectors share a cell, however many they are.  Cells meet in a join on the stepped
    components and a coarse grid over the first ``anchors`` continuous ones, whose step is
    twice the radius, so that a cell is looked up in few places; hot grid cells are left
    to the skew join.  Pairs that their bounding boxes leave open are decided by the members that
    lie within the radius of the other box, and only where the boxes' clusters are still apart.

    Null items and vectors are left out; an empty table gives empty results.
    """
    staging = staging or Staging(vectors.sparkSession, "clusters")
    smooth = dims - stepped
    side = radius / smooth**0.5 * (1 - 1e-9)
    width = 2 * radius
    x = lambda i: F.col(vector)[i]
    points = vectors.select(
        F.col(f"`{item}`").alias("id"), *[x(i).alias(f"x{i}") for i in range(smooth)], F.slice(F.col(vector), smooth + 1, max(stepped, 1)).alias("fixed")
    ).filter("id is not null and x0 is not null")
    if not stepped:
        points = points.withColumn("fixed", F.array().cast("array<double>"))
    quantised = [F.floor(F.col(f"x{i}") / side).alias(f"q{i}") for i in range(smooth)]
    points = staging.put("points", points.select("id", "fixed", *quantised, *[f"x{i}" for i in range(smooth)]))
    cell_key = ["fixed", *[f"q{i}" for i in range(smooth)]]
    cells = points.groupBy(*cell_key).agg(
        F.min("id").alias("cell"), F.count(F.lit(1)).alias("n"),
        *[f(f"x{i}").alias(f"{n}{i}") for i in range(smooth) for n, f in (("l", F.min), ("h", F.max), ("m", F.avg))],
    )
    cells = staging.put("cells", cells)

    bounds = ["cell", "n", "fixed", *[f"{n}{i}" for i in range(smooth) for n in "lh"]]
    m = min(anchors, smooth)
    ends = lambda p, q: [F.col(f"{c}{i}").alias(f"{q}{c}{i}") for i in range(smooth) for c in p]
    home = cells.select(F.col("cell").alias("a"), F.col("n").alias("an"), "fixed", *ends("lh", "a"), *[F.floor(F.col(f"l{i}") / width).alias(f"g{i}") for i in range(m)])
    away = cells.select(*bounds)
    # the home of a cell is the place of its lower corner; a cell spans at most its side
    for i in range(m):
        away = away.withColumn(f"g{i}", F.explode(_covers(F.col(f"l{i}"), F.col(f"h{i}") + 0.0, width, radius + side)))
    away = away.select(F.col("cell").alias("b"), F.col("n").alias("bn"), "fixed", *ends("lh", "b"), *[f"g{i}" for i in range(m)])
    near = home.join(away, ["fixed", *[f"g{i}" for i in range(m)]]).filter("a < b")
    between = [F.greatest(F.lit(0.0), F.col(f"bl{i}") - F.col(f"ah{i}"), F.col(f"al{i}") - F.col(f"bh{i}")) for i in range(smooth)]
    across = [F.greatest(F.col(f"bh{i}") - F.col(f"al{i}"), F.col(f"ah{i}") - F.col(f"bl{i}")) for i in range(smooth)]
    limit = radius * radius
    near = near.filter(_sum([_square(c) for c in between]) <= limit)
    near = near.select("a", "b", (_sum([_square(c) for c in across]) <= limit).alias("sure")).distinct()
    near = staging.put("near", near)

    sure = near.filter("sure").select(F.col("a").alias("u"), F.col("b").alias("v"))
    first = min_label_components(sure, staging, name="sure")
    la = first.select(F.col("node").alias("a"), F.col("label").alias("la"))
    lb = first.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    open_pairs = near.filter("not sure").join(la, "a", "left").join(lb, "b", "left")
    open_pairs = staging.put("open", open_pairs.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"))
    # members of the cells of open pairs, each only if it lies within the radius of the other box
    named = cells.select("cell", *cell_key)
    box = cells.select("cell", *[f"{n}{i}" for i in range(smooth) for n in "lh"])
    ends_of = open_pairs.select("a", "b", F.col("a").alias("cell"), F.col("b").alias("other"), F.lit(True).alias("left")).unionByName(
        open_pairs.select("a", "b", F.col("b").alias("cell"), F.col("a").alias("other"), F.lit(False).alias("left"))
    )
    sides = ends_of.join(box.withColumnRenamed("cell", "other"), "other").join(named, "cell").drop("cell", "other")
    inside = points.join(sides, cell_key).drop(*cell_key, "id")
    off = [F.greatest(F.lit(0.0), F.col(f"l{i}") - F.col(f"x{i}"), F.col(f"x{i}") - F.col(f"h{i}")) for i in range(smooth)]
    inside = inside.filter(_sum([_square(c) for c in off]) <= limit).select("a", "b", "left", *[f"x{i}" for i in range(smooth)]).distinct()
    inside = staging.put("inside", inside)
    met = _met(inside, smooth, side, radius, heavy, staging)
    # what the sure links joined counts as one node from here on
    links = sure.unionByName(met)
    labels = min_label_components(links, staging, name="all")

    headed = cells.join(labels, cells["cell"] == labels["node"], "left").withColumn("head", F.coalesce("label", "cell"))
    sizes = headed.groupBy("head").agg(F.sum("n").alias("size")).filter(F.col("size") >= least)
    kept = headed.join(sizes, "head").select(*cell_key, "cell", "n", F.array(*[f"m{i}" for i in range(smooth)]).alias("centre"), "head", "size")
    kept = staging.put("kept", kept)
    members = points.join(kept.drop("n", "centre"), cell_key).select(F.col("id").alias(item), "head", "size", "cell", F.array(*[f"x{i}" for i in range(smooth)]).alias("place"))
    return members, kept.select("cell", "n", "centre", "head", "size")


def cluster_report(members: DataFrame, cells: DataFrame, item: str, typical: int = 3) -> DataFrame:
    """(head, size, cells, densest, typical): each cluster with its size, its cells, the
    members of its densest cell and up to ``typical`` of these, the nearest to their mean."""
    best = cells.groupBy("head").agg(
        F.max("size").alias("size"), F.count(F.lit(1)).alias("cells"), F.max(F.struct("n", F.col("cell").alias("c"), "centre")).alias("d")
    )
    core = members.join(best.select(F.col("d.c").alias("cell"), F.col("d.centre").alias("centre")), "cell")
    off = F.aggregate(F.zip_with("place", "centre", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    core = core.select("head", F.struct(off.alias("off"), F.col(item).alias("id")).alias("m"))
    # the least of each cell by partial minima: a cell of any size sends `typical` rows a task
    picked = core.groupBy("head").agg(F.min("m").alias("first"))
    report = best.select("head", "size", "cells", F.col("d.n").alias("densest"))
    chosen = picked.select("head", F.array(F.col("first.id")).alias("typical"), F.col("first").alias("_last"))
    for _ in range(typical - 1):
        more = core.join(chosen, "head").filter("m > _last").groupBy("head").agg(F.min("m").alias("_next"))
        chosen = chosen.join(more, "head", "left").select(
            "head", F.when(F.col("_next").isNull(), F.col("typical")).otherwise(F.concat("typical", F.array("_next.id"))).alias("typical"), F.coalesce("_next", "_last").alias("_last")
        )
    return report.join(chosen.drop("_last"), "head")
