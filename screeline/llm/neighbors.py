"""The k most similar vectors of every vector: a small-world graph per shard, merged.

Equal vectors are one point, however many items hold them.  The points are cut into
shards by a k-d tree fitted on a bounded sample; every point is indexed in its shard, and
the shard's graph is written as flat arrays.  Every point is looked up in its own shard
first; the distance of its k-th neighbour there tells which other shards could hold a
nearer one, and only these are searched too.  The shards' results are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screeline.llm import hnsw
from screeline.staging import Staging


def kd_tree(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, threshold, left, right); a leaf has axis -1 and its shard as threshold.

    The leaf with the most points is cut at the median of its widest axis (between its 10th
    and 90th percentile), left of the threshold going strictly below it.
    """
    nodes: list = [None]
    open_leaves = {0: np.arange(len(sample))}
    ready = [(-len(sample), 0)]  # a heap: the largest leaf first
    while len(open_leaves) < leaves and ready:
        size, at = heapq.heappop(ready)
        if size > -2:
            break
        rows = open_leaves[at]
        spread = np.subtract(*np.percentile(sample[rows], [90, 10], axis=0))
        for axis in np.argsort(-spread, kind="stable"):
            values = np.sort(sample[rows, axis])
            cut = values[len(values) // 2]
            if cut == values[0]:
                above = values[values > cut]
                if not len(above):
                    continue
                cut = above[0]
            below = sample[rows, axis] < cut
            nodes[at] = (int(axis), float(cut), len(nodes), len(nodes) + 1)
            nodes += [None, None]
            del open_leaves[at]
            for child, part in ((len(nodes) - 2, rows[below]), (len(nodes) - 1, rows[~below])):
                open_leaves[child] = part
                heapq.heappush(ready, (-len(part), child))
            break
    for shard, leaf in enumerate(sorted(open_leaves)):
        nodes[leaf] = (-1, float(shard), 0, 0)
    return nodes


def shard_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    axis, cut, left, right = (np.array(c) for c in zip(*nodes))
    at = np.zeros(len(x), np.int64)
    while True:
        inner = np.flatnonzero(axis[at] >= 0)
        if not len(inner):
            return cut[at].astype(np.int32)
        here = at[inner]
        at[inner] = np.where(x[inner, axis[here]] < cut[here], left[here], right[here])


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


INDEX = "shard int, n int, ids array<string>, vectors binary, sizes array<int>, links binary, low array<double>, high array<double>, near binary, dist binary"
_LISTS = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.string())]))


def _graph(row: dict, dims: int, m: int) -> tuple[np.ndarray, list[np.ndarray]]:
    x = np.frombuffer(row["vectors"], np.float64).reshape(-1, dims)
    flat, layers, at = np.frombuffer(row["links"], np.int32), [], 0
    for t, size in enumerate(row["sizes"]):
        wide = 2 * m if t == 0 else m
        layers.append(flat[at : at + size * wide].reshape(size, wide))
        at += size * wide
    return x, layers


def node_boxes(nodes: list[tuple[int, float, int, int]], low: dict[int, np.ndarray], high: dict[int, np.ndarray], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The corners of every node's box, from those of the leaves' points; a leaf without points
    is nowhere."""
    lows, highs = np.full((len(nodes), dims), np.inf), np.full((len(nodes), dims), -np.inf)
    for at in range(len(nodes) - 1, -1, -1):  # children stand behind their parent
        axis, leaf, left, right = nodes[at]
        if axis < 0:
            lows[at], highs[at] = low.get(int(leaf), lows[at]), high.get(int(leaf), highs[at])
        else:
            lows[at], highs[at] = np.minimum(lows[left], lows[right]), np.maximum(highs[left], highs[right])
    return lows, highs


def reached_leaves(x: np.ndarray, reach: np.ndarray, nodes: list[tuple[int, float, int, int]], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): the leaves whose box lies within each row's squared reach, found down the
    tree: no row meets boxes below one that it doesn't reach."""
    axis, leaf, left, right = (np.array(c) for c in zip(*nodes))
    rows, at = np.arange(len(x)), np.zeros(len(x), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(rows):
        off = np.maximum(0, np.maximum(low[at] - x[rows], x[rows] - high[at]))
        near = (off * off).sum(1) < reach[rows]
        rows, at = rows[near], at[near]
        end = axis[at] < 0
        found.append((rows[end], leaf[at[end]].astype(np.int64)))
        rows, at = np.repeat(rows[~end], 2), np.stack([left[at[~end]], right[at[~end]]], 1).ravel()
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def nearest_neighbours(
    vectors: DataFrame,
    item: str,
    vector: str,
    *,
    dims: int,
    k: int = 10,
    m: int = 16,
    build_width: int = 40,
    search_width: int = 48,
    probe_width: int = 24,
    slack: float = 0.25,
    shards: int = 12,
    shard_rows: int = 50_000,
    sample: int = 20_000,
    sample_shard: int = 64,
    staging: Staging | None = None,
) -> DataFrame:
    """(item, neighbours): each item with its k nearest others, an array of (d, id) by
    distance and then id, d being the Euclidean distance.

    All items are indexed and looked up.  ``shards`` is the least number of shards, one more
    is made for every ``shard_rows`` points; the tree that cuts them is fitted on at
    most ``sample`` points or ``sample_shard`` for each shard, whichever is more, and a leaf that
    turns out to hold over three times ``shard_rows`` points is cut into shards by hash.  ``search_width`` and ``probe_width`` are how many candidates a search keeps
    in the point's own shard and in others.  Another shard is left out where its bounding box is farther than the k-th
    distance found so far / (1 + ``slack``): what it could improve is then within that factor.
    Items with equal vectors are each other's neighbours at distance 0, the least ids first.

    Null items, and vectors that are null or don't have ``dims`` components without nulls,
    are left out; an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    staging = staging or Staging(spark, "neighbours")
    items = vectors.select(F.col(f"`{item}`").cast("string").alias("id"), F.col(f"`{vector}`").alias("x"))
    items = items.filter((F.size("x") == dims) & F.col("id").isNotNull() & F.forall("x", lambda v: v.isNotNull()))
    points = items.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    points = staging.put("points", points)
    total = points.count()
    if not total:
        return spark.createDataFrame([], f"`{item}` string, neighbours array<struct<d:double,id:string>>")
    cut = max(shards, math.ceil(total / shard_rows))
    sample = max(sample, sample_shard * cut)
    # about twice the sample is asked for, so that no task sends more than its part of that
    drawn = points.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < math.ceil(2_000_000 * sample / total))
    some = drawn.select("x").orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()["x"]
    nodes = kd_tree(np.array(some.tolist()), cut)
    leaves = sum(a < 0 for a, *_ in nodes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(_matrix(b.column("x"), dims), nodes)), b.column("id"), b.column("x"), b.column("h")], ["leaf", "id", "x", "h"])

    placed = points.select("id", "x", F.xxhash64("id").alias("h")).mapInArrow(place, "leaf int, id string, x array<double>, h long")
    placed = staging.put("placed", placed)
    large = {r["leaf"]: math.ceil(r["count"] / shard_rows) for r in placed.groupBy("leaf").count().filter(F.col("count") > 3 * shard_rows).collect()}  # at most a row a leaf
    pieces = np.array([large.get(i, 1) for i in range(leaves)])
    first = np.concatenate([[0], np.cumsum(pieces)])  # the shards of leaf i begin at first[i]
    shard = F.col("leaf")
    if large:
        of = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("leaf") + 1)
        shard = of(first[:-1]) + F.pmod(F.hash("h"), of(pieces))
    placed = placed.select(shard.cast("int").alias("shard"), "id", "x", "h")
    leaves = int(first[-1])

    def index(t: pa.Table) -> pa.Table:
        x, h = _matrix(t["x"], dims), t["h"].to_numpy()
        level = hnsw.levels(((h.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53, m)
        order = np.lexsort((h, -level))
        x = np.ascontiguousarray(x[order])
        layers = hnsw.build(x, level[order], m, build_width)
        number, dist = hnsw.search(x, layers, x, k + 1, search_width)
        own = number == np.arange(len(x))[:, None]
        own[~own.any(1), -1] = True  # a point that missed itself gives up its last
        number, dist = number[~own].reshape(len(x), -1), dist[~own].reshape(len(x), -1)
        return pa.table(
            {
                "shard": pa.array([t["shard"][0].as_py()], pa.int32()),
                "n": pa.array([len(x)], pa.int32()),
                "ids": pa.array([t["id"].take(pa.array(order)).to_pylist()], pa.list_(pa.string())),
                "vectors": pa.array([x.tobytes()], pa.binary()),
                "sizes": pa.array([[len(a) for a in layers]], pa.list_(pa.int32())),
                "links": pa.array([b"".join(a.tobytes() for a in layers)], pa.binary()),
                "low": pa.array([x.min(0).tolist()], pa.list_(pa.float64())),
                "high": pa.array([x.max(0).tolist()], pa.list_(pa.float64())),
                "near": pa.array([number.astype(np.int32).tobytes()], pa.binary()),
                "dist": pa.array([dist.tobytes()], pa.binary()),
            }
        )

    built = placed.repartitionByRange(leaves, "shard").groupBy("shard").applyInArrow(index, INDEX)
    built = staging.put("index", built)
    boxes = built.select("shard", "low", "high").collect()  # a row a shard, at most sample / 2 or total / shard_rows
    leaf_low: dict[int, np.ndarray] = {}
    leaf_high: dict[int, np.ndarray] = {}
    there = {b["shard"] for b in boxes}
    for b in boxes:
        leaf = int(np.searchsorted(first, b["shard"], side="right")) - 1
        leaf_low[leaf] = np.minimum(leaf_low.get(leaf, np.inf), b["low"])
        leaf_high[leaf] = np.maximum(leaf_high.get(leaf, -np.inf), b["high"])
    low, high = node_boxes(nodes, leaf_low, leaf_high, dims)

    known = np.array(sorted(there))

    def own_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                near, dist = np.frombuffer(row["near"], np.int32).reshape(-1, k), np.frombuffer(row["dist"], np.float64).reshape(-1, k)
                yield _candidates(row["ids"], np.arange(row["n"]), near, dist, row["ids"])

    def other_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = np.frombuffer(row["vectors"], np.float64).reshape(-1, dims)
                reach = np.frombuffer(row["dist"], np.float64).reshape(-1, k)[:, -1]
                for s in range(0, len(x), 4096):
                    part = x[s : s + 4096]
                    r, leaf = reached_leaves(part, reach[s : s + 4096] / (1 + slack) ** 2, nodes, low, high)
                    many = pieces[leaf]
                    r, c = np.repeat(r, many), np.repeat(first[leaf], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    other = (c != row["shard"]) & np.isin(c, known)
                    r, c = r[other], c[other]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(c, pa.int32()),
                            pa.array([row["ids"][i] for i in r + s], pa.string()),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1) * dims, pa.int32()), pa.array(part[r].ravel())),
                            pa.array(reach[s + r]),
                        ],
                        ["shard", "id", "x", "reach"],
                    )

    lists = "id string, near array<struct<d:double,id:string>>"
    local = built.select("n", "ids", "near", "dist").mapInArrow(own_shard, lists)
    away = built.select("shard", "ids", "vectors", "dist").mapInArrow(other_shards, "shard int, id string, x array<double>, reach double")
    away = staging.put("away", away)
    per_shard = away.groupBy("shard").count().collect()  # at most a row a shard
    parts = {r["shard"]: max(1, math.ceil(r["count"] / 8192)) for r in per_shard} or {0: 1}
    part_of = F.create_map(*[F.lit(v) for kv in parts.items() for v in kv])
    away = away.withColumn("part", F.pmod(F.xxhash64("id"), F.element_at(part_of, F.col("shard")).cast("long")).cast("int"))
    graphs = built.select("shard", "ids", "vectors", "sizes", "links", F.explode(F.sequence(F.lit(0), F.coalesce(F.element_at(part_of, F.col("shard")), F.lit(1)) - 1)).alias("part"))

    def look_up(graph: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"id": pa.array([], pa.string()), "near": pa.array([], _LISTS)})
        row = graph.to_pylist()[0]
        x, layers = _graph(row, dims, m)
        reach = asked["reach"].to_numpy()
        number, dist = hnsw.search(x, layers, _matrix(asked["x"], dims), k, probe_width, reach)
        dist = np.where(dist < reach[:, None], dist, np.inf)
        some = np.flatnonzero(np.isfinite(dist).any(1))
        return pa.Table.from_batches([_candidates(asked["id"].to_pylist(), some, number[some], dist[some], row["ids"])])

    keys = ["shard", "part"]
    remote = graphs.groupBy(*keys).cogroup(away.groupBy(*keys)).applyInArrow(look_up, lists)
    merged = local.unionByName(remote).groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
    merged = merged.select("id", F.slice(F.array_sort("near"), 1, k).alias("near"))
    return _for_items(items, points, merged, item, k, staging)


def _candidates(ids: list[str], rows: np.ndarray, number: np.ndarray, dist: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """(id, near) of some rows; ``number`` names points, infinite distances name none."""
    have = np.isfinite(dist) & (number >= 0)
    count = have.sum(1)
    r, c = np.nonzero(have)
    pairs = pa.StructArray.from_arrays([pa.array(np.sqrt(dist[r, c])), pa.array([names[i] for i in number[r, c]], pa.string())], ["d", "id"])
    near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pairs)
    return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], pa.string()), near], ["id", "near"])


def _for_items(items: DataFrame, points: DataFrame, merged: DataFrame, item: str, k: int, staging: Staging) -> DataFrame:
    """From the neighbours of points to those of items: of each set of equal vectors the
    k + 1 least ids can be anyone's neighbours."""
    merged = staging.put("merged", merged)
    shared = points.filter("n > 1").select("x", F.col("id").alias("point"))
    copies = items.join(shared, "x").select("id", "point")
    salted = Window.partitionBy("point", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    least = copies.withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= k + 1).drop("_r")
    least = least.withColumn("_r", F.row_number().over(Window.partitionBy("point").orderBy("id"))).filter(F.col("_r") <= k + 1)
    members = staging.put("members", least.groupBy("point").agg(F.array_sort(F.collect_list("id")).alias("members")))
    at = merged.select(F.col("id").alias("of"), F.explode("near").alias("n")).select("of", F.col("n.d").alias("d"), F.col("n.id").alias("point"))
    at = at.unionByName(members.select(F.col("point").alias("of"), F.lit(0.0).alias("d"), "point"))
    at = at.join(members, "point", "left").select("of", "d", F.explode(F.coalesce("members", F.array("point"))).alias("id"))
    lists = at.groupBy("of").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k + 1).alias("near"))
    single = points.filter("n = 1").select("id", F.col("id").alias("of"))
    owners = single.unionByName(copies.select("id", F.col("point").alias("of")))
    near = owners.join(lists, "of", "left").select("id", F.coalesce("near", F.array().cast("array<struct<d:double,id:string>>")).alias("near"))
    return near.select(F.col("id").alias(item), F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k).alias("neighbours"))


def mutual_pairs(neighbours: DataFrame, item: str, within: float) -> DataFrame:
    """(a, b, d), a < b: items among each other's neighbours at most ``within`` apart."""
    pairs = neighbours.select(F.col(item).alias("a"), F.explode("neighbours").alias("n")).select("a", F.col("n.id").alias("b"), F.col("n.d").alias("d"))
    pairs = pairs.filter(F.col("d") <= within)
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("d"))
    return both.filter("n = 2").drop("n")
