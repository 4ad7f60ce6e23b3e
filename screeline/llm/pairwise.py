"""One ranking from pairwise votes: weighted least squares on the comparison graph.

Every compared pair gives a log-odds margin with a weight; the strengths whose differences
fit the margins best solve a system with the weighted Laplacian of the graph, by conjugate
gradient.  Solving again with margins and weights taken at the current strengths (iterative
reweighting) leads to the strengths that make the counted votes most likely, which is
what uneven numbers of votes per pair need.  What no ranking can explain, the cyclic part of
the margins, is reported per item.

The graph is cut into blocks of items by hash.  A block holds its items' edges as flat
arrays; a step sends, for every edge between two blocks, the one end's value to the other,
so a step costs as much as there are edges, whatever the number of blocks, and a hot item's
edges are spread over its neighbours' blocks.  The blocks' arrays are cached where they are
hashed to; the vectors are written after each step.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screeline.staging import Staging

_MATRIX = "b int, ids array<string>, li binary, ob binary, n binary, win binary"
_VECTORS = ["s", "x", "r", "u", "p", "q", "y", "d", "c"]
_STATE = "b int, " + ", ".join(f"{v} binary" for v in _VECTORS) + ", gamma double, delta double, most double"
_SENT = "b int, source int, sent binary, " + ", ".join(f"{v} binary" for v in _VECTORS)


def counted_votes(votes: DataFrame, voter: str, a: str, b: str, a_wins: Column, when: str, order: str) -> DataFrame:
    """(lo, hi, n, wins): for each pair the voters that compared it and those that put ``lo`` first.

    ``lo`` < ``hi`` are the pair's items.  Of a voter's votes on a pair only the first by
    (``when``, ``order``) counts, so repeated rows count once.  A pair with a null item or of
    an item with itself is left out; null voters are one voter.
    """
    quoted = lambda c: F.col(f"`{c}`")
    rows = votes.select(
        quoted(voter).alias("voter"), F.least(quoted(a), quoted(b)).alias("lo"), F.greatest(quoted(a), quoted(b)).alias("hi"),
        (a_wins == (quoted(a) < quoted(b))).alias("first"), quoted(when).alias("when"), quoted(order).alias("order"),
        (quoted(a) != quoted(b)).alias("two"),
    ).filter("two and first is not null")
    once = rows.groupBy("voter", "lo", "hi").agg(F.min(F.struct("when", "order", "first")).alias("v"))
    return once.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.count_if("v.first").alias("wins"))


def _block(t: pa.Table) -> pa.Table:
    src, lo, hi, ob = (t[c].to_numpy(zero_copy_only=False) for c in ("src", "lo", "hi", "ob"))
    ids, li = np.unique(src.astype(str), return_inverse=True)
    order = np.lexsort((src, hi, lo, ob))
    f = lambda c, kind: pa.array([t[c].to_numpy()[order].astype(kind).tobytes()], pa.binary())
    return pa.table(
        {
            "b": pa.array([t["b"][0].as_py()], pa.int32()),
            "ids": pa.array([ids.tolist()], pa.list_(pa.string())),
            "li": pa.array([li[order].astype(np.int32).tobytes()], pa.binary()),
            "ob": f("ob", np.int32),
            "n": f("n", np.float64),
            "win": f("win", np.float64),
        }
    )


class _Block:
    """The arrays of one block and the vectors of its items."""

    def __init__(self, matrix: pa.Table, state: dict | None = None):
        m = {c: matrix[c][0] for c in matrix.column_names}
        read = lambda c, kind: np.frombuffer(m[c].as_py(), kind)
        self.b, self.size = m["b"].as_py(), len(m["ids"])
        self.li, self.ob = read("li", np.int32), read("ob", np.int32)
        self.n, self.win = read("n", np.float64), read("win", np.float64)
        self.w = read("w", np.float64) if "w" in m else None
        begin = np.flatnonzero(np.diff(self.ob, prepend=-1))
        self.parts = {int(self.ob[i]): (i, j) for i, j in zip(begin, np.append(begin[1:], len(self.ob)))}
        for v in _VECTORS:
            raw = state.get(v) if state else None
            setattr(self, v, np.frombuffer(raw, np.float64) if raw else np.zeros(self.size))

    def sum(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.li, values, self.size)

    def messages(self, v: np.ndarray, kind: type) -> pa.Table:
        """The values of ``v`` at this end of every edge, a row for each block at the other
        end, and a row (source -1) that keeps the block's own vectors."""
        sent = []
        for other, (i, j) in self.parts.items():
            values = v[self.li[i:j]].astype(kind)
            if other == self.b:  # both ends here: an edge's two rows stand next to each other
                values = values.reshape(-1, 2)[:, ::-1]
            sent.append((other, self.b, values.tobytes(), {}))
        sent.append((self.b, -1, None, {k: getattr(self, k).tobytes() for k in _VECTORS}))
        columns = {"b": pa.array([x[0] for x in sent], pa.int32()), "source": pa.array([x[1] for x in sent], pa.int32()), "sent": pa.array([x[2] for x in sent], pa.binary())}
        return pa.table(columns | {k: pa.array([x[3].get(k) for x in sent], pa.binary()) for k in _VECTORS})

    def others(self, rows: list[dict], kind: type) -> np.ndarray:
        got = {r["source"]: r["sent"] for r in rows}
        return np.concatenate([np.frombuffer(got[other], kind).astype(np.float64) for other in self.parts])

    def saved(self, gamma: float = 0.0, delta: float = 0.0, most: float = 0.0) -> dict:
        return {"b": self.b} | {k: getattr(self, k).tobytes() for k in _VECTORS} | {"gamma": gamma, "delta": delta, "most": most}


def _state_table(row: dict, extra: dict | None = None) -> pa.Table:
    types = {"b": pa.int32(), "gamma": pa.float64(), "delta": pa.float64(), "most": pa.float64()}
    return pa.table({k: pa.array([v], types.get(k, pa.binary())) for k, v in (row | (extra or {})).items()})


def _own(rows: list[dict]) -> dict:
    return next(r for r in rows if r["source"] == -1)


def _margins(b: _Block) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-odds of each edge, seen from this end, and their weights."""
    won, lost = b.win + 0.5, b.n - b.win + 0.5
    return np.log(won / lost), won * lost / (won + lost)


def pairwise_strengths(
    pairs: DataFrame,
    *,
    ridge: float = 0.1,
    blocks: int = 6,
    block_edges: int = 2_000_000,
    rounds: int = 40,
    settled: float = 0.01,
    tolerance: float = 0.01,
    steps: int = 400,
    staging: Staging | None = None,
) -> DataFrame:
    """(item, strength, votes, wins, cyclic): every compared item with its strength in log-odds.

    ``pairs`` is (lo, hi, n, wins) as ``counted_votes`` gives it.  ``ridge`` pulls strengths
    to 0, by which items that won or lost everything stay finite and parts of the graph that are
    not joined are comparable.  The first solution fits smoothed log-odds, the next are
    reweighted, until no strength moves by more than ``settled``.  ``cyclic`` is the share of
    the item's weighted squared margins that the first solution leaves unexplained, the part
    that runs in cycles: 0 where all margins add up.

    An empty table gives an empty result.  Conjugate gradient that needs more than ``steps`` steps
    or reweighting that needs more than ``rounds`` rounds is an error, not a result.
    """
    spark = pairs.sparkSession
    staging = staging or Staging(spark, "pairwise")
    pairs = staging.put("pairs", pairs.select("lo", "hi", F.col("n").cast("double").alias("n"), F.col("wins").cast("double").alias("wins")))
    edges = pairs.count()
    if not edges:
        return spark.createDataFrame([], "item string, strength double, votes long, wins long, cyclic double")
    count = max(blocks, math.ceil(2 * edges / block_edges))
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    directed = pairs.select(hashed("lo").alias("b"), F.col("lo").alias("src"), hashed("hi").alias("ob"), "lo", "hi", "n", F.col("wins").alias("win")).unionByName(
        pairs.select(hashed("hi").alias("b"), F.col("hi").alias("src"), hashed("lo").alias("ob"), "lo", "hi", "n", (F.col("n") - F.col("wins")).alias("win"))
    )
    matrix = staging.put("matrix", directed.repartition(count, "b").groupBy("b").applyInArrow(_block, _MATRIX))
    matrix = matrix.repartition(count, "b").persist()

    def first(t: pa.Table) -> pa.Table:
        b = _Block(t)
        margin, w = _margins(b)
        b.d = b.sum(w) + ridge
        b.r = b.sum(w * margin)
        b.u = b.r / b.d
        return _state_table(b.saved(), {"w": w.tobytes()})

    def sends(alpha: float, beta: float):
        def run(m: pa.Table, state: pa.Table) -> pa.Table:
            b = _Block(m, state.to_pylist()[0])
            if alpha:
                b.p = b.u + beta * b.p
                b.q = b.y + beta * b.q
                b.x = b.x + alpha * b.p
                b.r = b.r - alpha * b.q
                b.u = b.r / b.d
            return b.messages(b.u, np.float32)

        return run

    def multiplied(m: pa.Table, sent: pa.Table) -> pa.Table:
        rows = sent.to_pylist()
        b = _Block(m, _own(rows))
        b.y = b.sum(b.w * (b.u[b.li] - b.others(rows, np.float32))) + ridge * b.u
        return _state_table(b.saved(float(b.r @ b.u), float(b.y @ b.u)))

    def moved(m: pa.Table, state: pa.Table) -> pa.Table:
        b = _Block(m, state.to_pylist()[0])
        b.s = b.s + b.x
        return b.messages(b.s, np.float64)

    def reweighted(m: pa.Table, sent: pa.Table) -> pa.Table:
        rows = sent.to_pylist()
        b = _Block(m, _own(rows))
        gap = np.clip(b.s[b.li] - b.others(rows, np.float64), -30, 30)
        chance = 1 / (1 + np.exp(-gap))
        w = b.n * chance * (1 - chance)
        most = float(np.abs(b.x).max(initial=0.0))
        if not b.c.any():  # the first solution, that of the margins themselves
            margin, weight = _margins(b)
            left, all_of = b.sum(weight * (margin - gap) ** 2), b.sum(weight * margin**2)
            b.c = np.divide(left, all_of, out=np.zeros(b.size), where=all_of > 0)
        b.d = b.sum(w) + ridge
        b.r = b.sum(b.win - b.n * chance) - ridge * b.s
        b.u = b.r / b.d
        b.x, b.p, b.q, b.y = (np.zeros(b.size) for _ in range(4))
        return _state_table(b.saved(most=most), {"w": w.tobytes()})

    both = lambda left, right, function, schema: left.groupBy("b").cogroup(right.groupBy("b")).applyInArrow(function, schema)
    state = staging.put("state", matrix.groupBy("b").applyInArrow(first, _STATE + ", w binary"))
    for turn in range(rounds + 1):
        weighted = matrix.join(state.select("b", "w").repartition(count, "b"), "b").persist()
        state = staging.put("vectors", state.drop("w"))
        gamma0 = gamma = alpha = beta = 0.0
        for step in range(steps + 1):
            sent = both(matrix, state, sends(alpha, beta), _SENT)
            state = staging.put("vectors", both(weighted, sent, multiplied, _STATE))
            dots = state.agg(F.sum("gamma"), F.sum("delta")).collect()[0]
            now, delta = float(dots[0]), float(dots[1])
            if not step:
                gamma0 = now
                alpha, beta = (now / delta if delta else 0.0), 0.0
            else:
                beta = now / gamma
                rest = delta - beta * now / alpha
                alpha = now / rest if rest else 0.0
            gamma = now
            if now <= tolerance * gamma0 and step or not alpha:
                break
        else:
            raise RuntimeError(f"conjugate gradient did not reach {tolerance} of its first residual in {steps} steps")
        sent = both(matrix, state, moved, _SENT)
        state = staging.put("state", both(matrix, sent, reweighted, _STATE + ", w binary"))
        weighted.unpersist()
        if turn and state.agg(F.max("most")).collect()[0][0] <= settled:
            break
    else:
        raise RuntimeError(f"strengths still move by more than {settled} after {rounds} rounds")

    def result(m: pa.Table, state: pa.Table) -> pa.Table:
        b = _Block(m, state.to_pylist()[0])
        return pa.table(
            {
                "item": m["ids"].combine_chunks().flatten(),
                "strength": b.s,
                "votes": b.sum(b.n).astype(np.int64),
                "wins": np.rint(b.sum(b.win)).astype(np.int64),
                "cyclic": b.c,
            }
        )

    strengths = staging.put("strengths", both(matrix, state, result, "item string, strength double, votes long, wins long, cyclic double"))
    matrix.unpersist()
    return strengths
