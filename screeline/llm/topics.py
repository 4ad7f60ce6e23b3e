"""Topics of texts: spherical k-means over hashed words, learned from all texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screeline.llm.hashed import WORD, codes, decoded

DIMS = 1 << 12
_UNIT = 1 << 24  # sums are of whole numbers, so their order and the partitions don't matter
_BLOCK = 1 << 13  # words at a time
_PART = 512  # numbers in a row between tasks


@dataclass(frozen=True)
class Topics:
    """Unit centres (topics, dims), already multiplied by the words' rarity."""

    centres: np.ndarray

    def of(self, texts: list[str | None]) -> list[str]:
        """The name of each text's topic; 'none' for texts without a word."""
        return self.of_packed(packed_words(texts))

    def of_packed(self, packed: list[bytes | None]) -> list[str]:
        """The same for packed words."""
        names = ["none"] * len(packed)
        if not len(self.centres):
            return names
        held = [i for i, words in enumerate(packed) if words]
        best = [scores.argmax(0) for _, _, scores in _scored([packed[i] for i in held], self.centres)]
        for at, topic in zip(held, np.concatenate(best).tolist() if best else []):
            names[at] = f"t{topic}"
        return names

    def label(self, table: DataFrame, words: str) -> DataFrame:
        """The table with ``topic`` in place of its packed ``words``."""
        known = table.sparkSession.sparkContext.broadcast(self)  # a few hundred kilobytes
        keep = [c for c in table.columns if c != words]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names = known.value.of_packed(b.column(words).to_pylist())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(names, pa.string())], [*keep, "topic"])

        return table.mapInArrow(run, table.drop(words).withColumn("topic", F.lit("")).schema)


def packed_words(texts: list[str | None]) -> list[bytes | None]:
    """Each whole text's distinct hashed words, ascending, two bytes each; None for null texts."""
    split = [WORD.findall(decoded(t).lower()) if t else [] for t in texts]
    word, owner = codes([w for ws in split for w in ws]) % DIMS, np.repeat(np.arange(len(texts)), [len(w) for w in split])
    pair = np.sort(owner * DIMS + word)
    pair = pair[np.diff(pair, prepend=-1) > 0]
    end = 2 * np.cumsum(np.bincount(pair // DIMS, minlength=len(texts)))
    flat, begin = (pair % DIMS).astype("<u2").tobytes(), 0
    packed: list[bytes | None] = []
    for t, e in zip(texts, end.tolist()):
        packed.append(None if t is None else flat[begin:e])
        begin = e
    return packed


def _blocks(packed: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, size) of some texts at a time, each of which has a word."""
    size = np.fromiter(map(len, packed), np.int64, len(packed)) // 2
    end = np.cumsum(size)
    lo = 0
    while lo < len(packed):
        hi = max(lo + 1, int(np.searchsorted(end, end[lo] - size[lo] + _BLOCK, "right")))
        yield np.frombuffer(b"".join(packed[lo:hi]), "<u2").astype(np.int64), size[lo:hi]
        lo = hi


def _scored(packed: list[bytes], centres: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, size, scores by topic) of some texts at a time; a text's scores don't depend on the others."""
    for word, size in _blocks(packed):
        yield word, size, np.add.reduceat(np.take(centres, word, axis=1), np.cumsum(size) - size, axis=1)


def _held(packed: list[bytes]) -> np.ndarray:
    """How many texts hold each word, and how many there are."""
    words = [w for w in packed if w]
    return np.append(sum((np.bincount(word, minlength=DIMS) for word, _ in _blocks(words)), np.zeros(DIMS, np.int64)), len(packed))


def _topic_sums(packed: list[bytes], centres: np.ndarray, rarity: np.ndarray, topics: int) -> np.ndarray:
    """The sums of the texts' vectors by start, topic and word, in parts of ``_UNIT``; ``centres`` (starts x topics, dims)."""
    starts = len(centres) // topics
    sums = np.zeros((starts, topics * DIMS))
    for word, size, scores in _scored([w for w in packed if w], centres):
        weight = rarity[word]
        norm = np.sqrt(np.add.reduceat(weight * weight, np.cumsum(size) - size))
        value = np.rint(weight / np.repeat(np.maximum(norm, 1e-12), size) * _UNIT)
        best = scores.reshape(starts, topics, len(size)).argmax(1) * DIMS
        for s in range(starts):
            sums[s] += np.bincount(np.repeat(best[s], size) + word, value, topics * DIMS)
    return sums.astype(np.int64).ravel()


def _firsts(packed: list[bytes], starts: int, topics: int) -> list[tuple[int, int, bytes]]:
    """(start, place, words): for each start the distinct texts of the least places."""
    words = sorted({w for w in packed if w})
    places = np.frombuffer(b"".join(hashlib.shake_128(w).digest(8 * starts) for w in words), "<u8").reshape(len(words), starts) >> 1
    return [(s, int(places[i, s]), words[i]) for s in range(starts) for i in np.argsort(places[:, s], kind="stable")[:topics]]


class _List:
    """Texts in a list."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def total(self, sums: Callable[[list[bytes]], np.ndarray], size: int) -> np.ndarray:
        return sums(self.packed)

    def firsts(self, starts: int, topics: int) -> list[tuple[int, int, bytes]]:
        return _firsts(self.packed, starts, topics)


class _Table:
    """Texts in a table, one column of packed words that are not null."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def total(self, sums: Callable[[list[bytes]], np.ndarray], size: int) -> np.ndarray:
        """The sums, ``size`` whole numbers, over all rows: by task, then by part of the numbers."""

        def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = np.zeros(size, np.int64)
            for b in batches:
                mine += sums(b.column(0).to_pylist())
            yield packed_sums({at: mine[at : at + _PART] for at in range(0, size, _PART) if mine[at : at + _PART].any()})

        def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine: dict[int, np.ndarray] = {}
            for b in batches:
                for at, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    mine[at] = mine.get(at, 0) + np.frombuffer(raw, "<i8")
            yield packed_sums(mine)

        def packed_sums(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([p.astype("<i8").tobytes() for p in parts.values()], pa.binary())], ["at", "sums"])

        schema = "at long, sums binary"
        total = np.zeros(size, np.int64)
        for r in self.rows.mapInArrow(by_task, schema).repartition("at").mapInArrow(by_part, schema).collect():
            part = np.frombuffer(r["sums"], "<i8")
            total[r["at"] : r["at"] + len(part)] = part
        return total

    def firsts(self, starts: int, topics: int) -> list[tuple[int, int, bytes]]:
        def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine: list[tuple[int, int, bytes]] = []
            for b in batches:
                mine = _firsts([*{w for _, _, w in mine}, *b.column(0).to_pylist()], starts, topics)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in mine], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["start", "place", "words"])

        rows = self.rows.mapInArrow(by_task, "start int, place long, words binary").distinct()
        nth = F.row_number().over(Window.partitionBy("start").orderBy("place", "words"))
        return [(r["start"], r["place"], r["words"]) for r in rows.withColumn("_nth", nth).filter(F.col("_nth") <= topics).orderBy("start", "_nth").collect()]


def _settle(texts: _List | _Table, topics: int, starts: int, rounds: int, settled: float) -> Topics:
    *held, count = texts.total(_held, DIMS + 1).tolist()
    held = np.array(held)
    firsts = texts.firsts(starts, topics)
    if not firsts:
        return Topics(np.zeros((0, DIMS)))
    rarity = np.where((held > 0) & (held * 2 <= count), np.log(count / np.maximum(held, 1)), 0.0)
    k = len(firsts) // starts
    centres = np.zeros((starts, k, DIMS))
    for i, (start, _, words) in enumerate(firsts):
        at = np.frombuffer(words, "<u2")
        centres[start, i % k, at] = rarity[at] / max(float(np.linalg.norm(rarity[at])), 1e-12)
    sums, open_ = np.full(centres.shape, np.inf), np.arange(starts)
    for _ in range(rounds):
        weighted = (centres[open_] * rarity).reshape(-1, DIMS)
        now = texts.total(lambda packed, w=weighted: _topic_sums(packed, w, rarity, k), len(open_) * k * DIMS).reshape(len(open_), k, DIMS) / _UNIT
        moved = np.linalg.norm(now - sums[open_], axis=2).sum(1)
        sums[open_] = now
        norm = np.linalg.norm(now, axis=2, keepdims=True)
        centres[open_] = np.where(norm > 0, now / np.maximum(norm, 1e-12), centres[open_])
        open_ = open_[moved > int(settled * count)]
        if not len(open_):
            break
    else:
        raise RuntimeError(f"the topics did not settle in {rounds} rounds")
    best = int(np.linalg.norm(sums, axis=2).sum(1).argmax())
    return Topics(centres[best] * rarity)


def k_means(texts: list[str | None], topics: int, starts: int = 8, rounds: int = 200, settled: float = 1e-6) -> Topics:
    """The topics of the texts.

    A text is the unit vector of its distinct words weighted by their rarity; words of more than
    half of the texts weigh nothing.  Of ``starts`` choices of centres, different texts drawn by a
    hash, the one counts whose texts end nearest to their centres.  A start ends when the sums of
    its topics' vectors move by no more than the share ``settled`` of the number of texts, rounded
    down: for less than a million texts, when they stay as they are.  An error if ``rounds`` do not get there.
    """
    return _settle(_List([w for w in packed_words(texts) if w is not None]), topics, starts, rounds, settled)


def learn_topics(table: DataFrame, words: str, topics: int, starts: int = 8, rounds: int = 200, settled: float = 1e-6) -> Topics:
    """The same of the texts whose packed words stand in a table, all of them; null ones don't count.

    Every round reads the table, so it should be staged.  The result doesn't depend on its partitions.
    """
    rows = table.select(F.col(f"`{words}`").alias("words")).filter("words is not null")
    return _settle(_Table(rows), topics, starts, rounds, settled)
