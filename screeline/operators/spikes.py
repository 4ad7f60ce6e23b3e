"""Implausible measurements: spikes, frozen values and impossible readings per source.

Every ordered sequence of readings is run through two robust exponentially weighted
control charts, one forward and one backward in time.  A chart predicts the next
reading from a level and a trend, clips what it did not expect before it updates
level, trend and scale, counts how long readings stay outside its limits, and starts
again at the new level when they stay outside for good.  A reading far from the
forecasts of both charts is suspected; a step that stays is far from one of them only.
Suspected readings are then measured against the course of their neighbours, and the
measure is compared with the usual scatter of the reading's own source, which is
estimated from the second differences of all of the source's readings.  Run-length
counters find frozen values, plain limits find impossible ones.

Plan: one shuffle of the needed columns by (sequence, block); the charts run over
arrays of many sequences at a time; only flagged readings and small histograms leave
the Python stage.  A sequence of any length is cut into blocks of ``block`` readings
that overlap by ``halo`` readings on either side, so no task holds more than a block,
and a hot source is spread over its sequences' blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from screeline.staging import Staging

METRES_PER_DEGREE = 111_320.0


@dataclass(frozen=True)
class SpikeLimits:
    """What counts as a fault.

    The possible range is the earth's.  The expected range is that of the data set, outside of
    which a reading belongs to another place; without bounds no reading does.
    """

    max_abs_lat: float = 90.0
    max_abs_lon: float = 180.0
    ele_range: tuple[float, float] = (-430.0, 8849.0)
    expected_lat: tuple[float, float] = (-np.inf, np.inf)
    expected_lon: tuple[float, float] = (-np.inf, np.inf)
    expected_ele: tuple[float, float] = (-np.inf, np.inf)
    scatter_factor: float = 8.0
    min_ele_m: float = 5.0
    min_position_m: float = 55.0
    longest_excursion: int = 3
    stuck_from: int = 15


@dataclass(frozen=True)
class ChartSettings:
    """The control charts: weights of level, trend and scale, the clip in scales, the
    scales from which a reading is outside, and the readings outside that restart a chart."""

    level: float = 0.4
    trend: float = 0.2
    scale: float = 0.05
    clip: float = 1.5
    outside: float = 1.5
    restart_after: int = 6
    slab_rows: int = 60_000


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Indexes at which any of the keys differs from the row before."""
    change = np.zeros(len(keys[0]), bool)
    if len(change):
        change[0] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(change)


def stuck(values: np.ndarray, first: np.ndarray, at_least: int) -> np.ndarray:
    """Marks each repeat, after the first, of a value held for ``at_least`` rows of one group.

    ``first`` marks the first row of each group; NaN is no value and ends a run.
    """
    n = len(values)
    if not n:
        return np.zeros(0, bool)
    new = np.ones(n, bool)
    new[1:] = first[1:] | ~(values[1:] == values[:-1])
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, n))
    return ~new & (np.repeat(length, length) >= at_least)


def chart(values: np.ndarray, start: np.ndarray, length: np.ndarray, how: ChartSettings, least: float) -> np.ndarray:
    """Marks the rows that lie outside both charts.

    ``values`` is (rows, channels) without NaN, sorted by group; the groups begin at
    ``start`` and have ``length`` rows.  All groups advance together, one row a step.
    """
    rows, channels = values.shape
    outside = np.zeros((2, rows), bool)
    if not rows:
        return outside[0]
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    end = start + length - 1
    groups = len(start)
    # usual jump of each group: the median distance of a row from the middle of its neighbours
    bend = np.zeros(rows)
    bend[1:-1] = np.sqrt(((values[1:-1] - (values[:-2] + values[2:]) / 2) ** 2).sum(1)) if rows > 2 else 0
    group_of = np.repeat(np.argsort(order, kind="stable"), length[np.argsort(order, kind="stable")])
    by_size = np.lexsort((bend, group_of))
    first_of = np.concatenate([[0], np.cumsum(length)[:-1]])
    usual = bend[by_size][first_of + length // 2]
    floor = least / 4  # a chart follows slopes that bend by less than what can be a fault
    scale = np.maximum(np.stack([usual, usual]), floor)
    level = np.stack([values[np.minimum(start + np.minimum(1, length - 1), end)], values[np.maximum(end - np.minimum(1, length - 1), start)]])
    for c in range(channels):  # the middle of the first three readings, from either end
        head = np.sort(np.stack([values[np.minimum(start + i, end), c] for i in range(3)]), axis=0)[1]
        tail = np.sort(np.stack([values[np.maximum(end - i, start), c] for i in range(3)]), axis=0)[1]
        level[0, :, c], level[1, :, c] = head, tail
    trend = np.zeros((2, groups, channels))
    early = np.arange(1, 7)  # the usual step of the first seven readings, from either end
    for side, at in enumerate((np.minimum(start[:, None] + early, end[:, None]), np.maximum(end[:, None] - early, start[:, None]))):
        before = np.maximum(at - 1, start[:, None]) if not side else np.minimum(at + 1, end[:, None])
        trend[side] = np.median(values[at] - values[before], axis=1)
    run = np.zeros((2, groups), np.int64)
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    for t in range(int(length[0])):
        k = int(active[t])
        at = np.stack([start[:k] + t, end[:k] - t])
        forecast = level[:, :k] + trend[:, :k]
        miss = values[at] - forecast
        size = np.sqrt((miss * miss).sum(2)) if channels > 1 else np.abs(miss[:, :, 0])
        s = scale[:, :k]
        out = (size > how.outside * s) & (size > 0.5 * least)
        outside[0, at[0]], outside[1, at[1]] = out[0], out[1]
        most = how.clip * s
        clipped = np.minimum(size, most)
        part = (clipped / np.maximum(size, 1e-12))[:, :, None] * miss
        level[:, :k] = forecast + how.level * part
        trend[:, :k] += how.trend * part
        scale[:, :k] = np.maximum(np.sqrt((1 - how.scale) * s * s + how.scale * clipped * clipped), floor)
        count = np.where(out, run[:, :k] + 1, 0)
        again = count >= how.restart_after
        if again.any():
            # the new level, with the usual step of the readings that stayed outside
            back = how.restart_after - 1
            earlier = np.stack([np.maximum(at[0] - back, start[:k]), np.minimum(at[1] + back, end[:k])])
            level[:, :k][again] = values[at][again]
            trend[:, :k][again] = (values[at][again] - values[earlier][again]) / back
            count[again] = 0
        run[:, :k] = count
    return outside[0] & outside[1]


def local_slope(values: np.ndarray, group: np.ndarray, at: np.ndarray, reach: int = 6) -> np.ndarray:
    """The usual step from reading to reading around each of ``at``: the median of the steps
    of its group within ``reach`` readings, which an excursion of three doesn't move."""
    n, channels = values.shape
    if n < 2 or not len(at):
        return np.zeros((len(at), channels))
    step = np.diff(values, axis=0)
    step[group[1:] != group[:-1]] = np.nan
    near = at[:, None] + np.arange(-reach, reach)
    inside = (near >= 0) & (near < n - 1)
    near = np.where(inside, near, 0)
    own = inside & (group[near] == group[at][:, None])
    slope = np.zeros((len(at), channels))
    for c in range(channels):
        steps = np.sort(np.where(own, step[near, c], np.nan), axis=1)  # NaN last
        many = (~np.isnan(steps)).sum(1)
        rows = np.arange(len(at))
        middle = (steps[rows, np.maximum(many - 1, 0) // 2] + steps[rows, np.minimum(many // 2, np.maximum(many - 1, 0))]) / 2
        slope[:, c] = np.where(many > 0, middle, 0.0)
    return slope


def excursion(values: np.ndarray, group: np.ndarray, suspects: np.ndarray, longest: int) -> np.ndarray:
    """How far each suspect stands off the course of its neighbours, as part of an
    excursion of at most ``longest`` rows that returns; 0 where it is part of none.

    The course joins a reading before and one after the excursion.  It is drawn through
    the nearest and the second nearest on either side, and the least distance counts, so
    that a sound reading beside a wrong one is not taken for the wrong one.  The readings
    joined must lie nearer to each other, up to the usual slope, than the excursion to the course.
    """
    n = len(values)
    best = np.zeros(len(suspects))
    slope = local_slope(values, group, suspects)
    for width in range(1, longest + 1):
        for offset in range(width):
            i = suspects - offset
            least = np.full(len(suspects), np.inf)
            fits = np.ones(len(suspects), bool)
            for x in (1, 2):
                for y in (1, 2):
                    before, after = i - x, i + width - 1 + y
                    inside = (before >= 0) & (after < n)
                    b, a = np.where(inside, before, 0), np.where(inside, after, 0)
                    inside &= group[b] == group[a]
                    if x == y == 1:
                        fits &= inside
                    p, q = values[b], values[a]
                    gap = np.sqrt(((q - p - slope * (width - 1 + x + y)) ** 2).sum(1))
                    for m in range(width):
                        w = (m + x) / (width - 1 + x + y)
                        off = values[np.where(inside, i + m, 0)] - (p * (1 - w) + q * w)
                        off = np.sqrt((off * off).sum(1))
                        least = np.where(inside, np.minimum(least, np.where(off > gap, off, 0)), least)
            best = np.where(fits & np.isfinite(least), np.maximum(best, least), best)
    return best


def excursions(values: np.ndarray, group: np.ndarray, suspects: np.ndarray, longest: int, least: float) -> np.ndarray:
    """``excursion`` in two rounds: what the first finds beyond ``least``, and not much
    weaker than anything near it, is taken off the course before the second, so that
    faults close to each other neither hide each other nor draw in their neighbours."""
    off = excursion(values, group, suspects, longest)
    near = np.zeros(len(values) + 2 * longest + 2)
    near[suspects + longest + 1] = off
    around = np.max([near[suspects + shift] for shift in range(2 * longest + 3)], axis=0) if len(suspects) else off
    sure = (off > least) & (off >= 0.7 * around)
    off = np.where(sure, off, 0)
    if sure.any() and not sure.all():
        stay = np.ones(len(values), bool)
        stay[suspects[sure]] = False
        at = np.cumsum(stay) - 1
        rest = suspects[~sure]
        off[~sure] = excursion(values[stay], group[stay], at[rest], longest)
    return off


def _bends(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with both neighbours in their group, and their distance from the neighbours' middle."""
    n = len(values)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    rows = np.flatnonzero(~first[1:-1] & ~first[2:]) + 1
    return rows, values[rows] - (values[rows - 1] + values[rows + 1]) / 2


def _middle_latitude(lat: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row the middle of three latitudes of its group (first, mid, last), by which
    degrees of longitude are measured; 0 where these are missing."""
    start = _starts(group)
    length = np.diff(np.append(start, len(group)))
    three = np.stack([lat[start], lat[start + length // 2], lat[start + length - 1]])
    middle = np.sort(np.where(np.abs(three) <= 90, three, np.nan), axis=0)  # NaN last
    known = (~np.isnan(middle)).sum(0)
    return np.repeat(np.where(known > 0, middle[np.maximum(known - 1, 0) // 2, np.arange(len(start))], 0.0), length)


BINS_PER_OCTAVE = 16

_OUT = pa.schema(
    [
        ("kind", pa.int8()),  # 0: a flagged reading; 1, 2: bins of ele and position scatter
        ("recorder", pa.string()),
        ("track", pa.string()),
        ("seq", pa.int32()),
        ("pt", pa.int32()),
        ("impossible", pa.bool_()),
        ("elsewhere", pa.bool_()),
        ("stuck", pa.bool_()),
        ("ele_off", pa.float64()),
        ("position_off", pa.float64()),
        ("bin", pa.int32()),
        ("n", pa.int64()),
        ("squares", pa.float64()),
    ]
)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    coded = column.combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy().astype(np.float64)


def _slab(t: pa.Table, limits: SpikeLimits, how: ChartSettings) -> pa.Table:
    """The flagged readings and histograms of whole groups."""
    track, seq, block = _codes(t["track"]), _numbers(t["seq"]), _numbers(t["block"])
    pt = _numbers(t["pt"])
    seq, pt = np.nan_to_num(seq, nan=-9e15), np.nan_to_num(pt, nan=-9e15)
    last = np.ones(len(pt), bool)  # of a reading delivered twice the later counts
    last[:-1] = (track[1:] != track[:-1]) | (seq[1:] != seq[:-1]) | (block[1:] != block[:-1]) | (pt[1:] != pt[:-1])
    keep = np.flatnonzero(last)
    t = t.take(pa.array(keep))
    track, seq, block, pt = track[keep], seq[keep], block[keep], pt[keep]
    first = np.zeros(len(keep), bool)
    first[_starts(track, seq, block)] = True
    group = np.cumsum(first)
    lat, lon, ele = (_numbers(t[c]) for c in ("lat", "lon", "ele"))
    own = t["own"].to_numpy().astype(bool)
    rec_coded = t["recorder"].combine_chunks().dictionary_encode()
    if isinstance(rec_coded, pa.ChunkedArray):
        rec_coded = rec_coded.combine_chunks()
    recorder = rec_coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    names = rec_coded.dictionary.to_pylist()

    with np.errstate(invalid="ignore"):
        no_place = (np.abs(lat) > limits.max_abs_lat) | (np.abs(lon) > limits.max_abs_lon)
        no_ele = (ele > limits.ele_range[1]) | (ele < limits.ele_range[0])
        far = (lat < limits.expected_lat[0]) | (lat > limits.expected_lat[1]) | (lon < limits.expected_lon[0]) | (lon > limits.expected_lon[1])
        off_ele = (ele < limits.expected_ele[0]) | (ele > limits.expected_ele[1])
    frozen = np.zeros(len(keep), bool)
    for v in (ele, lat, lon):
        frozen |= stuck(v, first, limits.stuck_from)

    ele_off, position_off = np.zeros(len(keep)), np.zeros(len(keep))
    tables = []
    east = np.cos(np.radians(_middle_latitude(lat, group))) * METRES_PER_DEGREE
    for kind, columns, good, least, off in (
        (1, (ele,), ~np.isnan(ele) & ~no_ele & ~off_ele, limits.min_ele_m, ele_off),
        (2, (lat * METRES_PER_DEGREE, lon * east), ~np.isnan(lat) & ~np.isnan(lon) & ~no_place & ~far, limits.min_position_m, position_off),
    ):
        rows = np.flatnonzero(good)
        if not len(rows):
            continue
        values = np.stack([c[rows] for c in columns], axis=1)
        g = group[rows]
        start = _starts(g)
        length = np.diff(np.append(start, len(rows)))
        begins = np.zeros(len(rows), bool)
        begins[start] = True
        suspects = np.flatnonzero(chart(values, start, length, how, least))
        # an excursion of which one reading is suspected is measured as a whole
        reach = np.arange(1 - limits.longest_excursion, limits.longest_excursion)
        suspects = np.unique(np.clip(suspects[:, None] + reach, 0, len(rows) - 1))
        off[rows[suspects]] = excursions(values, g, suspects, limits.longest_excursion, least)
        for c in range(values.shape[1]):
            mid, bend = _bends(values[:, c], begins)
            at = rows[mid]
            use = own[at]
            bend, of = np.abs(bend[use]), recorder[at[use]]
            bins = np.where(bend > 1e-9, np.floor(np.log2(np.maximum(bend, 1e-9)) * BINS_PER_OCTAVE), -10_000).astype(np.int64)
            key = of.astype(np.int64) * 100_000 + (bins + 20_000)
            unique, where = np.unique(key, return_inverse=True)
            r = unique // 100_000
            tables.append(
                {
                    "kind": np.full(len(unique), kind, np.int8),
                    "recorder": [names[i] if i >= 0 else None for i in r],
                    "bin": (unique - r * 100_000 - 20_000).astype(np.int32),
                    "n": np.bincount(where, minlength=len(unique)).astype(np.int64),
                    "squares": np.bincount(where, bend * bend, minlength=len(unique)),
                }
            )
    impossible, elsewhere = no_place | no_ele, far | off_ele
    flagged = np.flatnonzero(own & (impossible | elsewhere | frozen | (ele_off > 0) | (position_off > 0)))
    some = t.select(["recorder", "track", "seq", "pt"]).take(pa.array(flagged))
    tables.append(
        {
            "kind": np.zeros(len(flagged), np.int8),
            "recorder": some["recorder"],
            "track": some["track"],
            "seq": some["seq"],
            "pt": some["pt"],
            "impossible": impossible[flagged],
            "elsewhere": elsewhere[flagged],
            "stuck": frozen[flagged],
            "ele_off": ele_off[flagged],
            "position_off": position_off[flagged],
        }
    )
    parts = []
    for x in tables:
        size = len(x["kind"])
        parts.append(pa.table([(x[f.name] if isinstance(x.get(f.name), pa.ChunkedArray) else pa.array(x[f.name], f.type)) if f.name in x else pa.nulls(size, f.type) for f in _OUT], schema=_OUT))
    return pa.concat_tables(parts)


def _charted(limits: SpikeLimits, how: ChartSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def table() -> pa.Table:
            return pa.Table.from_batches(held).combine_chunks()

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < how.slab_rows:
                continue
            t = table()
            begin = _starts(_codes(t["track"]), np.nan_to_num(_numbers(t["seq"]), nan=-9e15), _numbers(t["block"]))
            cut = int(begin[-1])
            if cut:
                yield from _slab(t.slice(0, cut), limits, how).to_batches()
                t = t.slice(cut).combine_chunks()
                held, rows = t.to_batches(), t.num_rows
        if held:
            yield from _slab(table(), limits, how).to_batches()

    return run


def _type(field: pa.DataType) -> T.DataType:
    return {pa.int8(): T.ByteType(), pa.int32(): T.IntegerType(), pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType()}.get(field, T.StringType())


def flag_faulty_fixes(
    fixes: DataFrame,
    *,
    source: str = "recorder",
    track: str = "track_id",
    sequence: str = "seq_no",
    order: str = "pt_no",
    version: str | None = "loaded_at",
    lat: str = "lat",
    lon: str = "lon",
    ele: str = "ele",
    limits: SpikeLimits = SpikeLimits(),
    how: ChartSettings = ChartSettings(),
    block: int = 2048,
    halo: int = 64,
) -> DataFrame:
    """Faulty fixes, each once, with the reasons and the measures behind them.

    Columns: track, sequence and order under their own names; recorder; impossible,
    elsewhere, stuck, ele_spike, position_spike; ele_off and position_off in metres (0
    where the fix is part of no returning excursion); ele_scatter and position_scatter,
    the usual scatter of the fix's source.

    Defined cases.  Null or NaN readings are no faults and are left out of the charts.  A
    null source is a source of its own.  A null track, sequence or order is a value like
    any other.  Of rows with one key the one with the greatest ``version`` counts (of
    equal versions the one with the greatest readings).  Infinite readings are impossible.
    An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    column = lambda name: F.col(f"`{name}`")
    place = F.floor(F.coalesce(column(order), F.lit(0)) / F.lit(block)).cast("int")
    within = F.pmod(F.coalesce(column(order), F.lit(0)), F.lit(block))
    blocks: Column = F.array_compact(
        F.array(place, F.when((within < halo) & (place > 0), place - 1), F.when(within >= block - halo, place + 1))
    )
    rows = fixes.select(
        column(source).cast("string").alias("recorder"),
        column(track).cast("string").alias("track"),
        column(sequence).cast("int").alias("seq"),
        column(order).cast("int").alias("pt"),
        column(lat).cast("double").alias("lat"),
        column(lon).cast("double").alias("lon"),
        column(ele).cast("double").alias("ele"),
        (column(version) if version else F.lit(0)).alias("version"),
        F.explode(blocks).alias("block"),
        place.alias("place"),
    ).withColumn("own", F.col("block") == F.col("place")).drop("place")
    charted = (
        rows.repartition("track", "seq", "block")
        .sortWithinPartitions("track", "seq", "block", "pt", "version", "lat", "lon", "ele")
        .drop("version")
        .mapInArrow(_charted(limits, how), T.StructType([T.StructField(f.name, _type(f.type)) for f in _OUT]))
    )
    staging = Staging(fixes.sparkSession, "faulty-fixes")
    charted = staging.put("charted", charted)
    scatter = _scatter(charted.filter("kind > 0"))
    found = charted.filter("kind = 0").select("recorder", "track", "seq", "pt", "impossible", "elsewhere", "stuck", "ele_off", "position_off")
    found = found.join(scatter, found["recorder"].eqNullSafe(scatter["source"]), "left").drop("source")
    wide = lambda off, usual, least: F.col(off) > F.greatest(F.lit(least), limits.scatter_factor * F.coalesce(F.col(usual), F.lit(0.0)))
    found = found.withColumn("ele_spike", wide("ele_off", "ele_scatter", limits.min_ele_m)).withColumn("position_spike", wide("position_off", "position_scatter", limits.min_position_m))
    return found.filter("impossible or elsewhere or stuck or ele_spike or position_spike").select(
        F.col("track").alias(track), F.col("seq").alias(sequence), F.col("pt").alias(order), "recorder",
        "impossible", "elsewhere", "stuck", "ele_spike", "position_spike", "ele_off", "position_off", "ele_scatter", "position_scatter",
    )


def _scatter(bins: DataFrame) -> DataFrame:
    """Per source the usual scatter of ele and of position, one row a source.

    The root mean square of the second differences below five times their median, divided
    by what the middle of two neighbours adds; from bins, so that a source of any size
    costs a few hundred rows.
    """
    from pyspark.sql import Window

    bins = bins.groupBy("kind", "recorder", "bin").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"))
    by = Window.partitionBy("kind", "recorder")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    median = F.min(F.when(F.col("upto") * 2 >= F.col("all"), F.col("bin"))).over(by)
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(by)).withColumn("median", median)
    # five times the median is log2(5) octaves above it; a median of zero keeps everything
    usual = (F.col("median") == -10_000) | (F.col("bin") <= F.col("median") + int(np.log2(5) * BINS_PER_OCTAVE) + 1)
    one = bins.filter(usual).groupBy("kind", "recorder").agg((F.sqrt(F.sum("squares") / F.sum("n")) / F.sqrt(F.lit(1.5))).alias("scatter"))
    return one.groupBy(F.col("recorder").alias("source")).agg(
        F.max(F.when(F.col("kind") == 1, F.col("scatter"))).alias("ele_scatter"),
        F.max(F.when(F.col("kind") == 2, F.col("scatter"))).alias("position_scatter"),
    )
