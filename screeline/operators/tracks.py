"""Tracks: edges, runs without gaps, equal-step profiles, grade bands, cells and overlap.

A track is rows of (track, sequence, point number, lat, lon, ele); sequences of a track are
never bridged.  All orderings are within one sequence, so a window never holds more than a
sequence, and a hot track costs as many tasks as it has sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screeline.functions.geo import distance_m, metres_east_north
from screeline.operators.graph import min_label_components
from screeline.staging import Staging


@dataclass(frozen=True)
class TrackLimits:
    """Limits on edges (metres and percent), the bands of grade, and the coverage from which
    densities are released."""

    min_step: float = 0.5
    max_step: float = 100.0
    step_tolerance: float = 1e-7
    max_grade: float = 300.0
    medium_from: float = 20.0
    extreme_above: float = 35.0
    snap: float = 1e-9
    coverage: float = 0.95


LIMITS = TrackLimits()
SEQ = ["track_id", "seq_no"]


def edges(points: DataFrame, limits: TrackLimits = LIMITS) -> DataFrame:
    """One row for each point after the first of its sequence: dx, dz (null where an end has no
    elevation) and the first verdict that fits: near_zero, long_gap, missing, implausible, ok."""
    w = Window.partitionBy(*SEQ).orderBy("pt_no")
    p = points.select(
        *SEQ, "pt_no", "lat", "lon", "ele",
        F.lag("lat").over(w).alias("lat0"), F.lag("lon").over(w).alias("lon0"), F.lag("ele").over(w).alias("ele0"), F.row_number().over(w).alias("_n"),
    ).filter("_n > 1")
    p = p.withColumn("dx", distance_m(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))).withColumn("dz", F.col("ele") - F.col("ele0"))
    verdict = (
        F.when(F.col("dx") < limits.min_step, "near_zero")
        .when((F.col("dx") > limits.max_step) & (F.abs(F.col("dx") - limits.max_step) > limits.step_tolerance), "long_gap")
        .when(F.col("dz").isNull(), "missing")
        .when(F.abs("dz") / F.col("dx") * 100 > limits.max_grade, "implausible")
        .otherwise("ok")
    )
    return p.withColumn("verdict", verdict).drop("_n")


def runs(edges: DataFrame) -> DataFrame:
    """The accepted edges with their run: the edges between two that aren't accepted."""
    w = Window.partitionBy(*SEQ).orderBy("pt_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = edges.withColumn("run", F.sum(F.when(F.col("verdict") != "ok", 1).otherwise(0)).over(w))
    return numbered.filter("verdict = 'ok'")


def track_quality(edges: DataFrame) -> DataFrame:
    """Per track: recorded and accepted metres, edges by verdict, valid fraction, longest step."""
    ok = F.col("verdict") == "ok"
    q = edges.groupBy("track_id").agg(
        F.sum("dx").alias("recorded_m"),
        F.coalesce(F.sum(F.when(ok, F.col("dx"))), F.lit(0.0)).alias("accepted_m"),
        *[F.count_if(F.col("verdict") == v).alias(v) for v in ("near_zero", "long_gap", "missing", "implausible")],
        F.max("dx").alias("longest_step_m"),
        F.count_if(F.col("dx") == 0).alias("zero_steps"),
    )
    return q.withColumn("valid_fraction", F.coalesce(F.try_divide("accepted_m", "recorded_m"), F.lit(0.0)))


def _snapped(grade: Column, limits: TrackLimits) -> Column:
    for bound in (limits.medium_from, limits.extreme_above):
        grade = F.when(F.abs(grade - bound) <= limits.snap, F.lit(bound)).otherwise(grade)
    return grade


def band_summary(profile: DataFrame, by: list[str], order: list[str], run: list[str], limits: TrackLimits = LIMITS) -> DataFrame:
    """Per ``by``: metres, gain, metres and densities of the medium and extreme bands, and the
    longest stretches of each band and of both; a stretch ends with its run.

    ``profile`` has dx and dz, ordered by ``order`` within ``by``; a run is told by ``run``.
    Densities are null where there are no metres.
    """
    p = profile.withColumn("_grade", _snapped(F.try_divide(F.abs("dz") * 100, F.col("dx")), limits))
    medium = (F.col("_grade") >= limits.medium_from) & (F.col("_grade") <= limits.extreme_above)
    extreme = F.col("_grade") > limits.extreme_above
    p = p.withColumn("_medium", F.coalesce(medium, F.lit(False))).withColumn("_extreme", F.coalesce(extreme, F.lit(False)))
    p = p.withColumn("_steep", F.col("_medium") | F.col("_extreme"))
    w = Window.partitionBy(*by, *run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marks = ["_medium", "_extreme", "_steep"]
    for m in marks:
        p = p.withColumn(f"{m}_isle", F.sum(F.when(F.col(m), 0).otherwise(1)).over(w))
    longest = None
    for m in marks:
        isles = p.filter(m).groupBy(*by, *run, f"{m}_isle").agg(F.sum("dx").alias("_len"))
        best = isles.groupBy(*by).agg(F.max("_len").alias(f"longest{m}_m"))
        longest = best if longest is None else longest.join(best, by, "full_outer")
    total = p.groupBy(*by).agg(
        F.sum("dx").alias("metres"), F.sum(F.greatest(F.col("dz"), F.lit(0.0))).alias("gain_m"),
        *[F.coalesce(F.sum(F.when(F.col(m), F.col("dx"))), F.lit(0.0)).alias(f"{m[1:]}_m") for m in marks],
    )
    out = total.join(longest, by, "left")
    for m in ("medium", "extreme", "steep"):
        out = out.withColumn(f"{m}_density", F.try_divide(F.col(f"{m}_m") * 100, F.col("metres"))).withColumn(f"longest_{m}_m", F.coalesce(F.col(f"longest_{m}_m"), F.lit(0.0)))
    return out


def resample(runs: DataFrame, interval: Column, extra: list[str] | None = None) -> DataFrame:
    """Each run at n equal steps, n = max(1, ceil(length / interval)), both ends included.

    Rows (track, sequence, run, k, x, z); k from 0 to n.  Every edge makes the grid points
    that lie on it, so there is no join; ``extra`` columns (constant in a run) are kept.
    """
    key = [*SEQ, "run", *(extra or [])]
    upto = Window.partitionBy(*key).orderBy("pt_no").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    r = runs.withColumn("_x", F.sum("dx").over(upto))
    r = r.withColumn("_last", F.max("_x").over(whole)).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.max("_x").over(whole) / interval)).cast("int"))
    first = F.row_number().over(Window.partitionBy(*key).orderBy("pt_no")) == 1
    r = r.withColumn("_first", first)
    lo = F.when(F.col("_first"), F.lit(0)).otherwise(F.floor((F.col("_x") - F.col("dx")) * F.col("_n") / F.col("_last")).cast("int") + 1)
    hi = F.when(F.col("_x") == F.col("_last"), F.col("_n")).otherwise(F.floor(F.col("_x") * F.col("_n") / F.col("_last")).cast("int"))
    r = r.withColumn("_lo", lo).withColumn("_hi", hi).filter("_lo <= _hi").withColumn("k", F.explode(F.sequence("_lo", "_hi")))
    x = F.col("_last") * F.col("k") / F.col("_n")
    z = F.col("ele0") + (x - (F.col("_x") - F.col("dx"))) / F.col("dx") * F.col("dz")
    return r.select(*key, "k", x.alias("x"), z.alias("z"), F.col("_n").alias("n"), (F.col("_last") / F.col("_n")).alias("step"))


def smooth(resampled: DataFrame, window: Column, extra: list[str] | None = None) -> DataFrame:
    """The resampled profile with z averaged over 2 * half + 1 points, half =
    floor(window / (2 * step)), the ends extended in a straight line.

    Runs without a window, of fewer than three points or with half 0 stay as they are.
    """
    key = [*SEQ, "run", *(extra or [])]
    r = resampled.withColumn("_window", window)
    lists = r.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("k", "z"))).alias("_p"), F.first("n").alias("n"), F.first("step").alias("step"), F.first("_window").alias("_window")
    )
    lists = lists.withColumn("_z", F.transform("_p", lambda p: p["z"]))
    half = F.when((F.col("_window") > 0) & (F.col("n") >= 2), F.floor(F.col("_window") / (2 * F.col("step")))).otherwise(0).cast("int")
    lists = lists.withColumn("_half", half)
    at = lambda i: (
        F.when(i < 0, F.col("_z")[0] + i * (F.col("_z")[1] - F.col("_z")[0]))
        .when(i > F.col("n"), F.col("_z")[F.col("n")] + (i - F.col("n")) * (F.col("_z")[F.col("n")] - F.col("_z")[F.col("n") - 1]))
        .otherwise(F.get("_z", i))
    )
    mean = lambda k: F.aggregate(F.sequence(k - F.col("_half"), k + F.col("_half")), F.lit(0.0), lambda s, i: s + at(i)) / (2 * F.col("_half") + 1)
    smoothed = F.when(F.col("_half") == 0, F.col("_z")).otherwise(F.transform(F.sequence(F.lit(0), F.col("n")), mean))
    return lists.select(*key, "n", "step", F.posexplode(smoothed).alias("k", "z"))


def profile_steps(profile: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The equal steps of a profile as edges (dx, dz), numbered by k."""
    key = [*SEQ, "run", *(extra or [])]
    w = Window.partitionBy(*key).orderBy("k")
    p = profile.withColumn("dz", F.col("z") - F.lag("z").over(w)).filter("k > 0")
    return p.select(*key, "k", F.col("step").alias("dx"), "dz")


def profile_bands(runs: DataFrame, settings: DataFrame | None = None, interval: float = 10.0, window: float = 25.0) -> DataFrame:
    """Band summaries of the resampled, smoothed profiles, per track and setting.

    ``settings`` (interval, window), a few rows that the caller names, makes a summary for each;
    without it there is one, for the given interval and window.
    """
    spark = runs.sparkSession
    if settings is None:
        settings = spark.createDataFrame([(interval, window)], "interval double, window double")
    extra = ["interval", "window"]
    each = runs.crossJoin(F.broadcast(settings))
    steps = profile_steps(smooth(resample(each, F.col("interval"), extra), F.col("window"), extra), extra)
    return band_summary(steps, ["track_id", *extra], ["k"], ["seq_no", "run"])


def sensitivity(runs: DataFrame, intervals: tuple[float, ...] = (5.0, 10.0, 20.0), windows: tuple[float, ...] = (0.0, 25.0, 50.0), base: tuple[float, float] = (10.0, 25.0)) -> DataFrame:
    """Per track the ranges over all settings of medium and extreme density (points) and gain
    (metres), and the gain's range in percent of the base setting's (null where that is 0)."""
    settings = runs.sparkSession.createDataFrame([(i, w) for i in intervals for w in windows], "interval double, window double")
    b = profile_bands(runs, settings)
    at_base = F.max(F.when((F.col("interval") == base[0]) & (F.col("window") == base[1]), F.col("gain_m")))
    spread = lambda c: F.max(c) - F.min(c)
    r = b.groupBy("track_id").agg(spread("medium_density").alias("medium_range"), spread("extreme_density").alias("extreme_range"), spread("gain_m").alias("gain_range_m"), at_base.alias("_base"))
    return r.withColumn("gain_range_percent", F.when(F.col("_base") > 0, F.col("gain_range_m") / F.col("_base") * 100)).drop("_base")


def density_bounds(bands: DataFrame, quality: DataFrame, limits: TrackLimits = LIMITS) -> DataFrame:
    """Per track the densities, null below the coverage limit, and what they could be at
    least and at most over the whole recording (chord bounds)."""
    f = F.col("valid_fraction")
    b = bands.join(quality.select("track_id", "valid_fraction"), "track_id")
    for m in ("medium", "extreme"):
        v = F.col(f"{m}_density")
        b = b.withColumn(f"{m}_low", v * f).withColumn(f"{m}_high", F.least(F.lit(100.0), v * f + 100 * (1 - f)))
        b = b.withColumn(f"{m}_released", F.when(f >= limits.coverage, v))
    return b.select("track_id", "valid_fraction", *[f"{m}_{x}" for m in ("medium", "extreme") for x in ("low", "high", "released")])


def occupied_cells(runs: DataFrame, owner: list[str], grid_m: float = 50.0) -> DataFrame:
    """The distinct grid cells (owner, cx, cy) that accepted edges touch, sampled at half a cell."""
    n = F.greatest(F.lit(1), F.ceil(F.col("dx") / (grid_m / 2))).cast("int")
    r = runs.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    part = F.col("_i") / F.col("_n")
    east, north = metres_east_north(F.col("lat0") + (F.col("lat") - F.col("lat0")) * part, F.col("lon0") + (F.col("lon") - F.col("lon0")) * part)
    return r.select(*owner, F.floor(east / grid_m).alias("cx"), F.floor(north / grid_m).alias("cy")).distinct()


def cell_overlap(cells: DataFrame, owner: str, least: float = 0.5) -> DataFrame:
    """Pairs (a, b, common, fraction) of owners whose shared cells are at least the part
    ``least`` of the smaller owner's cells.

    Of a pair that overlaps so far, the smaller owner's rarest cells, all but as many as may be
    missing, hold one that the other has too.  Only these rarest cells look for partners, so a
    cell that a third of all owners cross proposes no pairs but those of owners with hardly any
    other cell; the proposed pairs are then counted over all their cells.
    """
    name = F.col(owner)
    c = cells.select(name.alias("o"), "cx", "cy").filter("o is not null").distinct()
    crossed = c.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("_many"))
    size = c.groupBy("o").agg(F.count(F.lit(1)).alias("_size"))
    sized = c.join(size, "o")
    rarest = sized.join(crossed, ["cx", "cy"]).withColumn("_r", F.row_number().over(Window.partitionBy("o").orderBy("_many", "cx", "cy")))
    rarest = rarest.filter(F.col("_r") <= F.col("_size") - F.ceil(F.col("_size") * least - 1e-9) + 1).select("cx", "cy", F.col("o").alias("s"), F.col("_size").alias("_ss"))
    all_of = sized.select("cx", "cy", F.col("o").alias("t"), F.col("_size").alias("_st"))
    order = (F.col("_ss") < F.col("_st")) | ((F.col("_ss") == F.col("_st")) & (F.col("s") < F.col("t")))
    proposed = rarest.join(all_of, ["cx", "cy"]).filter(order).select("s", "t", "_ss").distinct()
    counted = proposed.join(c.withColumnRenamed("o", "s"), "s").join(c.withColumnRenamed("o", "t"), ["t", "cx", "cy"])
    pairs = counted.groupBy("s", "t", "_ss").agg(F.count(F.lit(1)).alias("common")).withColumn("fraction", F.col("common") / F.col("_ss"))
    return pairs.filter(F.col("fraction") >= least).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"), "common", "fraction")


def overlap_groups(owners: DataFrame, links: DataFrame, owner: str, staging: Staging | None = None) -> DataFrame:
    """(owner, group, size): every owner with the least member of its group of linked owners."""
    staging = staging or Staging(owners.sparkSession, "overlap")
    labels = min_label_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), staging)
    g = owners.select(owner).distinct().join(labels, F.col(owner) == F.col("node"), "left").select(owner, F.coalesce("label", owner).alias("group"))
    sizes = g.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    return g.join(sizes, "group").select(owner, "group", "size")


def geometry_signature(points: DataFrame) -> DataFrame:
    """(track, points, signature): a hash of the rounded geometry in order, without times.

    Latitude and longitude count to six decimals, elevation to one, rounded half to even;
    a null elevation is written as null, sequences stay apart.
    """
    text = F.concat_ws(",", F.bround(F.col("lat") * 1_000_000).cast("long").cast("string"), F.bround(F.col("lon") * 1_000_000).cast("long").cast("string"), F.coalesce(F.bround(F.col("ele") * 10).cast("long").cast("string"), F.lit("null")))
    seq = points.groupBy(*SEQ).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pt_no", text.alias("t")))), lambda p: p["t"]), ";").alias("s"), F.count(F.lit(1)).alias("n"))
    return seq.groupBy("track_id").agg(F.sum("n").alias("points"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq_no", "s"))), lambda p: p["s"]), "/"), 256).alias("signature"))


def validate_tracks(points: DataFrame, lat: tuple[float, float] = (36.8, 41.2), lon: tuple[float, float] = (-109.2, -101.8)) -> DataFrame:
    """Per track: its sequences of two points or more, the share of points with elevation, the
    distance between its ends, and the first rule it breaks (null: it is valid)."""
    nan = lambda c: F.col(c).isNull() | F.isnan(c)
    p = points.withColumn("_bad", nan("lat") | nan("lon") | (F.abs("lat") > 90) | (F.abs("lon") > 180) | (~F.isnan("ele") & (F.abs("ele") == float("inf"))))
    p = p.withColumn("_away", ~F.col("lat").between(*lat) | ~F.col("lon").between(*lon))
    seq = p.groupBy(*SEQ).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_bad").alias("bad"), F.count_if("_away").alias("away"), F.count("ele").alias("with_ele"),
        F.min(F.struct("pt_no", "lat", "lon")).alias("first"), F.max(F.struct("pt_no", "lat", "lon")).alias("last"),
    )
    t = seq.groupBy("track_id").agg(
        F.count_if(F.col("n") >= 2).alias("sequences"), F.sum("n").alias("points"), F.sum("bad").alias("bad"), F.sum("away").alias("away"), F.sum("with_ele").alias("with_ele"),
        F.min(F.struct("seq_no", "first")).alias("first"), F.max(F.struct("seq_no", "last")).alias("last"),
    )
    a, b = F.col("first.first"), F.col("last.last")
    rule = F.when(F.col("bad") > 0, "coordinate_out_of_range").when(F.col("sequences") == 0, "no_sequence_of_two_points").when(F.col("away") > 0, "outside_region")
    return t.select("track_id", "sequences", "points", (F.col("with_ele") / F.col("points")).alias("elevation_coverage"), distance_m(a["lat"], a["lon"], b["lat"], b["lon"]).alias("endpoint_gap_m"), rule.alias("problem"))


def up_to(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """The points up to a cut (track_id, last_seq, last_pt) of their track; other tracks whole."""
    c = points.join(cuts, "track_id", "left")
    keep = F.col("last_seq").isNull() | (F.col("seq_no") < F.col("last_seq")) | ((F.col("seq_no") == F.col("last_seq")) & (F.col("pt_no") <= F.col("last_pt")))
    return c.filter(keep).select(points.columns)


def assemble(parts: DataFrame, components: DataFrame) -> DataFrame:
    """Tracks put together from component tracks, one after the other and without bridging.

    ``components`` is (route, place, track_id); the sequences of a component follow those of the
    components before.  The result is (track_id: the route, seq_no, pt_no, lat, lon, ele).
    """
    p = parts.join(components, "track_id").select(F.col("route").alias("_route"), "place", "seq_no", "pt_no", "lat", "lon", "ele")
    seqs = p.select("_route", "place", "seq_no").distinct()
    seqs = seqs.withColumn("new", F.row_number().over(Window.partitionBy("_route").orderBy("place", "seq_no")).cast("int"))
    return p.join(seqs, ["_route", "place", "seq_no"]).select(F.col("_route").alias("track_id"), F.col("new").alias("seq_no"), "pt_no", "lat", "lon", "ele")
