import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from screeline.operators import tracks

POINT = "track_id string, seq_no int, pt_no int, lat double, lon double, ele double"
BY = ["track_id"]


def profile(spark, *sequences):
    """A track along a meridian: sequences of positions and elevations in metres."""
    rows = [("t", s, i, 39 + math.degrees(x / 6371008.8), -106.0, None if z is None else float(z)) for s, (xs, zs) in enumerate(sequences, 1) for i, (x, z) in enumerate(zip(xs, zs), 1)]
    return spark.createDataFrame(rows, POINT)


def bands(points, **how):
    return tracks.profile_bands(tracks.runs(tracks.edges(points)), **how).collect()[0]


def test_constant_slope_and_its_reverse(spark):
    xs, zs = [0, 50, 100, 200, 250], [3000.0, 3020, 3040, 3080, 3100]
    up = bands(profile(spark, (xs, zs)))
    assert up.gain_m == pytest.approx(100) and up.extreme_density == pytest.approx(100)
    down = bands(profile(spark, (xs[::-1], zs[::-1])))
    assert down.gain_m == pytest.approx(0, abs=1e-6) and down.extreme_density == pytest.approx(100)


def test_sequences_are_not_bridged(spark):
    p = profile(spark, ([0, 50, 100], [3000.0, 3020, 3040]), ([10000, 10050, 10100], [4000.0, 4020, 4040]))
    q = tracks.track_quality(tracks.edges(p)).collect()[0]
    b = bands(p)
    assert q.recorded_m == pytest.approx(200)
    assert b.longest_extreme_m == pytest.approx(100) and b.extreme_m == pytest.approx(200)


def test_gaps_end_runs(spark):
    p = profile(spark, ([0, 50, 1000, 1050, 1050, 1100, 1150], [3000.0, 3020, 3200, 3220, 3300, None, 3340]))
    e = tracks.edges(p)
    q = tracks.track_quality(e).collect()[0]
    assert (q.long_gap, q.near_zero, q.missing) == (1, 1, 2)
    r = tracks.runs(e)
    assert r.select("run").distinct().count() == 2
    b = bands(p)
    assert b.gain_m == pytest.approx(40) and b.longest_extreme_m == pytest.approx(50)


def test_spike_flat_and_unusable(spark):
    spike = tracks.track_quality(tracks.edges(profile(spark, ([0, 10, 20, 30], [3000.0, 3100, 3000, 3001])))).collect()[0]
    assert spike.implausible == 2 and spike.valid_fraction < 0.95
    flat = profile(spark, ([0, 50, 100], [3000.0] * 3))
    assert bands(flat).gain_m == 0
    assert tracks.sensitivity(tracks.runs(tracks.edges(flat))).collect()[0].gain_range_percent is None
    still = tracks.edges(profile(spark, ([0, 0], [3000.0, 4000.0])))
    assert tracks.track_quality(still).collect()[0].valid_fraction == 0
    assert tracks.profile_bands(tracks.runs(still)).count() == 0


@pytest.mark.parametrize(
    ("dx", "dz", "medium", "extreme", "gain", "steep"),
    [([10.0, 20, 30, 40], [2.0, 7, 12, 0], 30, 30, 21, 60), ([100.0], [25.0], 100, 0, 25, 100), ([100.0, 50, 80], [50.0, 0, 40], 0, 180 / 230 * 100, 90, 100)],
)
def test_bands_of_edges(spark, dx, dz, medium, extreme, gain, steep):
    e = spark.createDataFrame([("t", 1, 0, i, float(x), float(z)) for i, (x, z) in enumerate(zip(dx, dz))], "track_id string, seq_no int, run int, k int, dx double, dz double")
    b = tracks.band_summary(e, BY, ["k"], ["seq_no", "run"]).collect()[0]
    assert b.medium_density == pytest.approx(medium) and b.extreme_density == pytest.approx(extreme)
    assert b.gain_m == gain and b.longest_steep_m == steep


def test_smoothing_with_different_windows_per_run(spark):
    rng = np.random.default_rng(1)
    xs = [0, 7, 19, 30, 42, 55]
    p = profile(spark, (xs, rng.normal(3000, 3, 6).tolist()), ([0.0, 40, 95, 140], [3000.0, 3010, 3005, 3030]))
    r = tracks.resample(tracks.runs(tracks.edges(p)), F.lit(10.0))
    got = tracks.smooth(r, F.lit(25.0)).orderBy("seq_no", "k").toPandas()
    raw = r.orderBy("seq_no", "k").toPandas()
    for seq, part in raw.groupby("seq_no"):
        z, n = part.z.to_numpy(), int(part.n.iloc[0])
        half = int(25 // (2 * part.step.iloc[0]))
        wide = np.concatenate([z[0] - np.arange(half, 0, -1) * (z[1] - z[0]), z, z[n] + np.arange(1, half + 1) * (z[n] - z[n - 1])])
        want = np.convolve(wide, np.ones(2 * half + 1) / (2 * half + 1), "valid")
        assert np.allclose(got[got.seq_no == seq].z, want)


def test_density_bounds(spark):
    b = spark.createDataFrame([("a", 30.0, 40.0), ("b", 30.0, 40.0), ("c", None, None)], "track_id string, medium_density double, extreme_density double")
    q = spark.createDataFrame([("a", 0.9), ("b", 1.0), ("c", 0.5)], "track_id string, valid_fraction double")
    r = {x.track_id: x for x in tracks.density_bounds(b, q).collect()}
    assert (r["a"].medium_low, r["a"].medium_high, r["a"].extreme_low, r["a"].extreme_high) == pytest.approx((27, 37, 36, 46))
    assert r["a"].medium_released is None and r["b"].medium_released == 30 and r["b"].medium_low == r["b"].medium_high == 30
    assert r["c"].medium_low is None


def test_overlap_groups(spark):
    cells = spark.createDataFrame([("a", 0, 0), ("b", 1, 1), ("c", 1, 1), ("d", 9, 9)], "r string, cx int, cy int")
    links = tracks.cell_overlap(cells, "r")
    assert [(x.a, x.b, x.common) for x in links.collect()] == [("b", "c", 1)]
    prior = spark.createDataFrame([("a", "b")], "a string, b string")
    g = {x.r: (x.group, x["size"]) for x in tracks.overlap_groups(cells, links.select("a", "b").unionByName(prior), "r").collect()}
    assert g == {"a": ("a", 3), "b": ("a", 3), "c": ("a", 3), "d": ("d", 1)}


@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
def test_overlap_equals_all_pairs(spark, least):
    rng = np.random.default_rng(int(least * 10))
    sets = {f"o{i:02}": {(0, 0)} | {(int(x), 0) for x in rng.integers(0, 25, rng.integers(1, 12))} for i in range(40)}
    cells = spark.createDataFrame([(o, x, y) for o, cs in sets.items() for x, y in cs] + [(None, 0, 0)], "o string, cx int, cy int")
    got = {(r.a, r.b): (r.common, r.fraction) for r in tracks.cell_overlap(cells, "o", least).collect()}
    want = {}
    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n / min(len(sets[a]), len(sets[b])) >= least:
                want[(a, b)] = (n, pytest.approx(n / min(len(sets[a]), len(sets[b]))))
    assert got == want and want


def test_signature_ignores_times_and_keeps_sequences(spark):
    one = profile(spark, ([0, 50], [3000.0, None]), ([90, 130], [1.0, 2.0]))
    joined = profile(spark, ([0, 50, 90, 130], [3000.0, None, 1.0, 2.0]))
    a, b = (tracks.geometry_signature(x).collect()[0] for x in (one, joined))
    assert a.points == b.points == 4 and a.signature != b.signature


def test_prefix_and_assembly(spark):
    p = profile(spark, ([0, 50, 100], [1.0, 2, 3]), ([0, 50], [4.0, 5]))
    cut = spark.createDataFrame([("t", 1, 2)], "track_id string, last_seq int, last_pt int")
    assert tracks.up_to(p, cut).count() == 2
    parts = spark.createDataFrame([("route", 2, "t"), ("route", 1, "t")], "route string, place int, track_id string")
    a = tracks.assemble(p, parts)
    assert a.select("seq_no").distinct().count() == 4 and a.count() == 10


def test_empty_tracks(spark):
    p = profile(spark)
    e = tracks.edges(p)
    assert tracks.track_quality(e).count() == tracks.profile_bands(tracks.runs(e)).count() == tracks.validate_tracks(p).count() == 0
