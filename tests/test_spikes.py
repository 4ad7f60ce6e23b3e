import numpy as np
import pytest
from pyspark.sql import functions as F

from screeline.operators.spikes import SpikeLimits, excursions, flag_faulty_fixes, stuck
from screeline.plans.quality import COLORADO

FIX = "track_id string, seq_no int, pt_no int, recorder string, lat double, lon double, ele double, loaded_at int"


def walk(n, seed=0, noise=0.5):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 39 + t * 5e-5 + rng.normal(0, 1e-5, n), -106 + rng.normal(0, 1e-5, n), 3000 + 30 * np.sin(t / 40) + rng.normal(0, noise, n)


def frame(spark, lat, lon, ele, track="t", recorder="r", seq=1):
    rows = [(track, seq, i + 1, recorder, float(a), float(b), None if c is None or np.isnan(c) else float(c), 0) for i, (a, b, c) in enumerate(zip(lat, lon, ele))]
    return spark.createDataFrame(rows, FIX)


def found(df, **how):
    return {r.pt_no: r for r in flag_faulty_fixes(df, **{"limits": COLORADO} | how).collect()}


def test_stuck_counts_within_groups():
    v = np.array([1.0] * 15 + [2.0] * 14 + [np.nan] * 20 + [3.0] * 16)
    first = np.zeros(len(v), bool)
    first[0] = True
    assert stuck(v, first, 15).sum() == 14 + 15
    first[8] = True  # two groups of equal values are two runs
    assert stuck(v, first, 15).sum() == 15


def test_excursion_returns_and_steps_stay():
    v = np.arange(40.0)[:, None]
    v[10:12] += 50
    v[25:] += 80
    off = excursions(v, np.zeros(40, int), np.arange(40), 3, 5.0)
    assert set(np.flatnonzero(off > 5)) == {10, 11}


@pytest.mark.parametrize("rise", [-9.0, -4.0, 0.0, 4.0, 9.0])
@pytest.mark.parametrize("size", [-14.0, 14.0])
def test_excursions_stand_out_on_any_slope(spark, rise, size):
    """Also where the course climbs more in two fixes than the excursion leaves it, near either
    end of a sequence, and for each length; the sound fixes beside stay out."""
    lat, lon, _ = walk(200)
    ele = 2000 + (900 if rise < 0 else 0) + rise * np.arange(200) / 2 + np.random.default_rng(7).normal(0, 0.1, 200)
    want = {7, 60, 61, 100, 101, 102, 150, 195}
    for at in want:
        ele[at] += size
    ele[120:] += 20  # a ledge that stays
    assert set(found(frame(spark, lat, lon, ele))) == {at + 1 for at in want}


def test_no_bounds_no_other_place(spark):
    lat, lon, ele = walk(60)
    df = frame(spark, lat - 60, lon + 200, ele - 2900)
    assert not found(df, limits=SpikeLimits()) and len(found(df)) == 60


def test_each_kind_of_fault(spark):
    lat, lon, ele = walk(400)
    ele[50] += 40
    ele[80:83] -= 60
    lat[120] += 0.003
    ele[150] = 9999.0
    lat[170], lon[170] = lon[170], lat[170]
    ele[200:220] = ele[200]
    ele[300:] += 45  # a step that stays
    ele[[240, 241, 260]] = np.nan
    got = found(frame(spark, lat, lon, ele))
    assert {51, 81, 82, 83} <= {p for p, r in got.items() if r.ele_spike}
    assert [p for p, r in got.items() if r.position_spike] == [121]
    assert got[151].impossible and got[171].elsewhere and got[171].impossible
    assert sorted(p for p, r in got.items() if r.stuck) == list(range(202, 221))
    assert set(got) == {51, 81, 82, 83, 121, 151, 171, *range(202, 221)}


def test_scatter_is_the_recorders_own(spark):
    quiet, loud = walk(600, 1, 0.3), walk(600, 2, 6.0)
    for w in (quiet, loud):
        w[2][300] += 30
    df = frame(spark, *quiet, "q", "quiet").unionByName(frame(spark, *loud, "l", "loud"))
    got = flag_faulty_fixes(df).filter("ele_spike").select("track_id", "pt_no").collect()
    assert [(r.track_id, r.pt_no) for r in got] == [("q", 301)]


def test_blocks_and_repeats_change_nothing(spark):
    lat, lon, ele = walk(900, 3)
    for at in (0, 63, 64, 65, 130, 500, 899):
        ele[at] += 70
    ele[250:275] = ele[250]
    df = frame(spark, lat, lon, ele)
    again = df.filter("pt_no % 7 = 0").withColumn("loaded_at", F.lit(1))
    whole, cut = found(df), found(df.unionByName(again), block=128, halo=64)
    assert set(whole) == set(cut) and len(whole) >= 29


def test_later_rows_count(spark):
    lat, lon, ele = walk(50)
    df = frame(spark, lat, lon, ele)
    wrong = df.filter("pt_no = 20").withColumn("ele", F.lit(9000.0)).withColumn("loaded_at", F.lit(-1))
    assert not found(df.unionByName(wrong)) and set(found(df.unionByName(wrong.withColumn("loaded_at", F.lit(1))))) == {20}


def test_nulls_empty_and_clashing_names(spark):
    lat, lon, ele = walk(30)
    df = frame(spark, lat, lon, ele)
    assert flag_faulty_fixes(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None), ("t", 1, 1, None, None, None, None, None), ("t", 1, None, "r", 39.0, -106.0, 12000.0, None)], FIX)
    assert [r.pt_no for r in flag_faulty_fixes(nulls).collect()] == [None]
    odd = df.withColumns({c: F.lit("x") for c in ("block", "own", "kind", "bin", "track", "seq", "pt", "version", "source", "a.b")})
    assert flag_faulty_fixes(odd).count() == 0
    assert set(found(df.withColumn("ele", F.when(F.col("pt_no") == 9, float("inf")).otherwise(F.col("ele"))))) == {9}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_short_sequences(spark, n):
    lat, lon, ele = walk(n)
    assert not found(frame(spark, lat, lon, ele))
