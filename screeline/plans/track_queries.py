"""Queries over GPS tracks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from screeline.operators import tracks
from screeline.operators.latest import latest_rows
from screeline.plans.registry import query
from screeline.session import table

KEY = ["track_id", "seq_no", "pt_no"]

# --- SQL, for DuckDB ---------------------------------------------------------------------------
_POINTS = """points AS (
  SELECT track_id, seq_no, pt_no, route_id, lat, lon, ele FROM (
    SELECT *, row_number() OVER (PARTITION BY track_id, seq_no, pt_no ORDER BY loaded_at DESC NULLS LAST, route_id DESC NULLS LAST, lat DESC NULLS LAST, lon DESC NULLS LAST, ele DESC NULLS LAST) AS n
    FROM trkpt WHERE track_id IS NOT NULL AND seq_no IS NOT NULL AND pt_no IS NOT NULL) WHERE n = 1)"""
_DIST = """2 * 6371008.8::DOUBLE * asin(sqrt(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
    pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))))"""
_EDGES = f"""{_POINTS},
lagged AS (
  SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, lag(ele) OVER w AS ele0, row_number() OVER w AS n
  FROM points WINDOW w AS (PARTITION BY track_id, seq_no ORDER BY pt_no)),
measured AS (
  SELECT track_id, seq_no, pt_no, route_id, lat0, lon0, lat, lon, ele0,
    {_DIST.replace("{a}lat", "lat0").replace("{a}lon", "lon0").replace("{b}lat", "lat").replace("{b}lon", "lon")} AS dx, ele - ele0 AS dz
  FROM lagged WHERE n > 1),
edges AS (
  SELECT *, CASE WHEN dx < 0.5 THEN 'near_zero' WHEN dx > 100 AND abs(dx - 100) > 1e-7 THEN 'long_gap' WHEN dz IS NULL THEN 'missing'
    WHEN abs(dz) / dx * 100 > 300 THEN 'implausible' ELSE 'ok' END AS verdict FROM measured),
runs AS (
  SELECT * FROM (SELECT *, sum(CASE WHEN verdict <> 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, seq_no ORDER BY pt_no ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM edges)
  WHERE verdict = 'ok')"""


def _bands(source: str, by: str, order: str) -> str:
    """CTEs from ``source`` (by, seq_no, run, order, dx, dz) to ``bands``."""
    return f"""graded AS (
  SELECT *, CASE WHEN abs(g - 20) <= 1e-9 THEN 20.0 WHEN abs(g - 35) <= 1e-9 THEN 35.0 ELSE g END AS grade
  FROM (SELECT *, CASE WHEN dx <> 0 THEN abs(dz) * 100 / dx END AS g FROM {source})),
marked AS (SELECT *, coalesce(grade BETWEEN 20 AND 35, false) AS medium, coalesce(grade > 35, false) AS extreme, coalesce(grade >= 20, false) AS steep FROM graded),
isles AS (
  SELECT *, sum((NOT medium)::INT) OVER w AS im, sum((NOT extreme)::INT) OVER w AS ie, sum((NOT steep)::INT) OVER w AS ist
  FROM marked WINDOW w AS (PARTITION BY {by}, seq_no, run ORDER BY {order} ROWS UNBOUNDED PRECEDING)),
lm AS (SELECT {by}, max(l) AS l FROM (SELECT {by}, sum(dx) AS l FROM isles WHERE medium GROUP BY {by}, seq_no, run, im) GROUP BY {by}),
le AS (SELECT {by}, max(l) AS l FROM (SELECT {by}, sum(dx) AS l FROM isles WHERE extreme GROUP BY {by}, seq_no, run, ie) GROUP BY {by}),
ls AS (SELECT {by}, max(l) AS l FROM (SELECT {by}, sum(dx) AS l FROM isles WHERE steep GROUP BY {by}, seq_no, run, ist) GROUP BY {by}),
totals AS (
  SELECT {by}, sum(dx) AS metres, sum(greatest(dz, 0)) AS gain_m, coalesce(sum(dx) FILTER (medium), 0) AS medium_m,
    coalesce(sum(dx) FILTER (extreme), 0) AS extreme_m, coalesce(sum(dx) FILTER (steep), 0) AS steep_m FROM marked GROUP BY {by}),
bands AS (
  SELECT t.*, 100 * medium_m / metres AS medium_density, 100 * extreme_m / metres AS extreme_density, 100 * steep_m / metres AS steep_density,
    coalesce(lm.l, 0) AS longest_medium_m, coalesce(le.l, 0) AS longest_extreme_m, coalesce(ls.l, 0) AS longest_steep_m
  FROM totals t LEFT JOIN lm USING ({by}) LEFT JOIN le USING ({by}) LEFT JOIN ls USING ({by}))"""


_MEASURES = ["metres", "gain_m", "medium_m", "extreme_m", "steep_m", "medium_density", "extreme_density", "steep_density", "longest_medium_m", "longest_extreme_m", "longest_steep_m"]
_ROUNDED = ", ".join(f"round({m}, 4) AS {m}" for m in _MEASURES)
_SETTINGS = "settings AS (SELECT i::DOUBLE AS interval, w::DOUBLE AS win FROM (VALUES {}) v(i, w))"
_PROFILE = """upto AS (SELECT r.*, s.interval, s.win, sum(dx) OVER (PARTITION BY track_id, seq_no, run, interval, win ORDER BY pt_no ROWS UNBOUNDED PRECEDING) AS x FROM runs r CROSS JOIN settings s),
whole AS (SELECT *, max(x) OVER p AS last, row_number() OVER (PARTITION BY track_id, seq_no, run, interval, win ORDER BY pt_no) AS nth FROM upto WINDOW p AS (PARTITION BY track_id, seq_no, run, interval, win)),
cut AS (SELECT *, greatest(1, ceil(last / interval))::INT AS n FROM whole),
spans AS (
  SELECT *, CASE WHEN nth = 1 THEN 0 ELSE floor((x - dx) * n / last)::INT + 1 END AS lo, CASE WHEN x = last THEN n ELSE floor(x * n / last)::INT END AS hi FROM cut),
grid AS (SELECT *, unnest(range(lo, hi + 1))::INT AS k FROM spans WHERE lo <= hi),
resampled AS (
  SELECT track_id, seq_no, run, interval, win, k, n, last * k / n AS x, ele0 + (last * k / n - (x - dx)) / dx * dz AS z, last / n AS step FROM grid)"""
_SMOOTH = """halves AS (SELECT *, CASE WHEN win > 0 AND n >= 2 THEN floor(win / (2 * step))::INT ELSE 0 END AS half FROM resampled),
lists AS (SELECT track_id, seq_no, run, interval, win, n, step, half, list(z ORDER BY k) AS zs FROM halves GROUP BY ALL),
points_k AS (SELECT *, unnest(range(0, n + 1))::INT AS k FROM lists),
smoothed AS (
  SELECT track_id, seq_no, run, interval, win, n, step, k, CASE WHEN half = 0 THEN zs[k + 1] ELSE
    list_sum(list_transform(range(k - half, k + half + 1), lambda i: CASE WHEN i < 0 THEN zs[1] + i * (zs[2] - zs[1]) WHEN i > n THEN zs[n + 1] + (i - n) * (zs[n + 1] - zs[n]) ELSE zs[i + 1] END)) / (2 * half + 1) END AS z
  FROM points_k),
steps AS (
  SELECT track_id, seq_no, run, interval, win, k, step AS dx, z - lag(z) OVER (PARTITION BY track_id, seq_no, run, interval, win ORDER BY k) AS dz FROM smoothed),
inner_steps AS (SELECT * FROM steps WHERE k > 0)"""
_BASE = _SETTINGS.format("(10, 25)")
_GRID = _SETTINGS.format(", ".join(f"({i}, {w})" for i in (5, 10, 20) for w in (0, 25, 50)))
_QUALITY = """quality AS (
  SELECT track_id, sum(dx) AS recorded_m, coalesce(sum(dx) FILTER (verdict = 'ok'), 0.0) AS accepted_m, count(*) FILTER (verdict = 'near_zero') AS near_zero,
    count(*) FILTER (verdict = 'long_gap') AS long_gap, count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict = 'implausible') AS implausible,
    max(dx) AS longest_step_m, count(*) FILTER (dx = 0) AS zero_steps FROM edges GROUP BY track_id),
covered AS (SELECT *, CASE WHEN recorded_m > 0 THEN accepted_m / recorded_m ELSE 0.0 END AS valid_fraction FROM quality)"""
_CELLS = """touched AS (SELECT DISTINCT route_id, floor(radians(lon0 + (lon - lon0) * part + 106.0) * (6371008.8::DOUBLE * cos(radians(39.0::DOUBLE))) / 50.0)::BIGINT AS cx,
    floor(radians(lat0 + (lat - lat0) * part - 39.0) * 6371008.8::DOUBLE / 50.0)::BIGINT AS cy
  FROM (SELECT *, i::DOUBLE / n AS part FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT *, greatest(1, ceil(dx / 25.0))::INT AS n FROM runs WHERE route_id IS NOT NULL)))),
sized AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS size FROM touched),
links AS (
  SELECT a.route_id AS a, b.route_id AS b, count(*) AS common, count(*)::DOUBLE / min(least(a.size, b.size)) AS fraction
  FROM sized a JOIN sized b ON a.cx = b.cx AND a.cy = b.cy AND a.route_id < b.route_id GROUP BY 1, 2 HAVING count(*)::DOUBLE / min(least(a.size, b.size)) >= 0.5)"""


# --- queries -----------------------------------------------------------------------------------
def points(spark, folder):
    """The current version of every fix."""
    return latest_rows(table(spark, folder, "trkpt"), KEY, "loaded_at", ["route_id", "lat", "lon", "ele"])


def _rounded(df, columns, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


def _with_route(spark, folder):
    p = points(spark, folder)
    return tracks.edges(p).join(p.select(*KEY, "route_id"), KEY)


@query("track_edges", f"WITH {_EDGES} SELECT track_id, seq_no, pt_no, round(dx, 4) AS dx, round(dz, 4) AS dz, verdict FROM edges")
def track_edges(spark, folder):
    e = tracks.edges(points(spark, folder))
    return e.select(*KEY, F.round("dx", 4).alias("dx"), F.round("dz", 4).alias("dz"), "verdict")


@query("run_split", f"WITH {_EDGES} SELECT track_id, seq_no, run, count(*) + 1 AS points, round(sum(dx), 4) AS metres FROM runs GROUP BY ALL")
def run_split(spark, folder):
    r = tracks.runs(tracks.edges(points(spark, folder)))
    return r.groupBy("track_id", "seq_no", "run").agg((F.count(F.lit(1)) + 1).alias("points"), F.round(F.sum("dx"), 4).alias("metres"))


_Q = ["recorded_m", "accepted_m", "longest_step_m", "valid_fraction"]


@query("track_quality", f"WITH {_EDGES}, {_QUALITY} SELECT track_id, near_zero, long_gap, missing, implausible, zero_steps, {', '.join(f'round({c}, 4) AS {c}' for c in _Q)} FROM covered")
def track_quality(spark, folder):
    return _rounded(tracks.track_quality(tracks.edges(points(spark, folder))), _Q)


@query("grade_bands", f"WITH {_EDGES}, {_bands('runs', 'track_id', 'pt_no')} SELECT track_id, {_ROUNDED} FROM bands")
def grade_bands(spark, folder):
    r = tracks.runs(tracks.edges(points(spark, folder)))
    return _rounded(tracks.band_summary(r, ["track_id"], ["pt_no"], ["seq_no", "run"]), _MEASURES).select("track_id", *_MEASURES)


@query("resample_profile", f"WITH {_EDGES}, {_BASE}, {_PROFILE} SELECT track_id, seq_no, run, k, n, round(x, 4) AS x, round(z, 4) AS z FROM resampled")
def resample_profile(spark, folder):
    r = tracks.resample(tracks.runs(tracks.edges(points(spark, folder))), F.lit(10.0))
    return r.select("track_id", "seq_no", "run", "k", "n", F.round("x", 4).alias("x"), F.round("z", 4).alias("z"))


@query("smooth_profile", f"WITH {_EDGES}, {_BASE}, {_PROFILE}, {_SMOOTH} SELECT track_id, seq_no, run, k, round(z, 4) AS z FROM smoothed")
def smooth_profile(spark, folder):
    r = tracks.resample(tracks.runs(tracks.edges(points(spark, folder))), F.lit(10.0))
    return tracks.smooth(r, F.lit(25.0)).select("track_id", "seq_no", "run", "k", F.round("z", 4).alias("z"))


@query("profile_bands", f"WITH {_EDGES}, {_BASE}, {_PROFILE}, {_SMOOTH}, {_bands('inner_steps', 'track_id', 'k')} SELECT track_id, {_ROUNDED} FROM bands")
def profile_bands(spark, folder):
    b = tracks.profile_bands(tracks.runs(tracks.edges(points(spark, folder))))
    return _rounded(b, _MEASURES).select("track_id", *_MEASURES)


@query(
    "sensitivity_range",
    f"""WITH {_EDGES}, {_GRID}, {_PROFILE}, {_SMOOTH}, {_bands('inner_steps', 'track_id, interval, win', 'k')},
ranges AS (SELECT track_id, max(medium_density) - min(medium_density) AS mr, max(extreme_density) - min(extreme_density) AS er, max(gain_m) - min(gain_m) AS gr,
  max(gain_m) FILTER (interval = 10 AND win = 25) AS base FROM bands GROUP BY track_id)
SELECT track_id, round(mr, 4) AS medium_range, round(er, 4) AS extreme_range, round(gr, 4) AS gain_range_m, round(CASE WHEN base > 0 THEN gr / base * 100 END, 4) AS gain_range_percent FROM ranges""",
)
def sensitivity_range(spark, folder):
    s = tracks.sensitivity(tracks.runs(tracks.edges(points(spark, folder))))
    return _rounded(s, ["medium_range", "extreme_range", "gain_range_m", "gain_range_percent"])


@query(
    "density_bounds",
    f"""WITH {_EDGES}, {_QUALITY}, {_BASE}, {_PROFILE}, {_SMOOTH}, {_bands('inner_steps', 'track_id', 'k')}
SELECT track_id, round(f, 4) AS valid_fraction, {', '.join(f"round({m}_density * f, 4) AS {m}_low, round(least(100, {m}_density * f + 100 * (1 - f)), 4) AS {m}_high, round(CASE WHEN f >= 0.95 THEN {m}_density END, 4) AS {m}_released" for m in ('medium', 'extreme'))}
FROM (SELECT b.*, c.valid_fraction AS f FROM bands b JOIN covered c USING (track_id))""",
)
def density_bounds(spark, folder):
    e = tracks.edges(points(spark, folder))
    d = tracks.density_bounds(tracks.profile_bands(tracks.runs(e)), tracks.track_quality(e))
    return _rounded(d, [c for c in d.columns if c != "track_id"])


@query("occupied_cells", f"WITH {_EDGES}, {_CELLS} SELECT route_id, cx, cy FROM touched")
def occupied_cells(spark, folder):
    r = tracks.runs(_with_route(spark, folder)).filter("route_id is not null")
    return tracks.occupied_cells(r, ["route_id"])


@query("cell_overlap", f"WITH {_EDGES}, {_CELLS} SELECT a, b, common, round(fraction, 6) AS fraction FROM links")
def cell_overlap(spark, folder):
    o = tracks.cell_overlap(occupied_cells(spark, folder), "route_id")
    return o.select("a", "b", "common", F.round("fraction", 6).alias("fraction"))


@query(
    "overlap_groups",
    f"""WITH RECURSIVE {_EDGES}, {_CELLS}, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (SELECT route_id, route_id FROM (SELECT DISTINCT route_id FROM touched) UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
labels AS (SELECT node AS route_id, min(seen) AS "group" FROM reach GROUP BY node)
SELECT route_id, "group", count(*) OVER (PARTITION BY "group") AS size FROM labels""",
)
def overlap_groups(spark, folder):
    cells = occupied_cells(spark, folder)
    return tracks.overlap_groups(cells, tracks.cell_overlap(cells, "route_id"), "route_id")


_SIGNED = f"""WITH {_POINTS},
texts AS (SELECT track_id, seq_no, pt_no, concat_ws(',', round_even(lat * 1000000, 0)::BIGINT::VARCHAR, round_even(lon * 1000000, 0)::BIGINT::VARCHAR, coalesce(round_even(ele * 10, 0)::BIGINT::VARCHAR, 'null')) AS t FROM points),
seqs AS (SELECT track_id, seq_no, string_agg(t, ';' ORDER BY pt_no) AS s, count(*) AS n FROM texts GROUP BY ALL),
signed AS (SELECT track_id, sum(n)::BIGINT AS points, sha256(string_agg(s, '/' ORDER BY seq_no)) AS signature FROM seqs GROUP BY track_id)"""


@query("geometry_signature", f"{_SIGNED} SELECT track_id, points, signature FROM signed")
def geometry_signature(spark, folder):
    return tracks.geometry_signature(points(spark, folder))


@query("duplicate_tracks", f"{_SIGNED} SELECT signature, count(*) AS tracks, min(track_id) AS first_track FROM signed GROUP BY signature HAVING count(*) > 1")
def duplicate_tracks(spark, folder):
    s = tracks.geometry_signature(points(spark, folder))
    return s.groupBy("signature").agg(F.count(F.lit(1)).alias("tracks"), F.min("track_id").alias("first_track")).filter("tracks > 1")


@query(
    "validate_tracks",
    f"""WITH {_POINTS},
flagged AS (SELECT *, lat IS NULL OR lon IS NULL OR abs(lat) > 90 OR abs(lon) > 180 AS bad, lat NOT BETWEEN 36.8 AND 41.2 OR lon NOT BETWEEN -109.2 AND -101.8 AS away FROM points),
seqs AS (SELECT track_id, seq_no, count(*) AS n, count(*) FILTER (bad) AS bad, count(*) FILTER (away) AS away, count(ele) AS with_ele FROM flagged GROUP BY ALL),
ends AS (SELECT track_id, first(lat ORDER BY seq_no, pt_no) AS lat1, first(lon ORDER BY seq_no, pt_no) AS lon1, last(lat ORDER BY seq_no, pt_no) AS lat2, last(lon ORDER BY seq_no, pt_no) AS lon2 FROM points GROUP BY track_id),
t AS (SELECT track_id, count(*) FILTER (n >= 2) AS sequences, sum(n)::BIGINT AS points, sum(bad) AS bad, sum(away) AS away, sum(with_ele) AS with_ele FROM seqs GROUP BY track_id)
SELECT track_id, sequences, points, round(with_ele / points, 6) AS elevation_coverage,
  round({_DIST.replace("{a}lat", "lat1").replace("{a}lon", "lon1").replace("{b}lat", "lat2").replace("{b}lon", "lon2")}, 4) AS endpoint_gap_m,
  CASE WHEN bad > 0 THEN 'coordinate_out_of_range' WHEN sequences = 0 THEN 'no_sequence_of_two_points' WHEN away > 0 THEN 'outside_region' END AS problem
FROM t JOIN ends USING (track_id)""",
)
def validate_tracks(spark, folder):
    v = tracks.validate_tracks(points(spark, folder))
    return v.select("track_id", "sequences", "points", F.round("elevation_coverage", 6).alias("elevation_coverage"), F.round("endpoint_gap_m", 4).alias("endpoint_gap_m"), "problem")


@query(
    "ascent_prefix",
    f"""WITH {_POINTS}, tops AS (SELECT track_id, seq_no AS ls, pt_no AS lp FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY ele DESC, seq_no, pt_no) AS n FROM points WHERE ele BETWEEN 800 AND 4700) WHERE n = 1)
SELECT track_id, count(*) AS points, max(seq_no) AS last_seq FROM points p LEFT JOIN tops t USING (track_id)
WHERE ls IS NULL OR seq_no < ls OR (seq_no = ls AND pt_no <= lp) GROUP BY track_id""",
)
def ascent_prefix(spark, folder):
    """Each track up to its highest plausible fix."""
    p = points(spark, folder)
    top = p.filter(F.col("ele").between(800, 4700)).groupBy("track_id").agg(F.max(F.struct("ele", (-F.col("seq_no")).alias("s"), (-F.col("pt_no")).alias("p"))).alias("t"))
    cuts = top.select("track_id", (-F.col("t.s")).alias("last_seq"), (-F.col("t.p")).alias("last_pt"))
    return tracks.up_to(p, cuts).groupBy("track_id").agg(F.count(F.lit(1)).alias("points"), F.max("seq_no").alias("last_seq"))


@query(
    "assembled_routes",
    f"""WITH {_POINTS}, parts AS (SELECT DISTINCT route_id, track_id, seq_no FROM points WHERE route_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY track_id, seq_no) AS seq FROM parts)
SELECT n.route_id AS track_id, n.seq::INT AS seq_no, count(*) AS points FROM numbered n JOIN points p ON p.route_id = n.route_id AND p.track_id = n.track_id AND p.seq_no = n.seq_no GROUP BY ALL""",
)
def assembled_routes(spark, folder):
    """All tracks of a route, one after the other."""
    p = points(spark, folder)
    components = p.filter("route_id is not null").select(F.col("route_id").alias("route"), F.col("track_id").alias("place"), "track_id").distinct()
    return tracks.assemble(p.drop("route_id"), components).groupBy("track_id", "seq_no").agg(F.count(F.lit(1)).alias("points"))
