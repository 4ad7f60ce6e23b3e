"""Queries over routes' status, manifest, features and texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from screeline.functions import text as tx
from screeline.operators import matching, quality, tracks
from screeline.operators.graph import min_label_components, shared_key_edges
from screeline.operators.latest import latest_rows
from screeline.plans.registry import query
from screeline.plans.track_queries import _BASE, _EDGES, _GRID, _PROFILE, _QUALITY, _SMOOTH, _bands, points
from screeline.session import table
from screeline.staging import Staging

HOST = "peakledger.example"


def latest_sql(name: str, source: str, key: str, version: str, columns: list[str]) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in [version, *columns])
    return f"{name} AS (SELECT {key}, {', '.join(columns)} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM {source} WHERE {key} IS NOT NULL) WHERE n = 1)"


STATUS = ["canonical_name", "source_url", "status", "start_name", "geometry_sha256", "related_itinerary_group", "evaluation_group"]
FEATURES = ["yds_class", "yds_encoded", "source_distance_mi", "source_gain_ft", "gpx_distance_mi", "gpx_gain_ft", "crux_density_medium", "crux_density_extreme", "exposure", "rockfall", "route_finding", "commitment", "quality_flags", "provisional_rank"]
_STATUS = latest_sql("status", "route_status", "route_id", "updated_at", STATUS)
_FEATURES = latest_sql("features", "route_features_full", "route_id", "exported_at", FEATURES)


def status(spark, folder):
    return latest_rows(table(spark, folder, "route_status"), "route_id", "updated_at", STATUS)


def features(spark, folder):
    return latest_rows(table(spark, folder, "route_features_full"), "route_id", "exported_at", FEATURES)


def manifest(spark, folder):
    return table(spark, folder, "route_manifest")


def _canon(url: str) -> str:
    parts = r"'^https://(?:www\.)?peakledger\.example(?::443)?(/[^?#]*)?(\?[^#]*)?(?:#.*)?$'"
    return f"""CASE WHEN regexp_matches(trim({url}), {parts}, 'i') THEN 'https://www.peakledger.example' ||
      CASE WHEN regexp_extract(trim({url}), {parts}, 1, 'i') = '' THEN '/' ELSE regexp_extract(trim({url}), {parts}, 1, 'i') END || regexp_extract(trim({url}), {parts}, 2, 'i') END"""


def _page(url: str) -> str:
    return f"""CASE WHEN len(regexp_extract_all({url}, '[?&]route=')) = 1 THEN nullif(regexp_extract({url}, '/route\\.php\\?(?:[^#]*&)?route=([a-zA-Z0-9_-]+)(?:&|#|$)', 1), '') END"""


_ALIAS = "lower({})"
for _old, _new in tx.ALIASES:
    _ALIAS = f"replace({_ALIAS}, '{_old}', '{_new}')"


def _norm(name: str) -> str:
    x = _ALIAS.format(name)
    for pattern in tx.DROPPED:
        x = f"regexp_replace({x}, '{pattern}', ' ', 'g')"
    return f"array_to_string(regexp_extract_all({x}, '[a-z0-9]+'), ' ')"


@query("canonical_urls", f"WITH {_STATUS}, c AS (SELECT route_id, {_canon('source_url')} AS url FROM status) SELECT route_id, url, {_page('url')} AS page FROM c")
def canonical_urls(spark, folder):
    s = status(spark, folder).select("route_id", tx.canonical_url(F.col("source_url"), HOST).alias("url"))
    return s.withColumn("page", tx.page_key(F.col("url")))


@query("norm_names", f"WITH {_STATUS} SELECT route_id, {_norm('canonical_name')} AS name, trim(regexp_replace(regexp_replace(lower(start_name), '\\btrailhead\\b', 'th', 'g'), '[^a-z0-9]+', ' ', 'g')) AS start FROM status")
def norm_names(spark, folder):
    return status(spark, folder).select("route_id", tx.normal_name(F.col("canonical_name")).alias("name"), tx.normal_start(F.col("start_name")).alias("start"))


def _found(pattern: str) -> str:
    return f"nullif(regexp_extract(text, '{pattern}', 1, 'i'), '')"


@query(
    "page_fields",
    f"""SELECT doc_id, {_found(r'\bclass\s+(\d)')}::INT AS yds_class, {', '.join(f"lower({_found(chr(92) + 'b' + p + chr(92) + 's+(low|moderate|considerable|high|extreme)' + chr(92) + 'b')}) AS {n}" for n, p in (('exposure', 'exposure'), ('rockfall', 'rockfall'), ('route_finding', 'route[ -]finding'), ('commitment', 'commitment')))},
  replace({_found(r'\blength\s+([\d,]+(?:\.\d+)?)\s*mi')}, ',', '')::DOUBLE AS length_mi, replace({_found(r'\bgain\s+([\d,]+)\s*f')}, ',', '')::DOUBLE AS gain_ft FROM documents""",
)
def page_fields(spark, folder):
    return table(spark, folder, "documents").select("doc_id", *[c.alias(n) for n, c in tx.page_fields(F.col("text")).items()])


_LEVELS = "list_position(['low', 'moderate', 'considerable', 'high', 'extreme'], lower(trim({})))"


@query("encoded_labels", f"WITH {_FEATURES} SELECT route_id, CASE yds_class WHEN 1 THEN 1.0 WHEN 2 THEN 2.0 WHEN 3 THEN 4.0 WHEN 4 THEN 8.0 WHEN 5 THEN 16.0 END::DOUBLE AS weight, {', '.join(f'({_LEVELS.format(c)} - 1)::INT AS {c}' for c in ('exposure', 'rockfall', 'route_finding', 'commitment'))} FROM features")
def encoded_labels(spark, folder):
    f = features(spark, folder)
    return f.select("route_id", tx.class_weight(F.col("yds_class")).alias("weight"), *[tx.risk_level(F.col(c)).alias(c) for c in ("exposure", "rockfall", "route_finding", "commitment")])


_TITLES = f"titles AS (SELECT DISTINCT route_id AS entry, {_norm('canonical_name')} AS name FROM route_manifest)"


@query(
    "match_by_name",
    f"""WITH {_STATUS}, {_TITLES}, named AS (SELECT route_id, {_norm('canonical_name')} AS name FROM status),
hits AS (SELECT n.route_id, count(DISTINCT entry) AS matches, min(entry) AS one FROM named n JOIN titles t ON t.name = n.name AND n.name <> '' GROUP BY 1)
SELECT s.route_id, CASE WHEN matches = 1 THEN one END AS entry, coalesce(matches, 0) AS matches FROM status s LEFT JOIN hits USING (route_id)""",
)
def match_by_name(spark, folder):
    return matching.match_by_name(status(spark, folder), "route_id", ["canonical_name"], manifest(spark, folder), "canonical_name", "route_id")


@query(
    "nearest_names",
    f"""WITH {_STATUS}, {_TITLES}, asked AS (SELECT route_id, {_norm('canonical_name')} AS q FROM status WHERE source_url IS NULL AND canonical_name IS NOT NULL),
rated AS (SELECT route_id, entry, 1 - levenshtein(q, name)::DOUBLE / greatest(length(q), length(name), 1) AS ratio FROM asked, titles),
placed AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY ratio DESC, entry) AS place FROM rated)
SELECT route_id, place::INT AS place, entry, round(ratio, 6) AS ratio FROM placed WHERE place <= 5""",
)
def nearest_names(spark, folder):
    """For the routes without an address: the five most similar names of the manifest."""
    lost = status(spark, folder).filter("source_url is null")
    n = matching.nearest_names(lost, "route_id", "canonical_name", manifest(spark, folder), "canonical_name", "route_id")
    return n.withColumn("ratio", F.round("ratio", 6))


@query(
    "match_by_page",
    f"""WITH {_STATUS}, a AS (SELECT route_id, {_canon('source_url')} AS url FROM status), b AS (SELECT route_id AS entry, {_canon('source_url')} AS url FROM route_manifest)
SELECT DISTINCT a.route_id, b.entry, {_page('a.url')} AS page FROM a JOIN b ON a.url = b.url AND {_page('a.url')} = {_page('b.url')}""",
)
def match_by_page(spark, folder):
    """Status rows and manifest entries with the same page and the same address."""
    a = canonical_urls(spark, folder)
    b = manifest(spark, folder).select(F.col("route_id").alias("entry"), tx.canonical_url(F.col("source_url"), HOST).alias("url"))
    b = b.withColumn("page", tx.page_key(F.col("url")))
    return a.join(b, ["url", "page"]).select("route_id", "entry", "page").distinct()


@query(
    "unmatched_candidates",
    f"""WITH {_STATUS}, {_TITLES}, named AS (SELECT route_id, {_norm('canonical_name')} AS q, {_canon('source_url')} AS url FROM status),
pages AS (SELECT route_id AS entry, {_canon('source_url')} AS url FROM route_manifest),
settled AS (SELECT route_id FROM named n JOIN pages p ON n.url = p.url AND {_page('n.url')} = {_page('p.url')} GROUP BY 1 HAVING count(DISTINCT entry) = 1
  UNION SELECT route_id FROM named n JOIN titles t ON t.name = n.q AND n.q <> '' GROUP BY 1 HAVING count(DISTINCT entry) = 1),
rated AS (SELECT route_id, entry, 1 - levenshtein(q, name)::DOUBLE / greatest(length(q), length(name), 1) AS ratio FROM (SELECT * FROM named ANTI JOIN settled USING (route_id)), titles WHERE q IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY ratio DESC, entry) AS place FROM rated)
SELECT route_id, place::INT AS place, entry, round(ratio, 6) AS ratio FROM placed WHERE place <= 5""",
)
def unmatched_candidates(spark, folder):
    """For the routes to which neither page nor name gives exactly one entry, with or without an
    address: the five most similar names of the manifest. A route without a name has none."""
    by_page = match_by_page(spark, folder).groupBy("route_id").agg(F.count_distinct("entry").alias("n")).filter("n = 1")
    by_name = match_by_name(spark, folder).filter("entry is not null")
    left = status(spark, folder).join(by_page.select("route_id").unionByName(by_name.select("route_id")), "route_id", "left_anti")
    n = matching.nearest_names(left, "route_id", "canonical_name", manifest(spark, folder), "canonical_name", "route_id")
    return n.withColumn("ratio", F.round("ratio", 6))


@query(
    "contract_violations",
    """WITH broken AS (
  SELECT 'id_missing' AS rule, route_id AS key FROM route_status WHERE route_id IS NULL
  UNION ALL SELECT 'name_missing', route_id FROM route_status WHERE canonical_name IS NULL OR trim(canonical_name) = ''
  UNION ALL SELECT 'hash_malformed', route_id FROM route_status WHERE geometry_sha256 IS NULL OR NOT regexp_matches(geometry_sha256, '^[0-9a-f]{64}$')
  UNION ALL SELECT 'address_foreign', route_id FROM route_status WHERE source_url IS NULL OR NOT regexp_matches(source_url, '^https://', 'i')
  UNION ALL SELECT 'flag_unknown', route_id FROM route_status WHERE dry_summer_verified IS NULL OR dry_summer_verified NOT IN ('true', 'false'))
SELECT rule, count(*) AS rows, min(key) AS example FROM broken GROUP BY rule""",
)
def contract_violations(spark, folder):
    filled = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    rules = {
        "id_missing": F.col("route_id").isNotNull(),
        "name_missing": filled("canonical_name"),
        "hash_malformed": F.col("geometry_sha256").rlike("^[0-9a-f]{64}$"),
        "address_foreign": F.col("source_url").rlike("(?i)^https://"),
        "flag_unknown": F.col("dry_summer_verified").isin("true", "false"),
    }
    return quality.violations(table(spark, folder, "route_status"), "route_id", rules)


@query("repeated_ids", "SELECT route_id, count(*) AS rows FROM route_features_full GROUP BY route_id HAVING count(*) > 1")
def repeated_ids(spark, folder):
    return quality.repeated_keys(table(spark, folder, "route_features_full"), "route_id")


@query("null_counts", " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS nulls, count(*) AS rows FROM route_features_full" for c in FEATURES))
def null_counts(spark, folder):
    return quality.null_counts(table(spark, folder, "route_features_full"), FEATURES)


@query("status_counts", f"WITH {_STATUS} SELECT status, count(*) AS routes, count(*) FILTER (source_url IS NULL) AS without_address, count(DISTINCT geometry_sha256) AS tracks FROM status GROUP BY status")
def status_counts(spark, folder):
    s = status(spark, folder)
    return s.groupBy("status").agg(F.count(F.lit(1)).alias("routes"), F.count_if(F.col("source_url").isNull()).alias("without_address"), F.count_distinct("geometry_sha256").alias("tracks"))


@query("run_report", f"WITH {_STATUS} SELECT count(*) AS routes, count(*) FILTER (status = 'downloaded') AS downloaded, count(*) FILTER (status = 'pending') AS pending, count(DISTINCT source_url) AS addresses, count(*) FILTER (geometry_sha256 IS NULL) AS without_track FROM status")
def run_report(spark, folder):
    return status(spark, folder).agg(
        F.count(F.lit(1)).alias("routes"), F.count_if(F.col("status") == "downloaded").alias("downloaded"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_distinct("source_url").alias("addresses"), F.count_if(F.col("geometry_sha256").isNull()).alias("without_track"),
    )


@query("duplicate_hashes", f"WITH {_STATUS} SELECT geometry_sha256, count(*) AS items, min(route_id) AS first FROM status WHERE regexp_matches(geometry_sha256, '[^0]') GROUP BY 1 HAVING count(*) > 1")
def duplicate_hashes(spark, folder):
    s = status(spark, folder).filter(F.col("geometry_sha256").rlike("[^0]"))
    return quality.duplicate_groups(s, "route_id", "geometry_sha256")


@query("duplicate_texts", "SELECT sha256(text) AS digest, count(*) AS items, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark, folder):
    d = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return quality.duplicate_groups(d, "doc_id", "digest")


@query("id_check", "SELECT coalesce(a.route_id, b.route_id) AS route_id, CASE WHEN b.route_id IS NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT DISTINCT route_id FROM route_features_full) a FULL JOIN (SELECT DISTINCT route_id FROM route_status) b ON a.route_id = b.route_id WHERE a.route_id IS NULL OR b.route_id IS NULL")
def id_check(spark, folder):
    return quality.key_check(table(spark, folder, "route_features_full"), table(spark, folder, "route_status"), "route_id")


@query("overlaid_names", f"WITH {_STATUS} SELECT coalesce(m.route_id, s.route_id) AS route_id, coalesce(m.canonical_name, s.canonical_name) AS canonical_name, coalesce(m.source_url, s.source_url) AS source_url FROM status s FULL JOIN route_manifest m ON m.route_id = s.route_id")
def overlaid_names(spark, folder):
    """Status rows overlaid with the frozen manifest."""
    return quality.overlay(status(spark, folder), manifest(spark, folder), "route_id", ["canonical_name", "source_url"])


@query("active_features", f"WITH {_FEATURES}, {_STATUS} SELECT f.route_id, s.canonical_name, f.gpx_distance_mi, f.gpx_gain_ft FROM features f JOIN status s USING (route_id) WHERE f.route_id NOT IN (SELECT route_id FROM route_manifest)")
def active_features(spark, folder):
    """Features of routes with a status, without those of the frozen manifest."""
    f = features(spark, folder).join(status(spark, folder).select("route_id", "canonical_name"), "route_id")
    return f.join(manifest(spark, folder).select("route_id"), "route_id", "left_anti").select("route_id", "canonical_name", "gpx_distance_mi", "gpx_gain_ft")


@query("summit_routes", "WITH s AS (SELECT route_id, trim(unnest(string_split(summit_order, '|'))) AS summit FROM route_manifest) SELECT summit, count(DISTINCT route_id) AS routes, string_agg(DISTINCT route_id, '|' ORDER BY route_id) AS route_ids FROM s WHERE summit <> '' GROUP BY summit")
def summit_routes(spark, folder):
    s = manifest(spark, folder).select("route_id", F.explode(F.split("summit_order", r"\|")).alias("summit")).select("route_id", F.trim("summit").alias("summit")).filter("summit <> ''")
    return s.groupBy("summit").agg(F.count_distinct("route_id").alias("routes"), F.array_join(F.array_sort(F.collect_set("route_id")), "|").alias("route_ids"))


@query(
    "connected_groups",
    f"""WITH RECURSIVE {_STATUS}, held AS (
  SELECT route_id, 'h:' || geometry_sha256 AS k FROM status WHERE regexp_matches(geometry_sha256, '[^0]')
  UNION SELECT route_id, 'u:' || {_page('url')} FROM (SELECT route_id, {_canon('source_url')} AS url FROM status)),
heads AS (SELECT k, min(route_id) AS head FROM held WHERE k IS NOT NULL GROUP BY k),
links AS (SELECT DISTINCT head AS a, route_id AS b FROM held JOIN heads USING (k) WHERE head <> route_id),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
labels AS (SELECT node AS route_id, min(seen) AS head FROM reach GROUP BY node)
SELECT route_id, head, count(*) OVER (PARTITION BY head) AS size FROM labels""",
)
def connected_groups(spark, folder):
    """Routes joined, over any number of steps, by a common track or page."""
    s = status(spark, folder)
    track = F.when(F.col("geometry_sha256").rlike("[^0]"), F.concat(F.lit("h:"), "geometry_sha256"))
    page = F.concat(F.lit("u:"), tx.page_key(tx.canonical_url(F.col("source_url"), HOST)))
    members = s.select("route_id", F.explode(F.array_compact(F.array(track, page))).alias("key"))
    labels = min_label_components(shared_key_edges(members, "route_id", "key"), Staging(spark, "groups"))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return labels.join(sizes, "label").select(F.col("node").alias("route_id"), F.col("label").alias("head"), "size")


@query("declared_flag_counts", f"WITH {_FEATURES}, f AS (SELECT unnest(string_split(coalesce(quality_flags, ''), '|')) AS flag FROM features) SELECT flag, count(*) AS rows FROM f WHERE flag <> '' GROUP BY flag")
def declared_flag_counts(spark, folder):
    return quality.flag_counts(features(spark, folder), "quality_flags")


_QA = f"""WITH {_EDGES}, {_QUALITY}, {_GRID}, {_PROFILE}, {_SMOOTH}, {_bands('inner_steps', 'track_id, interval, win', 'k')},
ranges AS (SELECT track_id, max(medium_density) - min(medium_density) AS mr, max(extreme_density) - min(extreme_density) AS er, max(gain_m) - min(gain_m) AS gr,
  max(gain_m) FILTER (interval = 10 AND win = 25) AS base, max(medium_density) FILTER (interval = 10 AND win = 25) AS md FROM bands GROUP BY track_id),
flagged AS (SELECT c.track_id, [CASE WHEN valid_fraction < 0.95 THEN 'insufficient_valid_profile_coverage' END, CASE WHEN long_gap + missing + implausible > 0 THEN 'profile_edges_excluded' END,
  CASE WHEN base IS NULL THEN 'no_valid_profile' END, CASE WHEN mr > 5 OR er > 5 THEN 'density_sensitive_to_parameters' END, CASE WHEN base > 0 AND gr / base * 100 > 20 THEN 'gain_sensitive_to_parameters' END] AS f,
  CASE WHEN valid_fraction >= 0.95 THEN md END AS medium_density FROM covered c LEFT JOIN ranges r USING (track_id))
SELECT track_id, array_to_string(list_filter(f, lambda x: x IS NOT NULL), '|') AS flags, len(list_filter(f, lambda x: x IS NOT NULL)) = 0 AS passed, round(medium_density, 4) AS medium_density FROM flagged"""


@query("qa_flags", _QA)
def qa_flags(spark, folder):
    """Flags of each track's profile, and its medium density where enough of it is valid."""
    e = tracks.edges(points(spark, folder))
    r = tracks.runs(e)
    q = tracks.track_quality(e)
    s = q.join(tracks.sensitivity(r), "track_id", "left").join(tracks.profile_bands(r).select("track_id", "medium_density", F.col("gain_m").alias("base")), "track_id", "left")
    rules = {
        "insufficient_valid_profile_coverage": F.col("valid_fraction") < 0.95,
        "profile_edges_excluded": F.col("long_gap") + F.col("missing") + F.col("implausible") > 0,
        "no_valid_profile": F.col("base").isNull(),
        "density_sensitive_to_parameters": (F.col("medium_range") > 5) | (F.col("extreme_range") > 5),
        "gain_sensitive_to_parameters": F.col("gain_range_percent") > 20,
    }
    names, passed = quality.flags(rules)
    s = quality.released(s.withColumn("flags", names).withColumn("passed", passed), ["medium_density"], F.col("valid_fraction") >= 0.95)
    return s.select("track_id", "flags", "passed", F.round("medium_density", 4).alias("medium_density"))


@query("scope_ratios", f"WITH {_FEATURES} SELECT route_id, round(CASE WHEN source_distance_mi <> 0 THEN gpx_distance_mi / source_distance_mi END, 6) AS distance_ratio, round(CASE WHEN source_gain_ft <> 0 THEN gpx_gain_ft / source_gain_ft END, 6) AS gain_ratio, coalesce(CASE WHEN source_distance_mi <> 0 THEN abs(gpx_distance_mi / source_distance_mi - 1) > 0.2 END, false) AS distance_off, coalesce(CASE WHEN source_gain_ft <> 0 THEN abs(gpx_gain_ft / source_gain_ft - 1) > 0.3 END, false) AS gain_off FROM features")
def scope_ratios(spark, folder):
    f = features(spark, folder)
    d, g = F.try_divide("gpx_distance_mi", "source_distance_mi"), F.try_divide("gpx_gain_ft", "source_gain_ft")
    off = lambda r, limit: F.coalesce(F.abs(r - 1) > limit, F.lit(False))
    return f.select("route_id", F.round(d, 6).alias("distance_ratio"), F.round(g, 6).alias("gain_ratio"), off(d, 0.2).alias("distance_off"), off(g, 0.3).alias("gain_off"))
