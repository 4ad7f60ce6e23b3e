"""SQL, for DuckDB, of the queries that SQL can express."""

# rows that agree in route_id and exported_at: the greatest values count, nulls least
_SCORED = """latest AS (
  SELECT route_id, provisional_score, yds_encoded, gpx_gain_ft, crux_density_medium FROM (
    SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY exported_at DESC NULLS LAST, provisional_score DESC NULLS LAST,
      yds_encoded DESC NULLS LAST, gpx_gain_ft DESC NULLS LAST, crux_density_medium DESC NULLS LAST) AS n
    FROM route_features_full WHERE route_id IS NOT NULL) WHERE n = 1),
long AS (
  SELECT route_id, 0 AS series, provisional_score AS v FROM latest UNION ALL SELECT route_id, 1, yds_encoded FROM latest
  UNION ALL SELECT route_id, 2, gpx_gain_ft FROM latest UNION ALL SELECT route_id, 3, crux_density_medium FROM latest),
ranked AS (
  SELECT route_id, series, rank() OVER (PARTITION BY series ORDER BY v DESC) AS r, count(*) OVER (PARTITION BY series) AS n
  FROM long WHERE v IS NOT NULL)"""

# words and signs for tokens: any usual tokenizer gives the same answer
_TOKENS = """sized AS (
  SELECT regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') AS source, len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')) AS tokens
  FROM documents)"""

_PARTS = ["gpx_distance_mi / 1.0", "gpx_gain_ft / 250.0", "crux_density_medium / 2.5", "crux_density_extreme / 1.5", "longest_medium_section_mi / 0.04", "longest_extreme_section_mi / 0.02", "yds_class / 0.4"]
_RISKS = ["exposure", "rockfall", "route_finding", "commitment"]
_COLUMNS = [p.split(" ")[0] for p in _PARTS] + _RISKS
_LEVEL = "(list_position(['low', 'moderate', 'considerable', 'high', 'extreme'], lower(trim({}))) - 1) / 0.4::DOUBLE"
_VECTORS = f"""newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY exported_at DESC NULLS LAST, {', '.join(c + ' DESC NULLS LAST' for c in _COLUMNS)}) AS nth
    FROM route_features_full WHERE route_id IS NOT NULL) WHERE nth = 1),
vectors AS (
  SELECT * FROM (SELECT route_id, {', '.join(f'({p.replace("/ ", "/ (")}::DOUBLE)) AS x{i}' for i, p in enumerate(_PARTS))}, {', '.join(f'{_LEVEL.format(r)} AS x{7 + i}' for i, r in enumerate(_RISKS))} FROM newest)
  WHERE {' AND '.join(f'x{i} IS NOT NULL' for i in range(11))})"""
_APART = "sqrt(" + " + ".join(f"pow(a.x{i} - b.x{i}, 2)" for i in range(11)) + ")"
_NAMED = "list_filter(list_transform(regexp_split_to_array(coalesce({}, ''), '[|;,]'), lambda t: lower(trim(t))), lambda t: t NOT IN ('', '-', 'none', 'n/a', 'unassigned'))"
_REACH = """heads AS (SELECT k, min(route_id) AS head FROM held WHERE k IS NOT NULL GROUP BY k),
links AS (SELECT DISTINCT head AS a, route_id AS b FROM held JOIN heads USING (k) WHERE head <> route_id),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
labels AS (SELECT node AS route_id, min(seen) AS head FROM reach GROUP BY node)"""

ORACLES = {
    "p2_found": f"""WITH RECURSIVE {_VECTORS},
both_ways AS (SELECT a.route_id AS a, b.route_id AS b FROM vectors a JOIN vectors b ON a.route_id <> b.route_id AND {' AND '.join(f'a.x{i} = b.x{i}' for i in range(6, 11))} AND {_APART} <= 1.5),
reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
labels AS (SELECT node AS route_id, min(seen) AS head FROM reach GROUP BY node)
SELECT head AS head_route_id, route_id FROM (SELECT *, count(*) OVER (PARTITION BY head) AS size FROM labels) WHERE size >= 5 AND route_id <> head""",
    "p5_found": f"""WITH RECURSIVE status AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY updated_at DESC NULLS LAST, geometry_sha256 DESC NULLS LAST, source_url DESC NULLS LAST,
    evaluation_group DESC NULLS LAST, related_itinerary_group DESC NULLS LAST) AS nth FROM route_status WHERE route_id IS NOT NULL) WHERE nth = 1),
held AS (
  SELECT route_id, 'n:' || lower(trim(route_id)) AS k FROM status UNION SELECT route_id, 'n:' || unnest({_NAMED.format('evaluation_group')}) FROM status
  UNION SELECT route_id, 'n:' || unnest({_NAMED.format('related_itinerary_group')}) FROM status UNION SELECT route_id, 't:' || lower(trim(geometry_sha256)) FROM status WHERE regexp_matches(geometry_sha256, '[^0\\s]')
  UNION SELECT route_id, 'p:' || nullif(regexp_extract(source_url, '[?&]route=([^&#\\s]+)', 1), '') FROM status),
{_REACH} SELECT head AS head_route_id, route_id FROM labels WHERE route_id <> head""",
    "p6_found": f"""WITH {_VECTORS},
apart AS (SELECT a.route_id AS a, b.route_id AS b, {_APART} AS d FROM vectors a JOIN vectors b ON a.route_id <> b.route_id),
near AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS place FROM apart) WHERE place <= 10 AND d <= 0.05)
SELECT x.a AS route_a, x.b AS route_b FROM near x JOIN near y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
    "p8_found": f"""WITH {_TOKENS}, have AS (SELECT source, sum(tokens) AS tokens FROM sized GROUP BY source)
SELECT t.source FROM mix_target t LEFT JOIN have h ON h.source = t.source
WHERE coalesce(h.tokens, 0) * t.max_repeats < t.target_share * (SELECT sum(tokens) FROM sized)""",
    "p3_found": f"""WITH {_SCORED}
SELECT route_id FROM ranked GROUP BY route_id HAVING count(*) >= 3 AND max((r - 1)::DOUBLE / n) < 0.1""",
    "p3_ranking": f"""WITH {_SCORED},
fused AS (
  SELECT l.route_id, count(r.r) AS n_scores, coalesce(sum(1.0::DOUBLE / (60.0::DOUBLE + r.r) ORDER BY r.series), 0.0) AS fused
  FROM latest l LEFT JOIN ranked r USING (route_id) GROUP BY l.route_id)
SELECT route_id, n_scores, round(fused, 9) AS fused, rank() OVER (ORDER BY fused DESC) AS position FROM fused""",
}
