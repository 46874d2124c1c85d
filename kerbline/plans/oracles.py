"""The queries of ``registry`` as SQL for an independent engine (DuckDB) over the same files."""

from __future__ import annotations

from kerbline.operators import ml


def rounded(expression: str, digits: int) -> str:
    """Round half up on the shortest decimal of a double, as Spark does."""
    return f"cast(round(cast(cast({expression} AS varchar) AS decimal(38,24)), {digits}) AS double)"


def draw(key: str, seed: int) -> str:
    return f"(cast(('0x' || substr(md5('{seed}:' || {key}), 1, 8)) AS bigint) / cast(4294967296 AS double))"


def pick(choices: list[str], drawn: str) -> str:
    listed = ", ".join(f"'{c}'" for c in choices)
    return f"[{listed}][cast(floor({drawn} * {len(choices)}) AS integer) + 1]"


SRC = """
src AS (SELECT *, cast(json_extract_string(props, '$.k') AS integer) AS k FROM events),
twice AS (SELECT * FROM src UNION ALL SELECT * FROM src WHERE event_id % 50 = 0),
raw AS (
  SELECT cast(event_id AS varchar) AS event_id,
         event_id AS number,
         ts,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp",
         'I' || cast(event_id % 8 AS varchar) AS intersection_id,
         CASE event_id % 8 WHEN 0 THEN 'north' WHEN 1 THEN 'central' WHEN 2 THEN 'central' WHEN 3 THEN 'west'
              WHEN 4 THEN 'south' WHEN 5 THEN 'north' WHEN 6 THEN 'east' ELSE 'south' END AS zone,
         CASE WHEN k % 17 <> 0 THEN value END AS speed_kmh,
         CASE WHEN k % 13 = 0 THEN NULL WHEN k % 29 = 1 THEN 'gridlock' WHEN event_type = 'view' THEN 'low'
              WHEN event_type = 'click' THEN 'medium' WHEN event_type = 'signup' THEN 'high'
              ELSE 'critical' END AS congestion,
         CASE user_id % 7 WHEN 0 THEN 'car' WHEN 1 THEN 'truck' WHEN 2 THEN 'bus' WHEN 3 THEN 'motorcycle'
              WHEN 4 THEN 'ambulance' WHEN 5 THEN 'police'
              ELSE CASE WHEN k % 2 = 1 THEN 'tram' END END AS vehicle_type,
         k * 6 AS vehicle_count,
         CASE user_id % 11 WHEN 0 THEN 'foggy' WHEN 1 THEN 'rainy' WHEN 2 THEN 'dusty' WHEN 3 THEN 'hot'
              WHEN 4 THEN 'snow' WHEN 5 THEN NULL ELSE 'clear' END AS weather,
         CASE k % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'red' WHEN 2 THEN 'yellow' END AS signal_phase,
         CASE WHEN k % 20 <> 1 THEN k % 20 = 0 END AS incident_flag,
         cast(NULL AS varchar) AS record_type
  FROM twice)
"""

CLEAN = (
    SRC
    + """,
filled AS (
  SELECT event_id, number, ts, "timestamp", intersection_id, zone,
         coalesce(speed_kmh, 30.0) AS speed_kmh,
         coalesce(congestion, 'low') AS congestion, coalesce(vehicle_type, 'car') AS vehicle_type,
         coalesce(vehicle_count, 1) AS vehicle_count, coalesce(weather, 'clear') AS weather,
         coalesce(signal_phase, 'unknown') AS signal_phase, coalesce(incident_flag, false) AS incident_flag,
         coalesce(record_type, 'normal') AS record_type
  FROM raw),
typed AS (SELECT * REPLACE (cast(speed_kmh AS float) AS speed_kmh) FROM filled),
ranged AS (SELECT * FROM typed WHERE speed_kmh BETWEEN 0 AND 200 AND vehicle_count BETWEEN 0 AND 500),
single AS (SELECT * FROM ranged QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1),
clean AS (
  SELECT * REPLACE (cast(speed_kmh AS double) AS speed_kmh), cast(hour(ts) AS integer) AS hour
  FROM single
  WHERE congestion IN ('low', 'medium', 'high', 'critical')
    AND vehicle_type IN ('car', 'truck', 'bus', 'motorcycle', 'ambulance', 'police')
    AND weather IN ('clear', 'foggy', 'rainy', 'dusty', 'hot'))
"""
)

SCORES = (
    CLEAN
    + f""",
flagged AS (
  SELECT *,
         CASE congestion WHEN 'low' THEN 25 WHEN 'medium' THEN 50 WHEN 'high' THEN 75 WHEN 'critical' THEN 100
              ELSE 0 END AS congestion_score,
         {rounded("speed_kmh / cast(100 AS double)", 3)} AS speed_ratio,
         cast(vehicle_type IN ('ambulance', 'police') AS integer) AS is_emergency,
         cast(weather IN ('foggy', 'rainy', 'dusty') AS integer) AS is_bad_weather,
         CASE WHEN hour BETWEEN 6 AND 9 THEN 'morning_rush' WHEN hour BETWEEN 12 AND 14 THEN 'lunch_rush'
              WHEN hour BETWEEN 16 AND 19 THEN 'evening_rush' WHEN hour BETWEEN 22 AND 23 THEN 'night'
              WHEN hour BETWEEN 0 AND 5 THEN 'night' ELSE 'off_peak' END AS hour_bin
  FROM clean),
risky AS (
  SELECT *, {rounded('''congestion_score * cast(0.5 AS double)
         + (1 - speed_ratio) * 100 * cast(0.3 AS double) + is_bad_weather * 20''', 1)} AS risk_score
  FROM flagged),
labelled AS (
  SELECT *, CASE WHEN risk_score < 25 THEN 'low' WHEN risk_score < 50 THEN 'medium' WHEN risk_score < 75 THEN 'high'
                 ELSE 'critical' END AS severity_label
  FROM risky),
scores AS (
  SELECT *, CASE severity_label WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3
                 ELSE 0 END AS severity_index
  FROM labelled)
"""
)

JSON = (
    SRC
    + """,
parts AS (
  SELECT event_id, number % 20 AS r,
         coalesce('"' || event_id || '"', 'null') AS e, coalesce('"' || "timestamp" || '"', 'null') AS t,
         coalesce('"' || intersection_id || '"', 'null') AS i, coalesce('"' || zone || '"', 'null') AS z,
         coalesce(cast(speed_kmh AS varchar), 'null') AS s, coalesce('"' || congestion || '"', 'null') AS c,
         coalesce('"' || vehicle_type || '"', 'null') AS v, coalesce(cast(vehicle_count AS varchar), 'null') AS n,
         coalesce('"' || weather || '"', 'null') AS w
  FROM raw),
bodies AS (
  SELECT event_id, r,
         '{"event_id":' || e || ',"timestamp":' || t || ',"intersection_id":' || i || ','
         || CASE WHEN r = 2 THEN '' ELSE '"zone":' || z || ',' END
         || '"speed_kmh":' || CASE r WHEN 3 THEN 'null' WHEN 4 THEN '"FAST"' WHEN 6 THEN '999.9' ELSE s END
         || ',"congestion":' || CASE WHEN r = 8 THEN '"gridlock"' ELSE c END
         || ',"vehicle_type":' || v
         || ',"vehicle_count":' || CASE r WHEN 5 THEN '3.0' WHEN 7 THEN '501' ELSE n END
         || ',"weather":' || w || '}' AS body
  FROM parts),
texts AS (
  SELECT event_id, CASE r WHEN 0 THEN substring(body, 1, length(body) - 5) WHEN 1 THEN '[' || body || ']' ELSE body END AS value
  FROM bodies),
docs_json AS (SELECT event_id, value, CASE WHEN json_valid(value) THEN value END AS j FROM texts),
"""
)

_FIELDS = {
    "event_id": "('VARCHAR')",
    "timestamp": "('VARCHAR')",
    "intersection_id": "('VARCHAR')",
    "zone": "('VARCHAR')",
    "speed_kmh": "('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE', 'BOOLEAN')",
    "congestion": "('VARCHAR')",
    "vehicle_type": "('VARCHAR')",
    "vehicle_count": "('BIGINT', 'UBIGINT', 'HUGEINT', 'BOOLEAN')",
    "weather": "('VARCHAR')",
}
_FIELD_RULES = "\n".join(
    f"""    WHEN json_type(j, '$.{f}') IS NULL THEN 'missing_field:{f}'
    WHEN json_type(j, '$.{f}') = 'NULL' THEN 'null_field:{f}'
    WHEN json_type(j, '$.{f}') NOT IN {kinds} THEN 'wrong_type:{f}'"""
    for f, kinds in _FIELDS.items()
)
CHECKED = (
    JSON
    + f"""
checked AS (
  SELECT event_id, value, CASE
    WHEN j IS NULL THEN 'json_parse_error'
    WHEN json_type(j) <> 'OBJECT' THEN 'not_a_dict'
{_FIELD_RULES}
    WHEN NOT try_cast(json_extract_string(j, '$.speed_kmh') AS double) BETWEEN 0 AND 200 THEN 'speed_out_of_range'
    WHEN NOT try_cast(json_extract_string(j, '$.vehicle_count') AS double) BETWEEN 0 AND 500 THEN 'count_out_of_range'
    WHEN json_extract_string(j, '$.congestion') NOT IN ('low', 'medium', 'high', 'critical')
      THEN 'invalid_congestion_value'
    ELSE 'ok' END AS reason
  FROM docs_json)
"""
)

USER_EDGES = """
users AS (SELECT DISTINCT user_id AS src FROM events),
user_edges AS (
  SELECT src, (src * 3 + 1) % 150 AS dst, 0 AS ord FROM users
  UNION ALL
  SELECT src, (src + 7) % 150, 1 FROM users WHERE (src + 7) % 150 <> (src * 3 + 1) % 150)
"""

SENSOR_EDGES = """
crossings AS (SELECT DISTINCT event_id % 8 AS n FROM events),
edges AS (
  SELECT 'I' || cast(n AS varchar) AS src, 'I' || cast((n * 3 + 1) % 8 AS varchar) AS dst, n AS ord FROM crossings
  UNION ALL
  SELECT 'I' || cast(n AS varchar), 'H' || cast(n AS varchar), n + 100 FROM crossings WHERE n IN (1, 4)),
reach AS (
  SELECT dst AS node, dst AS target, ord, 0 AS hops FROM edges WHERE ord >= 100
  UNION
  SELECT e.src, r.target, r.ord, r.hops + 1 FROM reach r JOIN edges e ON e.dst = r.node WHERE r.hops < 12),
nearest AS (
  SELECT node, target, hops FROM reach
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY hops, ord) = 1)
"""


def top_docs(name: str, queries: str, docs: str, doc_key: str, k: int) -> str:
    """CTEs that end in ``<name>_top``: the k best documents per distinct query."""
    return rf"""
{name}_docs AS MATERIALIZED (SELECT {doc_key} AS doc_id, text, lower(text) AS low FROM {docs}),
{name}_asked AS MATERIALIZED (
  SELECT DISTINCT query, word
  FROM (SELECT query, unnest(string_split_regex(lower(query), '\s+')) AS word FROM ({queries}))
  WHERE word <> ''),
{name}_found AS (
  SELECT w.word, d.doc_id FROM (SELECT DISTINCT word FROM {name}_asked) w JOIN {name}_docs d ON contains(d.low, w.word)),
{name}_top AS (
  SELECT query, doc_id, count(*) AS score,
         row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, doc_id) AS place
  FROM {name}_asked JOIN {name}_found USING (word)
  GROUP BY query, doc_id
  QUALIFY place <= {k})"""


def texts_of(name: str, width: int) -> str:
    """CTE ``<name>_texts``: the joined, cut texts per query."""
    return f"""
{name}_texts AS (
  SELECT query, string_agg(substring(text, 1, {width}), '; ' ORDER BY place) AS context
  FROM {name}_top JOIN {name}_docs USING (doc_id) GROUP BY query)"""


DECIDED = (
    SCORES
    + ","
    + SENSOR_EDGES
    + """,
judged AS (
  SELECT *, CASE WHEN is_emergency = 1 AND congestion IN ('high', 'critical') THEN 'critical' ELSE severity_label END AS severity
  FROM scores),
acted AS (
  SELECT *, CASE severity WHEN 'low' THEN 'monitor' WHEN 'medium' THEN 'rebalance_signal_timing'
                          WHEN 'high' THEN 'activate_reroute' ELSE 'emergency_priority_clear' END AS action,
         congestion || ' congestion ' || vehicle_type || ' ' || weather AS vehicle_query,
         vehicle_type || ' ' || severity || ' ' || congestion AS incident_query
  FROM judged),
ruled AS (
  SELECT *, severity || ' ' || action || ' signal' AS signal_query,
         is_emergency = 1 AND action = 'emergency_priority_clear' AS override
  FROM acted),
lists AS (SELECT src, string_agg(dst, '|' ORDER BY ord) AS neighbors FROM edges GROUP BY src),"""
    + top_docs("va", "SELECT DISTINCT vehicle_query AS query FROM ruled", "documents", "doc_id", 2)
    + ","
    + texts_of("va", 80)
    + ","
    + top_docs("ida", "SELECT DISTINCT incident_query AS query FROM ruled", "benchmark", "item_id", 1)
    + ","
    + texts_of("ida", 100)
    + ","
    + top_docs("tla", "SELECT DISTINCT signal_query AS query FROM ruled", "documents", "doc_id", 1)
    + ","
    + texts_of("tla", 80)
    + """,
decided AS (
  SELECT r.*,
         coalesce(v.context, 'Standard protocol applies') AS vehicle_context,
         coalesce(i.context, 'Follow standard emergency protocol') AS protocol,
         coalesce(t.context, 'Default timing policy applied') AS policy_context,
         coalesce(n.target, 'H0') AS hospital, coalesce(l.neighbors, '') AS neighbors,
         CASE WHEN override THEN 60 WHEN severity = 'low' THEN 30 WHEN severity = 'medium' THEN 25
              WHEN severity = 'high' THEN 20 ELSE 0 END AS green,
         CASE WHEN override OR severity = 'critical' THEN 3 ELSE 5 END AS yellow,
         CASE WHEN override THEN 0 WHEN severity = 'low' THEN 25 WHEN severity = 'medium' THEN 30
              WHEN severity = 'high' THEN 45 ELSE 60 END AS red,
         CASE WHEN override THEN 'EMERGENCY OVERRIDE: Full green phase for ' || intersection_id || '. Clear all lanes.'
              WHEN severity = 'high' THEN 'Rerouting activated at ' || intersection_id || '. Extended red to divert traffic.'
              WHEN severity = 'medium' THEN 'Rebalancing signal timing at ' || intersection_id || ' to ease medium congestion.'
              ELSE 'Normal monitoring at ' || intersection_id || '. Standard timing maintained.' END AS decision
  FROM ruled r
  LEFT JOIN va_texts v ON v.query = r.vehicle_query
  LEFT JOIN ida_texts i ON i.query = r.incident_query
  LEFT JOIN tla_texts t ON t.query = r.signal_query
  LEFT JOIN nearest n ON n.node = r.intersection_id
  LEFT JOIN lists l ON l.src = r.intersection_id)
"""
)

CORPUS = "corpus AS (SELECT d.doc_id, d.text, cast(l.quality AS varchar) AS severity FROM documents d JOIN labels l USING (doc_id))"

_QUALITY = f"""
SELECT cast(r AS bigint) AS total_raw, cast(c AS bigint) AS total_clean, cast(r - c AS bigint) AS dropped,
       {rounded("cast(r - c AS double) / greatest(r, 1) * 100", 1)} AS drop_rate_pct
FROM totals
"""
_CLEAN_SELECT = """
SELECT event_id, intersection_id, zone, speed_kmh, congestion, vehicle_type, vehicle_count, weather, signal_phase,
       incident_flag, record_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_ts,
       strftime(ts, '%Y-%m-%d') AS date, hour
FROM clean
"""
_RISK_BY_ZONE = f"""
SELECT zone, {rounded("avg(risk_score)", 1)} AS avg_risk, {rounded("avg(congestion_score)", 1)} AS avg_congestion,
       count(*) AS event_count
FROM scores GROUP BY zone
"""


def _raw(field: str) -> str:
    return f"CASE WHEN reason NOT IN ('json_parse_error', 'not_a_dict') THEN json_extract_string(value, '$.{field}') END"


_RAW_TEXTS = ", ".join(
    f"{_raw(f)} AS raw_{f}"
    for f in ["event_id", "timestamp", "intersection_id", "zone", "congestion", "vehicle_type", "weather"]
)
_HANDED_ON = """event_id, intersection_id, zone, congestion, congestion_score, risk_score, vehicle_type, is_emergency, weather,
        is_bad_weather, speed_kmh, vehicle_count, hour_bin, severity_label"""


def _scores(columns: str) -> str:
    return f"WITH {SCORES} SELECT event_id, {columns} FROM scores"


_NAMED_TEST = f"""SELECT doc_id, lang AS severity, lang AS predicted_severity FROM documents
        WHERE {draw("doc_id", 42)} >= 0.8 AND text IS NOT NULL AND lang IS NOT NULL"""
_MESSAGES = f"""'[VA] Intersection ' || intersection_id || ' (zone: ' || zone || ') — ' || vehicle_type || ' at '
        || format('{{:.1f}}', speed_kmh) || ' km/h. Congestion: ' || congestion || '. Weather: ' || weather || '. Period: '
        || hour_bin || '. Risk score: ' || format('{{:.1f}}', risk_score) || '. Policy context: ' || vehicle_context || '.'
          AS message,
        coalesce(a.alerts, '') AS alerts, risk_score AS risk, neighbors
        FROM decided d LEFT JOIN (
          SELECT event_id, string_agg('[VA→' || dst || '] High-risk spillover warning from ' || intersection_id
                 || ' (risk=' || format('{{:.1f}}', risk_score) || ')', '|' ORDER BY ord) AS alerts
          FROM scores JOIN edges ON src = intersection_id WHERE risk_score >= 75 GROUP BY event_id) a USING (event_id)"""

# Of the northern folders with an even id only the even ids are left; replacing touches no other folder.
ROLLED_UP = """(zone <> 'north' OR event_id::bigint % 2 = 0 OR cast(ts AS date) NOT IN
        (SELECT cast(ts AS date) FROM scores WHERE zone = 'north' AND event_id::bigint % 2 = 0))"""

ORACLES = {
    "etl_drop_all_null_keys": f"""WITH {SRC} SELECT * FROM (
        SELECT CASE WHEN number % 3 <> 0 THEN event_id END AS event_id,
               CASE WHEN number % 5 <> 0 THEN "timestamp" END AS "timestamp",
               CASE WHEN number % 2 <> 0 THEN intersection_id END AS intersection_id, zone
        FROM raw) WHERE coalesce(event_id, "timestamp", intersection_id) IS NOT NULL""",
    "etl_fill_defaults": f"WITH {CLEAN} SELECT * EXCLUDE (number, ts) FROM filled",
    "etl_cast_or_default": f"""WITH {SRC} SELECT event_id,
        cast(coalesce(try_cast(coalesce(cast(speed_kmh AS varchar), 'FAST') AS float), 30.0) AS double) AS speed_kmh,
        coalesce(try_cast(CASE WHEN vehicle_count % 60 = 0 THEN 'many' ELSE cast(vehicle_count AS varchar) END AS integer), 1)
          AS vehicle_count
        FROM raw""",
    "etl_range_filter": f"WITH {CLEAN} SELECT event_id, cast(speed_kmh AS double) AS speed_kmh, vehicle_count FROM ranged",
    "etl_domain_filter": f"""WITH {CLEAN} SELECT event_id, congestion, vehicle_type, weather FROM filled
        WHERE congestion IN ('low', 'medium', 'high', 'critical')
          AND vehicle_type IN ('car', 'truck', 'bus', 'motorcycle', 'ambulance', 'police')
          AND weather IN ('clear', 'foggy', 'rainy', 'dusty', 'hot')""",
    "etl_dedup_by_event": f"WITH {SRC} SELECT DISTINCT * EXCLUDE (number, ts) FROM raw",
    "etl_dedup_hot_key": f"""WITH {SRC} SELECT shared AS event_id, "timestamp", intersection_id, speed_kmh, vehicle_count
        FROM (SELECT *, CASE WHEN number % 3 = 0 THEN 'HOT' ELSE cast(number % 997 AS varchar) END AS shared FROM raw)
        QUALIFY row_number() OVER (PARTITION BY shared ORDER BY ts, intersection_id) = 1""",
    "etl_event_time_parts": f"""WITH {SRC} SELECT event_id,
        CASE WHEN number % 7 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS event_ts,
        CASE WHEN number % 7 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS date,
        CASE WHEN number % 7 <> 0 THEN cast(hour(ts) AS integer) END AS hour
        FROM raw""",
    "etl_clean": f"WITH {CLEAN} {_CLEAN_SELECT}",
    "etl_rule_counts": f"""WITH {CLEAN}
        SELECT 'raw' AS rule, (SELECT count(*) FROM raw) AS rows
        UNION ALL SELECT 'keyless', (SELECT count(*) FROM raw WHERE event_id IS NULL AND "timestamp" IS NULL AND intersection_id IS NULL)
        UNION ALL SELECT 'out_of_range', (SELECT count(*) FROM typed) - (SELECT count(*) FROM ranged)
        UNION ALL SELECT 'duplicate', (SELECT count(*) FROM ranged) - (SELECT count(*) FROM single)
        UNION ALL SELECT 'out_of_domain', (SELECT count(*) FROM single) - (SELECT count(*) FROM clean)
        UNION ALL SELECT 'clean', (SELECT count(*) FROM clean)""",
    "src_rescued_lines": f"""WITH {SRC}
        SELECT CASE number % 20 WHEN 4 THEN 'speed_kmh' WHEN 5 THEN 'vehicle_count' ELSE '' END AS fields, count(*) AS lines
        FROM raw WHERE number % 20 IN (0, 4, 5) GROUP BY fields""",
    "roll_severity_by_zone": f"""WITH {SCORES} SELECT zone, severity_label, count(*) AS count FROM scores
        WHERE {ROLLED_UP} GROUP BY zone, severity_label""",
    "roll_risk_by_zone": f"""WITH {SCORES} SELECT zone, {rounded("avg(risk_score)", 1)} AS avg_risk,
        {rounded("avg(congestion_score)", 1)} AS avg_congestion, count(*) AS event_count FROM scores
        WHERE {ROLLED_UP} GROUP BY zone""",
    "etl_quality_stats": f"""WITH {CLEAN},
        totals AS (SELECT (SELECT count(*) FROM raw) AS r, (SELECT count(*) FROM clean) AS c) {_QUALITY}""",
    "feat_congestion_score": _scores("congestion, congestion_score"),
    "feat_speed_ratio": _scores("speed_kmh, speed_ratio"),
    "feat_flags": _scores("vehicle_type, is_emergency, weather, is_bad_weather"),
    "feat_hour_bin": _scores("hour, hour_bin"),
    "feat_risk_score": _scores("risk_score"),
    "feat_severity": _scores("severity_label, severity_index"),
    "win_zone_averages": f"""WITH {SCORES} SELECT event_id, zone,
        {rounded("avg(congestion_score) OVER (PARTITION BY zone)", 1)} AS zone_avg_congestion,
        {rounded("avg(speed_kmh) OVER (PARTITION BY zone)", 1)} AS zone_avg_speed
        FROM scores""",
    "win_severity_share": f"""WITH {SCORES} SELECT severity_label, count(*) AS count,
        {rounded("cast(count(*) * 100 AS double) / sum(count(*)) OVER ()", 1)} AS pct
        FROM scores GROUP BY severity_label""",
    "rep_severity_by_zone": f"WITH {SCORES} SELECT zone, severity_label, count(*) AS count FROM scores GROUP BY ALL",
    "rep_risk_by_hour_bin": f"""WITH {SCORES}
        SELECT hour_bin, {rounded("avg(risk_score)", 1)} AS avg_risk, count(*) AS events FROM scores GROUP BY hour_bin""",
    "rep_emergency_incidents": f"""WITH {SCORES}
        SELECT vehicle_type, severity_label, count(*) AS count FROM scores WHERE is_emergency = 1 GROUP BY ALL""",
    "rep_top3_intersections": f"""WITH {SCORES}
        SELECT intersection_id, {rounded("avg(risk_score)", 1)} AS avg_risk FROM scores GROUP BY intersection_id
        ORDER BY avg_risk DESC, intersection_id LIMIT 3""",
    "rep_risk_by_zone_sql": f"WITH {SCORES} {_RISK_BY_ZONE}",
    "rep_class_distribution": f"WITH {CORPUS} SELECT severity, count(*) AS count FROM corpus WHERE text IS NOT NULL GROUP BY severity",
    "rep_first_n_records": f"""WITH {SCORES} SELECT event_id, intersection_id, zone, congestion, congestion_score, risk_score,
        vehicle_type, is_emergency, weather, is_bad_weather, speed_kmh, vehicle_count, hour_bin, severity_label
        FROM scores ORDER BY event_id LIMIT 50""",
    "join_zone_lookup": f"WITH {SRC} SELECT event_id, intersection_id, zone FROM raw",
    "src_sink_parquet_roundtrip": f"""WITH {SCORES} SELECT event_id, intersection_id, zone, speed_kmh, congestion, vehicle_type,
        vehicle_count, weather, signal_phase, incident_flag, record_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_ts,
        strftime(ts, '%Y-%m-%d') AS date, hour, congestion_score, speed_ratio, is_emergency, is_bad_weather, hour_bin,
        {rounded("avg(congestion_score) OVER (PARTITION BY zone)", 1)} AS zone_avg_congestion,
        {rounded("avg(speed_kmh) OVER (PARTITION BY zone)", 1)} AS zone_avg_speed, risk_score, severity_label, severity_index
        FROM scores""",
    "sink_replace_is_idempotent": f"WITH {CLEAN} SELECT event_id, zone, strftime(ts, '%Y-%m-%d') AS date FROM clean",
    "src_catalog_table": f"WITH {SCORES} {_RISK_BY_ZONE}",
    "src_table_listing": f"""WITH {CLEAN} SELECT "table", false AS temporary, (SELECT count(*) FROM clean) AS rows
        FROM (VALUES ('clean'), ('features')) AS tables("table")""",
    "src_arrival_folders": """SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, count(*) AS records
        FROM events GROUP BY ALL""",
    "ml_labelled_guard": """SELECT lang AS severity, count(*) AS records, true AS empty_refused FROM documents
        WHERE text IS NOT NULL AND lang IS NOT NULL GROUP BY lang""",
    "src_json_roundtrip": f"""WITH {SRC} SELECT event_id, "timestamp", intersection_id, zone,
        cast(cast(speed_kmh AS float) AS double) AS speed_kmh, congestion, vehicle_type, vehicle_count, weather, signal_phase,
        incident_flag, record_type FROM raw""",
    "sink_scored_json": f"WITH {SCORES} SELECT {_HANDED_ON} FROM scores",
    "src_incident_corpus": "SELECT cast(doc_id AS varchar) AS id, text, lang AS severity FROM documents",
    "src_policy_corpus": "SELECT cast(item_id AS varchar) AS policy_id, text, true AS numbered FROM benchmark",
    "val_reasons": f"WITH {CHECKED} SELECT event_id, reason FROM checked",
    "val_reason_counts": f"WITH {CHECKED} SELECT reason, count(*) AS records FROM checked GROUP BY reason",
    "val_status_counts": f"""WITH {CHECKED} SELECT CASE reason WHEN 'ok' THEN 'valid' WHEN 'json_parse_error' THEN 'parse_error'
        ELSE 'invalid' END AS status, count(*) AS records FROM checked GROUP BY 1""",
    "val_quarantine": f"""WITH {CHECKED} SELECT event_id, reason,
        CASE WHEN reason IN ('json_parse_error', 'not_a_dict') THEN value END AS raw_text, {_RAW_TEXTS},
        try_cast({_raw("speed_kmh")} AS double) AS raw_speed_kmh, try_cast({_raw("vehicle_count")} AS double) AS raw_vehicle_count
        FROM checked WHERE reason <> 'ok'""",
    "stream_ingest_available_now": f"""WITH {CHECKED} SELECT reason,
        CASE WHEN reason NOT IN ('json_parse_error', 'not_a_dict') THEN event_id END AS event_id FROM checked""",
    "stream_dedup": f"""WITH {SRC}
        SELECT DISTINCT event_id, intersection_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_ts FROM raw""",
    "graph_successors": f"WITH {USER_EDGES} SELECT src AS node, dst AS neighbor, ord FROM user_edges",
    "graph_hops": f"""WITH RECURSIVE {USER_EDGES},
        walk AS (
          SELECT src AS source, src AS target, 0 AS hops FROM users WHERE src IN (0, 75)
          UNION
          SELECT e.src, w.target, w.hops + 1 FROM walk w JOIN user_edges e ON e.dst = w.source
          WHERE w.hops < (SELECT count(*) FROM (SELECT src FROM user_edges UNION SELECT dst FROM user_edges)))
        SELECT source, target, cast(min(hops) AS integer) AS hops FROM walk GROUP BY source, target""",
    "graph_nearest_target": f"""WITH RECURSIVE {SENSOR_EDGES}
        SELECT n.node, coalesce(r.target, 'none') AS target, cast(r.hops AS integer) AS hops
        FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n LEFT JOIN nearest r ON r.node = n.node""",
    "graph_neighbor_lists": f"""WITH RECURSIVE {SRC}, {SENSOR_EDGES},
        lists AS (SELECT src, string_agg(dst, '|' ORDER BY ord) AS neighbors FROM edges GROUP BY src)
        SELECT event_id, coalesce(neighbors, '') AS neighbors FROM raw LEFT JOIN lists ON src = intersection_id""",
    "graph_spillover": f"""WITH RECURSIVE {SCORES}, {SENSOR_EDGES}
        SELECT event_id, intersection_id, dst AS neighbor, ord AS edge_ord,
               '[VA→' || dst || '] High-risk spillover warning from ' || intersection_id
               || ' (risk=' || format('{{:.1f}}', risk_score) || ')' AS alert
        FROM scores JOIN edges ON src = intersection_id WHERE risk_score >= 75""",
    "text_topk_overlap": f"""WITH
        {top_docs("t", "SELECT text AS query FROM benchmark", "documents", "doc_id", 2)}
        SELECT query, cast(place AS integer) AS rank, cast(score AS integer) AS score, doc_id FROM t_top""",
    "text_record_context": f"""WITH {SCORES},
        asking AS (SELECT event_id, congestion || ' congestion ' || vehicle_type || ' ' || weather AS query FROM scores),
        {top_docs("v", "SELECT DISTINCT query FROM asking", "documents", "doc_id", 2)},
        {texts_of("v", 80)}
        SELECT event_id, query, coalesce(context, 'Standard protocol applies') AS context
        FROM asking LEFT JOIN v_texts USING (query)""",
    "decide_incident": f"""WITH RECURSIVE {DECIDED} SELECT event_id, intersection_id, severity,
        severity_label AS spark_predicted_sev, risk_score, is_emergency = 1 AS is_emergency, action AS recommended_action,
        protocol, CASE WHEN severity IN ('high', 'critical') THEN hospital END AS nearest_hospital,
        risk_score >= 50 AND severity IN ('high', 'critical') AS va_risk_confirmed FROM decided""",
    "decide_signal": f"""WITH RECURSIVE {DECIDED} SELECT event_id, intersection_id, severity, action, decision, policy_context,
        is_emergency = 1 AS is_emergency, green, yellow, red FROM decided""",
    "decide_summary": f"""WITH RECURSIVE {DECIDED} SELECT event_id, intersection_id, severity, action, green, red,
        substring(decision, 1, 70) AS decision FROM decided""",
    "stream_decisions": f"""WITH RECURSIVE {DECIDED} SELECT event_id, intersection_id, severity, action, green, red,
        substring(decision, 1, 70) AS decision FROM decided""",
    "decide_messages": f"""WITH RECURSIVE {DECIDED} SELECT d.event_id, {_MESSAGES}""",
    "decide_nested_json": f"""WITH RECURSIVE {DECIDED} SELECT d.event_id, 0 AS part, severity,
        severity_label AS spark_predicted_sev, action AS recommended_action, action, protocol,
        CASE WHEN severity IN ('high', 'critical') THEN hospital END AS nearest_hospital,
        risk_score >= 50 AND severity IN ('high', 'critical') AS va_risk_confirmed, decision, policy_context,
        is_emergency = 1 AS is_emergency, green, yellow, red, {_MESSAGES}""",
    "score_text_column": f"""WITH {SCORES} SELECT event_id, concat_ws(' ', intersection_id, congestion, vehicle_type, weather,
        hour_bin, CASE WHEN is_emergency = 1 THEN 'emergency vehicle' ELSE 'normal vehicle' END) AS text FROM scores""",
    "ml_split": f"""WITH {CORPUS} SELECT doc_id,
        CASE WHEN {draw("doc_id", 42)} < 0.8 THEN 'train' ELSE 'test' END AS part FROM corpus""",
    "ml_null_text": f"""WITH {CORPUS} SELECT doc_id,
        CASE WHEN {draw("doc_id", 1)} < 0.2 THEN 'unknown incident reported' ELSE text END AS text FROM corpus""",
    "ml_noisy_labels": f"""SELECT doc_id, CASE WHEN {draw("doc_id", 2)} < 0.1
        THEN {pick(["de", "en", "es", "fr"], draw("doc_id", 3))} ELSE lang END AS severity FROM documents""",
    "ml_logreg_score": _NAMED_TEST,
    "ml_svm_score": _NAMED_TEST,
    "ml_metrics": f"""WITH test AS (SELECT lang FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND {draw("doc_id", 42)} >= 0.8),
        classes AS (SELECT lang, count(*) AS n FROM test GROUP BY lang),
        sizes AS (SELECT cast(sum(n) AS bigint) AS test_rows, {rounded("cast(max(n) AS double) / sum(n)", 4)} AS majority_share FROM classes)
        SELECT classifier, condition, test_rows, majority_share, true AS learned, true AS agrees, timed
        FROM sizes, (VALUES ('logreg', 'clean', true), ('svm', 'clean', true), ('logreg', 'null_20pct', false),
            ('logreg', 'noisy_labels_10pct', true)) AS runs(classifier, condition, timed)""",
    "ml_intervals": f"""WITH {CORPUS},
        guesses AS (SELECT cast(doc_id AS varchar) AS key, severity AS a, cast(doc_id % 3 % 2 AS varchar) AS g FROM corpus),
        drawn AS (SELECT r, a, g, cast(('0x' || substr(md5((r // {ml.DRAWS_PER_DIGEST} + {ml.BOOTSTRAP_SEED}) || ':' || key),
                      8 * (r % {ml.DRAWS_PER_DIGEST}) + 1, 8)) AS bigint) / cast(4294967296 AS double) AS u
                  FROM guesses, range({ml.REPLICATES}) AS replicates(r)),
        weighted AS (SELECT r, a, g, {" + ".join(f"cast(u >= {step!r}::double AS integer)" for step in ml.poisson_steps())} AS w FROM drawn
                     UNION ALL SELECT -1, a, g, 1 FROM guesses),
        cells AS (SELECT r, a, g, cast(sum(w) AS double) AS n FROM weighted WHERE w > 0 GROUP BY r, a, g),
        sides AS (SELECT r, a AS c, n AS actual, 0 AS guessed, CASE WHEN a = g THEN n ELSE 0 END AS hits FROM cells
                  UNION ALL SELECT r, g, 0, n, 0 FROM cells),
        by_class AS (SELECT r, c, sum(actual) AS actual, sum(guessed) AS guessed, sum(hits) AS hits FROM sides GROUP BY r, c),
        scores AS (SELECT r, sum(hits) / sum(actual) AS accuracy, sum(2 * hits / (actual + guessed) * actual) / sum(actual) AS f1
                   FROM by_class GROUP BY r)
        SELECT {", ".join(
            f"{rounded(f'max({name}) FILTER (r = -1)', 4)} AS {name}, "
            f"{rounded(f'quantile_cont({name}, 0.025) FILTER (r >= 0)', 4)} AS {name}_low, "
            f"{rounded(f'quantile_cont({name}, 0.975) FILTER (r >= 0)', 4)} AS {name}_high"
            for name in ("accuracy", "f1"))}
        FROM scores""",
    "ml_score_features": f"WITH {SCORES} SELECT {_HANDED_ON}, true AS has_known_severity FROM scores",
    "ml_confusion_metrics": f"""WITH {CORPUS},
        pairs AS (SELECT severity AS a, cast(doc_id % 3 % 2 AS varchar) AS g FROM corpus),
        classes AS (SELECT c, count(*) FILTER (a = c) AS actual, count(*) FILTER (g = c) AS guessed,
                           count(*) FILTER (a = c AND g = c) AS hits
                    FROM pairs, (SELECT a AS c FROM pairs UNION SELECT g FROM pairs) GROUP BY c)
        SELECT {rounded("cast(sum(hits) AS double) / sum(actual)", 4)} AS accuracy,
               {rounded("sum(2 * cast(hits AS double) / (actual + guessed) * actual) / sum(actual)", 4)} AS f1
        FROM classes""",
    "quality_metrics": f"""WITH {CLEAN},
        totals AS (SELECT (SELECT count(*) FROM raw) AS r, (SELECT count(*) FROM clean) AS c) {_QUALITY}""",
}
