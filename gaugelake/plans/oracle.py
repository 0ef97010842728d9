"""SQL checks of the query catalogue, over the given tables.

They work on the plain event columns and know from ``k`` which fault a message has, so they neither
build nor parse JSON.
"""

from __future__ import annotations

MESSAGES = """
WITH e AS (
  SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, ts + INTERVAL 90 SECONDS AS ingest_ts FROM events
), m AS (
  SELECT k, user_id, event_id AS "offset", CAST(user_id % 4 AS INTEGER) AS "partition",
    'sensor-data-' || event_type AS topic, event_type AS sensor_name, event_type AS table_name,
    ts, ingest_ts,
    CASE WHEN k = 3 THEN -1 ELSE (epoch_us(ts) // 1000) END AS kafka_timestamp,
    CASE k WHEN 7 THEN 'null_value' WHEN 21 THEN 'invalid_utf8' WHEN 13 THEN 'raw_text' ELSE 'json' END AS parse_status,
    CASE WHEN k IN (13, 34, 62, 96) THEN ingest_ts
         WHEN k = 71 THEN make_timestamp((epoch_us(ts) // 1000) * 1000)
         WHEN k = 80 THEN ts - INTERVAL 2 HOURS ELSE ts END AS event_time,
    CASE WHEN k IN (13, 34, 96) THEN 'ingest' WHEN k = 62 THEN 'fallback' ELSE 'payload' END AS time_quality,
    CASE WHEN k IN (13, 55, 96) OR (k = 47 AND user_id = 0) THEN 'unknown_asset'
         WHEN k = 47 THEN CAST(user_id AS VARCHAR)
         ELSE 'asset_' || lpad(CAST(user_id AS VARCHAR), 6, '0') END AS asset_id,
    value AS event_value,
    CASE WHEN k NOT IN (13, 29, 89) THEN value END AS value,
    CASE WHEN k NOT IN (13, 96) THEN CAST(k AS DOUBLE) END AS props_k,
    (CAST(user_id % 4 AS BIGINT) << 48) + event_id AS arrival
  FROM e
), a AS (
  SELECT * FROM m WHERE parse_status NOT IN ('null_value', 'invalid_utf8')
)"""

# Measures and attributes of accepted messages; NaN is shown as -1.
LONG = MESSAGES + """, long AS (
  SELECT "offset", sensor_name, asset_id, event_time, arrival, 'value' AS measure, value, k = 29 AS is_nan
  FROM a WHERE k NOT IN (13, 89)
  UNION ALL SELECT "offset", sensor_name, asset_id, event_time, arrival, 'props_k', props_k, false
  FROM a WHERE k NOT IN (13, 96)
  UNION ALL SELECT "offset", sensor_name, asset_id, event_time, arrival, 'daqid', CAST(user_id AS DOUBLE), false
  FROM a WHERE k = 47
  UNION ALL SELECT "offset", sensor_name, asset_id, event_time, arrival, 'time', CAST((epoch_us(ts) // 1000) AS DOUBLE), false
  FROM a WHERE k = 71
)"""

FILES = """
WITH files AS (
  SELECT *, 'asset_' || o_custkey AS asset_id,
    'asset_' || o_custkey || '/' || strftime(o_orderdate, '%Y/%m/%d') || '/f_' || o_orderkey || '.parquet' AS rel_path,
    CAST(round(o_totalprice) AS BIGINT) AS size
  FROM orders
), local AS (
  SELECT rel_path, asset_id, size, o_orderdate AS mtime FROM files
), remote AS (
  SELECT rel_path,
    CASE o_orderpriority WHEN '2-HIGH' THEN size + 2000 WHEN '3-MEDIUM' THEN size + 512 ELSE size END AS size,
    CASE o_orderpriority WHEN '5-LOW' THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 1 DAY END AS mtime
  FROM files WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O')
), log AS (
  SELECT rel_path, CASE WHEN l_linestatus = 'F' THEN 'uploaded' WHEN l_returnflag = 'R' THEN 'deleted' ELSE 'failed' END AS event, l_shipdate AS logged_at
  FROM lineitem JOIN files ON l_orderkey = o_orderkey
), state AS (
  SELECT rel_path, max(logged_at) FILTER (event = 'uploaded') AS uploaded_at,
    max(logged_at) FILTER (event = 'deleted') AS deleted_at
  FROM log GROUP BY rel_path
), uploaded AS (
  SELECT rel_path, uploaded_at FROM state
  WHERE uploaded_at IS NOT NULL AND (deleted_at IS NULL OR uploaded_at > deleted_at)
), plan AS (
  SELECT l.rel_path, l.size, l.mtime,
    CASE WHEN r.size IS NULL THEN 'missing_remote' WHEN l.mtime > r.mtime THEN 'local_newer'
         WHEN abs(l.size - r.size) > 1024 THEN 'size_differs' ELSE 'already_up_to_date' END AS reason
  FROM local l LEFT JOIN remote r USING (rel_path)
), eligible AS (
  SELECT rel_path, size, mtime FROM local
  WHERE mtime < TIMESTAMP '2001-08-01' - INTERVAL 7 DAYS AND rel_path IN (SELECT rel_path FROM uploaded)
), pending AS (
  SELECT * FROM local WHERE rel_path NOT IN (SELECT rel_path FROM uploaded)
)"""

_SAMPLES = """
WITH samples AS (
  SELECT CAST(l_suppkey % 2 AS VARCHAR) AS asset_id, l_returnflag AS sensor_name,
    date_trunc('quarter', CAST(l_shipdate AS TIMESTAMP)) + to_hours(l_partkey % 2) + to_minutes(l_linenumber % 3 * 10)
      + to_seconds(l_suppkey % 60) AS event_time,
    l_quantity AS quantity, round(l_extendedprice) AS price, round(l_discount * 100) AS discount, round(l_tax * 100) AS tax,
    (l_orderkey * 8 + l_linenumber) * 64 + l_suppkey % 60 AS arrival
  FROM lineitem
)"""

_MB = "1048576.0"


def _stats(columns: list[str]) -> tuple[str, list[str]]:
    """Select list of mean, min and max of the columns, and the resulting names."""
    parts, names = [], []
    for c in columns:
        for name, fn in (("mean", "avg"), ("min", "min"), ("max", "max")):
            parts.append(f"{fn}({c}) AS {c}_{name}")
            names.append(f"{c}_{name}")
    return ", ".join(parts), names


def _rollup(
    prefix: str, source: str, columns: list[str], level: str, keys: tuple[str, ...] = ("sensor_name", "asset_id"),
    minute_filter: str = "true", hour_filter: str = "true", digits: int = 6,
) -> str:
    """Nested GROUP BYs from rows up to the given level, rounded at the end."""
    by = ", ".join(keys)
    select, names = _stats(columns)
    sql = (
        f"{prefix}, minutes AS (SELECT date_trunc('minute', event_time) AS minute_bucket, {by}, {select}, "
        f"arg_min(event_time, arrival) AS timestamp_first FROM {source} GROUP BY ALL)"
    )
    bucket, first, final = "minute_bucket", "timestamp_first", "minutes"
    if level in ("hour", "day"):
        select, names = _stats(names)
        sql += (
            f", hours AS (SELECT date_trunc('hour', minute_bucket) AS hour_bucket, {by}, {select}, "
            f"min(minute_bucket) AS minute_bucket_first FROM minutes WHERE {minute_filter} GROUP BY ALL)"
        )
        bucket, first, final = "hour_bucket", "minute_bucket_first", "hours"
    if level == "day":
        select, names = _stats(names)
        sql += (
            f", days AS (SELECT CAST(hour_bucket AS DATE) AS day_bucket, {by}, {select}, "
            f"min(hour_bucket) AS hour_bucket_first FROM hours WHERE {hour_filter} GROUP BY ALL)"
        )
        bucket, first, final = "day_bucket", "hour_bucket_first", "days"
    rounded = ", ".join(f"round({n}, {digits}) AS {n}" for n in names)
    return f"{sql} SELECT {bucket}, {by}, {rounded}, {first} FROM {final}"


_VALUES = MESSAGES + ", measured AS (SELECT * FROM a WHERE k NOT IN (13, 89))"
_BOTH = MESSAGES + ", measured AS (SELECT * FROM a WHERE k <> 13)"
_QUANTITIES = ["quantity", "price", "discount", "tax"]

ORACLES: dict[str, str] = {
    # Sources
    "src_topic_filter": MESSAGES + """
        SELECT topic, "partition", "offset" FROM m WHERE regexp_matches(topic, '^sensor-data-(view|click).*')""",
    "src_incremental_pull": "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15'",
    "src_high_water": """
        SELECT coalesce(max(ts), TIMESTAMP '2024-01-15') AS high_water, count(*) AS "rows"
        FROM events WHERE ts > TIMESTAMP '2024-01-15'""",
    "src_pull_capped": """
        SELECT event_id, ts, user_id, event_type, value, props FROM (
          SELECT *, rank() OVER (ORDER BY ts) AS r FROM events WHERE ts > TIMESTAMP '2024-01-15'
        ) WHERE r <= 1000""",
    "src_pull_capped_ties": """
        SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate FROM (
          SELECT *, rank() OVER (ORDER BY l_shipdate) AS r FROM lineitem
        ) WHERE r <= 1000""",
    "src_key_extract": """
        SELECT 'sensor-data-' || event_type AS topic, CAST(user_id AS VARCHAR) AS "key",
          '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS value
        FROM events""",
    # Parsing and layout
    "parse_envelope": MESSAGES + """
        SELECT sensor_name, topic, "partition", "offset", ingest_ts, kafka_timestamp, parse_status,
          CASE WHEN k = 96 THEN 'DECIMAL' ELSE 'OBJECT' END AS payload_kind FROM a""",
    "parse_topic": MESSAGES + """ SELECT "offset", sensor_name, table_name FROM m""",
    "parse_event_time": MESSAGES + """
        SELECT "offset", event_time, time_quality,
          CASE WHEN epoch_us(event_time) % 1000000 = 0 THEN strftime(event_time, '%Y-%m-%dT%H:%M:%S')
               ELSE strftime(event_time, '%Y-%m-%dT%H:%M:%S.%f') END AS iso_time FROM a""",
    "parse_event_time_source_clock": MESSAGES + """
        SELECT "offset", time_quality,
          CASE k WHEN 80 THEN ts WHEN 71 THEN make_timestamp((epoch_us(ts) // 1000) // 1000) ELSE event_time END AS event_time
        FROM a""",
    "parse_asset": MESSAGES + """ SELECT "offset", asset_id FROM a""",
    "parse_raw_text": MESSAGES + """
        SELECT "offset", parse_status,
          CASE WHEN k = 13 THEN 'corrupt ' || "offset"
               ELSE regexp_replace(CAST(event_value AS VARCHAR), '\\.0$', '') END AS value
        FROM a WHERE k IN (13, 96)""",
    "parse_rejects": MESSAGES + """
        SELECT topic, parse_status AS reason, count(*) AS "rows" FROM m
        WHERE parse_status IN ('null_value', 'invalid_utf8') GROUP BY ALL""",
    "parse_status_counts": MESSAGES + """ SELECT topic, parse_status, count(*) AS "rows" FROM m GROUP BY ALL""",
    "layout_keys": MESSAGES + """
        SELECT asset_id || '/' || strftime(event_time, '%Y/%m/%d/%H') || '/' || table_name AS group_key,
          strftime(event_time, '%Y') AS "year", strftime(event_time, '%m') AS "month",
          strftime(event_time, '%d') AS "day", strftime(event_time, '%H') AS "hour", count(*) AS "rows"
        FROM a GROUP BY ALL""",
    "layout_paths": MESSAGES + """
        SELECT '/data/raw/' || asset_id || '/' || strftime(event_time, '%Y/%m/%d/%H') || '/' || table_name || '_'
          || strftime(event_time, '%Y%m%d_%H') || '.parquet' AS file_path, count(*) AS "rows"
        FROM a GROUP BY ALL""",
    "layout_rollup_paths": MESSAGES + """
        SELECT
          'aggregated/' || asset_id || strftime(event_time, '/%Y/%m/%d/%H/') || sensor_name || '_minute.parquet' AS minute_path,
          'aggregated/' || asset_id || strftime(event_time, '/%Y/%m/%d/') || sensor_name || '_hour.parquet' AS hour_path,
          'daily/' || asset_id || strftime(event_time, '/%Y/%m/') || sensor_name || '_day.parquet' AS day_path,
          count(*) AS "rows"
        FROM a GROUP BY ALL""",
    "layout_relative_paths": """
        SELECT o_orderkey,
          CASE WHEN o_orderstatus = 'O' THEN o_orderkey || '_day' ELSE 'daily/asset_' || o_custkey || '/' || o_orderkey || '_day' END AS rel_path,
          CAST(o_orderkey AS VARCHAR) AS stem
        FROM orders""",
    # Flattening
    "flatten_collision": MESSAGES + """
        SELECT "offset", sensor_name,
          CASE WHEN k IN (13, 55, 96) THEN topic WHEN k = 47 THEN CAST(user_id AS VARCHAR) ELSE asset_id END AS topic
        FROM a""",
    "flatten_wide": MESSAGES + """
        SELECT "offset", sensor_name, asset_id, CASE WHEN k = 29 THEN -1.0 ELSE value END AS value, props_k,
          CASE WHEN k IN (13, 55, 96) THEN '' WHEN k = 47 THEN CAST(user_id AS VARCHAR) ELSE asset_id END AS daqid
        FROM a""",
    "flatten_long": LONG + """
        SELECT "offset", measure, CASE WHEN is_nan THEN -1.0 ELSE value END AS value FROM long""",
    "flatten_attributes": MESSAGES + """
        SELECT "offset", 'time' AS attribute,
          CASE k WHEN 62 THEN 'not a time' WHEN 80 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+02:00'
                 ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS value
        FROM a WHERE k NOT IN (13, 34, 71, 96)
        UNION ALL SELECT "offset", 'daqid', asset_id FROM a WHERE k NOT IN (13, 47, 55, 96)
        UNION ALL SELECT "offset", 'value', 'corrupt ' || "offset" FROM a WHERE k = 13
        UNION ALL SELECT "offset", 'value', CAST(event_value AS VARCHAR) FROM a WHERE k = 89""",
    "flatten_fields": MESSAGES + """, fields AS (
          SELECT 'time' AS field, CASE WHEN k = 71 THEN 'BIGINT' ELSE 'STRING' END AS type FROM a WHERE k NOT IN (13, 34, 96)
          UNION ALL SELECT 'daqid', CASE WHEN k = 47 THEN 'BIGINT' ELSE 'STRING' END FROM a WHERE k NOT IN (13, 55, 96)
          UNION ALL SELECT 'value', CASE WHEN k IN (13, 89) THEN 'STRING' WHEN k = 29 THEN 'DOUBLE' ELSE 'DECIMAL' END FROM a
          UNION ALL SELECT 'props_k', 'BIGINT' FROM a WHERE k NOT IN (13, 96)
        ) SELECT field, type, count(*) AS "rows" FROM fields GROUP BY ALL""",
    # Rollups
    "agg_minute": _rollup(_VALUES, "measured", ["value"], "minute"),
    "agg_minute_multi": _rollup(_SAMPLES, "samples", _QUANTITIES, "minute"),
    "agg_minute_long": _rollup(LONG, "long", ["value"], "minute", ("sensor_name", "asset_id", "measure"), digits=3),
    "agg_hour": _rollup(_VALUES, "measured", ["value"], "hour"),
    "agg_hour_target": _rollup(
        _VALUES, "measured", ["value"], "hour",
        minute_filter="date_trunc('hour', minute_bucket) = TIMESTAMP '2024-01-10 12:00:00'",
    ),
    "agg_hour_multi": _rollup(_SAMPLES, "samples", _QUANTITIES, "hour"),
    "agg_day": _rollup(_VALUES, "measured", ["value"], "day"),
    "agg_day_target": _rollup(
        _SAMPLES, "samples", ["quantity"], "day", hour_filter="CAST(hour_bucket AS DATE) = DATE '1998-04-01'"
    ),
    "agg_cascade": _rollup(_BOTH, "measured", ["value", "props_k"], "day"),
    "agg_cascade_sensor": _rollup(_BOTH, "measured", ["value", "props_k"], "day", ("sensor_name",), digits=8),
    "agg_refresh_late": _rollup(_SAMPLES, "samples", _QUANTITIES, "day"),
    "agg_pivot_wide": f"""SELECT * EXCLUDE (timestamp_first) FROM (
        {_rollup(_BOTH, "measured", ["value", "props_k"], "minute")})""",
    "agg_text_buckets": f"""
        SELECT sensor_name, asset_id, strftime(hour_bucket, '%Y-%m-%d %H:00:00') AS hour_bucket,
          strftime(minute_bucket_first, '%Y-%m-%dT%H:%M:00') AS minute_bucket_first, hour_bucket AS parsed
        FROM ({_rollup(_VALUES, "measured", ["value"], "hour")})""",
    "agg_minute_windows": _rollup(_VALUES, "measured", ["value"], "minute"),
    "agg_day_windows": _rollup(_VALUES, "measured", ["value"], "day"),
    "set_union_schema": """
        SELECT event_id, floor(value) AS value, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '' AS event_type
        FROM events WHERE event_type IN ('error', 'signup')
        UNION ALL SELECT event_id, value, -1, event_type FROM events WHERE event_type NOT IN ('error', 'signup')""",
    # Ingest
    "ingest_group_sizes": MESSAGES + """
        SELECT count(*) AS group_count, CAST(sum(n) AS BIGINT) AS buffered_records, max(n) AS largest_group FROM (
          SELECT asset_id, date_trunc('hour', event_time) AS h, table_name, count(*) AS n FROM a GROUP BY ALL)""",
    "ingest_dedup": MESSAGES + """
        SELECT topic, "partition", count(*) AS "rows", max("offset") AS last_offset FROM (
          SELECT topic, "partition", "offset" FROM m UNION SELECT topic, "partition", "offset" FROM m
        ) GROUP BY ALL""",
    # Lifecycle
    "life_list_prefix": FILES + f"""
        SELECT count(*) AS "count", round(sum(size / {_MB}), 6) AS total_size_mb FROM remote
        WHERE starts_with(rel_path, 'asset_1')""",
    "life_list_files": FILES + f"""
        SELECT rel_path AS name, round(size / {_MB}, 6) AS size_mb, mtime AS last_modified,
          'application/octet-stream' AS content_type
        FROM remote WHERE starts_with(rel_path, 'asset_1')""",
    "life_storage_stats": FILES + f"""
        SELECT coalesce(tier, '*') AS tier, coalesce(asset_id, '*') AS asset_id, count(*) AS files,
          CAST(sum(size) AS BIGINT) AS size_bytes, round(CAST(sum(size) AS BIGINT) / {_MB}, 6) AS size_mb
        FROM (SELECT 'raw' AS tier, asset_id, size FROM local) GROUP BY ROLLUP (tier, asset_id)""",
    "life_sync_plan": FILES + """
        SELECT rel_path, size, mtime, CASE reason WHEN 'already_up_to_date' THEN 'skip' ELSE 'upload' END AS action, reason
        FROM plan""",
    "life_sync_summary": FILES + f"""
        SELECT CASE reason WHEN 'already_up_to_date' THEN 'skipped' ELSE 'uploaded' END AS status, count(*) AS files,
          CAST(sum(size) AS BIGINT) AS size_bytes, round(CAST(sum(size) AS BIGINT) / {_MB}, 6) AS size_mb,
          TIMESTAMP '2001-08-01' AS last_time
        FROM plan GROUP BY ALL""",
    "life_uploaded_set": FILES + " SELECT rel_path, uploaded_at FROM uploaded",
    "life_backlog": FILES + """
        SELECT asset_id, count(*) AS pending_files, CAST(sum(size) AS BIGINT) AS pending_bytes, count(*) > 1000 AS breach
        FROM pending GROUP BY ALL""",
    "life_backlog_total": FILES + """
        SELECT count(*) AS pending_files, CAST(sum(size) AS BIGINT) AS pending_bytes, count(*) > 1000 AS breach FROM pending""",
    "life_cleanup_eligible": FILES + " SELECT rel_path, size, mtime FROM eligible",
    "life_cleanup_dry_run": FILES + f"""
        SELECT rel_path, 'would_delete' AS status, round(size / {_MB}, 6) AS size_mb FROM eligible""",
    "life_cleanup_report": FILES + """
        SELECT count(*) AS files_processed, count(*) AS files_deleted, CAST(0 AS BIGINT) AS files_would_delete,
          CAST(0 AS BIGINT) AS files_failed, CAST(0 AS BIGINT) AS files_skipped,
          CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes_freed
        FROM eligible""",
    # Monitoring
    "mon_rate_5m": MESSAGES + """
        SELECT topic, time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, count(*) AS messages,
          round(count(*) / 300.0, 6) AS rate
        FROM m GROUP BY ALL""",
    "mon_counter_rate": """
        WITH c AS (
          SELECT 'half=' || (user_id % 2) || ',topic=' || event_type AS series, ts, date_trunc('hour', ts) AS window_start,
            CAST(event_id % 500 AS DOUBLE) AS v
          FROM events
        ), d AS (
          SELECT *, lag(v) OVER (PARTITION BY series, window_start ORDER BY ts) AS p FROM c
        )
        SELECT 'events_total' AS name, series, window_start, count(*) AS samples,
          round(coalesce(sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END), 0), 6) AS increase,
          round(coalesce(sum(CASE WHEN p IS NULL THEN 0 WHEN v >= p THEN v - p ELSE v END), 0) / 3600, 6) AS rate
        FROM d GROUP BY ALL""",
    "mon_failure_rate": MESSAGES + """, f AS (
          SELECT topic, date_trunc('hour', ingest_ts) AS window_start, count(*) AS total,
            count(*) FILTER (k IN (7, 21)) AS failures FROM m GROUP BY ALL)
        SELECT *, round(failures / 3600.0, 6) AS failure_rate, round(failures / total, 6) AS failure_share,
          failures > 0 AS breach FROM f""",
    "mon_lag": MESSAGES + """, h AS (
          SELECT topic, "partition", max("offset") AS latest_offset,
            coalesce(max("offset") FILTER (ingest_ts <= TIMESTAMP '2024-01-20'), -1) AS committed_offset
          FROM m GROUP BY ALL)
        SELECT *, latest_offset - committed_offset AS lag, latest_offset - committed_offset > 3500 AS breach FROM h""",
    "mon_gaps": MESSAGES + """, w AS (
          SELECT DISTINCT topic, time_bucket(INTERVAL 5 MINUTES, ts) AS s FROM m
        ), g AS (
          SELECT topic, s + INTERVAL 5 MINUTES AS gap_start,
            coalesce(lead(s) OVER (PARTITION BY topic ORDER BY s), TIMESTAMP '2024-01-31') AS gap_end FROM w)
        SELECT *, CAST(epoch_us(gap_end) - epoch_us(gap_start) AS DOUBLE) / 1000000 AS gap_seconds FROM g
        WHERE gap_end - gap_start >= INTERVAL 15 MINUTES""",
    "mon_usage_ratio": FILES + """, u AS (
          SELECT asset_id, CAST(sum(size) AS BIGINT) AS used_bytes FROM local GROUP BY ALL
        ), q AS (
          SELECT 'asset_' || c_custkey AS asset_id, CAST(round(c_acctbal) * 1000 AS BIGINT) AS capacity_bytes FROM customer)
        SELECT asset_id, used_bytes, capacity_bytes, round(used_bytes / capacity_bytes, 6) AS usage,
          used_bytes / capacity_bytes > 0.85 AS breach
        FROM u JOIN q USING (asset_id) WHERE capacity_bytes > 0""",
    "mon_alerts": """
        WITH s AS (
          SELECT 'event_value' AS name, 'half=' || (user_id % 2) || ',topic=' || event_type AS series, ts, value FROM events
          UNION ALL
          SELECT 'events_total', 'half=' || (user_id % 2) || ',topic=' || event_type, ts, CAST(event_id % 500 AS DOUBLE) FROM events
        ), k AS (
          SELECT *, epoch_us(ts) // 60000000 * 60 AS t, lag(value) OVER (PARTITION BY name, series, epoch_us(ts) // 60000000 ORDER BY ts, value) AS prev FROM s
        ), reduced AS (
          SELECT name, series, t, sum(CASE WHEN value >= prev THEN value - prev WHEN value < prev THEN value END) AS grown,
            arg_min(value, ts) AS first, arg_max(value, ts) AS value
          FROM k GROUP BY name, series, t
        ), step AS (
          SELECT *, coalesce(grown, 0) + coalesce(CASE WHEN lag(value) OVER w IS NULL THEN NULL WHEN first >= lag(value) OVER w THEN first - lag(value) OVER w ELSE first END, 0) AS increase
          FROM reduced WINDOW w AS (PARTITION BY name, series ORDER BY t)
        ), rates AS (
          SELECT name, series, t, value,
            sum(increase) OVER (PARTITION BY name, series ORDER BY t RANGE BETWEEN 540 PRECEDING AND CURRENT ROW) / 600.0 AS r600,
            sum(increase) OVER (PARTITION BY name, series ORDER BY t RANGE BETWEEN 3540 PRECEDING AND CURRENT ROW) / 3600.0 AS r3600,
            sum(increase) OVER (PARTITION BY name, series ORDER BY t RANGE BETWEEN 7140 PRECEDING AND CURRENT ROW) / 7200.0 AS r7200
          FROM step
        ), judged AS (
          SELECT 'high_value' AS rule, 'critical' AS severity, name, series, t, value AS measure, value > 40 AS holds, 3600 AS hold_s FROM rates WHERE name = 'event_value'
          UNION ALL SELECT 'low_value', 'warning', name, series, t, value, value < 20, 5400 FROM rates WHERE name = 'event_value'
          UNION ALL SELECT 'many_events', 'warning', name, series, t, r3600, r3600 > 0.05, 3600 FROM rates WHERE name = 'events_total'
          UNION ALL SELECT 'few_events', 'warning', name, series, t, r7200, r7200 < 0.01, 7200 FROM rates WHERE name = 'events_total'
          UNION ALL SELECT 'started_anew', 'warning', name, series, t, r600, r600 = 0, 0 FROM rates WHERE name = 'events_total'
        ), marked AS (
          SELECT *, CASE WHEN holds AND NOT coalesce(lag(holds) OVER w AND t - lag(t) OVER w <= 10800, false) THEN 1 ELSE 0 END AS starts
          FROM judged WINDOW w AS (PARTITION BY rule, name, series ORDER BY t)
        ), numbered AS (
          SELECT *, sum(starts) OVER (PARTITION BY rule, name, series ORDER BY t ROWS UNBOUNDED PRECEDING) AS hold FROM marked
        )
        SELECT rule, severity, name, series, make_timestamp(min(t) * 1000000) AS held_from, make_timestamp(max(t) * 1000000) AS held_until,
          max(t) - min(t) AS held_seconds,
          round(CASE WHEN rule IN ('low_value', 'few_events') THEN min(measure) ELSE max(measure) END, 6) AS peak
        FROM numbered WHERE holds GROUP BY rule, severity, name, series, hold, hold_s HAVING max(t) - min(t) >= hold_s""",
    "mon_threshold_for": """
        WITH s AS (
          SELECT 'half=' || (user_id % 2) || ',topic=' || event_type AS series, date_trunc('minute', ts) AS t,
            arg_max(value, ts) AS v FROM events GROUP BY ALL
        ), c AS (
          SELECT *, v > 40 AS above, lag(v > 40) OVER w AS p, t - lag(t) OVER w AS gap FROM s
          WINDOW w AS (PARTITION BY series ORDER BY t)
        ), n AS (
          SELECT *, sum(CASE WHEN above AND NOT coalesce(p AND gap <= INTERVAL 1 HOUR, false) THEN 1 ELSE 0 END)
            OVER (PARTITION BY series ORDER BY t ROWS UNBOUNDED PRECEDING) AS period FROM c
        ), h AS (
          SELECT series, min(t) AS held_from, max(t) AS held_until, count(*) AS steps, max(v) AS peak
          FROM n WHERE above GROUP BY series, period)
        SELECT 'event_value' AS name, series, held_from, held_until, date_diff('second', held_from, held_until) AS held_seconds, steps,
          round(peak, 6) AS peak
        FROM h WHERE date_diff('second', held_from, held_until) >= 300""",
    "mon_rollup_delay": MESSAGES + """, d AS (
          SELECT sensor_name, asset_id, max(date_trunc('hour', event_time)) AS last_bucket
          FROM a WHERE k NOT IN (13, 89) GROUP BY ALL)
        SELECT *, CAST(epoch(TIMESTAMP '2024-01-30' - last_bucket) AS DOUBLE) AS delay_seconds,
          epoch(TIMESTAMP '2024-01-30' - last_bucket) > 7200 AS breach
        FROM d""",
    "mon_last_value": """
        SELECT 'event_value' AS name, 'half=' || (user_id % 2) || ',topic=' || event_type AS series, max(ts) AS last_ts,
          round(arg_max(value, ts), 6) AS last_value
        FROM events WHERE value IS NOT NULL GROUP BY ALL""",
    "mon_stale": MESSAGES + """, l AS (SELECT topic, "partition", max(ts) AS last_message FROM m GROUP BY ALL)
        SELECT *, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_message)) / 1000000.0, 6) AS age_seconds FROM l
        WHERE TIMESTAMP '2024-01-31' - last_message > INTERVAL 300 SECONDS""",
    "mon_ingest_counters": MESSAGES + """
        SELECT topic, count(*) FILTER (k NOT IN (7, 21)) AS messages_consumed,
          count(*) FILTER (k IN (7, 21)) AS messages_failed,
          max(ingest_ts) FILTER (k NOT IN (7, 21)) AS last_message_time
        FROM m GROUP BY ALL""",
    "mon_health": MESSAGES + """, s AS (
          SELECT CAST(user_id AS VARCHAR) AS asset, topic, TIMESTAMP '2024-01-31' - max(ts) > INTERVAL 6 HOURS AS stale,
            count(*) FILTER (k = 7) > 0 AS failing
          FROM m GROUP BY ALL)
        SELECT asset, count(*) AS sensors, count(*) FILTER (stale) AS stale_sensors,
          count(*) FILTER (failing) AS failing_sensors, bool_and(NOT stale AND NOT failing) AS healthy,
          concat_ws(',', CASE WHEN bool_or(failing) THEN 'failing' END, CASE WHEN bool_or(stale) THEN 'stale' END) AS issues
        FROM s GROUP BY ALL""",
    "mon_snapshot": MESSAGES + """, c AS (
          SELECT topic, count(*) FILTER (k NOT IN (7, 21)) AS ok, count(*) FILTER (k IN (7, 21)) AS bad FROM m GROUP BY ALL)
        SELECT TIMESTAMP '2024-01-31' AS ts, 'messages_consumed' AS name, topic, CAST(ok AS DOUBLE) AS value FROM c
        UNION ALL SELECT TIMESTAMP '2024-01-31', 'messages_failed', topic, CAST(bad AS DOUBLE) FROM c""",
}
