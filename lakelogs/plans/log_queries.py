"""Registered queries over the log view: predicates, metrics, catalogs, reports, windows. name -> (callable, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelogs.functions.times import epoch_micros, epoch_to_ns, epoch_to_ts, with_partitions
from lakelogs.operators import catalog as K
from lakelogs.operators import metrics as M
from lakelogs.operators import predicates as P
from lakelogs.operators import reports as R
from lakelogs.operators import windows as W
from lakelogs.plans.views import events, logs_view, oracle
from lakelogs.sources.tables import query_logs

START, END = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)
_T = "timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 12:00:00'"
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def add(name: str, fn: Callable[[DataFrame], DataFrame], sql: str | None, view: Callable = logs_view) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(view(spark, sf_dir))
    if sql:
        ORACLES[name] = oracle(sql)


def _epochs(df: DataFrame) -> DataFrame:
    """Event times as integers in s, ms, us or ns by event_id."""
    us, scale = epoch_micros(F.col("ts")), F.col("event_id") % 4
    div = lambda k: F.call_function("div", us, F.lit(k))
    return df.select("event_id", F.when(scale == 0, div(1_000_000)).when(scale == 1, div(1000)).when(scale == 2, us).otherwise(us * 1000).alias("n"))


def _ids(name: str, fn: Callable[[DataFrame], DataFrame], where: str) -> None:
    add(name, lambda df: fn(df).select("event_id"), f"SELECT event_id FROM logs WHERE {where}")


# --- predicates ---------------------------------------------------------------------------------------------

_ci = lambda text: f"contains(lower(message), '{text.lower()}')"
_ids("c1_by_stream", lambda df: P.by_stream(df, ["/app/error", "/app/click"], "stream-3"), "log_group_name IN ('/app/error', '/app/click') AND log_stream_name = 'stream-3'")
_ids("c2_in_range", lambda df: P.in_range(df, START, END), _T)
_ids("c4_by_labels", lambda df: P.by_labels(df, {"env": "prod", "service_name": "svc-2", "level": ""}), "label_env = 'prod' AND label_service = 'svc-2'")
_ids("c4_unknown_label", lambda df: P.by_labels(df, {"nowhere": "x"}), "false")
_ids("c5_by_text", lambda df: P.by_text(df, "USER=1"), _ci("user=1"))
_ids("c6_by_levels", lambda df: P.by_levels(df, ["error", "warn"]), " OR ".join(map(_ci, ("error", "exception", "fatal", "warn"))))
_ids("c7_match_equal", lambda df: P.match(df, [("env", "=", "prod")]), "label_env = 'prod'")
_ids("c8_match_regex", lambda df: P.match(df, [("service", "=~", "svc-[1-3]"), ("level", "=~", ".+")]), "regexp_full_match(label_service, 'svc-[1-3]')")
_ids("c9_match_not", lambda df: P.match(df, [("level", "!=", "error"), ("service", "!~", "svc-[1-3]")]), "coalesce(label_level, '') <> 'error' AND NOT regexp_full_match(label_service, 'svc-[1-3]')")
_ids("c10_line_filter", lambda df: P.line_filter(P.line_filter(df, "|=", "Error"), "|~", r"user=\d{2} "), _ci("error") + " AND regexp_matches(message, 'user=[0-9]{2} ')")
add("c10b_label_filter", lambda df: P.label_filter(df, "k", ">=", 50, source="props").select("event_id"), "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50", events)
_ids("c10c_detected_level", lambda df: P.by_levels(df, ["debug", "info"]), f"{_ci('debug')} OR {_ci('info')}")
_ids("c11_like", lambda df: P.insights_where(df, ("like", "@message", "ERROR id=1")), _ci("error id=1"))
_ids("c12_not_like", lambda df: P.insights_where(df, ("not like", "message", "Info")), f"NOT {_ci('info')}")
_ids("c13_regex", lambda df: P.insights_where(df, ("=~", "@message", r"^(ERROR|WARN) id=\d+5 ")), "regexp_matches(message, '^(ERROR|WARN) id=[0-9]+5 ')")
_ids("c14_not_regex", lambda df: P.insights_where(df, ("not like/", "@message", "user=1?5 ")), "NOT regexp_matches(message, 'user=1?5 ')")
_ids("c15_equal_ci", lambda df: P.insights_where(df, ("and", ("=", "level", "ERROR"), ("!=", "@logStream", "STREAM-1"))), "lower(coalesce(label_level, '')) = 'error' AND lower(log_stream_name) <> 'stream-1'")
_ids("c16_compare", lambda df: P.insights_where(df, ("and", (">=", "duration", "20"), ("<", "@logGroup", "/app/p"))), "duration >= 20 AND log_group_name < '/app/p'")
_ids("c17_in", lambda df: P.insights_where(df, ("in", "service", ["svc-1", "svc-4", "SVC-5"])), "label_service IN ('svc-1', 'svc-4', 'SVC-5')")
_ids("c18_and_or_not", lambda df: P.insights_where(df, ("or", ("and", ("like", "message", "error"), ("not", ("=", "env", "prod"))), ("=", "@message", "nothing"))), f"({_ci('error')} AND label_env <> 'prod') OR lower(message) = 'nothing'")
_ids("c19_missing_field", lambda df: P.insights_where(df, ("and", ("=", "@nowhere", ""), ("=", "@level", ""))), "label_level IS NULL")
_ids("c20_pattern_text", lambda df: df.filter(P.filter_pattern(F.col("message"), "Debug")), _ci("debug"))
_ids("c20_pattern_all", lambda df: df.filter(P.filter_pattern(F.col("message"), "ALL")), "true")
_ids("c21_pattern_keys", lambda df: df.filter(P.filter_pattern(F.col("message"), '[k=5, msg != "user=7 "]')), "contains(message, '\"k\"') AND NOT contains(message, 'user=7 ')")
_ids("c22_pattern_regex", lambda df: df.filter(P.filter_pattern(F.col("message"), "message like /err.r ID=2/")), "regexp_matches(message, '(?i)err.r ID=2')")
_ids("c23_pattern_not", lambda df: df.filter(P.filter_pattern(F.col("message"), "!error !user=3")), f"NOT {_ci('error')} AND NOT {_ci('user=3')}")
_ids("c24_stream_prefix", lambda df: P.by_stream_prefix(df, "stream-1"), "starts_with(log_stream_name, 'stream-1')")
_ids("c24b_streams", lambda df: P.by_streams(df, ["stream-2", "stream-9"]), "log_stream_name IN ('stream-2', 'stream-9')")
add("c27_get_events", lambda df: P.get_events(df, "/app/view", None, START, END, 200).select("event_id", "timestamp", "message"),
    f"SELECT event_id, timestamp, message FROM logs WHERE log_group_name = '/app/view' AND {_T} ORDER BY timestamp, sequence_token LIMIT 200")
add("c28_filter_events", lambda df: P.filter_events(df, "/app/error", "stream-1", "!user=4", START, END, 100).select("event_id", "message"),
    f"SELECT event_id, message FROM logs WHERE log_group_name = '/app/error' AND starts_with(log_stream_name, 'stream-1') AND NOT {_ci('user=4')} AND {_T} ORDER BY timestamp, sequence_token LIMIT 100")
add("a3_query_logs", lambda df: query_logs(df.filter("event_id % 3 <> 0"), df.filter("event_id % 3 = 0").drop("label_level"), group="/app/click", start=START, end=END, labels={"env": "staging"}, text="user=", columns=["event_id", "label_level"], limit=300),
    f"SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN label_level END AS label_level FROM logs WHERE log_group_name = '/app/click' AND label_env = 'staging' AND {_T} ORDER BY timestamp, sequence_token LIMIT 300")
add("b1_projection", lambda df: df.select("event_id", "log_stream_name", "label_env"), "SELECT event_id, log_stream_name, label_env FROM logs")

# --- metrics ------------------------------------------------------------------------------------------------

_b = lambda step: f"(epoch_us(timestamp) // 1000000) // {step} * {step}"
_LEVEL = "CASE WHEN " + " OR ".join(map(_ci, ("error", "exception", "fatal"))) + f" THEN 'error' WHEN {_ci('warn')} THEN 'warn' WHEN {_ci('debug')} THEN 'debug' WHEN {_ci('info')} THEN 'info' ELSE 'unknown' END"
_U = "coalesce(label_level, 'unknown') AS level"
_MB = "sum(strlen(message))::BIGINT"


def _series(name: str, fn, value: str, step: int = 3600, by: str = "", where: str = "true") -> None:
    add(name, fn, f"SELECT {_b(step)} AS bucket{', ' + by if by else ''}, {value} AS value FROM logs WHERE {where} GROUP BY ALL")


_series("e1_count_over_time", lambda df: M.count_over_time(df, 3600), "count(*)")
_series("e2_count_by_labels", lambda df: M.count_over_time(df, 7200, ["level", "label_env"]), "count(*)", 7200, f"{_U}, label_env")
_series("e3_count_by_level", lambda df: M.count_over_time(P.in_range(df, START, END), 3600, ["detected_level"]), "count(*)", 3600, f"{_LEVEL} AS detected_level", _T)
_series("e4_two_tiers", lambda df: M.count_over_time(df.filter("event_id % 2 = 0").unionByName(df.filter("event_id % 2 = 1"), allowMissingColumns=True), 1800), "count(*)", 1800)
_series("e5_rate", lambda df: M.rate(df, 600, ["service"]), "count(*) / 600.0::DOUBLE", 600, "label_service AS service")
_series("e6_bytes_over_time", lambda df: M.bytes_over_time(df, 3600), _MB)
_series("e7_bytes_rate", lambda df: M.bytes_rate(df, 3600, ["env"]), f"{_MB} / 3600.0::DOUBLE", 3600, "label_env AS env")
_series("e9_sum_over_time", lambda df: M.sum_over_time(df.withColumn("n", F.col("event_id") % 97), "n", 3600, ["service"]), "sum(event_id % 97)::DOUBLE", 3600, "label_service AS service")
_series("e10_avg_over_time", lambda df: M.avg_over_time(df.withColumn("n", F.col("event_id") % 97), "n", 3600), "avg(event_id % 97)")
_series("e11_min_over_time", lambda df: M.min_over_time(df, "duration", 3600, ["level"]), "min(duration)", 3600, _U)
_series("e11_max_over_time", lambda df: M.max_over_time(df, "duration", 3600, ["level"]), "max(duration)", 3600, _U)
_series("e12_quantile_over_time", lambda df: M.quantile_over_time(df.withColumn("n", F.col("event_id") % 97), 0.9, "n", 7200), "round(quantile_cont((event_id % 97)::DOUBLE, 0.9), 6)", 7200)
QUERIES["e12_quantile_over_time"] = lambda spark, d: M.quantile_over_time(logs_view(spark, d).withColumn("n", F.col("event_id") % 97), 0.9, "n", 7200).withColumn("value", F.round("value", 6))
add("e13_sum_by", lambda df: M.aggregate_series(M.count_over_time(df, 3600, ["env", "service"]), "sum", ["env"]), f"SELECT {_b(3600)} AS bucket, label_env AS env, count(*) AS value FROM logs GROUP BY ALL")
add("e13_max_by", lambda df: M.aggregate_series(M.count_over_time(df, 3600, ["env", "service"]), "max", ["env"]), f"SELECT bucket, env, max(n) AS value FROM (SELECT {_b(3600)} AS bucket, label_env AS env, label_service, count(*) AS n FROM logs GROUP BY ALL) GROUP BY ALL")
add("e14_instant_count", lambda df: M.instant_count(df, datetime(2024, 1, 10), 86400, ["service"]), "SELECT label_service AS service, count(*) AS value FROM logs WHERE timestamp >= TIMESTAMP '2024-01-09 00:00:00' AND timestamp <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY ALL")
add("e15_stats_count", lambda df: M.insights_stats(P.insights_where(df, ("like", "@message", "error")), [("count", None, "cnt")], (1, "h")), f"SELECT epoch_us(timestamp) // 1000 // 3600000 * 3600000 AS bin, count(*) AS cnt FROM logs WHERE {_ci('error')} GROUP BY ALL")
add("e16_stats_fields", lambda df: M.insights_stats(df.withColumn("n", F.col("event_id") % 97), [("avg", "n", "a"), ("sum", "n", "s"), ("min", "duration", "lo"), ("max", "duration", "hi"), ("count", "label_level", "c")], (30, "m"), ["@logStream"]),
    "SELECT epoch_us(timestamp) // 1000 // 1800000 * 1800000 AS bin, log_stream_name AS \"logStream\", avg(event_id % 97) AS a, sum(event_id % 97)::DOUBLE AS s, min(duration) AS lo, max(duration) AS hi, count(label_level) AS c FROM logs GROUP BY ALL")
add("e17_query_stats", lambda df: M.query_stats(df, P.condition(df, ("like", "@message", "error"))), f"SELECT count(*) FILTER ({_ci('error')}) AS records_matched, count(*) AS records_scanned, sum(length(message))::BIGINT AS bytes_scanned FROM logs")
add("b16_insights_fields", lambda df: M.insights_fields(df, [("event_id", "event_id"), (("toupper", "@logStream"), "s"), (("strlen", "@message"), "n"), (("substr", "@message", 0, 4), "head"), (("strcontains", "@message", "props"), "has")]),
    "SELECT event_id, upper(log_stream_name) AS s, length(message)::INT AS n, substr(message, 1, 4) AS head, 1 AS has FROM logs")
add("g2_insights_sort", lambda df: M.insights_sort(df, "@timestamp", "desc", 150).select("event_id", "timestamp"), "SELECT event_id, timestamp FROM logs ORDER BY timestamp DESC, sequence_token DESC LIMIT 150")
add("g5_newest_first", lambda df: P.get_events(df, "/app/error", "stream-5", limit=50, newest_first=True).select("event_id"), "SELECT event_id FROM logs WHERE log_group_name = '/app/error' AND log_stream_name = 'stream-5' ORDER BY timestamp DESC, sequence_token DESC LIMIT 50")

# --- catalogs -----------------------------------------------------------------------------------------------

add("e18_volume", lambda df: K.volume(df, "level"), f"SELECT {_U}, {_MB} AS bytes, count(*) AS lines FROM logs GROUP BY ALL")
_series("e19_volume_range", lambda df: K.volume_range(df, "service", 86400), _MB, 86400, "label_service AS service")
add("e20_index_stats", K.index_stats, f"SELECT count(DISTINCT row(log_group_name, log_stream_name, label_env, label_service)) AS streams, greatest(1, count(*) // 1000)::BIGINT AS chunks, count(*) AS entries, {_MB} AS bytes FROM logs")
add("e21_series", K.series, "SELECT DISTINCT log_group_name, log_stream_name, nullif(label_env, '') AS env, label_service AS service FROM logs")
add("e22_label_names", K.label_names, "SELECT unnest(['env', 'service', 'level']) AS label")
add("e23_label_values", lambda df: K.label_values(df, "env"), "SELECT DISTINCT label_env AS value FROM logs WHERE label_env <> ''")
add("e24_detected_labels", lambda df: K.detected_labels(df, exact=True), "SELECT unnest(['env', 'service', 'level']) AS label, unnest([count(DISTINCT nullif(label_env, '')), count(DISTINCT label_service), count(DISTINCT label_level)]) AS cardinality FROM logs")
_logfmt = lambda: F.expr(
    """concat('level="', lower(split(message, ' ')[0]), '" message="said \\\\"', event_id, '\\\\"" user="', event_id % 16, '"')"""
)
add("e25_detected_fields", lambda df: K.detected_fields(df.withColumn("message", _logfmt()), exact=True),
    "SELECT unnest(['level', 'message', 'user']) AS field, unnest(['string', 'string', 'number']) AS type, unnest([count(DISTINCT split_part(message, ' ', 1)), count(DISTINCT event_id), count(DISTINCT event_id % 16)]) AS cardinality, 'logfmt' AS parser FROM logs")
add("e26_field_values", lambda df: K.field_values(df, "level"), "SELECT DISTINCT CASE " + " ".join(f"WHEN {_ci(w)} THEN '{v}'" for w, v in (("error", "error"), ("warn", "warn"), ("info", "info"), ("debug", "debug"))) + " ELSE 'info' END AS value FROM logs")
add("e27_log_groups", lambda df: K.log_groups(df, "/app/"), f"SELECT log_group_name, min(ingestion_time) AS creation_time, {_MB} AS stored_bytes FROM logs GROUP BY ALL")
add("e28_log_streams", lambda df: K.log_streams(df, "/app/view", order_by="last", descending=True, limit=10),
    f"SELECT log_stream_name, min(ingestion_time) AS creation_time, min(timestamp) AS first_event, max(timestamp) AS last_event, max(ingestion_time) AS last_ingestion, {_MB} AS stored_bytes FROM logs WHERE log_group_name = '/app/view' GROUP BY ALL ORDER BY last_event DESC, log_stream_name LIMIT 10")

# --- reports ------------------------------------------------------------------------------------------------

_OWN = "CASE " + " ".join(f"WHEN {_ci(w)} THEN '{w}'" for w in ("error", "warn", "debug", "info")) + " ELSE 'other' END AS level"
_H = "date_trunc('hour', timestamp) AS hour_start"
add("e48_count_logs", lambda df: R.count_logs(P.in_range(df, START, END)), f"SELECT count(*) AS cnt FROM logs WHERE {_T}")
add("e49_sample_logs", lambda df: R.sample_logs(df, 25).select("event_id", "message"), "SELECT event_id, message FROM logs ORDER BY timestamp DESC, sequence_token DESC LIMIT 25")
add("e50_level_share", R.level_share, f"SELECT {_OWN}, count(*) AS cnt, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS pct FROM logs GROUP BY 1")
add("e51_hourly_levels", R.hourly_levels, f"SELECT {_H}, {_OWN}, count(*) AS cnt FROM logs GROUP BY ALL ORDER BY hour_start DESC, level LIMIT 96")
add("e52_hourly_level_pivot", R.hourly_level_pivot, f"SELECT hour_start, {', '.join(f'''count(*) FILTER (level = '{v}') AS {v}''' for v in R.PIVOT_LEVELS)} FROM (SELECT {_H}, {_OWN} FROM logs) GROUP BY 1")
add("e53_top_streams", R.top_streams, "SELECT log_group_name, log_stream_name, count(*) AS cnt FROM logs GROUP BY ALL ORDER BY cnt DESC, log_group_name, log_stream_name LIMIT 20")
add("e54_hourly_volume", R.hourly_volume, f"SELECT {_H}, count(*) AS cnt FROM logs GROUP BY ALL ORDER BY hour_start DESC LIMIT 24")
add("e55_volume_by", lambda df: R.volume_by(df, "label_service"), "SELECT label_service, count(*) AS cnt FROM logs GROUP BY ALL")

# --- windows ------------------------------------------------------------------------------------------------

add("f1_share", lambda df: W.share(R.volume_by(df, "log_group_name"), "cnt", 3), "SELECT log_group_name, count(*) AS cnt, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 3) AS pct FROM logs GROUP BY 1")
add("f2_cap_per_stream", lambda df: W.cap_per_stream(df, 20).select("event_id"), "SELECT event_id FROM logs QUALIFY row_number() OVER (PARTITION BY log_group_name, log_stream_name ORDER BY sequence_token DESC) <= 20")
add("f3_assign_sequence", lambda df: W.assign_sequence(df.withColumn("batch", F.expr("event_id div 500"))),
    "SELECT log_group_name, log_stream_name, event_id // 500 AS batch, count(*) AS events, (1 + sum(count(*)) OVER (PARTITION BY log_group_name, log_stream_name ORDER BY event_id // 500))::BIGINT AS sequence_token FROM logs GROUP BY 1, 2, 3")
add("h1_union_promotes", lambda df: df.filter("event_id % 2 = 0").select("event_id", F.expr("cast(event_id as int)").alias("n")).unionByName(df.filter("event_id % 2 = 1").select("event_id", F.col("duration").alias("x"), F.col("event_id").alias("n")), allowMissingColumns=True),
    "SELECT event_id, event_id AS n, CASE WHEN event_id % 2 = 1 THEN duration END AS x FROM logs")
add("h2_merge_dedup", lambda df: W.merge_dedup(df.filter("event_id % 10 < 7"), df.filter("event_id % 10 > 3"), 500).select("event_id", "timestamp"), "SELECT event_id, timestamp FROM logs ORDER BY timestamp, sequence_token LIMIT 500")
add("h3_distinct", lambda df: df.select("log_group_name", "log_stream_name").distinct(), "SELECT DISTINCT log_group_name, log_stream_name FROM logs")
add("b10_event_view", lambda df: W.event_view(df, ["label_env", "label_level"]),
    "SELECT epoch_us(timestamp) // 1000 AS timestamp, message, epoch_us(ingestion_time) // 1000 AS ingestion_time, log_group_name, log_stream_name, label_env, coalesce(label_level, '') AS label_level FROM logs")
add("b11_stream_entries", lambda df: W.to_stream_entries(df).select("ts_ns", "line", F.col("labels")["service_name"].alias("service"), F.col("labels")["env"].alias("env"), F.array_join(F.array_sort(F.map_keys("labels")), ",").alias("keys")),
    "SELECT epoch_us(timestamp) * 1000 AS ts_ns, message AS line, label_service AS service, nullif(label_env, '') AS env, CASE WHEN label_env <> '' THEN 'env,' ELSE '' END || CASE WHEN label_level IS NOT NULL THEN 'level,' ELSE '' END || 'message,service,service_name' AS keys FROM logs")
add("b3_epoch_to_ts", lambda df: _epochs(df).select("event_id", epoch_to_ts(F.col("n")).alias("t")), """SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) ELSE ts END AS t FROM events""", events)
add("b4_epoch_to_ns", lambda df: _epochs(df).select("event_id", epoch_to_ns(F.col("n")).alias("ns")), """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000000 WHEN 1 THEN epoch_us(ts) // 1000 * 1000000 ELSE epoch_us(ts) * 1000 END AS ns FROM events""", events)
add("b6_partitions", lambda df: with_partitions(df).select("event_id", "date", "hour"), "SELECT event_id, strftime(timestamp, '%Y-%m-%d') AS date, strftime(timestamp, '%H') AS hour FROM logs")

