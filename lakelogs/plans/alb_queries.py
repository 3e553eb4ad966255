"""Registered queries over the access-log view: filters, metrics, tables, catalogs, dashboard. name -> (callable, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelogs.functions.levels import alb_level, status_class
from lakelogs.operators import alb as A
from lakelogs.operators import catalog as K
from lakelogs.operators import predicates as P
from lakelogs.operators import reports as R
from lakelogs.plans.views import alb_view, oracle

START, END = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)
_T = "time >= TIMESTAMP '2024-01-05 00:00:00' AND time <= TIMESTAMP '2024-01-20 12:00:00'"
QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def add(name: str, fn: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(alb_view(spark, sf_dir))
    ORACLES[name] = oracle(sql)


_b = lambda step: f"(epoch_us(time) // 1000000) // {step} * {step}"
_H = "date_trunc('hour', time) AS hour_start"
_ERR = "count(*) FILTER (elb_status_code >= 400)"
_LAT = "CASE WHEN target_processing_time >= 0 THEN target_processing_time END"
_LEVEL = "CASE WHEN elb_status_code >= 500 THEN 'error' WHEN elb_status_code >= 400 THEN 'warn' WHEN elb_status_code IS NOT NULL THEN 'info' ELSE 'unknown' END"
_CLASS = "CASE WHEN elb_status_code >= 500 THEN '5xx' WHEN elb_status_code >= 400 THEN '4xx' WHEN elb_status_code >= 300 THEN '3xx' WHEN elb_status_code >= 200 THEN '2xx' ELSE 'other' END AS status_class"

# --- filters, renderings ------------------------------------------------------------------------------------

add("c25_alb_where", lambda df: P.alb_where(df, START, END, {"service_name": "app/alb-1", "request_method": "GET", "elb_status_code": "200", "type": ""}).select("trace_id"),
    f"SELECT trace_id FROM alb WHERE {_T} AND elb = 'app/alb-1' AND request_method = 'GET' AND elb_status_code = 200")
add("c26_alb_search", lambda df: P.alb_search(df, "50").select("trace_id"), "SELECT trace_id FROM alb WHERE contains(lower(request_path), '50') OR contains(elb_status_code::VARCHAR, '50') OR contains(client_ip, '50')")
add("b13_alb_logfmt", lambda df: df.select("trace_id", A.alb_logfmt(df).alias("line")),
    "SELECT trace_id, concat_ws(' ', 'method=' || request_method, 'path=' || request_path, 'status=' || elb_status_code, 'latency=' || printf('%.3f', target_processing_time) || 's', 'client=' || client_ip, 'bytes_in=' || received_bytes, 'bytes_out=' || sent_bytes, 'host=' || domain_name, 'error_reason=' || error_reason, 'trace=' || trace_id) AS line FROM alb")
add("b12_alb_streams", lambda df: A.alb_streams(df, 200).select("elb", "request_method", "type", F.size("entries").cast("long").alias("n"), F.col("entries")[0]["ts_ns"].alias("first_ns"), F.element_at("entries", -1)["ts_ns"].alias("last_ns")),
    "SELECT elb, request_method, type, count(*) AS n, min(epoch_us(time) * 1000) AS first_ns, max(epoch_us(time) * 1000) AS last_ns FROM (SELECT * FROM alb ORDER BY time DESC, trace_id DESC LIMIT 200) GROUP BY 1, 2, 3")
add("b14_status_class", lambda df: df.select("trace_id", status_class(F.col("elb_status_code")).alias("status_class")), f"SELECT trace_id, {_CLASS} FROM alb")
add("b15_alb_level", lambda df: df.select("trace_id", alb_level(F.col("elb_status_code")).alias("level")), f"SELECT trace_id, {_LEVEL} AS level FROM alb")
add("a13_enriched", lambda df: R.enriched(df).select("trace_id", "elb_status_code", "status_class"), f"SELECT trace_id, elb_status_code, {_CLASS} FROM alb")

# --- metrics ------------------------------------------------------------------------------------------------

_METRICS = {
    "request_rate": "count(*)::DOUBLE", "error_rate": f"nullif({_ERR}, 0)::DOUBLE", "error_rate_pct": f"round(100.0::DOUBLE * {_ERR} / count(*), 4)",
    "2xx_rate": "nullif(count(*) FILTER (elb_status_code >= 200 AND elb_status_code < 300), 0)::DOUBLE", "3xx_rate": "nullif(count(*) FILTER (elb_status_code >= 300 AND elb_status_code < 400), 0)::DOUBLE",
    "4xx_rate": "nullif(count(*) FILTER (elb_status_code >= 400 AND elb_status_code < 500), 0)::DOUBLE", "5xx_rate": "nullif(count(*) FILTER (elb_status_code >= 500), 0)::DOUBLE",
    "latency_p50": f"round(quantile_cont({_LAT}, 0.5), 6)", "latency_p95": f"round(quantile_cont({_LAT}, 0.95), 6)", "latency_p99": f"round(quantile_cont({_LAT}, 0.99), 6)",
    "bandwidth_in": "sum(received_bytes)::DOUBLE", "bandwidth_out": "sum(sent_bytes)::DOUBLE",
}
_IDS = {"request_rate": "e35_request_rate", "error_rate": "e36_error_rate", "error_rate_pct": "e37_error_rate_pct", "latency_p50": "e39_latency_p50", "latency_p95": "e39_latency_p95", "latency_p99": "e39_latency_p99", "bandwidth_in": "e40_bandwidth_in", "bandwidth_out": "e40_bandwidth_out"}
for _m, _sql in _METRICS.items():
    add(_IDS.get(_m, f"e38_{_m}"), lambda df, m=_m: A.alb_timeseries(df, m, 3_600_000), f"SELECT * FROM (SELECT {_b(3600)} AS bucket, {_sql} AS value FROM alb GROUP BY 1) WHERE value IS NOT NULL")
# Ranks are exact as long as a bucket has fewer rows than the 10,000 of its accuracy.
add("e39_latency_p99_approx", lambda df: A.alb_timeseries(df, "latency_p99", 3_600_000, approx=True), f"SELECT {_b(3600)} AS bucket, round(quantile_disc({_LAT}, 0.99), 6) AS value FROM alb GROUP BY 1 HAVING max({_LAT}) IS NOT NULL")
add("e41_alb_metrics", lambda df: A.alb_metrics(df, interval_ms=7_200_000),
    "SELECT metric, bucket, value FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {_b(7200)} AS bucket, {s} AS value FROM alb GROUP BY 2" for m, s in _METRICS.items()) + ") WHERE value IS NOT NULL")

# --- tables -------------------------------------------------------------------------------------------------

add("e43_top_paths", A.top_paths, f"SELECT request_path AS path, count(*) AS requests, {_ERR} AS errors, round(100.0::DOUBLE * {_ERR} / count(*), 2) AS error_pct FROM alb GROUP BY 1 ORDER BY requests DESC, path LIMIT 20")
add("e44_top_ips", A.top_ips, "SELECT client_ip AS ip, count(*) AS requests FROM alb GROUP BY 1 ORDER BY requests DESC, ip LIMIT 20")
add("e45_status_distribution", A.status_distribution, "SELECT elb_status_code AS status, count(*) AS cnt, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM alb GROUP BY 1")
add("e46_latency_stats", A.latency_stats,
    f"SELECT stat, round(value, 6) AS value FROM (SELECT unnest(['mean', 'p50', 'p75', 'p90', 'p95', 'p99', 'max']) AS stat, unnest([avg(x), quantile_cont(x, 0.5), quantile_cont(x, 0.75), quantile_cont(x, 0.9), quantile_cont(x, 0.95), quantile_cont(x, 0.99), max(x)]) AS value FROM (SELECT {_LAT} AS x FROM alb))")
add("e47_alb_summary", lambda df: A.alb_summary(P.alb_where(df, START, END)),
    f"SELECT count(*) AS total_requests, {_ERR} AS total_errors, round(100.0::DOUBLE * {_ERR} / count(*), 2) AS error_rate_pct, sum(received_bytes)::BIGINT AS total_rx_bytes, sum(sent_bytes)::BIGINT AS total_tx_bytes, round(quantile_cont({_LAT}, 0.5), 6) AS p50_latency, round(quantile_cont({_LAT}, 0.99), 6) AS p99_latency FROM alb WHERE {_T}")

# --- catalogs -----------------------------------------------------------------------------------------------

add("e29_alb_volume", K.alb_volume, "SELECT elb, count(*) AS lines, count(*) * 250 AS bytes FROM alb GROUP BY 1")
add("e30_alb_volume_range", lambda df: K.alb_volume_range(df, 3600), f"SELECT {_b(3600)} AS bucket, elb, count(*) * 250 AS value FROM alb GROUP BY 1, 2")
add("e31_alb_index_stats", K.alb_index_stats, "SELECT count(DISTINCT elb) AS streams, greatest(1, count(*) // 1000)::BIGINT AS chunks, count(*) AS entries, count(*) * 250 AS bytes FROM alb")
add("e32_alb_series", K.alb_series, "SELECT DISTINCT elb, request_method, type, domain_name FROM alb")
add("e33_alb_field_values", lambda df: K.alb_field_values(df, "status"), "SELECT DISTINCT elb_status_code::VARCHAR AS value FROM alb")
add("e34_alb_count_over_time", lambda df: K.alb_count_over_time(df, 3600, "detected_level"), f"SELECT {_b(3600)} AS bucket, {_LEVEL} AS detected_level, count(*) AS value FROM alb GROUP BY 1, 2")
add("e34_alb_count_by_column", lambda df: K.alb_count_over_time(P.alb_search(df, "v1/error"), 7200, "ssl_protocol"), f"SELECT {_b(7200)} AS bucket, coalesce(ssl_protocol, 'unknown') AS ssl_protocol, count(*) AS value FROM alb WHERE contains(request_path, 'v1/error') GROUP BY 1, 2")

# --- dashboard ----------------------------------------------------------------------------------------------

add("e56_dash_error_rate", R.dash_error_rate, f"SELECT 100.0::DOUBLE * {_ERR} / count(*) AS error_rate FROM alb")
add("e57_dash_total", R.dash_total, "SELECT count(time) AS total FROM alb")
add("e58_dash_p99", lambda df: R.dash_p99(df).select(F.round("p99", 9).alias("p99")), "SELECT round(quantile_cont(target_processing_time, 0.99), 9) AS p99 FROM alb")
add("e59_dash_avg_kb", R.dash_avg_kb, "SELECT avg(sent_bytes) / 1024.0::DOUBLE AS avg_kb FROM alb")
add("e60_dash_hourly", R.dash_hourly, f"SELECT {_H}, count(*) AS requests FROM alb GROUP BY 1")
for _c in ("status_class", "request_method", "ssl_protocol", "elb"):
    add("e61_dash_status_class" if _c == "status_class" else f"e63_dash_by_{_c}", lambda df, c=_c: R.dash_by(df, c), f"SELECT {_CLASS if _c == 'status_class' else _c}, count(*) AS requests FROM alb GROUP BY 1")
add("e62_dash_5xx_hourly", R.dash_5xx_hourly, f"SELECT {_H}, 100.0::DOUBLE * count(*) FILTER (elb_status_code >= 500) / count(*) AS pct_5xx FROM alb GROUP BY 1")
add("e64_dash_latency_hourly", lambda df: R.dash_latency_hourly(df).select("hour_start", *[F.round(c, 9).alias(c) for c in ("p50", "p95", "p99")]),
    f"SELECT {_H}, round(quantile_cont(target_processing_time, 0.5), 9) AS p50, round(quantile_cont(target_processing_time, 0.95), 9) AS p95, round(quantile_cont(target_processing_time, 0.99), 9) AS p99 FROM alb GROUP BY 1")
add("e64_dash_latency_hourly_approx", lambda df: R.dash_latency_hourly(df, approx=True), f"SELECT {_H}, quantile_disc(target_processing_time, 0.5) AS p50, quantile_disc(target_processing_time, 0.95) AS p95, quantile_disc(target_processing_time, 0.99) AS p99 FROM alb GROUP BY 1")
add("e65_dash_mb_hourly", R.dash_mb_hourly, f"SELECT {_H}, sum(received_bytes)::DOUBLE / 1048576.0::DOUBLE AS received_mb, sum(sent_bytes)::DOUBLE / 1048576.0::DOUBLE AS sent_mb FROM alb GROUP BY 1")
add("e66_dash_method_hourly", R.dash_method_hourly, f"SELECT {_H}, request_method, count(*) AS requests FROM alb GROUP BY 1, 2")
for _n, _c, _e in (("e67_top_request_paths", "request_path", False), ("e67_top_clients", "client_ip", False), ("e67_top_error_paths", "request_path", True)):
    add(_n, lambda df, c=_c, e=_e: R.dash_top(df, c, errors_only=e), f"SELECT {_c}, count(*) AS requests FROM alb {'WHERE elb_status_code >= 400' if _e else ''} GROUP BY 1 ORDER BY requests DESC, {_c} LIMIT 15")
add("e68_slowest", R.slowest, "SELECT time, elb, client_ip, request_method, request_path, elb_status_code, target_processing_time, trace_id FROM alb ORDER BY target_processing_time DESC NULLS LAST, trace_id LIMIT 50")
add("e69_recent_errors", R.recent_errors, "SELECT time, elb, client_ip, request_method, request_path, elb_status_code, error_reason, trace_id FROM alb WHERE elb_status_code >= 500 ORDER BY time DESC, trace_id LIMIT 100")
