"""Log and access-log tables derived from the events table, the same text in Spark and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakelogs.session import configured

_WORD = "CASE event_type WHEN 'error' THEN '{}' WHEN 'signup' THEN '{}' WHEN 'view' THEN '{}' WHEN 'click' THEN '{}' ELSE '{}' END"
_UPPER, _LOWER = _WORD.format("ERROR", "WARN", "DEBUG", "INFO", "NOTE"), _WORD.format("error", "warn", "debug", "info", "note")
_PATH = "'/v1/' || event_type || '/' || (user_id % 20)"
_STATUS = "CASE event_type WHEN 'error' THEN 500 + event_id % 5 WHEN 'signup' THEN 400 + event_id % 5 WHEN 'view' THEN 301 ELSE 200 END"
_TYPE = "CASE event_id % 3 WHEN 0 THEN 'https' WHEN 1 THEN 'h2' ELSE 'http' END"

LOGS = {
    "log_group_name": "'/app/' || event_type",
    "log_stream_name": "'stream-' || (user_id % 16)",
    "timestamp": "ts",
    "message": f"{_UPPER} || ' id=' || event_id || ' user=' || user_id || ' props=' || props",
    "ingestion_time": "ts",
    "sequence_token": "event_id",
    "label_env": "CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE '' END",
    "label_service": "'svc-' || (user_id % 7)",
    "label_level": f"CASE WHEN event_id % 11 = 0 THEN NULL ELSE {_LOWER} END",
    "duration": "value",
    "event_id": "event_id",
}
ALB = {
    "time": "ts", "type": _TYPE, "elb": "'app/alb-' || (user_id % 3)", "client_ip": "'10.0.' || (user_id % 4) || '.' || (user_id % 250)", "client_port": "CAST(1024 + event_id % 60000 AS INT)",
    "target_ip": "CASE WHEN event_id % 50 = 0 THEN NULL ELSE '10.1.0.' || (event_id % 9) END", "target_port": "CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(80 AS INT) END",
    "target_processing_time": "CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(event_id * 37 % 1000 AS DOUBLE) / 1000 END", "elb_status_code": f"CAST({_STATUS} AS INT)",
    "received_bytes": "100 + user_id * 7", "sent_bytes": "500 + event_id % 1000", "request_method": "CASE event_id % 4 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' ELSE 'GET' END",
    "request_url": f"'https://api.example.com' || {_PATH} || '?q=' || event_id", "request_path": _PATH, "request_protocol": "'HTTP/1.1'",
    "user_agent": "CAST(NULL AS VARCHAR(9))", "ssl_protocol": f"CASE WHEN {_TYPE} = 'http' THEN NULL ELSE 'TLSv1.2' END", "domain_name": "'api.example.com'",
    "error_reason": "CASE WHEN event_type = 'error' THEN 'ConnectionError' ELSE NULL END", "trace_id": "'Root=1-' || event_id",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configured(spark).read.parquet(f"{sf_dir}/events.parquet")


def _view(spark: SparkSession, sf_dir: str, columns: dict[str, str], parts: int | None) -> DataFrame:
    """``parts``: the events are dealt out over so many tasks first, as a file may be one row group, which one task reads."""
    rows = events(spark, sf_dir)
    return (rows.repartition(parts, "event_id") if parts else rows).selectExpr(*[f"{e} AS `{n}`" for n, e in columns.items()])


def logs_view(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return _view(spark, sf_dir, LOGS, parts)


def alb_view(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return _view(spark, sf_dir, ALB, parts)


def oracle(sql: str) -> str:
    """SQL over ``logs`` and ``alb``."""
    view = lambda columns: "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in columns.items()) + " FROM events"
    return f"WITH logs AS ({view(LOGS)}), alb AS ({view(ALB)}) {sql}"
