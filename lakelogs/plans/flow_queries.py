"""Registered queries of parsing, ingest, storage and streaming: text is rendered from the event views, taken in again, and
compared with the typed rows it came from. name -> (callable, oracle SQL)."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelogs.functions import insights as I
from lakelogs.functions import levels as L
from lakelogs.functions import parsing as X
from lakelogs.functions.times import epoch_micros, epoch_millis
from lakelogs.operators import alb as A
from lakelogs.operators import metrics as M
from lakelogs.operators import predicates as P
from lakelogs.plans.views import alb_view, events, logs_view, oracle
from lakelogs.schema import ALB_SCHEMA, LOG_SCHEMA
from lakelogs.operators import catalog as K
from lakelogs.sources import ingest as G
from lakelogs.sources import rollups as R
from lakelogs.sources import tables as S
from lakelogs.sources.paths import files, folders, remove, scratch
from lakelogs.streaming import flush as J
from lakelogs.streaming import objects as O
from lakelogs.streaming import sequence as Q

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
_LABELS = ("env", "service", "level")
#: Events of a table for each file of an arrival.
EVENTS_A_FILE = 1_000_000


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = oracle(sql)


# --- the month in a day and six hours -------------------------------------------------------------------------

_DAY0 = 1_704_067_200_000_000
_TABLES = "".join(
    f", {name} AS (SELECT * REPLACE (make_timestamp((epoch_us({ts}) - {_DAY0}) // 24 + {_DAY0}) AS {ts}{', make_timestamp((epoch_us(timestamp) - %d) // 24 + %d) AS ingestion_time' % (_DAY0, _DAY0) if ts == 'timestamp' else ''}) FROM {view}) "
    for name, view, ts in (("tlogs", "logs", "timestamp"), ("talb", "alb", "time"))
)


def _squeezed(df: DataFrame, *times: str) -> DataFrame:
    """All rows with their times drawn together 24-fold, so that partitions are hundreds of rows and not a dozen."""
    squeeze = lambda c: F.timestamp_micros(F.call_function("div", epoch_micros(F.col(c)) - _DAY0, F.lit(24)) + _DAY0).cast("timestamp_ntz")
    return df.withColumns({c: squeeze(c) for c in times})


def table_logs(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return _squeezed(logs_view(spark, sf_dir, parts), "timestamp", "ingestion_time")


def table_alb(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    return _squeezed(alb_view(spark, sf_dir, parts), "time")


def add_table(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    add(name, fn, _TABLES + re.sub(r"\b(FROM|JOIN) (logs|alb)\b", r"\1 t\2", sql))


# --- rendered text ------------------------------------------------------------------------------------------


def alb_text(alb: DataFrame) -> DataFrame:
    """Access-log lines of typed requests, with lines among them that are no requests."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    latency = F.coalesce(F.col("target_processing_time").cast("string"), F.lit("-1"))
    target = F.when(F.col("target_ip").isNull(), "-").otherwise(F.concat_ws(":", "target_ip", "target_port"))
    agent = F.concat(F.lit('agent \\"x\\" '), F.col("trace_id"))
    line = F.concat_ws(
        " ", "type", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "elb", F.concat_ws(":", "client_ip", "client_port"), target, F.lit("0.001"), latency, F.lit("0.000"),
        dash("elb_status_code"), F.lit("-"), dash("received_bytes"), dash("sent_bytes"), quoted(F.concat_ws(" ", "request_method", "request_url", "request_protocol")), quoted(agent),
        F.lit("-"), dash("ssl_protocol"), F.lit("arn:x"), quoted(F.col("trace_id")), quoted(F.col("domain_name")), F.lit('"-"'), F.lit("0"), F.lit("2024-01-01T00:00:00Z"), F.lit('"forward"'), F.lit('"-"'), quoted(dash("error_reason")),
    )
    n = F.regexp_extract("trace_id", r"(\d+)$", 1).cast("long")
    junk = F.when(n % 97 == 0, "# comment").when(n % 97 == 1, "").when(n % 97 == 2, "too short").when(n % 97 == 3, F.concat(line, F.lit(' "open')))
    return alb.select(F.explode(F.array_compact(F.array(line, junk))).alias("value"))


_ALB_SQL = """SELECT time, type, elb, client_ip, client_port, target_ip, target_port, target_processing_time, elb_status_code, received_bytes, sent_bytes, request_method, request_url,
  request_path, request_protocol, 'agent "x" ' || trace_id AS user_agent, ssl_protocol, domain_name, error_reason, trace_id, 'forward' AS actions_executed FROM alb"""
_ALB_COLUMNS = ("time", "type", "elb", "client_ip", "client_port", "target_ip", "target_port", "target_processing_time", "elb_status_code", "received_bytes", "sent_bytes", "request_method", "request_url", "request_path", "request_protocol", "user_agent", "ssl_protocol", "domain_name", "error_reason", "trace_id", "actions_executed")


def _alb_files(spark: SparkSession, sf_dir: str, view: Callable = alb_view, files: int | None = None) -> str:
    """Gzip files of access logs, four for each lot of events; each is rendered by the task that writes it."""
    path = scratch(spark, "alb-text")
    alb_text(view(spark, sf_dir, files or 4 * _lots(spark, sf_dir))).write.option("compression", "gzip").text(path)
    return path


def _raw(logs: DataFrame) -> DataFrame:
    """Landed events of the log view, epochs in four scales by event."""
    us, scale = epoch_micros(F.col("timestamp")), F.col("event_id") % 2
    return logs.select(
        F.col("log_group_name").alias("logGroupName"), F.col("log_stream_name").alias("logStreamName"), F.when(scale == 0, us).otherwise(us * 1000).alias("timestamp"), "message",
        us.alias("ingestionTime"), F.col("sequence_token").alias("sequenceToken"), "label_env", "label_service", "label_level", F.when(F.col("event_id") % 3 == 0, "second").alias("table"),
    )


def _landing(spark: SparkSession, sf_dir: str, view: Callable = logs_view, files: int = 3) -> str:
    path = scratch(spark, "landing")
    _raw(view(spark, sf_dir)).repartition(files).write.json(path)
    return path


def _arrive(rows: DataFrame, source: str, lots: int) -> None:
    """One arrival of landed events, in so many files."""
    (rows.repartition(lots) if lots > 1 else rows.coalesce(1)).write.mode("append").json(source)


def _lots(s: SparkSession, d: str) -> int:
    """Files of an arrival, so that their number grows with the table."""
    return 1 + events(s, d).count() // EVENTS_A_FILE


_LOG_COLUMNS = ("log_group_name", "log_stream_name", "timestamp", "message", "ingestion_time", "sequence_token", "label_env", "label_service", "label_level")
_ROWS = "log_group_name, log_stream_name, timestamp, message, ingestion_time, sequence_token, label_env, label_service, coalesce(label_level, '') AS label_level"
_LOG_SQL = f"SELECT {_ROWS} FROM logs"
_PARTED = f"SELECT {_ROWS}, strftime(timestamp, '%Y-%m-%d') AS date, strftime(timestamp, '%H') AS hour FROM logs"


def _table(spark: SparkSession, sf_dir: str, batches: int = 2) -> str:
    """The log view as a table of several batches."""
    path, logs = scratch(spark, "table"), table_logs(spark, sf_dir).drop("duration", "event_id")
    for k in range(batches):
        S.append_table(logs.filter(F.col("sequence_token") % batches == k).withColumn("label_level", F.coalesce("label_level", F.lit(""))), path, batch=f"b{k}")
    return path


# --- parsing ------------------------------------------------------------------------------------------------

# The view is one small file, which one task reads: its lines are dealt out before they are parsed, as ``read_alb_text`` does.
add("i11_alb_parse", lambda s, d: S.parse_alb(alb_text(alb_view(s, d)).repartition(s.sparkContext.defaultParallelism)).select(*_ALB_COLUMNS), _ALB_SQL)
add("a4_read_alb_text", lambda s, d: S.read_alb_text(s, _alb_files(s, d)).select(*_ALB_COLUMNS), _ALB_SQL)


def _endpoints(s: SparkSession, d: str) -> DataFrame:
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 250).cast("string"), F.lit(".1"))
    v6 = F.concat(F.lit("[2001:db8::"), F.lower(F.hex("user_id")), F.lit("]"))
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(ip, F.lit(":443"))).when(k == 1, F.concat(v6, F.lit(":80"))).when(k == 2, "-").otherwise(F.concat(ip, F.lit(":x")))
    host, port = X.endpoint(text)
    return events(s, d).select("event_id", host.alias("ip"), port.alias("port"))


add("i1_endpoint", _endpoints, """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.' || user_id % 250 || '.1' WHEN 1 THEN '2001:db8::' || lower(printf('%x', user_id)) WHEN 2 THEN NULL ELSE '10.0.' || user_id % 250 || '.1' END AS ip,
  CASE event_id % 4 WHEN 0 THEN 443 WHEN 1 THEN 80 END::INT AS port FROM events""")


def _numbers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    text = F.when(k == 0, "-").when(k == 1, "").when(k == 2, "x1").when(k == 3, "-1").otherwise(F.col("event_id").cast("string"))
    return events(s, d).select("event_id", X.whole(text, "bigint").alias("n"), X.seconds(text).alias("x"), X.or_null(text).alias("t"))


add("i2_numbers", _numbers, "SELECT event_id, CASE event_id % 5 WHEN 3 THEN -1 WHEN 4 THEN event_id END AS n, CASE event_id % 5 WHEN 4 THEN event_id END::DOUBLE AS x, CASE event_id % 5 WHEN 2 THEN 'x1' WHEN 3 THEN '-1' WHEN 4 THEN event_id::VARCHAR END AS t FROM events")
add("i3_iso_time", lambda s, d: events(s, d).select("event_id", X.iso_time(F.when(F.col("event_id") % 7 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).alias("t")), "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS t FROM events")


def _requests(s: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("client_port") % 9 == 0, "-").otherwise(F.concat_ws(" ", "request_method", "request_url", "request_protocol"))
    method, url, protocol, path = X.request_parts(text)
    return alb_view(s, d).select("trace_id", method.alias("method"), url.alias("url"), protocol.alias("protocol"), path.alias("path"))


add("i4_request_parts", _requests, "SELECT trace_id, " + ", ".join(f"CASE WHEN client_port % 9 <> 0 THEN request_{c} END AS {c}" for c in ("method", "url", "protocol", "path")) + " FROM alb")
add("i5_url_path", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", X.url_path(F.col("url")).alias("path")),
    "SELECT page_id, CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*[?#]?$') THEN url ELSE coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), url) END AS path FROM pages")


def _logfmt(s: SparkSession, d: str) -> DataFrame:
    line = F.expr(r"""concat('level="old" level="', event_type, '" message="id ', event_id, ' said \\"hi\\"\\n" pod="p', user_id, '" time="', event_id, '"')""")
    plain = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('only="one" '), F.col("event_type"))).otherwise(line)
    labels = X.logfmt_labels(plain)
    return events(s, d).select("event_id", X.logfmt_message(plain).alias("message"), labels["level"].alias("level"), labels["pod"].alias("pod"), F.array_join(F.array_sort(F.map_keys(labels)), ",").alias("keys"))


add("i7_logfmt", _logfmt, """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'only="one" ' || event_type ELSE 'id ' || event_id || ' said "hi"' || chr(10) END AS message,
  CASE WHEN event_id % 5 <> 0 THEN event_type END AS level, CASE WHEN event_id % 5 <> 0 THEN 'p' || user_id END AS pod, CASE WHEN event_id % 5 <> 0 THEN 'level,pod' END AS keys FROM events""")


def _bodies(s: SparkSession, d: str) -> DataFrame:
    k8s = F.struct(F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("pod_name"), F.struct(F.col("event_type").alias("tier-x"), F.lit("mine").alias("env")).alias("labels"))
    body = F.to_json(F.struct(F.concat(F.lit("app-"), (F.col("user_id") % 5).cast("string")).alias("app"), F.lit("prod").alias("env"), F.lit("raw").alias("pod"), k8s.alias("kubernetes")))
    text = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("{"), body)).otherwise(body)
    found = events(s, d).select("event_id", text.alias("body")).select("event_id", X.json_labels(F.col("body")).alias("found"))
    return found.select("event_id", *[F.col("found")[c].alias(c) for c in ("app", "env", "pod", "tier_x")])


add("i8_json_labels", _bodies, "SELECT event_id, " + ", ".join(f"CASE WHEN event_id % 13 <> 0 THEN {v} END AS {c}" for c, v in (("app", "'app-' || user_id % 5"), ("env", "'mine'"), ("pod", "'pod-' || user_id"), ("tier_x", "event_type"))) + " FROM events")


def _brackets(s: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("]  "), F.upper("event_type"), F.lit(" id "), F.col("event_id").cast("string"))
    part = X.bracketed(F.when(F.col("event_id") % 6 == 0, F.upper("event_type")).otherwise(line))
    return events(s, d).select("event_id", *[c.alias(n) for n, c in part.items()])


add("i9_bracketed", _brackets, "SELECT event_id, " + ", ".join(f"CASE WHEN event_id % 6 <> 0 THEN {v} END AS {c}" for c, v in (("time", "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"), ("level", "upper(event_type)"), ("message", "'id ' || event_id"))) + " FROM events")
add("i10_collector", lambda s, d: logs_view(s, d).select("event_id", L.collector_level(F.col("message")).alias("level"), L.collector_app(F.concat("message", F.when(F.col("event_id") % 3 == 0, " Worker job ID").when(F.col("event_id") % 3 == 1, " cache hit").otherwise(""))).alias("app")),
    "SELECT event_id, CASE WHEN contains(message, 'ERROR') THEN 'error' WHEN contains(message, 'WARN') THEN 'warn' WHEN contains(message, 'DEBUG') THEN 'debug' ELSE 'info' END AS level, CASE event_id % 3 WHEN 0 THEN 'worker' WHEN 1 THEN 'cache' ELSE 'api-server' END AS app FROM logs")
add("i12_detected_level", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", L.detected_level(F.coalesce("text", F.lit(""))).alias("level")),
    "SELECT conv_id, turn, CASE WHEN contains(lower(coalesce(text, '')), 'error') OR contains(lower(coalesce(text, '')), 'exception') OR contains(lower(coalesce(text, '')), 'fatal') THEN 'error' WHEN contains(lower(coalesce(text, '')), 'warn') THEN 'warn' WHEN contains(lower(coalesce(text, '')), 'debug') THEN 'debug' WHEN contains(lower(coalesce(text, '')), 'info') THEN 'info' ELSE 'unknown' END AS level FROM conversations")

# --- insights functions -------------------------------------------------------------------------------------

_call = lambda fn, col, *args: I.FUNCTIONS[fn](F.col(col) if isinstance(col, str) else col, *args)
add("i13_math", lambda s, d: events(s, d).select("event_id", _call("abs", -F.col("value")).alias("a"), _call("ceil", "value").alias("c"), _call("floor", "value").alias("f"), F.round(_call("log", F.col("value") + 1), 9).alias("l"), _call("sqrt", F.col("event_id") * F.col("event_id")).alias("q")),
    "SELECT event_id, abs(value) AS a, ceil(value)::BIGINT AS c, floor(value)::BIGINT AS f, round(ln(value + 1), 9) AS l, event_id::DOUBLE AS q FROM events")
add("i14_strings", lambda s, d: logs_view(s, d).select("event_id", _call("strlen", "message").alias("n"), _call("toupper", "label_service").alias("u"), _call("tolower", "message").alias("lo"), _call("substr", "message", 2, 5).alias("sub"), _call("replace", "message", "id=", "#").alias("r"), _call("concat", "label_env", "/", "x").alias("c"), _call("trim", F.concat(F.lit("  "), "label_service", F.lit(" "))).alias("t"), _call("ltrim", F.concat(F.lit("  "), "label_service", F.lit(" "))).alias("lt"), _call("rtrim", F.concat(F.lit("  "), "label_service", F.lit(" "))).alias("rt")),
    "SELECT event_id, length(message)::INT AS n, upper(label_service) AS u, lower(message) AS lo, substr(message, 3, 5) AS sub, replace(message, 'id=', '#') AS r, label_env || '/x' AS c, label_service AS t, label_service || ' ' AS lt, '  ' || label_service AS rt FROM logs")
add("i15_strcontains", lambda s, d: logs_view(s, d).select("event_id", _call("strcontains", "message", "user=1").alias("has")), "SELECT event_id, contains(message, 'user=1')::INT AS has FROM logs")
add("i16_presence", lambda s, d: logs_view(s, d).select("event_id", _call("ispresent", "label_level").alias("p"), _call("isempty", "label_env").alias("e"), _call("isblank", F.concat(F.lit(" "), "label_env")).alias("b"), _call("coalesce", "label_level", "none").alias("c")),
    "SELECT event_id, label_level IS NOT NULL AS p, label_env = '' AS e, label_env = '' AS b, coalesce(label_level, 'none') AS c FROM logs")
add("i17_millis", lambda s, d: events(s, d).select("event_id", _call("toMillis", "ts").alias("ms"), _call("fromMillis", epoch_millis(F.col("ts"))).alias("t"), (_call("now", "ts") > F.col("ts")).alias("past")), "SELECT event_id, epoch_us(ts) // 1000 AS ms, date_trunc('millisecond', ts) AS t, true AS past FROM events")
add("i18_bin", lambda s, d: events(s, d).select("event_id", _call("bin", "ts", 5, "m").alias("m5"), _call("bin", "ts", 2, "d").alias("d2"), _call("bin", "ts", 250, "ms").alias("ms250")),
    "SELECT event_id, epoch_us(ts) // 1000 // 300000 * 300000 AS m5, epoch_us(ts) // 1000 // 172800000 * 172800000 AS d2, epoch_us(ts) // 1000 // 250 * 250 AS ms250 FROM events")
add("i19_json_parse", lambda s, d: events(s, d).select("event_id", F.try_variant_get(_call("jsonParse", F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props"))), "$.k", "bigint").alias("k")), "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events")


def _addresses(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    v4 = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 300).cast("string"), F.lit("0"), (F.col("event_id") % 256).cast("string"))
    groups = [F.lower(F.hex(c)) for c in (F.col("event_id") % 4, F.shiftright("user_id", 16).bitwiseAND(0xFFFF), F.col("user_id").bitwiseAND(0xFFFF))]  # four digits at most
    v6 = F.concat(F.lit("2001:db8:"), groups[0], F.lit("::"), groups[1], F.lit(":"), groups[2])
    a = F.when(k < 2, v4).when(k == 2, v6).when(k == 3, F.concat(v6, F.lit(":"))).otherwise(F.lit(None).cast("string"))
    return events(s, d).select("event_id", *[_call(fn, a, *args).alias(n) for n, fn, *args in (("v4", "isValidIpV4"), ("v6", "isValidIpV6"), ("ip", "isValidIp"), ("in4", "isIpInSubnet", "10.64.0.0/10"), ("in6", "isIpv6InSubnet", "2001:db8:2::/48"))])


_V4, _V6 = "(event_id % 5 < 2 AND user_id % 300 < 256)", "(event_id % 5 = 2)"
add("i20_addresses", _addresses, f"SELECT event_id, {_V4} AS v4, {_V6} AS v6, {_V4} OR {_V6} AS ip, {_V4} AND user_id % 300 BETWEEN 64 AND 127 AS in4, {_V6} AND event_id % 4 = 2 AS in6 FROM events")

# --- ingest -------------------------------------------------------------------------------------------------

add("b2_to_log_rows", lambda s, d: G.to_log_rows(_raw(logs_view(s, d)), _LABELS), _LOG_SQL)
add("a2_read_landing", lambda s, d: S.read_landing(s, _landing(s, d)).select(*_LOG_COLUMNS, "date", "hour"), _PARTED)


def _payloads(s: SparkSession, d: str) -> DataFrame:
    """Payloads of each group, of up to 1,000 events in a row, as [ns, line] values under one label set each."""
    logs = logs_view(s, d)
    labels = F.create_map(F.lit("log-group"), F.col("log_group_name"), F.lit("log_stream"), F.col("log_stream_name"), F.lit("env"), F.col("label_env"), F.lit("service"), F.col("label_service"))
    entry = F.array((epoch_micros(F.col("timestamp")) * 1000).cast("string"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('level="x" msg="'), F.col("event_id").cast("string"), F.lit('"'))).otherwise(F.col("message")))
    streams = logs.groupBy(F.expr("event_id div 1000").alias("batch"), "log_group_name", "log_stream_name", "label_env", "label_service").agg(F.collect_list(entry).alias("values"))
    streams = streams.select("batch", "log_group_name", F.struct(labels.alias("stream"), "values").alias("s"))
    return streams.groupBy("batch", "log_group_name").agg(F.to_json(F.struct(F.collect_list("s").alias("streams"))).alias("payload")).drop("batch")


def _push(s: SparkSession, d: str) -> DataFrame:
    return G.ingest_push(_payloads(s, d), ("env", "service", "app", "level")).select("log_group_name", "log_stream_name", "timestamp", "message", "ingestion_time", "label_env", "label_service", "label_app", "label_level")


add("a7_ingest_push", _push, "SELECT log_group_name, log_stream_name, timestamp, CASE WHEN event_id % 4 = 0 THEN event_id::VARCHAR ELSE message END AS message, timestamp AS ingestion_time, label_env, label_service, label_service AS label_app, CASE WHEN event_id % 4 = 0 THEN 'x' ELSE '' END AS label_level FROM logs")


def _collector(s: SparkSession, d: str) -> DataFrame:
    k8s = F.struct(F.concat(F.lit("p"), (F.col("user_id") % 9).cast("string")).alias("pod_name"), F.lit(None).cast("string").alias("container_name"), F.lit("ns").alias("namespace"), F.create_map(F.lit("app"), F.col("event_type")).alias("labels"))
    records = events(s, d).select(F.when(F.col("event_id") % 10 > 0, F.concat(F.lit("log "), F.col("event_id").cast("string"))).alias("log"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("message"), F.when(F.col("event_id") % 2 == 0, "warn").alias("level"), k8s.alias("kubernetes"), "ts")
    return G.ingest_collector(records, F.col("ts"), ("pod", "container", "namespace", "app", "level")).drop("ingestion_time", "sequence_token")


add("a8_ingest_collector", _collector, "SELECT 'ns' AS log_group_name, 'p' || user_id % 9 AS log_stream_name, ts AS timestamp, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'log ' || event_id END AS message, 'p' || user_id % 9 AS label_pod, 'unknown' AS label_container, 'ns' AS label_namespace, event_type AS label_app, CASE WHEN event_id % 2 = 0 THEN 'warn' ELSE 'info' END AS label_level FROM events WHERE event_id % 10 > 0")


def _messages(s: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("event_type").alias("app"), F.lit("dev").alias("env")))
    payloads = events(s, d).select(F.lit("g").alias("logGroupName"), F.lit(None).cast("string").alias("logStreamName"), epoch_millis(F.col("ts")).alias("timestamp"), F.array(body, F.concat(F.lit("plain "), F.col("event_id").cast("string"))).alias("messages"))
    return G.ingest_messages(payloads, {"env": "prod"}, ("env", "app")).drop("ingestion_time", "sequence_token")


add("a9_ingest_messages", _messages, """SELECT 'g' AS log_group_name, 'default' AS log_stream_name, date_trunc('millisecond', ts) AS timestamp, unnest(['{"app":"' || event_type || '","env":"dev"}', 'plain ' || event_id]) AS message, 'prod' AS label_env, unnest([event_type, '']) AS label_app FROM events""")


def _batch(s: SparkSession, d: str) -> DataFrame:
    records = events(s, d).select(F.lit("g").alias("logGroupName"), F.col("event_type").alias("logStreamName"), epoch_millis(F.col("ts")).alias("timestamp"), F.col("props").alias("message"), F.when(F.col("event_id") % 2 == 0, "a").alias("label_env"), F.when(F.col("event_id") % 3 == 0, "b").alias("label-env"), "ts")
    return G.ingest_batch(records, {"env": "h", "app": "web"}, F.col("ts"), ("env", "app")).drop("sequence_token")


add("a10_ingest_batch", _batch, "SELECT 'g' AS log_group_name, event_type AS log_stream_name, date_trunc('millisecond', ts) AS timestamp, props AS message, ts AS ingestion_time, CASE WHEN event_id % 2 = 0 THEN 'a' WHEN event_id % 3 = 0 THEN 'b' ELSE 'h' END AS label_env, 'web' AS label_app FROM events")


def _put_events(s: SparkSession, d: str) -> DataFrame:
    entry = F.struct(epoch_millis(F.col("timestamp")).alias("timestamp"), "message")
    payloads = logs_view(s, d).groupBy(F.expr("event_id div 1000").alias("batch"), F.col("log_group_name").alias("logGroupName"), F.col("log_stream_name").alias("logStreamName")).agg(F.collect_list(entry).alias("logEvents"))
    return G.ingest_events(payloads, labels=()).drop("ingestion_time")


add("a11_ingest_events", _put_events, "SELECT l.log_group_name, l.log_stream_name, date_trunc('millisecond', timestamp) AS timestamp, message, t.token AS sequence_token FROM logs l JOIN (SELECT log_group_name, log_stream_name, event_id // 1000 AS batch, (1 + sum(count(*)) OVER (PARTITION BY log_group_name, log_stream_name ORDER BY event_id // 1000))::BIGINT AS token FROM logs GROUP BY 1, 2, 3) t ON l.log_group_name = t.log_group_name AND l.log_stream_name = t.log_stream_name AND l.event_id // 1000 = t.batch")


def _notifications(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    record = lambda source, key: F.struct(F.lit(source).alias("eventSource"), F.struct(F.struct(F.lit("bkt").alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object")).alias("s3"))
    key = F.concat(F.lit("k/"), F.col("event_id").cast("string"))
    body = F.to_json(F.struct(F.array(record("aws:s3", key), record("aws:sqs", key)).alias("Records")))
    text = F.when(k == 0, F.to_json(F.struct(body.alias("Message")))).when(k == 1, F.to_json(F.struct(F.array(record("aws:s3", F.lit(""))).alias("Records")))).when(k == 2, "no json").otherwise(body)
    return G.object_paths(events(s, d).select(text.alias("body")))


add("a5_object_paths", _notifications, "SELECT CASE WHEN event_id % 5 IN (0, 3, 4) THEN 's3://bkt/k/' || event_id END AS path, CASE event_id % 5 WHEN 1 THEN 'missing bucket or key' WHEN 2 THEN 'body is not JSON' END AS error FROM events")
add("b7_sanitise", lambda s, d: events(s, d).select("event_id", F.array_join(F.map_keys(G.sanitise_labels(F.create_map(F.lit("a-b"), "event_type", F.lit("c.d e"), "event_type"))), ",").alias("keys")), "SELECT event_id, 'a_b,c_d_e' AS keys FROM events")
add("b8_aliases", lambda s, d: G.apply_label_aliases(logs_view(s, d).select("event_id", F.lit("default").alias("log_group_name"), F.col("label_env").alias("label_namespace"), F.lit("").alias("label_app"), "label_service", F.lit("s").alias("log_stream_name"))), "SELECT event_id, CASE WHEN label_env <> '' THEN label_env ELSE 'default' END AS log_group_name, label_env AS label_namespace, label_service AS label_app, label_service, 's' AS log_stream_name FROM logs")

# --- tables -------------------------------------------------------------------------------------------------

add_table("a1_read_logs", lambda s, d: P.in_range(S.read_logs(s, _table(s, d, 1)), datetime(2024, 1, 1, 5), datetime(2024, 1, 1, 20)).select(*_LOG_COLUMNS, "date", "hour"), f"{_PARTED} WHERE timestamp >= TIMESTAMP '2024-01-01 05:00:00' AND timestamp <= TIMESTAMP '2024-01-01 20:00:00'")
add_table("a6_append_table", lambda s, d: S.read_logs(s, _table(s, d, 2)).select(*_LOG_COLUMNS, "date", "hour"), _PARTED)


def _two_tiers(s: SparkSession, d: str) -> DataFrame:
    table, landing = scratch(s, "table"), scratch(s, "landing")
    logs = table_logs(s, d)
    S.append_table(logs.filter("event_id % 4 <> 0").drop("duration", "event_id"), table)
    _raw(logs.filter("event_id % 4 = 0")).write.json(landing)
    rows = S.query_logs(S.read_logs(s, table), S.read_landing(s, landing), group="/app/view", start=datetime(2024, 1, 1, 5), end=datetime(2024, 1, 1, 9), limit=400)
    return rows.select("timestamp", "message", "sequence_token")


add_table("a3_two_tiers", _two_tiers, "SELECT timestamp, message, sequence_token FROM logs WHERE log_group_name = '/app/view' AND timestamp >= TIMESTAMP '2024-01-01 05:00:00' AND timestamp <= TIMESTAMP '2024-01-01 09:00:00' ORDER BY timestamp, sequence_token LIMIT 400")


def _routed(s: SparkSession, d: str) -> DataFrame:
    tables = {"main": scratch(s, "main"), "second": scratch(s, "second")}
    rows = table_logs(s, d).drop("duration", "event_id").withColumn("table", F.when(F.col("sequence_token") % 3 == 0, "second").when(F.col("sequence_token") % 3 == 1, "lost"))
    S.route_and_append(rows, tables, "main")
    return S.read_logs(s, tables["main"]).withColumn("t", F.lit("main")).union(S.read_logs(s, tables["second"]).withColumn("t", F.lit("second"))).groupBy("t").agg(F.count("*").alias("n"), F.sum("sequence_token").alias("tokens"))


add_table("a12_route", _routed, "SELECT CASE WHEN event_id % 3 = 0 THEN 'second' ELSE 'main' END AS t, count(*) AS n, sum(event_id)::BIGINT AS tokens FROM logs GROUP BY 1")
add_table("a13_sql_views", lambda s, d: _views(s, d), "SELECT CASE WHEN elb_status_code >= 500 THEN '5xx' WHEN elb_status_code >= 400 THEN '4xx' WHEN elb_status_code >= 300 THEN '3xx' ELSE '2xx' END AS status_class, count(*) AS n FROM alb GROUP BY 1")
add_table("a14_table_stats", lambda s, d: S.table_stats(S.read_logs(s, _table(s, d, 2)), ["date"]).select("date", "files", "rows"), "SELECT strftime(timestamp, '%Y-%m-%d') AS date, count(DISTINCT row(strftime(timestamp, '%H'), event_id % 2)) AS files, count(*) AS rows FROM logs GROUP BY 1")


def _views(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "alb")
    S.append_table(table_alb(s, d), path, "time")
    S.register_alb_views(s, path, "lakelogs_alb")
    return s.sql("SELECT status_class, count(*) AS n FROM lakelogs_alb_enriched GROUP BY status_class")


def _compacted(s: SparkSession, d: str) -> DataFrame:
    path = _table(s, d, 2)
    S.compact(s, path, min_files=2)
    table = S.read_logs(s, path)
    stats = S.table_stats(table, ["date", "hour"])
    return table.groupBy("date", "hour").agg(F.count("*").alias("n"), F.sum("sequence_token").alias("tokens")).join(stats.select("date", "hour", "files"), ["date", "hour"])


add_table("k1_compact", _compacted, "SELECT strftime(timestamp, '%Y-%m-%d') AS date, strftime(timestamp, '%H') AS hour, count(*) AS n, sum(event_id)::BIGINT AS tokens, 1 AS files FROM logs GROUP BY 1, 2")


def _compacted_alb(s: SparkSession, d: str) -> DataFrame:
    path, rows = scratch(s, "alb"), table_alb(s, d)
    S.append_table(rows.filter("time < timestamp_ntz'2024-01-01 12:00:00'"), path, "time", "b0")
    S.append_table(rows.filter("time >= timestamp_ntz'2024-01-01 12:00:00' OR sent_bytes % 2 = 0"), path, "time", "b1")
    S.compact(s, path, 2, ALB_SCHEMA, "time")
    return S.read_alb(s, path).groupBy("date").agg(F.count("*").alias("n"), F.sum("sent_bytes").alias("b"))


def _killed(s: SparkSession, d: str) -> DataFrame:
    """A compaction that dies once it is committed, part of its old folders gone; a late replay; and the job that comes next."""
    path, logs = scratch(s, "killed"), table_logs(s, d).drop("duration", "event_id")
    parts = [logs.filter(F.col("sequence_token") % 2 == k) for k in range(2)]
    for epoch in range(2):
        S.write_epoch(parts[epoch], epoch, path)
    hours = [(day, hour, folders(s, f"{path}/{day}/{hour}")) for day in folders(s, path) if day.startswith("date=") for hour in folders(s, f"{path}/{day}")]
    S.commit_rewrite(s, path, LOG_SCHEMA, hours, "timestamp")
    remove(s, f"{path}/{hours[0][0]}/{hours[0][1]}/{hours[0][2][0]}")
    S.write_epoch(parts[0], 0, path)
    S.compact(s, path)
    S.write_epoch(parts[1], 1, path)
    return S.read_logs(s, path).select("sequence_token", "timestamp", "date", "hour")


add_table("k1_killed_swap", _killed, "SELECT event_id AS sequence_token, timestamp, strftime(timestamp, '%Y-%m-%d') AS date, strftime(timestamp, '%H') AS hour FROM logs")


def _compacted_in_slices(s: SparkSession, d: str) -> DataFrame:
    """Busy hours become several files, each with a time range of its own."""
    path = _table(s, d, 2)
    S.compact(s, path, file_bytes=8_000)
    rows = S.read_logs(s, path).select("sequence_token", "timestamp", "date", "hour", F.col("_metadata.file_path").alias("file"))
    each = rows.groupBy("date", "hour", "file").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"), F.count("*").alias("n"), F.sum("sequence_token").alias("tokens"))
    prior = F.max("b").over(Window.partitionBy("date", "hour").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    apart = each.withColumn("apart", F.coalesce(F.col("a") > prior, F.lit(True)))
    return apart.groupBy("date", "hour").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.min("apart").alias("apart"))


add_table("k1_compact_busy_hours", _compacted_in_slices, "SELECT strftime(timestamp, '%Y-%m-%d') AS date, strftime(timestamp, '%H') AS hour, count(*) AS n, sum(event_id)::BIGINT AS tokens, true AS apart FROM logs GROUP BY 1, 2")


def _compacted_burst(s: SparkSession, d: str) -> DataFrame:
    """Nine tenths of each hour's rows come in one of its minutes; its files still have no more than twice their mean of rows."""
    path = scratch(s, "burst")
    micros = epoch_micros(F.col("timestamp"))
    into_minute = F.timestamp_micros(micros - F.pmod(micros, F.lit(3_600_000_000)) + F.call_function("div", F.pmod(micros, F.lit(3_600_000_000)), F.lit(60))).cast("timestamp_ntz")
    burst = table_logs(s, d).drop("duration", "event_id").withColumn("timestamp", F.when(F.col("sequence_token") % 10 > 0, into_minute).otherwise(F.col("timestamp")))
    for k in range(2):
        S.append_table(burst.filter(F.col("sequence_token") % 2 == k), path, batch=f"b{k}")
    S.compact(s, path, file_bytes=2_000)
    each = S.read_logs(s, path).groupBy("date", "hour", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.sum("sequence_token").alias("tokens"))
    return each.groupBy("date", "hour").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), (F.max("n") <= 2 * F.avg("n")).alias("even"), (F.count("*") > 1).alias("cut"))


add_table("k1_compact_burst", _compacted_burst, "SELECT strftime(timestamp, '%Y-%m-%d') AS date, strftime(timestamp, '%H') AS hour, count(*) AS n, sum(event_id)::BIGINT AS tokens, true AS even, true AS cut FROM logs GROUP BY 1, 2")
add_table("k2_compact_alb", _compacted_alb, "SELECT strftime(time, '%Y-%m-%d') AS date, count(*) AS n, sum(sent_bytes)::BIGINT AS b FROM (SELECT * FROM alb UNION ALL SELECT * FROM alb WHERE time < TIMESTAMP '2024-01-01 12:00:00' AND sent_bytes % 2 = 0) GROUP BY 1")


def _retained(s: SparkSession, d: str) -> DataFrame:
    path = _table(s, d, 1)
    S.enforce_retention(s, path, 7, date(2024, 1, 9))
    return S.read_logs(s, path).groupBy("date").agg(F.count("*").alias("n"))


add_table("k3_retention", _retained, "SELECT strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS n FROM logs WHERE timestamp >= TIMESTAMP '2024-01-02' GROUP BY 1")


def _repartitioned(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "by-ingestion")
    S.append_table(table_logs(s, d).drop("duration", "event_id").withColumn("ingestion_time", F.expr("timestamp + INTERVAL 1 DAY")), path, "ingestion_time")
    S.repartition_table(s, S.read_logs(s, path), path)
    return S.read_logs(s, path).groupBy("date", "hour").agg(F.count("*").alias("n"))


add_table("k4_repartition", _repartitioned, "SELECT strftime(timestamp, '%Y-%m-%d') AS date, strftime(timestamp, '%H') AS hour, count(*) AS n FROM logs GROUP BY 1, 2")


def _repartitioned_meanwhile(s: SparkSession, d: str) -> DataFrame:
    """A table by ingestion day is written anew while a stream adds a batch; the swap dies halfway, the next job ends it, and all batches
    are replayed."""
    path, logs = scratch(s, "moved"), table_logs(s, d).drop("duration", "event_id").withColumn("ingestion_time", F.expr("timestamp + INTERVAL 1 DAY"))
    parts = [logs.filter(F.col("sequence_token") % 3 == k) for k in range(3)]
    for epoch in range(2):
        S.write_epoch(parts[epoch], epoch, path, "ingestion_time")
    source = S.read_logs(s, path)
    S.write_epoch(parts[2], 2, path)
    S.commit_repartition(s, source, path)
    for hour in folders(s, f"{path}/date=2024-01-02")[:2]:
        remove(s, f"{path}/date=2024-01-02/{hour}/batch={S.stream_batch(0)}")
    S.compact(s, path, min_files=2)
    for epoch in range(3):
        S.write_epoch(parts[epoch], epoch, path)
    return S.read_logs(s, path).select("sequence_token", "timestamp", "ingestion_time", "date", "hour")


add_table("k4_during_writes", _repartitioned_meanwhile, "SELECT event_id AS sequence_token, timestamp, timestamp + INTERVAL 1 DAY AS ingestion_time, strftime(timestamp, '%Y-%m-%d') AS date, strftime(timestamp, '%H') AS hour FROM logs")


def _evolved(s: SparkSession, d: str) -> DataFrame:
    path, logs = scratch(s, "evolving"), table_logs(s, d).drop("duration", "event_id")
    S.append_table(logs.filter("sequence_token % 2 = 0").drop("label_level"), path)
    S.append_table(logs.filter("sequence_token % 2 = 1"), path)
    return S.read_logs(s, path).select("sequence_token", "label_level", "label_host")


add_table("k5_schema_merge", _evolved, "SELECT event_id AS sequence_token, CASE WHEN event_id % 2 = 1 THEN label_level END AS label_level, NULL::VARCHAR AS label_host FROM logs")


def _deleted(s: SparkSession, d: str) -> DataFrame:
    path = _table(s, d, 1)
    S.delete_logs(s, path, "/app/error")
    S.delete_logs(s, path, "/app/view", "stream-3")
    return S.read_logs(s, path).select("sequence_token")


add_table("k6_delete_logs", _deleted, "SELECT event_id AS sequence_token FROM logs WHERE log_group_name <> '/app/error' AND NOT (log_group_name = '/app/view' AND log_stream_name = 'stream-3')")


def _deleted_untimed(s: SparkSession, d: str) -> DataFrame:
    """Rows without a time are deleted as well, and counted."""
    path = scratch(s, "untimed")
    S.append_table(table_logs(s, d).drop("duration", "event_id").withColumn("timestamp", F.when(F.col("sequence_token") % 5 > 0, F.col("timestamp"))), path)
    n = S.delete_logs(s, path, "/app/error")
    return S.read_logs(s, path).groupBy("log_group_name").agg(F.count("*").alias("n"), F.count_if(F.col("date").isNull()).alias("untimed")).withColumn("deleted", F.lit(n).cast("long"))


add_table("k6_delete_untimed", _deleted_untimed, "SELECT log_group_name, count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS untimed, (SELECT count(*) FROM logs WHERE log_group_name = '/app/error') AS deleted FROM logs WHERE log_group_name <> '/app/error' GROUP BY 1")

# --- streams ------------------------------------------------------------------------------------------------


def _streamed(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "streamed")
    J.stream_landing(s, _landing(s, d, table_logs), path, scratch(s, "ckpt"), every=None, max_files=2).awaitTermination()
    return S.read_logs(s, path).select(*_LOG_COLUMNS, "date", "hour")


add_table("j1_stream_landing", _streamed, _PARTED)


def _replayed(s: SparkSession, d: str) -> DataFrame:
    """A batch that is written twice, and a late replay after compaction."""
    path, logs = scratch(s, "replayed"), table_logs(s, d).drop("duration", "event_id")
    parts = [logs.filter(F.col("sequence_token") % 2 == k) for k in range(2)]
    for epoch in (0, 1, 1):
        S.write_epoch(parts[epoch], epoch, path)
    S.compact(s, path)
    S.write_epoch(parts[1], 1, path)
    return S.read_logs(s, path).groupBy("date").agg(F.count("*").alias("n"), F.sum("sequence_token").alias("tokens"))


add_table("j3_replay", _replayed, "SELECT strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS n, sum(event_id)::BIGINT AS tokens FROM logs GROUP BY 1")


def _partly_committed(s: SparkSession, d: str) -> DataFrame:
    """A batch whose writer dies between its hours, a compaction and a deletion meanwhile, and the replay."""
    path, logs = scratch(s, "partly"), table_logs(s, d).drop("duration", "event_id")
    parts = [logs.filter(F.col("sequence_token") % 2 == k) for k in range(2)]
    S.write_epoch(parts[0], 0, path)
    S.append_table(parts[1].filter("hour(timestamp) < 12"), path, batch=S.stream_batch(1))
    S.append_table(logs.filter("sequence_token % 5 = 0"), path, batch="b0")
    S.compact(s, path)
    S.delete_logs(s, path, "/app/error")
    for epoch in range(2):
        S.write_epoch(parts[epoch], epoch, path)
    S.compact(s, path)
    S.write_epoch(parts[1], 1, path)
    return S.read_logs(s, path).groupBy("date", "hour").agg(F.count("*").alias("n"), F.sum("sequence_token").alias("tokens"))


_TWICE = "SELECT * FROM logs WHERE event_id % 2 = 1 OR log_group_name <> '/app/error' UNION ALL SELECT * FROM logs WHERE event_id % 5 = 0 AND log_group_name <> '/app/error'"
add_table("j3_partial_commit", _partly_committed, f"SELECT strftime(timestamp, '%Y-%m-%d') AS date, strftime(timestamp, '%H') AS hour, count(*) AS n, sum(event_id)::BIGINT AS tokens FROM ({_TWICE}) GROUP BY 1, 2")


def _two_streams(s: SparkSession, d: str) -> DataFrame:
    """Two streams into one table, at the same epochs and hours."""
    path, raw = scratch(s, "shared"), _raw(table_logs(s, d))
    for k in range(2):
        source = scratch(s, "landing")
        raw.filter(F.col("sequenceToken") % 2 == k).repartition(2).write.json(source)
        J.stream_landing(s, source, path, scratch(s, "ckpt"), every=None, max_files=1).awaitTermination()
    return S.read_logs(s, path).select(*_LOG_COLUMNS, "date", "hour")


add_table("j3_two_streams", _two_streams, _PARTED)


def _new_checkpoint(s: SparkSession, d: str) -> DataFrame:
    """After a compaction a stream starts with a new checkpoint, on other files."""
    path, raw = scratch(s, "anew"), _raw(table_logs(s, d))
    for k in range(2):
        source = scratch(s, "landing")
        raw.filter(F.col("sequenceToken") % 2 == k).repartition(3).write.json(source)
        J.stream_landing(s, source, path, scratch(s, "ckpt"), every=None, max_files=1 if k == 0 else None).awaitTermination()
        S.compact(s, path)
    return S.read_logs(s, path).select(*_LOG_COLUMNS, "date", "hour")


add_table("j3_new_checkpoint", _new_checkpoint, _PARTED)


def _flushed_by_size(s: SparkSession, d: str) -> DataFrame:
    """Six landed files, two a flush."""
    source, path, raw = scratch(s, "landing"), scratch(s, "flushed"), _raw(table_logs(s, d))
    for k in range(6):
        J.land(raw.filter(F.col("sequenceToken") % 6 == k).coalesce(1), source, most=1_000_000_000)
    J.stream_landing(s, source, path, scratch(s, "ckpt"), every=None, max_files=2).awaitTermination()
    rows = s.read.parquet(path).select(F.split("batch", "-")[1].cast("long").alias("flush"), "sequence_token")
    return rows.groupBy("flush").agg(F.count("*").alias("n"), F.sum("sequence_token").alias("tokens"))


add_table("j2_flush_by_size", _flushed_by_size, "SELECT event_id % 6 // 2 AS flush, count(*) AS n, sum(event_id)::BIGINT AS tokens FROM logs GROUP BY 1")


def _refused(s: SparkSession, d: str) -> DataFrame:
    """Of three arrivals the last is refused, as the landing folder holds as many rows as it may; the others are flushed, in byte-bounded batches."""
    source, path, raw = scratch(s, "landing"), scratch(s, "held"), _raw(table_logs(s, d))
    parts = [raw.filter(F.col("sequenceToken") % 3 == k) for k in range(3)]
    most, refused = parts[0].count() + parts[1].count(), 0
    for part in parts:
        try:
            J.land(part, source, most)
        except J.TooManyWaiting:
            refused += 1
    J.stream_landing(s, source, path, scratch(s, "ckpt"), every=None, max_bytes=100_000).awaitTermination()
    return S.read_logs(s, path).groupBy("date").agg(F.count("*").alias("n"), F.sum("sequence_token").alias("tokens")).withColumn("refused", F.lit(refused).cast("long"))


add_table("j4_back_pressure", _refused, "SELECT strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS n, sum(event_id)::BIGINT AS tokens, 1::BIGINT AS refused FROM logs WHERE event_id % 3 < 2 GROUP BY 1")


def _reopened(s: SparkSession, d: str) -> DataFrame:
    """Land, flush, land again: the folder takes rows once those before are flushed, though their files stay; one arrival too many is refused."""
    source, path, ckpt, raw = scratch(s, "landing"), scratch(s, "reopened"), scratch(s, "ckpt"), _raw(table_logs(s, d))
    parts = [raw.filter(F.col("sequenceToken") % 3 == k) for k in range(3)]
    most, refused = max(p.count() for p in parts), 0
    for part in parts:
        J.land(part, source, most)
        try:
            J.land(parts[0], source, most)
        except J.TooManyWaiting:
            refused += 1
        J.stream_landing(s, source, path, ckpt, every=None, max_files=2).awaitTermination()
    return S.read_logs(s, path).groupBy("date").agg(F.count("*").alias("n"), F.sum("sequence_token").alias("tokens")).withColumns({"refused": F.lit(refused).cast("long"), "waiting": F.lit(J.waiting_rows(s, source)).cast("long")})


add_table("j4_reopens", _reopened, "SELECT strftime(timestamp, '%Y-%m-%d') AS date, count(*) AS n, sum(event_id)::BIGINT AS tokens, 3::BIGINT AS refused, 0::BIGINT AS waiting FROM logs GROUP BY 1")


def _resent(s: SparkSession, d: str) -> DataFrame:
    """A producer that sends events twice: within a file, in the next file, and after a restart of the stream."""
    source, path, ckpt, raw = scratch(s, "landing"), scratch(s, "resent"), scratch(s, "ckpt"), _raw(table_logs(s, d))
    third, lots = lambda k: raw.filter(F.col("sequenceToken") % 3 == k), _lots(s, d)
    for rows in (third(0).union(third(0)), third(1).union(third(0)), third(2).union(third(1)).union(third(0))):
        _arrive(rows, source, lots)
        J.stream_landing(s, source, path, ckpt, every=None, max_files=lots, resent="1 hour").awaitTermination()
    return S.read_logs(s, path).select(*_LOG_COLUMNS, "date", "hour")


add_table("h2_stream_dedup", _resent, _PARTED)


def _restarted(s: SparkSession, d: str) -> DataFrame:
    """Files that arrive after a stop are taken up from the checkpoint."""
    source, path, ckpt, raw = scratch(s, "landing"), scratch(s, "restarted"), scratch(s, "ckpt"), _raw(table_logs(s, d))
    for k in range(2):
        raw.filter(F.col("sequenceToken") % 2 == k).write.mode("append").json(source)
        J.stream_landing(s, source, path, ckpt, every=None).awaitTermination()
    return S.read_logs(s, path).select("sequence_token", "timestamp")


add_table("j5_restart", _restarted, "SELECT event_id AS sequence_token, timestamp FROM logs")


def _streamed_alb(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "streamed-alb")
    J.stream_alb(s, _alb_files(s, d, table_alb), path, scratch(s, "ckpt"), every=None, max_files=2 * _lots(s, d)).awaitTermination()
    return S.read_alb(s, path).select(*_ALB_COLUMNS)


add_table("j6_stream_alb", _streamed_alb, _ALB_SQL)


def _streamed_routes(s: SparkSession, d: str) -> DataFrame:
    tables = {"main": scratch(s, "main"), "second": scratch(s, "second")}
    J.stream_routed(s, _landing(s, d, table_logs), tables, "main", scratch(s, "ckpt"), every=None, max_files=2).awaitTermination()
    return S.read_logs(s, tables["main"]).withColumn("t", F.lit("main")).union(S.read_logs(s, tables["second"]).withColumn("t", F.lit("second"))).groupBy("t").agg(F.count("*").alias("n"), F.sum("sequence_token").alias("tokens"))


add_table("j7_stream_routed", _streamed_routes, "SELECT CASE WHEN event_id % 3 = 0 THEN 'second' ELSE 'main' END AS t, count(*) AS n, sum(event_id)::BIGINT AS tokens FROM logs GROUP BY 1")


def _standing(s: SparkSession, d: str) -> DataFrame:
    """Counts of a stream; a last event far ahead lets the watermark close every bucket before it."""
    source, out = scratch(s, "logs-stream"), scratch(s, "counts")
    logs = table_logs(s, d).select("timestamp", "message", "label_level")
    logs.union(logs.limit(1).withColumn("timestamp", F.lit(datetime(2030, 1, 1)).cast("timestamp_ntz"))).repartitionByRange(4, "timestamp").write.parquet(source)
    counts = J.stream_counts(s.readStream.schema(logs.schema).parquet(source), 3600, ["detected_level"])
    counts.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch(s, "ckpt")).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(counts.schema).parquet(out).filter("bucket < 1893456000")


_ci = lambda text: f"contains(lower(message), '{text}')"
add_table("j8_stream_counts", _standing, f"SELECT epoch_us(timestamp) // 1000000 // 3600 * 3600 AS bucket, CASE WHEN {_ci('error')} OR {_ci('exception')} OR {_ci('fatal')} THEN 'error' WHEN {_ci('warn')} THEN 'warn' WHEN {_ci('debug')} THEN 'debug' WHEN {_ci('info')} THEN 'info' ELSE 'unknown' END AS detected_level, count(*) AS value FROM logs GROUP BY 1, 2")


def _standing_series(s: SparkSession, d: str) -> DataFrame:
    """The largest stream's rows per bucket and level, from standing counts by stream and level; a last event far ahead closes every bucket."""
    source, out = scratch(s, "logs-stream"), scratch(s, "series")
    logs = table_logs(s, d).select("timestamp", "message", F.col("log_stream_name").alias("label_stream"))
    logs.repartitionByRange(2, "timestamp").write.parquet(source)
    logs.limit(1).withColumn("timestamp", F.lit(datetime(2030, 1, 1)).cast("timestamp_ntz")).write.mode("append").parquet(source)
    stream = s.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    series = J.stream_series(stream, 3600, ["stream", "detected_level"], "max", ["detected_level"], "2 days")
    series.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", scratch(s, "ckpt")).trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(series.schema).parquet(out).filter("bucket < 1893456000")


_level = f"CASE WHEN {_ci('error')} OR {_ci('exception')} OR {_ci('fatal')} THEN 'error' WHEN {_ci('warn')} THEN 'warn' WHEN {_ci('debug')} THEN 'debug' WHEN {_ci('info')} THEN 'info' ELSE 'unknown' END"
add_table("j8_stream_series", _standing_series, f"SELECT bucket, detected_level, max(value) AS value FROM (SELECT epoch_us(timestamp) // 1000000 // 3600 * 3600 AS bucket, {_level} AS detected_level, log_stream_name, count(*) AS value FROM logs GROUP BY ALL) GROUP BY ALL")


def _once(build: Callable[[SparkSession, str], str]) -> Callable[[SparkSession, str], str]:
    """Several queries read one table: it is built once in a session."""
    built: dict[tuple[str, str], str] = {}

    def path(s: SparkSession, d: str) -> str:
        key = (s.sparkContext.applicationId, d)
        if key not in built:
            built[key] = build(s, d)
        return built[key]

    return path


@_once
def _numbered(s: SparkSession, d: str) -> str:
    """A table of numbered events: two micro-batches, a stop, and a third one."""
    source, path, ckpt, raw, lots = scratch(s, "landing"), scratch(s, "numbered"), scratch(s, "ckpt"), _raw(table_logs(s, d)), _lots(s, d)
    for some in ((0, 1), (2,)):
        for k in some:
            _arrive(raw.filter(F.col("sequenceToken") % 3 == k), source, lots)
        Q.stream_numbered(s, source, path, ckpt, every=None, max_files=lots).awaitTermination()
    return path


_NUMBERS = "SELECT *, row_number() OVER (PARTITION BY log_group_name, log_stream_name ORDER BY event_id % 3, timestamp, message) AS number FROM logs"
add_table("f3_standing_tokens", lambda s, d: Q.stream_tokens(S.read_logs(s, _numbered(s, d))), "SELECT log_group_name, log_stream_name, count(*) AS events, count(*) + 1 AS sequence_token FROM logs GROUP BY ALL")
add_table("f3_standing_numbers", lambda s, d: S.read_logs(s, _numbered(s, d)).select("log_group_name", "log_stream_name", "message", "timestamp", F.col("sequence_token").alias("number")), f"SELECT log_group_name, log_stream_name, message, timestamp, number FROM ({_NUMBERS})")
add_table("f2_standing_cap", lambda s, d: Q.latest_per_stream(S.read_logs(s, _numbered(s, d)), 5).select("log_group_name", "log_stream_name", "message", F.col("sequence_token").alias("number")), f"SELECT log_group_name, log_stream_name, message, number FROM ({_NUMBERS}) QUALIFY row_number() OVER (PARTITION BY log_group_name, log_stream_name ORDER BY number DESC) <= 5")


def _notified(s: SparkSession, d: str) -> DataFrame:
    """Access-log files that messages name: one of four at first, named twice; then all of them, one that isn't there yet and a message that is no
    JSON; then that one again, and the first message once more."""
    objects, source, path, ckpt = _alb_files(s, d, table_alb, 4), scratch(s, "messages"), scratch(s, "notified"), scratch(s, "ckpt")
    names = [n for n in files(s, objects) if n.startswith("part-")]
    message = lambda name: '{"Records": [{"eventSource": "aws:s3", "s3": {"bucket": {"name": "b"}, "object": {"key": "%s"}}}]}' % name
    located = F.concat(F.lit(f"{objects}/"), F.substring_index("path", "/", -1))
    rounds = [[message(names[0])] * 2, [message(n) for n in [*names[:-1], "late.gz"]] + ["no json"], [message(names[-1]), message(names[0])]]
    for k, texts in enumerate(rounds):
        s.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").text(source)
        O.stream_objects(s, source, path, ckpt, every=None, max_files=1, located=located).awaitTermination()
    status = O.read_ledger(s, path).agg(F.count_if(F.col("status") == "read").alias("read"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("path").isNull()).alias("errors")).first()
    rows = S.read_alb(s, path).groupBy("date", "hour").agg(F.count("*").alias("n"), F.sum("sent_bytes").alias("b"))
    return rows.withColumns({c: F.lit(status[c]).cast("long") for c in ("read", "missing", "errors")})


add_table("j6_notified_objects", _notified, "SELECT strftime(time, '%Y-%m-%d') AS date, strftime(time, '%H') AS hour, count(*) AS n, sum(sent_bytes)::BIGINT AS b, 4::BIGINT AS read, 1::BIGINT AS missing, 1::BIGINT AS errors FROM alb GROUP BY 1, 2")

# --- partial aggregates beside a table ------------------------------------------------------------------------


_STREAMS, _LABELS_KIND = R.streams_kind(), R.labels_kind()


@_once
def _with_partials(s: SparkSession, d: str) -> str:
    """A table that has seen a deletion, a replay, a compaction whose partials were folded, and a replaced batch; its last batch has no partials."""
    kinds = (_STREAMS, _LABELS_KIND)
    path, logs = scratch(s, "kept"), table_logs(s, d, s.sparkContext.defaultParallelism).drop("duration", "event_id")
    parts = [logs.filter(F.col("sequence_token") % 3 == k) for k in range(3)]
    S.write_epoch(parts[0], 0, path)
    R.refresh(s, path, kinds)
    S.delete_logs(s, path, "/app/error")
    S.write_epoch(parts[1], 1, path)
    R.refresh(s, path, kinds)
    S.write_epoch(parts[1], 1, path)
    R.compact_partials(s, path, kinds)
    for rows in (parts[2], logs.filter("sequence_token % 5 = 0")):
        S.append_table(rows, path, batch="x")
        R.refresh(s, path, kinds)
    S.write_epoch(parts[2], 2, path)
    return path


_HELD = "(SELECT * FROM logs WHERE NOT (event_id % 3 = 0 AND log_group_name = '/app/error') UNION ALL SELECT * FROM logs WHERE event_id % 5 = 0)"
_FROM, _UNTIL = datetime(2024, 1, 1, 5, 30, 10), datetime(2024, 1, 1, 19, 45)
_WITHIN = "timestamp >= TIMESTAMP '2024-01-01 05:30:10' AND timestamp <= TIMESTAMP '2024-01-01 19:45:00'"
_BYTES = "sum(octet_length(encode(message)))::BIGINT"


def _from_partials(result: Callable, kind: R.Kind, *span: datetime) -> Callable:
    return lambda s, d: result(R.merged(s, _with_partials(s, d), kind, *span), kind)


add_table("e27_partials", _from_partials(R.log_groups, _STREAMS), f"SELECT log_group_name, min(timestamp) AS creation_time, {_BYTES} AS stored_bytes FROM {_HELD} GROUP BY 1")
add_table("e28_partials", _from_partials(lambda p, k: R.log_streams(p, k, "/app/view"), _STREAMS, _FROM, _UNTIL), f"SELECT log_stream_name, min(timestamp) AS creation_time, min(timestamp) AS first_event, max(timestamp) AS last_event, max(timestamp) AS last_ingestion, {_BYTES} AS stored_bytes FROM {_HELD} WHERE log_group_name = '/app/view' AND {_WITHIN} GROUP BY 1")
add_table("e18_partials", _from_partials(lambda p, k: R.volume(p, k, "level"), _STREAMS, _FROM, _UNTIL), f"SELECT coalesce(label_level, 'unknown') AS level, {_BYTES} AS bytes, count(*) AS lines FROM {_HELD} WHERE {_WITHIN} GROUP BY 1")
add_table("e19_partials", _from_partials(lambda p, k: R.volume_range(p, k, "service", 7200), _STREAMS), f"SELECT epoch_us(timestamp) // 1000000 // 7200 * 7200 AS bucket, label_service AS service, {_BYTES} AS value FROM {_HELD} GROUP BY 1, 2")


def _sketched_streams(s: SparkSession, d: str) -> DataFrame:
    """Entries and bytes are exact; the number of streams is within 5 % of a count of all rows."""
    path = _with_partials(s, d)
    exact = K.index_stats(P.in_range(S.read_logs(s, path), _FROM, _UNTIL)).first()["streams"]
    rows = R.index_stats(R.merged(s, path, _LABELS_KIND, _FROM, _UNTIL), _LABELS_KIND)
    return rows.select("entries", "chunks", "bytes", (F.abs(F.col("streams") - exact) <= 0.05 * exact).alias("near"))


add_table("e20_sketches", _sketched_streams, f"SELECT count(*) AS entries, greatest(1, count(*) // 1000)::BIGINT AS chunks, {_BYTES} AS bytes, true AS near FROM {_HELD} WHERE {_WITHIN}")
add_table("e24_sketches", _from_partials(R.detected_labels, _LABELS_KIND, _FROM, _UNTIL), f"SELECT * FROM (SELECT 'env' AS label, count(DISTINCT nullif(label_env, '')) AS cardinality FROM {_HELD} WHERE {_WITHIN} UNION ALL SELECT 'service', count(DISTINCT label_service) FROM {_HELD} WHERE {_WITHIN} UNION ALL SELECT 'level', count(DISTINCT label_level) FROM {_HELD} WHERE {_WITHIN})")


def _sketched_fields(s: SparkSession, d: str) -> DataFrame:
    path, kind = scratch(s, "fields"), R.fields_kind()
    line = F.format_string('user="%s" id="%s" level="%s"', F.regexp_extract("message", "user=([0-9]+)", 1), "sequence_token", F.coalesce("label_level", F.lit("none")))
    logs = table_logs(s, d).drop("duration", "event_id").withColumn("message", F.when(F.col("sequence_token") % 4 > 0, line).otherwise(F.col("message")))
    for epoch in range(2):
        S.write_epoch(logs.filter(F.col("sequence_token") % 2 == epoch), epoch, path)
    R.refresh(s, path, [kind])
    R.compact_partials(s, path, [kind])
    exact = K.detected_fields(S.read_logs(s, path), exact=True).select("field", F.col("cardinality").alias("exact"))
    rows = R.detected_fields(R.merged(s, path, kind), kind).join(exact, "field")
    return rows.select("field", "type", "parser", (F.abs(F.col("cardinality") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


add_table("e25_sketches", _sketched_fields, "SELECT unnest(['user', 'id', 'level']) AS field, unnest(['number', 'number', 'string']) AS type, 'logfmt' AS parser, true AS near")


def _sketched_latencies(s: SparkSession, d: str, step: int | None) -> DataFrame:
    """Quantiles whose values lie within 1 % of the asked rank, judged by all rows."""
    path, kind, alb = scratch(s, "latency"), R.latency_kind(), table_alb(s, d)
    for epoch in range(2):
        S.write_epoch(alb.filter(F.col("sent_bytes") % 2 == epoch), epoch, path, "time")
        R.refresh(s, path, [kind])
    R.compact_partials(s, path, [kind])
    ranks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = R.quantiles(R.merged(s, path, kind), kind, ranks, step)
    found = found if step else found.withColumn("bucket", F.lit(0).cast("long"))
    rows = S.read_alb(s, path).filter("target_processing_time >= 0").select((F.unix_seconds(F.col("time").cast("timestamp")) if step else F.lit(0).cast("long")).alias("t"), F.col("target_processing_time").alias("v"))
    rows = rows.select((F.col("t") - F.pmod("t", F.lit(step or 1))).alias("bucket"), "v").join(found, "bucket")
    near = [((F.avg((F.col("v") < F.col(c)).cast("int")) <= q + 0.01) & (F.avg((F.col("v") <= F.col(c)).cast("int")) >= q - 0.01)).alias(c) for c, q in ranks.items()]
    return rows.groupBy("bucket", "n", "low", "high").agg(*near)


_LATENCIES = "count(*) AS n, min(target_processing_time) AS low, max(target_processing_time) AS high, true AS p50, true AS p95, true AS p99 FROM alb WHERE target_processing_time >= 0 GROUP BY 1"
add_table("e64_sketches", lambda s, d: _sketched_latencies(s, d, 3600), f"SELECT epoch_us(time) // 1000000 // 3600 * 3600 AS bucket, {_LATENCIES}")
add_table("e46_sketches", lambda s, d: _sketched_latencies(s, d, None), f"SELECT 0::BIGINT AS bucket, {_LATENCIES}")


def _sketched_by_label(s: SparkSession, d: str) -> DataFrame:
    """Quantiles of a number in messages, by service and six hours."""
    path, logs = scratch(s, "durations"), table_logs(s, d).drop("duration", "event_id")
    kind = R.quantiles_kind("ids", lambda: F.regexp_extract("message", "user=([0-9]+)", 1).try_cast("double"), ["service"])
    for epoch in range(2):
        S.write_epoch(logs.filter(F.col("sequence_token") % 2 == epoch), epoch, path)
    R.refresh(s, path, [kind])
    found = R.quantiles(R.merged(s, path, kind), kind, {"median": 0.5}, 21600, ["service"])
    rows = S.read_logs(s, path).select(F.unix_seconds(F.col("timestamp").cast("timestamp")).alias("t"), F.col("label_service").alias("service"), F.regexp_extract("message", "user=([0-9]+)", 1).cast("double").alias("v"))
    rows = rows.select((F.col("t") - F.pmod("t", F.lit(21600))).alias("bucket"), "service", "v").join(found, ["bucket", "service"])
    near = (F.avg((F.col("v") < F.col("median")).cast("int")) <= 0.51) & (F.avg((F.col("v") <= F.col("median")).cast("int")) >= 0.49)
    return rows.groupBy("bucket", "service", "n").agg(near.alias("near"))


add_table("e12_sketches", _sketched_by_label, "SELECT epoch_us(timestamp) // 1000000 // 21600 * 21600 AS bucket, label_service AS service, count(*) AS n, true AS near FROM logs GROUP BY 1, 2")


def _standing_catalogue(s: SparkSession, d: str) -> DataFrame:
    """Groups and streams from partials that the ingest stream itself keeps, over a stop and a compaction."""
    source, path, ckpt, raw = scratch(s, "landing"), scratch(s, "standing"), scratch(s, "ckpt"), _raw(table_logs(s, d))
    for k in range(2):
        raw.filter(F.col("sequenceToken") % 2 == k).repartition(2).write.mode("append").json(source)
        J.stream_landing(s, source, path, ckpt, every=None, max_files=1, kinds=[_STREAMS]).awaitTermination()
        if k == 0:
            R.compact_partials(s, path, [_STREAMS])
    parts = R.merged(s, path, _STREAMS)
    if not all("_partials" in f for f in parts.inputFiles()):
        raise RuntimeError("rows were read again")
    return _STREAMS.merge(parts, "log_group_name", "log_stream_name").select("log_group_name", "log_stream_name", "n", "bytes", "first_event", "last_event")


add_table("e28_standing", _standing_catalogue, f"SELECT log_group_name, log_stream_name, count(*) AS n, {_BYTES} AS bytes, min(timestamp) AS first_event, max(timestamp) AS last_event FROM logs GROUP BY 1, 2")


def _standing_latencies(s: SparkSession, d: str) -> DataFrame:
    """Requests with a latency, and the extremes, per hour from the sketches that the access-log stream keeps."""
    path, kind = scratch(s, "standing-alb"), R.latency_kind()
    J.stream_alb(s, _alb_files(s, d, table_alb), path, scratch(s, "ckpt"), every=None, max_files=2 * _lots(s, d), kinds=[kind]).awaitTermination()
    found = R.quantiles(R.merged(s, path, kind), kind, {"least": 0.0, "most": 1.0}, 3600)
    return found.select("bucket", "n", "low", "high", (F.col("least") == F.col("low")).alias("least"), (F.col("most") == F.col("high")).alias("most"))


add_table("e39_standing", _standing_latencies, "SELECT epoch_us(time) // 1000000 // 3600 * 3600 AS bucket, count(*) AS n, min(target_processing_time) AS low, max(target_processing_time) AS high, true AS least, true AS most FROM alb WHERE target_processing_time >= 0 GROUP BY 1")


# --- access logs from partials ------------------------------------------------------------------------------

_REQUESTS, _PATHS = R.requests_kind(), R.requests_kind(("request_path",), "paths")


@_once
def _alb_with_partials(s: SparkSession, d: str) -> str:
    """A table of access logs with a replayed batch, folded partials, and a last batch that has none."""
    kinds = (_REQUESTS, _PATHS)
    path, alb = scratch(s, "alb-kept"), table_alb(s, d, s.sparkContext.defaultParallelism)
    parts = [alb.filter(F.pmod(F.xxhash64("trace_id"), F.lit(3)) == k) for k in range(3)]
    for epoch in (0, 1, 1):
        S.write_epoch(parts[epoch], epoch, path, "time")
        R.refresh(s, path, kinds)
    R.compact_partials(s, path, kinds)
    S.write_epoch(parts[2], 2, path, "time")
    return path


def _from_alb_partials(result: Callable, kind: R.Kind, *span: datetime) -> Callable:
    return lambda s, d: result(R.merged(s, _alb_with_partials(s, d), kind, *span))


_REQUEST_SQL = {
    "request_rate": "count(*)", "error_rate": "nullif(count(*) FILTER (elb_status_code >= 400), 0)", "error_rate_pct": "round(100.0::DOUBLE * count(*) FILTER (elb_status_code >= 400) / count(*), 4)",
    "2xx_rate": "nullif(count(*) FILTER (elb_status_code BETWEEN 200 AND 299), 0)", "3xx_rate": "nullif(count(*) FILTER (elb_status_code BETWEEN 300 AND 399), 0)",
    "4xx_rate": "nullif(count(*) FILTER (elb_status_code BETWEEN 400 AND 499), 0)", "5xx_rate": "nullif(count(*) FILTER (elb_status_code >= 500), 0)",
    "bandwidth_in": "sum(received_bytes)", "bandwidth_out": "sum(sent_bytes)",
}
_REQUEST_SERIES = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, epoch_us(time) // 1000000 // 7200 * 7200 AS bucket, ({sql})::DOUBLE AS value FROM alb GROUP BY 2" for m, sql in _REQUEST_SQL.items()) + ") WHERE value IS NOT NULL"
_ALB_WITHIN = _WITHIN.replace("timestamp >=", "time >=").replace("timestamp <=", "time <=")
_ERRORS = "count(*) FILTER (elb_status_code >= 400)"

add_table("e41_partials", _from_alb_partials(lambda p: R.request_metrics(p, step=7200), _REQUESTS), _REQUEST_SERIES)
add_table("e43_partials", _from_alb_partials(lambda p: R.top_requests(p, "request_path", "path"), _PATHS, _FROM, _UNTIL),
    f"SELECT request_path AS path, count(*) AS requests, {_ERRORS} AS errors, round(100.0::DOUBLE * {_ERRORS} / count(*), 2) AS error_pct FROM alb WHERE {_ALB_WITHIN} AND request_path IS NOT NULL GROUP BY 1 ORDER BY requests DESC, path LIMIT 20")
add_table("e45_partials", _from_alb_partials(R.status_distribution, _REQUESTS, _FROM, _UNTIL),
    f"SELECT elb_status_code AS status, count(*) AS cnt, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM alb WHERE {_ALB_WITHIN} AND elb_status_code IS NOT NULL GROUP BY 1")
add_table("e47_partials", _from_alb_partials(R.request_summary, _REQUESTS, _FROM, _UNTIL),
    f"SELECT count(*) AS total_requests, {_ERRORS} AS total_errors, round(100.0::DOUBLE * {_ERRORS} / count(*), 2) AS error_rate_pct, sum(received_bytes)::BIGINT AS total_rx_bytes, sum(sent_bytes)::BIGINT AS total_tx_bytes FROM alb WHERE {_ALB_WITHIN}")
add_table("e61_partials", _from_alb_partials(lambda p: R.requests_by(p, L.status_class(F.col("elb_status_code")).alias("status_class")).select("status_class", "requests"), _REQUESTS),
    "SELECT CASE WHEN elb_status_code >= 500 THEN '5xx' WHEN elb_status_code >= 400 THEN '4xx' WHEN elb_status_code >= 300 THEN '3xx' WHEN elb_status_code >= 200 THEN '2xx' ELSE 'other' END AS status_class, count(*) AS requests FROM alb GROUP BY 1")
add_table("e66_partials", _from_alb_partials(lambda p: R.requests_by(p, "request_method", step=3600), _REQUESTS),
    f"SELECT epoch_us(time) // 1000000 // 3600 * 3600 AS bucket, request_method, count(*) AS requests, {_ERRORS} AS errors, sum(received_bytes)::BIGINT AS received_bytes, sum(sent_bytes)::BIGINT AS sent_bytes FROM alb GROUP BY 1, 2")


def _standing_requests(s: SparkSession, d: str) -> DataFrame:
    """The request metrics from partials that the access-log stream keeps, without a look at its rows."""
    path = scratch(s, "standing-requests")
    J.stream_alb(s, _alb_files(s, d, table_alb), path, scratch(s, "ckpt"), every=None, max_files=2 * _lots(s, d), kinds=[_REQUESTS]).awaitTermination()
    parts = R.merged(s, path, _REQUESTS)
    if not all("_partials" in f for f in parts.inputFiles()):
        raise RuntimeError("rows were read again")
    return R.request_metrics(parts, step=7200)


add_table("e41_standing", _standing_requests, _REQUEST_SERIES)
