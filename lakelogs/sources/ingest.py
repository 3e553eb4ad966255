"""Payloads of collectors and APIs -> typed log rows. Each takes a DataFrame of payloads and returns LOG columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelogs.functions.parsing import json_labels, logfmt_labels, logfmt_message, logfmt_pairs
from lakelogs.functions.times import epoch_to_ts
from lakelogs.schema import LABELS, label_column

PUSH = "streams array<struct<stream:map<string,string>,values:array<array<string>>>>"
MESSAGES = "logGroupName string, logStreamName string, timestamp bigint, messages array<string>"
EVENTS = "logGroupName string, logStreamName string, logEvents array<struct<timestamp:bigint,message:string>>"
COLLECTOR = "log string, message string, level string, kubernetes struct<pod_name:string,container_name:string,namespace:string,labels:map<string,string>>"
_RECORD = "eventSource:string,s3:struct<bucket:struct<name:string>,object:struct<key:string>>"
NOTIFICATION = f"Records array<struct<{_RECORD}>>, Message string"


def sanitise_labels(labels: Column) -> Column:
    """Label names with ``-``, ``.`` and blanks as ``_``; of names that become equal the last one counts."""
    entries = F.transform(F.map_entries(labels), lambda e: F.named_struct(F.lit("key"), F.regexp_replace(e["key"], r"[-. ]", "_"), F.lit("value"), e["value"]))
    one = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(one)


def _text(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def first_of(*cols: Column) -> Column:
    """The first value that is neither null nor empty, else ``""``."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def apply_label_aliases(df: DataFrame) -> DataFrame:
    """app and service stand in for each other; a default group or stream is named by namespace or pod."""
    cols = {}
    has = df.columns
    if {"label_app", "label_service"} <= set(has):
        cols |= {"label_app": first_of(F.col("label_app"), F.col("label_service")), "label_service": first_of(F.col("label_service"), F.col("label_app"))}
    for name, label in (("log_group_name", "label_namespace"), ("log_stream_name", "label_pod")):
        if label in has:
            cols[name] = F.when((F.col(name) == "default") & (_text(F.col(label)) != ""), F.col(label)).otherwise(F.col(name))
    return df.withColumns(cols) if cols else df


def resolve_labels(header: Mapping[str, str], body: Column, labels: Sequence[str] = LABELS) -> dict[str, Column]:
    """Label columns: the header's value, else the body's, else ``""``."""
    return {label_column(c): first_of(F.lit(header.get(c)), body[c]) for c in labels}


def log_rows(df: DataFrame, group: Column, stream: Column, time: Column, message: Column, labels: Mapping[str, Column], ingested: Column | None = None, token: Column | None = None) -> DataFrame:
    return df.select(
        _text(group).alias("log_group_name"), _text(stream).alias("log_stream_name"), time.alias("timestamp"), _text(message).alias("message"),
        (time if ingested is None else ingested).alias("ingestion_time"), F.coalesce(token if token is not None else F.lit(None), F.lit(0)).cast("long").alias("sequence_token"),
        *[_text(c).alias(n) for n, c in labels.items()],
    )


def to_log_rows(raw: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Landed events (RAW columns, epochs of any scale) -> log rows."""
    names = [label_column(c) for c in labels]
    return log_rows(
        raw, F.col("logGroupName"), F.col("logStreamName"), epoch_to_ts(F.col("timestamp")), F.col("message"),
        {n: F.col(n) if n in raw.columns else F.lit("") for n in names}, epoch_to_ts(F.coalesce("ingestionTime", "timestamp")), F.col("sequenceToken"),
    )


def ingest_push(payloads: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Push payloads (``payload`` JSON text): a row a value. Group and stream come from labels, names are sanitised, logfmt lines are
    opened up (their pairs are labels of lower rank), and the event time is the ingestion time."""
    body = payloads.select(F.from_json("payload", PUSH).alias("p")).select(F.explode("p.streams").alias("s"))
    rows = body.select(sanitise_labels(F.coalesce("s.stream", F.create_map().cast("map<string,string>"))).alias("l"), F.explode("s.values").alias("v"))
    rows = rows.select("l", F.get("v", 0).try_cast("long").alias("ns"), F.get("v", 1).alias("line")).withColumn("extra", sanitise_labels(F.coalesce(logfmt_labels(F.col("line")), F.create_map().cast("map<string,string>"))))
    lab = F.col("l")
    group = first_of(lab["log_group"], lab["log_group_name"], lab["namespace"], F.lit("default"))
    stream = first_of(lab["log_stream"], lab["log_stream_name"], lab["pod"], F.lit("default"))
    columns = {label_column(c): F.coalesce(lab[c], F.col("extra")[c]) for c in labels}
    message = F.when(logfmt_pairs(F.col("line")).isNotNull(), logfmt_message(F.col("line"))).otherwise(F.col("line"))
    return apply_label_aliases(log_rows(rows, group, stream, epoch_to_ts(F.call_function("div", F.col("ns"), F.lit(1000))), message, columns))


def ingest_collector(records: DataFrame, now: Column | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """Collector records (COLLECTOR columns, one a row): each keeps its own labels; records without a log are skipped."""
    k8s = F.col("kubernetes")
    found = {
        "pod": F.coalesce(k8s["pod_name"], F.lit("unknown")), "container": F.coalesce(k8s["container_name"], F.lit("unknown")), "namespace": F.coalesce(k8s["namespace"], F.lit("default")),
        "app": F.coalesce(k8s["labels"]["app"], F.lit("unknown")), "level": F.coalesce("level", F.lit("info")),
    }
    columns = {label_column(c): found.get(c, F.lit("")) for c in labels}
    time = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    return apply_label_aliases(log_rows(records.filter("log IS NOT NULL"), found["namespace"], found["pod"], time, F.coalesce("message", "log"), columns))


def ingest_messages(payloads: DataFrame, header: Mapping[str, str] | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """Message lists (MESSAGES columns, timestamp in ms) -> rows; labels from the header, else from JSON bodies."""
    rows = payloads.select("logGroupName", "logStreamName", "timestamp", F.explode("messages").alias("message"))
    rows = rows.withColumn("found", F.coalesce(json_labels(F.col("message")), F.create_map().cast("map<string,string>")))
    time = F.timestamp_micros(F.col("timestamp") * 1000).cast("timestamp_ntz")
    return log_rows(rows, first_of(F.col("logGroupName"), F.lit("default")), first_of(F.col("logStreamName"), F.lit("default")), time, F.col("message"), resolve_labels(header or {}, F.col("found"), labels))


def ingest_batch(records: DataFrame, header: Mapping[str, str] | None = None, now: Column | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """Records with their own columns: a label is ``label_x``, else ``label-x``, else the header's; ingestion is the wall clock."""
    header, has = header or {}, records.columns
    columns = {label_column(c): first_of(*[F.col(f"`{n}`") for n in (label_column(c), f"label-{c}") if n in has], F.lit(header.get(c))) for c in labels}
    wall = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    return log_rows(records, F.col("logGroupName"), F.col("logStreamName"), F.coalesce(epoch_to_ts(F.col("timestamp")), wall), F.col("message"), columns, wall)


def ingest_events(payloads: DataFrame, now: Column | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """Put-events payloads (EVENTS columns, and ``batch`` to order them) -> rows with the stream's token after their batch."""
    from lakelogs.operators.windows import assign_sequence

    rows = payloads.select("batch", F.col("logGroupName").alias("log_group_name"), F.col("logStreamName").alias("log_stream_name"), F.explode("logEvents").alias("e"))
    tokens = assign_sequence(rows).drop("events")
    keyed = rows.join(tokens, ["log_group_name", "log_stream_name", "batch"])
    time = epoch_to_ts(F.col("e.timestamp"))
    return log_rows(keyed, F.col("log_group_name"), F.col("log_stream_name"), time, F.col("e.message"), {label_column(c): F.lit("") for c in labels}, time if now is None else now, F.col("sequence_token"))


def object_paths(notifications: DataFrame) -> DataFrame:
    """Object-created notifications (``body`` text, perhaps wrapped by a topic) -> (path, error). Records of other sources are
    skipped; a record without bucket or key, and a body that is no JSON, have an error instead of a path."""
    outer = F.from_json("body", NOTIFICATION)
    bodies = notifications.select("body", outer.alias("o")).select("body", F.coalesce(F.col("o.Records"), F.from_json("o.Message", NOTIFICATION)["Records"]).alias("r"), F.try_parse_json("body").isNull().alias("bad"))
    records = bodies.filter("NOT bad").select(F.explode("r").alias("r")).filter(F.coalesce("r.eventSource", F.lit("")).isin("", "aws:s3"))
    bucket, key = F.nullif("r.s3.bucket.name", F.lit("")), F.nullif("r.s3.object.key", F.lit(""))
    good = bucket.isNotNull() & key.isNotNull()
    paths = records.select(F.when(good, F.concat(F.lit("s3://"), bucket, F.lit("/"), key)).alias("path"), F.when(~good, "missing bucket or key").alias("error"))
    return paths.union(bodies.filter("bad").select(F.lit(None).cast(T.StringType()), F.lit("body is not JSON")))
