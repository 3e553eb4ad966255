"""Volumes, catalogs and discovery: what groups, streams, labels and fields a table holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelogs.functions.levels import alb_level, field_level
from lakelogs.functions.parsing import logfmt_pairs
from lakelogs.functions.times import bucket
from lakelogs.operators.metrics import group_columns, message_bytes, over_time
from lakelogs.schema import label_column

ALB_ROW_BYTES = 250
ALB_FIELDS = {"method": "request_method", "status": "elb_status_code", "client": "client_ip", "host": "domain_name", "error_reason": "error_reason"}
SERIES_LABELS = ("env", "service", "host", "region")


def _labels(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("label_")]


def volume(df: DataFrame, by: str) -> DataFrame:
    """Bytes and lines per label value."""
    return df.groupBy(*group_columns(df, [by])).agg(message_bytes().alias("bytes"), F.count("*").alias("lines"))


def volume_range(df: DataFrame, by: str, step: int) -> DataFrame:
    """Bytes per label value and bucket."""
    return over_time(df, message_bytes(), step, [by])


def index_stats(df: DataFrame) -> DataFrame:
    """Streams (different groups, streams, env and service), chunks, entries, bytes."""
    key = F.struct(*[F.coalesce(F.col(c), F.lit("")) for c in ("log_group_name", "log_stream_name", "label_env", "label_service") if c in df.columns])
    entries = F.count("*")
    return df.agg(
        F.count_distinct(key).alias("streams"), F.greatest(F.lit(1), F.call_function("div", entries, F.lit(1000))).cast("long").alias("chunks"), entries.alias("entries"),
        F.coalesce(message_bytes(), F.lit(0)).alias("bytes"),
    )


def series(df: DataFrame, labels: Sequence[str] = SERIES_LABELS) -> DataFrame:
    """Different label sets; an empty label is null."""
    cols = [F.col("log_group_name"), F.col("log_stream_name")]
    cols += [F.nullif(F.col(label_column(c)), F.lit("")).alias(c) for c in labels if label_column(c) in df.columns]
    return df.select(*cols).distinct()


def _unpivoted(df: DataFrame, aggregate, names: Sequence[str], value: str) -> DataFrame:
    """One aggregate a label, in one pass, as rows (label, value)."""
    wide = df.agg(*[aggregate(F.col(c)).alias(c) for c in names])
    return wide.unpivot([], list(names), "column", value)


def label_names(df: DataFrame) -> DataFrame:
    """Labels that have a non-empty value."""
    rows = _unpivoted(df, lambda c: F.count_if(F.coalesce(c, F.lit("")) != ""), _labels(df), "n")
    return rows.filter("n > 0").select(F.regexp_replace("column", "^label_", "").alias("label"))


def label_values(df: DataFrame, label: str, limit: int = 500) -> DataFrame:
    """Different non-empty values, ascending."""
    name = label if label in df.columns else label_column(label)
    if name not in df.columns:
        return df.sparkSession.createDataFrame([], "value string")
    col = F.col(name).cast("string")
    return df.filter(col != "").select(col.alias("value")).distinct().orderBy("value").limit(limit)


def detected_labels(df: DataFrame, exact: bool = False) -> DataFrame:
    """Labels and how many values they have; exact counts cost a shuffle of the values."""
    count = F.count_distinct if exact else F.approx_count_distinct
    rows = _unpivoted(df, lambda c: count(F.nullif(c, F.lit(""))), _labels(df), "cardinality")
    return rows.filter("cardinality > 0").select(F.regexp_replace("column", "^label_", "").alias("label"), "cardinality")


def detected_fields(df: DataFrame, exact: bool = False) -> DataFrame:
    """Fields of logfmt messages: (field, type, cardinality, parser)."""
    count = F.count_distinct if exact else F.approx_count_distinct
    pairs = df.select(F.explode(logfmt_pairs(F.col("message"))).alias("field", "value"))
    numeric = F.every(F.col("value").try_cast("double").isNotNull())
    return pairs.groupBy("field").agg(F.when(numeric, "number").otherwise("string").alias("type"), count("value").alias("cardinality")).withColumn("parser", F.lit("logfmt"))


def field_values(df: DataFrame, name: str, limit: int = 100) -> DataFrame:
    """Values of a detected field: message, level, or a label."""
    if name in ("level", "detected_level"):
        col: Column = field_level(F.col("message"))
    elif name == "message":
        col = F.col("message")
    else:
        return label_values(df, name, limit)
    return df.select(col.alias("value")).filter("value <> ''").distinct().orderBy("value").limit(limit)


def log_groups(df: DataFrame, prefix: str = "", limit: int = 50) -> DataFrame:
    """(log_group_name, creation_time, stored_bytes)."""
    rows = df.filter(F.col("log_group_name").startswith(prefix)) if prefix else df
    return rows.groupBy("log_group_name").agg(F.min("ingestion_time").alias("creation_time"), message_bytes().alias("stored_bytes")).orderBy("log_group_name").limit(limit)


def log_streams(df: DataFrame, group: str, prefix: str = "", order_by: str = "name", descending: bool = False, limit: int = 50) -> DataFrame:
    """Streams of a group with their first and last times and bytes, by name or by last event."""
    rows = df.filter(F.col("log_group_name") == group)
    rows = rows.filter(F.col("log_stream_name").startswith(prefix)) if prefix else rows
    out = rows.groupBy("log_stream_name").agg(
        F.min("ingestion_time").alias("creation_time"), F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event"),
        F.max("ingestion_time").alias("last_ingestion"), message_bytes().alias("stored_bytes"),
    )
    key = F.col("log_stream_name" if order_by == "name" else "last_event")
    return out.orderBy(key.desc() if descending else key.asc(), "log_stream_name").limit(limit)


# --- access logs --------------------------------------------------------------------------------------------


def alb_volume(df: DataFrame, limit: int = 500) -> DataFrame:
    out = df.groupBy("elb").agg(F.count("*").alias("lines"), (F.count("*") * ALB_ROW_BYTES).alias("bytes"))
    return out.orderBy(F.desc("lines"), "elb").limit(limit)


def alb_volume_range(df: DataFrame, step: int) -> DataFrame:
    return df.groupBy(bucket(F.col("time"), step).alias("bucket"), "elb").agg((F.count("*") * ALB_ROW_BYTES).alias("value"))


def alb_index_stats(df: DataFrame) -> DataFrame:
    n = F.count("*")
    return df.agg(F.count_distinct("elb").alias("streams"), F.greatest(F.lit(1), F.call_function("div", n, F.lit(1000))).cast("long").alias("chunks"), n.alias("entries"), (n * ALB_ROW_BYTES).alias("bytes"))


def alb_series(df: DataFrame, limit: int = 500) -> DataFrame:
    keys = ["elb", "request_method", "type", "domain_name"]
    return df.select(*keys).distinct().orderBy(*keys).limit(limit)


def alb_field_values(df: DataFrame, name: str, limit: int = 100) -> DataFrame:
    value = F.col(ALB_FIELDS.get(name, name)).cast("string")
    return df.filter(value.isNotNull()).select(value.alias("value")).distinct().orderBy("value").limit(limit)


def alb_count_over_time(df: DataFrame, step: int, by: str | None = None) -> DataFrame:
    """Requests per bucket, by any column or by detected level."""
    keys = []
    if by == "detected_level":
        keys = [alb_level(F.col("elb_status_code")).alias(by)]
    elif by:
        keys = [F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias(by)]
    return df.groupBy(bucket(F.col("time"), step).alias("bucket"), *keys).agg(F.count("*").alias("value"))
