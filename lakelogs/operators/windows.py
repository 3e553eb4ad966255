"""Shares, caps, sequence numbers, merges, and the views of events that clients read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelogs.functions.times import epoch_micros, epoch_millis
from lakelogs.operators.predicates import newest

STREAM = ("log_group_name", "log_stream_name")


def share(counts: DataFrame, cnt: str = "cnt", digits: int | None = None, name: str = "pct") -> DataFrame:
    """Percent of the total over all groups. ``counts`` is an aggregate, so the window has one small partition."""
    pct = F.lit(100.0) * F.col(cnt) / F.sum(cnt).over(Window.partitionBy())
    return counts.withColumn(name, F.round(pct, digits) if digits is not None else pct)


def cap_per_stream(df: DataFrame, n: int = 10_000, order: str = "sequence_token") -> DataFrame:
    """The latest n events of each stream in arrival order.

    A hot stream is cut before the ranking: each of its pre-partitions (by a hash of the order key) keeps its own latest n,
    which is a superset, so the window over a whole stream ranks few rows."""
    pre = Window.partitionBy(*STREAM, "_part").orderBy(F.desc(order))
    last = Window.partitionBy(*STREAM).orderBy(F.desc(order))
    cut = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(64))).withColumn("_rank", F.row_number().over(pre)).filter(F.col("_rank") <= n).drop("_part")
    return cut.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") <= n).drop("_rank")


def assign_sequence(df: DataFrame, batch: str = "batch") -> DataFrame:
    """(group, stream, batch, events, sequence_token): after a batch the token is 1 + the stream's events so far."""
    counts = df.groupBy(*STREAM, batch).agg(F.count("*").alias("events"))
    upto = Window.partitionBy(*STREAM).orderBy(batch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("sequence_token", 1 + F.sum("events").over(upto))


def merge_dedup(a: DataFrame, b: DataFrame, limit: int | None = None) -> DataFrame:
    """Two tiers without double events: one row per (timestamp, message, stream), ascending by time."""
    both = a.unionByName(b, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("timestamp", "message", *STREAM)]
    one = both.groupBy("timestamp", "message", *STREAM).agg(F.min(F.struct(*rest)).alias("_rest"))
    return newest(one.select("timestamp", "message", *STREAM, "_rest.*").select(*both.columns), limit)


def event_view(df: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """(timestamp ms, message, ingestion_time ms, log_group_name, log_stream_name, labels...) with ``""`` and 0 for nulls."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    millis = lambda c: F.coalesce(epoch_millis(F.col(c)), F.lit(0)).alias(c)
    labels = labels if labels is not None else [c for c in df.columns if c.startswith("label_")]
    return df.select(millis("timestamp"), text("message"), millis("ingestion_time"), *map(text, STREAM), *map(text, labels))


def label_map(df: DataFrame) -> Column:
    """Non-empty labels as a map; ``service`` is there as ``service_name`` too."""
    labels = {c.removeprefix("label_"): F.col(c) for c in df.columns if c.startswith("label_")}
    if "service" in labels:
        labels["service_name"] = labels["service"]
    full = F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), v)]) if labels else F.create_map().cast("map<string,string>")
    return F.map_filter(full, lambda k, v: v.isNotNull() & (v != ""))


def to_stream_entries(df: DataFrame) -> DataFrame:
    """(labels, ts_ns, line): what a log client shows; the message is a label too."""
    message = F.coalesce(F.col("message"), F.lit(""))
    labels = F.when(message != "", F.map_concat(label_map(df), F.create_map(F.lit("message"), message))).otherwise(label_map(df))
    return df.select(labels.alias("labels"), (epoch_micros(F.col("timestamp")) * 1000).alias("ts_ns"), message.alias("line"))
