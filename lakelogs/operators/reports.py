"""Ad-hoc log reports and the datasets behind the access-log dashboard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelogs.functions.levels import own_word_level, status_class
from lakelogs.operators.windows import share

PIVOT_LEVELS = ("info", "debug", "warn", "error")


def _hour(ts: str) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_start")


# --- logs ---------------------------------------------------------------------------------------------------


def count_logs(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("cnt"))


def sample_logs(df: DataFrame, n: int = 10, tiebreak: str = "sequence_token") -> DataFrame:
    """The newest rows."""
    return df.orderBy(F.desc("timestamp"), F.desc(tiebreak)).limit(n)


def level_share(df: DataFrame) -> DataFrame:
    """(level, cnt, pct)."""
    return share(df.groupBy(own_word_level(F.col("message")).alias("level")).agg(F.count("*").alias("cnt")), "cnt", 1)


def _hour_levels(df: DataFrame) -> DataFrame:
    return df.groupBy(_hour("timestamp"), own_word_level(F.col("message")).alias("level")).agg(F.count("*").alias("cnt"))


def hourly_levels(df: DataFrame, n: int = 96) -> DataFrame:
    """Rows by hour and level, the newest n."""
    return _hour_levels(df).orderBy(F.desc("hour_start"), "level").limit(n)


def hourly_level_pivot(df: DataFrame) -> DataFrame:
    """Hour by level, absent levels 0."""
    return _hour_levels(df).groupBy("hour_start").pivot("level", list(PIVOT_LEVELS)).agg(F.sum("cnt")).na.fill(0, list(PIVOT_LEVELS))


def top_streams(df: DataFrame, n: int = 20) -> DataFrame:
    out = df.groupBy("log_group_name", "log_stream_name").agg(F.count("*").alias("cnt"))
    return out.orderBy(F.desc("cnt"), "log_group_name", "log_stream_name").limit(n)


def hourly_volume(df: DataFrame, n: int = 24) -> DataFrame:
    return df.groupBy(_hour("timestamp")).agg(F.count("*").alias("cnt")).orderBy(F.desc("hour_start")).limit(n)


def volume_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("cnt"))


# --- access-log dashboard -----------------------------------------------------------------------------------


def enriched(df: DataFrame) -> DataFrame:
    """The dashboard's dataset: requests with their status class."""
    return df.withColumn("status_class", status_class(F.col("elb_status_code")))


def _pct(hit: Column) -> Column:
    return F.lit(100.0) * F.count_if(hit) / F.count("*")


def dash_error_rate(df: DataFrame) -> DataFrame:
    return df.agg(_pct(F.col("elb_status_code") >= 400).alias("error_rate"))


def dash_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("time").alias("total"))


def _quantiles(qs: Sequence[float], approx: bool) -> Column:
    """Exact ones keep the different values of a group in memory; approximate ones (ranks within a 10,000th) bound it."""
    at = F.array(*map(F.lit, qs))
    return F.percentile_approx("target_processing_time", at, 10_000) if approx else F.percentile("target_processing_time", at)


def dash_p99(df: DataFrame, approx: bool = False) -> DataFrame:
    return df.agg(F.get(_quantiles([0.99], approx), F.lit(0)).alias("p99"))


def dash_avg_kb(df: DataFrame) -> DataFrame:
    return df.agg((F.avg("sent_bytes") / F.lit(1024.0)).alias("avg_kb"))


def dash_hourly(df: DataFrame) -> DataFrame:
    return df.groupBy(_hour("time")).agg(F.count("*").alias("requests"))


def dash_by(df: DataFrame, column: str) -> DataFrame:
    """Requests by status class, method, TLS version or load balancer."""
    rows = enriched(df) if column == "status_class" else df
    return rows.groupBy(column).agg(F.count("*").alias("requests"))


def dash_5xx_hourly(df: DataFrame) -> DataFrame:
    return df.groupBy(_hour("time")).agg(_pct(F.col("elb_status_code") >= 500).alias("pct_5xx"))


def dash_latency_hourly(df: DataFrame, approx: bool = False) -> DataFrame:
    q = df.groupBy(_hour("time")).agg(_quantiles([0.5, 0.95, 0.99], approx).alias("q"))
    return q.select("hour_start", *[F.get("q", i).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def dash_mb_hourly(df: DataFrame) -> DataFrame:
    mb = lambda c: (F.sum(c) / F.lit(1048576.0)).alias(c.replace("bytes", "mb"))
    return df.groupBy(_hour("time")).agg(mb("received_bytes"), mb("sent_bytes"))


def dash_method_hourly(df: DataFrame) -> DataFrame:
    return df.groupBy(_hour("time"), "request_method").agg(F.count("*").alias("requests"))


def dash_top(df: DataFrame, column: str, n: int = 15, errors_only: bool = False) -> DataFrame:
    """The most frequent paths or clients, of all requests or of errors."""
    rows = df.filter(F.col("elb_status_code") >= 400) if errors_only else df
    return rows.groupBy(column).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), column).limit(n)


def slowest(df: DataFrame, n: int = 50, tiebreak: str = "trace_id") -> DataFrame:
    keep = ("time", "elb", "client_ip", "request_method", "request_path", "elb_status_code", "target_processing_time", "trace_id")
    return df.orderBy(F.desc_nulls_last("target_processing_time"), tiebreak).limit(n).select(*keep)


def recent_errors(df: DataFrame, n: int = 100, tiebreak: str = "trace_id") -> DataFrame:
    keep = ("time", "elb", "client_ip", "request_method", "request_path", "elb_status_code", "error_reason", "trace_id")
    return df.filter(F.col("elb_status_code") >= 500).orderBy(F.desc("time"), tiebreak).limit(n).select(*keep)
