"""Access-log metrics, tables, summaries and renderings. An error is a status of 400 or more."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelogs.functions.times import bucket, epoch_micros
from lakelogs.operators.windows import share
from lakelogs.timeutil import interval_seconds

STREAM_LABELS = ("elb", "request_method", "type", "domain_name")


def _status() -> Column:
    return F.col("elb_status_code")


def _latency() -> Column:
    """Target latency where there is one."""
    return F.when(F.col("target_processing_time") >= 0, F.col("target_processing_time"))


def _quantile(q: float | Sequence[float], approx: bool = False) -> Column:
    """Latency percentiles: exact ones keep the different latencies of a group in one task's memory; approximate ones (ranks within
    a 10,000th) bound it, whatever the group's size."""
    at = F.array(*map(F.lit, q)) if not isinstance(q, float) else F.lit(q)
    return F.percentile_approx(_latency(), at, 10_000) if approx else F.percentile(_latency(), at)


def _of_class(low: int, high: int | None) -> Column:
    hit = _status() >= low
    return F.count_if(hit & (_status() < high) if high else hit)


def _positive(n: Column) -> Column:
    """A count as a metric value: buckets without a hit have none."""
    return F.nullif(n, F.lit(0)).cast("double")


#: metric -> aggregate over a bucket, double; null where the bucket has no value.
METRICS = {
    "request_rate": lambda: F.count("*").cast("double"),
    "error_rate": lambda: _positive(F.count_if(_status() >= 400)),
    "error_rate_pct": lambda: F.round(F.lit(100.0) * F.count_if(_status() >= 400) / F.count("*"), 4),
    "2xx_rate": lambda: _positive(_of_class(200, 300)),
    "3xx_rate": lambda: _positive(_of_class(300, 400)),
    "4xx_rate": lambda: _positive(_of_class(400, 500)),
    "5xx_rate": lambda: _positive(_of_class(500, None)),
    "latency_p50": lambda approx=False: F.round(_quantile(0.5, approx), 6),
    "latency_p95": lambda approx=False: F.round(_quantile(0.95, approx), 6),
    "latency_p99": lambda approx=False: F.round(_quantile(0.99, approx), 6),
    "bandwidth_in": lambda: F.sum("received_bytes").cast("double"),
    "bandwidth_out": lambda: F.sum("sent_bytes").cast("double"),
}


def alb_metrics(df: DataFrame, metrics: Sequence[str] = tuple(METRICS), interval_ms: int = 60_000, approx: bool = False) -> DataFrame:
    """Several metrics in one pass: (metric, bucket, value), one row for each bucket that has a value; ``approx`` is for percentiles."""
    values = [(METRICS[m](approx) if m.startswith("latency_") else METRICS[m]()).alias(m) for m in metrics]
    wide = df.groupBy(bucket(F.col("time"), interval_seconds(interval_ms)).alias("bucket")).agg(*values)
    return wide.unpivot(["bucket"], list(metrics), "metric", "value").filter("value IS NOT NULL").select("metric", "bucket", "value")


def alb_timeseries(df: DataFrame, metric: str, interval_ms: int = 60_000, approx: bool = False) -> DataFrame:
    """(bucket, value) of one metric."""
    return alb_metrics(df, [metric], interval_ms, approx).select("bucket", "value")


def error_count() -> Column:
    return F.count_if(_status() >= 400)


def top_paths(df: DataFrame, n: int = 20) -> DataFrame:
    """(path, requests, errors, error_pct) of the most requested paths."""
    out = df.filter(F.col("request_path").isNotNull()).groupBy(F.col("request_path").alias("path")).agg(F.count("*").alias("requests"), error_count().alias("errors"))
    top = out.orderBy(F.desc("requests"), "path").limit(n)
    return top.withColumn("error_pct", F.round(F.lit(100.0) * F.col("errors") / F.col("requests"), 2))


def top_ips(df: DataFrame, n: int = 20) -> DataFrame:
    out = df.filter(F.col("client_ip").isNotNull()).groupBy(F.col("client_ip").alias("ip")).agg(F.count("*").alias("requests"))
    return out.orderBy(F.desc("requests"), "ip").limit(n)


def status_distribution(df: DataFrame) -> DataFrame:
    """(status, cnt, pct), ordered by status."""
    counts = df.filter(_status().isNotNull()).groupBy(_status().alias("status")).agg(F.count("*").alias("cnt"))
    return share(counts, "cnt", 2).orderBy("status")


def latency_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    """(stat, value) for mean, p50, p75, p90, p95, p99 and max; no rows without latencies."""
    names, qs = ("p50", "p75", "p90", "p95", "p99"), [0.5, 0.75, 0.9, 0.95, 0.99]
    x = _latency()
    one = df.agg(F.avg(x).alias("mean"), _quantile(qs, approx).alias("q"), F.max(x).alias("max"))
    wide = one.select("mean", *[F.get("q", i).alias(n) for i, n in enumerate(names)], "max")
    return wide.unpivot([], ["mean", *names, "max"], "stat", "value").filter("value IS NOT NULL").select("stat", F.round("value", 6).alias("value"))


def alb_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row: totals, error share, bytes, median and p99 latency; zeros and nulls for an empty table."""
    total, zero = F.count("*"), F.lit(0)
    return df.agg(
        total.alias("total_requests"), error_count().alias("total_errors"),
        F.coalesce(F.round(F.lit(100.0) * error_count() / F.nullif(total, zero), 2), F.lit(0.0)).alias("error_rate_pct"),
        F.coalesce(F.sum("received_bytes"), zero).alias("total_rx_bytes"), F.coalesce(F.sum("sent_bytes"), zero).alias("total_tx_bytes"),
        F.round(_quantile(0.5, approx), 6).alias("p50_latency"), F.round(_quantile(0.99, approx), 6).alias("p99_latency"),
    )


# --- renderings ---------------------------------------------------------------------------------------------


def _some(col: str) -> Column:
    return F.when(~F.coalesce(F.col(col), F.lit("")).isin("", "-"), F.col(col))


def alb_logfmt(df: DataFrame) -> Column:
    """A request as one logfmt line; fields without a value are left out, a line without fields is ``-``."""
    path = F.col("request_path")
    quoted = F.when(path.rlike('[ "=]'), F.concat(F.lit('"'), F.replace(path, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(path)
    key = lambda name, value: F.concat(F.lit(f"{name}="), value)
    parts = [
        key("method", F.nullif(F.col("request_method"), F.lit(""))), key("path", F.nullif(quoted, F.lit(""))), key("status", _status().cast("string")),
        key("latency", F.concat(F.format_string("%.3f", _latency()), F.lit("s"))), key("client", F.nullif(F.col("client_ip"), F.lit(""))),
        key("bytes_in", F.col("received_bytes").cast("string")), key("bytes_out", F.col("sent_bytes").cast("string")),
        key("host", F.coalesce(F.nullif(F.col("domain_name"), F.lit("")), F.nullif(F.col("elb"), F.lit("")))),
        key("error_reason", _some("error_reason")), key("trace", _some("trace_id")),
        F.concat(F.lit('ua="'), F.substring(_some("user_agent"), 1, 120), F.lit('"')),
    ]
    parts[3] = F.when(_latency().isNotNull(), parts[3])
    line = F.concat_ws(" ", *parts)
    return F.when(line == "", "-").otherwise(line)


def alb_streams(df: DataFrame, limit: int = 100, tiebreak: Sequence[str] = ("trace_id",)) -> DataFrame:
    """The newest requests grouped by label set: (labels..., entries), entries ascending by time within a stream."""
    newest = df.orderBy(F.desc("time"), *[F.desc(c) for c in tiebreak]).limit(limit)
    entry = F.struct((epoch_micros(F.col("time")) * 1000).alias("ts_ns"), alb_logfmt(df).alias("line"))
    return newest.groupBy(*STREAM_LABELS).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
