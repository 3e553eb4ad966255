"""Column functions of times: epochs of unknown scale, buckets, partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_to_ts(epoch: Column) -> Column:
    """Epoch of unknown scale to a zone-less timestamp: above 1e18 ns, 1e15 us, 1e12 ms, else s."""
    n = epoch.cast("long")
    us = F.when(n > 10**18, F.call_function("div", n, F.lit(1000))).when(n > 10**15, n).when(n > 10**12, n * 1000).otherwise(n * 1_000_000)
    return F.timestamp_micros(us).cast("timestamp_ntz")


def epoch_to_ns(epoch: Column) -> Column:
    """Epoch of unknown scale to nanoseconds: above 1e18 ns, 1e15 us, 1e11 ms, else s."""
    n = epoch.cast("long")
    return F.when(n > 10**18, n).when(n > 10**15, n * 1000).when(n > 10**11, n * 1_000_000).otherwise(n * 1_000_000_000)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def floor_to(value: Column, step: int) -> Column:
    """The largest multiple of step that is no larger, also below zero."""
    return value - F.pmod(value, F.lit(step).cast("long"))


def bucket(ts: Column, step: int) -> Column:
    """Start of the step-second bucket, as epoch seconds."""
    return floor_to(epoch_seconds(ts), step)


def with_partitions(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add ``date`` and ``hour`` of the event time; a null time has null partitions."""
    return df.withColumns({"date": F.date_format(ts, "yyyy-MM-dd"), "hour": F.date_format(ts, "HH")})
