"""Time-bucketed log metrics. One partial and one final hash aggregate each; buckets without rows don't appear."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelogs.functions.insights import FUNCTIONS, bin_millis, number
from lakelogs.functions.levels import detected_level
from lakelogs.functions.times import bucket
from lakelogs.operators.predicates import field_column, in_range
from lakelogs.schema import label_column


def group_columns(df: DataFrame, by: Sequence[str]) -> list[Column]:
    """Grouping labels by their given names; a null label is ``unknown``, ``detected_level`` is read from the message."""
    out = []
    for name in by:
        if name == "detected_level":
            out.append(detected_level(F.col("message")).alias(name))
        else:
            col = name if name in df.columns else label_column(name)
            out.append(F.coalesce(F.col(col) if col in df.columns else F.lit(None).cast("string"), F.lit("unknown")).alias(name))
    return out


def over_time(df: DataFrame, value: Column, step: int, by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """An aggregate per (bucket, labels): (bucket, labels..., value)."""
    return df.groupBy(bucket(F.col(ts), step).alias("bucket"), *group_columns(df, by)).agg(value.alias("value"))


def count_over_time(df: DataFrame, step: int, by: Sequence[str] = ()) -> DataFrame:
    return over_time(df, F.count("*"), step, by)


def rate(df: DataFrame, step: int, by: Sequence[str] = ()) -> DataFrame:
    return over_time(df, F.count("*") / F.lit(float(step)), step, by)


def message_bytes() -> Column:
    return F.sum(F.octet_length(F.coalesce(F.col("message"), F.lit("")))).cast("long")


def bytes_over_time(df: DataFrame, step: int, by: Sequence[str] = ()) -> DataFrame:
    return over_time(df, message_bytes(), step, by)


def bytes_rate(df: DataFrame, step: int, by: Sequence[str] = ()) -> DataFrame:
    return over_time(df, message_bytes() / F.lit(float(step)), step, by)


def _field(df: DataFrame, name: str) -> Column:
    col = field_column(df, name)
    return number(col)


def sum_over_time(df: DataFrame, field: str, step: int, by: Sequence[str] = ()) -> DataFrame:
    return over_time(df, F.sum(_field(df, field)), step, by)


def avg_over_time(df: DataFrame, field: str, step: int, by: Sequence[str] = ()) -> DataFrame:
    return over_time(df, F.avg(_field(df, field)), step, by)


def min_over_time(df: DataFrame, field: str, step: int, by: Sequence[str] = ()) -> DataFrame:
    return over_time(df, F.min(_field(df, field)), step, by)


def max_over_time(df: DataFrame, field: str, step: int, by: Sequence[str] = ()) -> DataFrame:
    return over_time(df, F.max(_field(df, field)), step, by)


def quantile_over_time(df: DataFrame, q: float, field: str, step: int, by: Sequence[str] = (), approx: bool = False) -> DataFrame:
    """Exact with linear interpolation; ``approx`` bounds the memory of a group whatever its size."""
    value = F.percentile_approx(_field(df, field), q, 10_000) if approx else F.percentile(_field(df, field), q)
    return over_time(df, value, step, by)


AGGREGATES = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}


def aggregate_series(matrix: DataFrame, fn: str, by: Sequence[str] = ()) -> DataFrame:
    """``sum by (...)`` over a per-series matrix."""
    return matrix.groupBy("bucket", *by).agg(AGGREGATES[fn]("value").alias("value"))


def instant_count(df: DataFrame, at: datetime, lookback: int = 3600, by: Sequence[str] = ()) -> DataFrame:
    """Rows in the look-back that ends at a time."""
    rows = in_range(df, at - timedelta(seconds=lookback), at)
    return rows.groupBy(*group_columns(rows, by)).agg(F.count("*").alias("value"))


def insights_stats(df: DataFrame, aggs: Sequence[tuple[str, str | None, str]], bin: tuple[int, str] | None = None, by: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    """``stats f(field) as alias, ... by bin(n unit), fields``; count takes a field or None; bins are epoch milliseconds."""
    keys = [bin_millis(F.col(ts), *bin).alias("bin")] if bin else []
    keys += [field_column(df, b).alias(b.removeprefix("@")) for b in by]
    values = [(F.count("*") if field in (None, "*") else F.count(field_column(df, field))).alias(alias) if fn == "count" else AGGREGATES[fn](_field(df, field)).alias(alias) for fn, field, alias in aggs]
    return df.groupBy(*keys).agg(*values)


def insights_fields(df: DataFrame, exprs: Sequence[tuple[str | tuple, str]]) -> DataFrame:
    """``fields a, f(b, ...) as c``: a field name or (function, field, literals...), with the name of the output column."""
    cols = []
    for expr, alias in exprs:
        if isinstance(expr, str):
            cols.append(field_column(df, expr).alias(alias))
        else:
            fn, field, *args = expr
            cols.append(FUNCTIONS[fn](field_column(df, field), *args).alias(alias))
    return df.select(*cols)


def insights_sort(df: DataFrame, field: str, direction: str = "desc", limit: int = 1000, tiebreak: Sequence[str] = ("sequence_token",)) -> DataFrame:
    keys = [field_column(df, field), *[F.col(c) for c in tiebreak if c in df.columns]]
    return df.orderBy(*[k.desc() if direction == "desc" else k.asc() for k in keys]).limit(limit)


def query_stats(df: DataFrame, matched: Column | None = None) -> DataFrame:
    """recordsMatched, recordsScanned and bytesScanned (characters of the messages) of a scan and its filter."""
    hit = F.coalesce(matched, F.lit(False)) if matched is not None else F.lit(True)
    return df.agg(
        F.count_if(hit).alias("records_matched"), F.count("*").alias("records_scanned"), F.coalesce(F.sum(F.length("message")), F.lit(0)).cast("long").alias("bytes_scanned")
    )
