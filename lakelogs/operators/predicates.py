"""Filters over log and access-log tables. Every one is a plain predicate, so it reaches the Parquet scan."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelogs.functions.levels import LEVEL_WORDS, contains_ci
from lakelogs.schema import label_column

#: Fields that are columns under another name.
FIELD_ALIASES = {"logStream": "log_stream_name", "logGroup": "log_group_name", "log": "log_group_name", "ingestionTime": "ingestion_time"}
LABEL_ALIASES = {"service_name": "service"}
ALB_LABELS = ("elb", "request_method", "type", "domain_name", "client_ip", "ssl_protocol")


def any_of(parts: Sequence[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def all_of(parts: Sequence[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


# --- streams, time, labels ----------------------------------------------------------------------------------


def by_stream(df: DataFrame, group: str | Sequence[str] | None = None, stream: str | None = None) -> DataFrame:
    """Rows of a group, or of any of several groups, and of a stream."""
    if group:
        df = df.filter(F.col("log_group_name") == group if isinstance(group, str) else F.col("log_group_name").isin(*group))
    return df.filter(F.col("log_stream_name") == stream) if stream else df


def by_streams(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.filter(F.col("log_stream_name").isin(*names))


def by_stream_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.filter(F.col("log_stream_name").startswith(prefix))


def in_range(df: DataFrame, start: datetime | None = None, end: datetime | None = None, ts: str = "timestamp") -> DataFrame:
    """Both ends inclusive; where the table has ``date`` partitions, their implied range as well, so that other days aren't listed."""
    for bound, op in ((start, ">="), (end, "<=")):
        if bound is not None:
            time = F.lit(bound).cast("timestamp_ntz")
            df = df.filter(F.col(ts) >= time if op == ">=" else F.col(ts) <= time)
            if "date" in df.columns:
                day = f"{bound:%Y-%m-%d}"
                df = df.filter(F.col("date") >= day if op == ">=" else F.col("date") <= day)
    return df


def _label(df: DataFrame, name: str) -> Column | None:
    """The column of a label or field, null if the table has none."""
    name = LABEL_ALIASES.get(name, name)
    for c in (label_column(name), name):
        if c in df.columns:
            return F.col(c)
    return None


def by_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """All labels equal; an empty value means any; a label that the table doesn't have matches no row."""
    for name, value in labels.items():
        if value:
            col = _label(df, name)
            df = df.filter(F.lit(False) if col is None else col == value)
    return df


def match(df: DataFrame, matchers: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Selector matchers (label, op, value) with = != =~ !~; regexes match the whole value, a missing label is ``""``."""
    for name, op, value in matchers:
        col = _label(df, name)
        value_of = F.lit("") if col is None else F.coalesce(col, F.lit(""))
        if op == "=~" and value in (".+", ".*"):
            continue  # only names the grouping label
        test = {"=": value_of == value, "!=": value_of != value, "=~": value_of.rlike(f"^(?:{value})$"), "!~": ~value_of.rlike(f"^(?:{value})$")}[op]
        df = df.filter(test)
    return df


# --- text ---------------------------------------------------------------------------------------------------


def by_text(df: DataFrame, text: str) -> DataFrame:
    """Message contains the text, literal and case-insensitive."""
    return df.filter(contains_ci(F.col("message"), text))


def by_levels(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Message contains a keyword of one of the levels; levels that are all unknown don't filter."""
    words = [w for level in levels for w in LEVEL_WORDS.get(level.lower(), ())]
    return df.filter(any_of([contains_ci(F.col("message"), w) for w in words])) if words else df


def line_filter(df: DataFrame, op: str, text: str) -> DataFrame:
    """|= contains, != doesn't, |~ matches a regex, !~ doesn't."""
    message = F.col("message")
    return df.filter({"|=": lambda: contains_ci(message, text), "!=": lambda: ~contains_ci(message, text), "|~": lambda: message.rlike(text), "!~": lambda: ~message.rlike(text)}[op]())


def json_field(col: Column, field: str) -> Column:
    """A top-level field of a JSON text, null if the text isn't JSON."""
    return F.get_json_object(col, f"$.{field}")


def label_filter(df: DataFrame, field: str, op: str, value: Any, source: str = "message") -> DataFrame:
    """A condition on a parsed JSON field: = != =~ !~ on text, and > >= < <= on numbers (text that isn't one doesn't match)."""
    text = json_field(F.col(source), field)
    if op in ("=", "!=", "=~", "!~") and not isinstance(value, int | float):
        text = F.coalesce(text, F.lit(""))
        return df.filter({"=": text == value, "!=": text != value, "=~": text.rlike(f"^(?:{value})$"), "!~": ~text.rlike(f"^(?:{value})$")}[op])
    n, v = text.try_cast("double"), F.lit(float(value))
    return df.filter({"=": n == v, "!=": n != v, ">": n > v, ">=": n >= v, "<": n < v, "<=": n <= v}[op])


# --- filter patterns ----------------------------------------------------------------------------------------


def filter_pattern(message: Column, pattern: str | None) -> Column:
    """The Logs-API pattern as a predicate: empty or ALL; ``[k=v, ...]``; ``f like /re/``; ``!word`` ...; plain text."""
    pattern = (pattern or "").strip()
    if not pattern or pattern.upper() == "ALL":
        return F.lit(True)
    if pattern.startswith("[") and pattern.endswith("]"):
        tests = []
        for part in filter(None, (p.strip() for p in pattern[1:-1].split(","))):
            if m := re.fullmatch(r"msg\s*!=\s*\"?(.*?)\"?", part):
                tests.append(~message.contains(m[1]))
            elif key := re.split(r"!?=", part)[0].strip():
                tests.append(message.contains(f'"{key}"'))
        return all_of(tests)
    if m := re.fullmatch(r".*?\blike\s+/(.*)/\s*", pattern, re.S):
        try:
            re.compile(m[1])
        except re.error:
            return contains_ci(message, m[1])
        return message.rlike(f"(?i){m[1]}")
    if "!" in pattern:
        words = re.findall(r"!(\S+)", pattern)
        if words:
            return all_of([~contains_ci(message, w) for w in words])
    return contains_ci(message, pattern)


# --- insights conditions ------------------------------------------------------------------------------------


def field_column(df: DataFrame, name: str) -> Column:
    """``@name`` and ``name`` are the same field; a field that the table lacks is ``""``."""
    name = name.removeprefix("@")
    name = FIELD_ALIASES.get(name, name)
    if name in df.columns:
        return F.col(name)
    return F.col(label_column(name)) if label_column(name) in df.columns else F.lit("")


def condition(df: DataFrame, cond: tuple | Column) -> Column:
    """A nested condition as a predicate.

    ("and" | "or", c, c, ...), ("not", c), or (op, field, value) with op one of: like, not like (case-insensitive text);
    =~, like/, not like/ (regex); = != (case-insensitive); < <= > >= (as numbers where both are, else as text); in (exact)."""
    if isinstance(cond, Column):
        return cond
    op, *rest = cond
    if op in ("and", "or"):
        return (all_of if op == "and" else any_of)([condition(df, c) for c in rest])
    if op == "not":
        return ~condition(df, rest[0])
    field, value = rest
    text = F.coalesce(field_column(df, field).cast("string"), F.lit(""))
    if op == "in":
        return text.isin(*map(str, value))
    if op in ("like", "not like"):
        return contains_ci(text, value) if op == "like" else ~contains_ci(text, value)
    if op in ("=~", "like/", "not like/"):
        return ~text.rlike(value) if op == "not like/" else text.rlike(value)
    if op in ("=", "!="):
        same = F.lower(text) == str(value).lower()
        return same if op == "=" else ~same
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    as_text = compare(text, F.lit(str(value)))
    try:
        wanted = float(value)
    except ValueError:
        return as_text
    number = text.try_cast("double")
    return F.when(number.isNotNull(), compare(number, F.lit(wanted))).otherwise(as_text)


def insights_where(df: DataFrame, cond: tuple | Column) -> DataFrame:
    return df.filter(condition(df, cond))


# --- access logs --------------------------------------------------------------------------------------------


def alb_where(df: DataFrame, start: datetime | None = None, end: datetime | None = None, labels: Mapping[str, Any] | None = None) -> DataFrame:
    """Time range and labels of an access-log table; service_name is the load balancer, a status that is no number matches nothing."""
    df = in_range(df, start, end, ts="time")
    for name, value in (labels or {}).items():
        name = "elb" if name == "service_name" else name
        if value in ("", None):
            continue
        if name == "elb_status_code":
            df = df.filter(F.col(name) == F.lit(str(value)).try_cast("int"))
        else:
            df = df.filter(F.col(name) == value if name in ALB_LABELS else F.lit(False))
    return df


def alb_search(df: DataFrame, text: str) -> DataFrame:
    """Text in the path, the status or the client address."""
    return df.filter(any_of([contains_ci(F.col(c).cast("string"), text) for c in ("request_path", "elb_status_code", "client_ip")]))


# --- events -------------------------------------------------------------------------------------------------


def newest(df: DataFrame, limit: int | None, ts: str = "timestamp", descending: bool = False, tiebreak: Sequence[str] = ("sequence_token",)) -> DataFrame:
    """Sorted by time and a tiebreak, then limited (a top-k, no full sort)."""
    keys = [F.col(c) for c in (ts, *tiebreak) if c in df.columns]
    out = df.orderBy(*[k.desc() if descending else k.asc() for k in keys])
    return out.limit(limit) if limit is not None else out


def get_events(df: DataFrame, group: str, stream: str | None = None, start: datetime | None = None, end: datetime | None = None, limit: int = 10_000, newest_first: bool = False) -> DataFrame:
    return newest(in_range(by_stream(df, group, stream), start, end), limit, descending=newest_first)


def filter_events(df: DataFrame, group: str, prefix: str = "", pattern: str = "", start: datetime | None = None, end: datetime | None = None, limit: int = 10_000) -> DataFrame:
    rows = in_range(by_stream(df, group), start, end)
    rows = by_stream_prefix(rows, prefix) if prefix else rows
    return newest(rows.filter(filter_pattern(F.col("message"), pattern)), limit)
