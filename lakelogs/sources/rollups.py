"""Partial aggregates of a table's batches, kept beside them: catalogues, volumes, cardinalities and quantiles without a scan of rows.

A kind (``Kind``) says what is kept for each hour of each batch: sums, first and last times, mergeable sketches. It is stored under
the batch's own name (``_partials/<kind>/date=/hour=/batch=``), so what is stored and what isn't can be told from folder names.
``merged`` takes the stored partials of the hours that a range covers and of batches that the table has now, and aggregates the raw
rows of the rest alike: hours that the range cuts, batches without partials, batches that aren't written whole. Its result is that of
a scan, whatever has been refreshed. ``store_batch`` stores them with a batch (``kinds`` of a stream), ``refresh`` adds what is missing and drops what is stale; ``append_table`` drops the partials of a
batch that it replaces; ``compact_partials`` compacts a table and folds the merged batches' partials instead of reading rows again.

Sketches are Spark's own: HyperLogLog (2^12 registers, 1.6 % standard error) for numbers of different values, KLL (k = 800, below 0.5 % of
rank) for quantiles.

Edges: rows without a time belong to no range, and are in results without one; an empty table has no partials; null labels stay null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelogs.functions.parsing import logfmt_pairs
from lakelogs.functions.times import epoch_seconds, floor_to
from lakelogs.operators.metrics import group_columns, message_bytes
from lakelogs.operators.windows import STREAM, share
from lakelogs.schema import ALB_SCHEMA, LABELS, LOG_SCHEMA, label_column
from lakelogs.sources.paths import exists, folders, matching, remove
from lakelogs.sources.tables import NO_VALUE, PARTIALS, _hours, _pending, _scan, commit_rewrite, finish_swaps

HLL_BITS = 12
KLL_K = 800
Slot = tuple[str, str, str]


@dataclass(frozen=True)
class Kind:
    """What is kept of an hour of a batch: a row a key, its values from rows, and how two of a value become one."""

    name: str
    keys: tuple[str, ...]
    values: Mapping[str, tuple[Callable[[], Column], Callable[[Column], Column]]]
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda rows: rows)
    schema: T.StructType = field(default=LOG_SCHEMA)
    ts: str = "timestamp"

    def of_rows(self, rows: DataFrame) -> DataFrame:
        return self.prepare(rows).groupBy("date", "hour", "batch", *self.keys).agg(*[make().alias(n) for n, (make, _) in self.values.items()])

    def merge(self, parts: DataFrame, *by: Column | str) -> DataFrame:
        return parts.groupBy(*by).agg(*[join(F.col(n)).alias(n) for n, (_, join) in self.values.items()])


def _labels(names: Sequence[str]) -> tuple[str, ...]:
    return tuple(label_column(c) for c in names)


def streams_kind(labels: Sequence[str] = LABELS) -> Kind:
    """Rows, bytes, first and last times for each stream and label set: groups, streams, series, label values, volumes."""
    low, high = (lambda c: lambda: F.min(c)), (lambda c: lambda: F.max(c))
    values = {
        "n": (lambda: F.count("*"), F.sum), "bytes": (message_bytes, F.sum), "first_event": (low("timestamp"), F.min), "last_event": (high("timestamp"), F.max),
        "first_ingestion": (low("ingestion_time"), F.min), "last_ingestion": (high("ingestion_time"), F.max),
    }
    return Kind("streams", (*STREAM, *_labels(labels)), values)


def _hll(column: Callable[[], Column]) -> tuple[Callable[[], Column], Callable[[Column], Column]]:
    return (lambda: F.hll_sketch_agg(column(), HLL_BITS)), F.hll_union_agg


def labels_kind(labels: Sequence[str] = LABELS) -> Kind:
    """One row an hour: rows, bytes, and a sketch of the different streams and of each label's values."""
    key = lambda: F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in (*STREAM, "label_env", "label_service")]))
    sketches = {c: _hll(lambda c=c: F.nullif(F.col(c), F.lit(""))) for c in _labels(labels)}
    return Kind("labels", (), {"n": (lambda: F.count("*"), F.sum), "bytes": (message_bytes, F.sum), "streams": _hll(key), **sketches})


def fields_kind() -> Kind:
    """For each field of logfmt messages: rows, whether all values are numbers, a sketch of the values."""
    numeric = lambda: F.every(F.col("value").try_cast("double").isNotNull())
    pairs = lambda rows: rows.select("date", "hour", "batch", F.explode(logfmt_pairs(F.col("message"))).alias("field", "value"))
    return Kind("fields", ("field",), {"n": (lambda: F.count("*"), F.sum), "numeric": (numeric, F.every), "sketch": _hll(lambda: F.col("value"))}, pairs)


def quantiles_kind(name: str, value: Callable[[], Column], by: Sequence[str] = (), schema: T.StructType = LOG_SCHEMA, ts: str = "timestamp") -> Kind:
    """A quantile sketch of a number, and how many there are, for each label set of ``by``."""
    keyed = lambda rows: rows.select("date", "hour", "batch", *group_columns(rows, by), value().cast("double").alias("_value"))
    sketch = (lambda: F.kll_sketch_agg_double("_value", F.lit(KLL_K)), lambda c: F.kll_merge_agg_double(c, F.lit(KLL_K)))
    return Kind(name, tuple(by), {"n": (lambda: F.count("_value"), F.sum), "low": (lambda: F.min("_value"), F.min), "high": (lambda: F.max("_value"), F.max), "sketch": sketch}, keyed, schema, ts)


def latency_kind() -> Kind:
    """Target times of access logs; negative ones are no times."""
    target = lambda: F.when(F.col("target_processing_time") >= 0, F.col("target_processing_time"))
    return quantiles_kind("latency", target, (), ALB_SCHEMA, "time")


def requests_kind(by: Sequence[str] = ("elb", "request_method", "ssl_protocol"), name: str = "requests") -> Kind:
    """Requests and bytes of access logs for each status code and values of ``by``. Rates, shares and totals come from a few rows an
    hour; with paths or clients in ``by`` (under a name of its own), a row for each different one, for the top ones."""
    values = {"n": (lambda: F.count("*"), F.sum), "received": (lambda: F.sum("received_bytes"), F.sum), "sent": (lambda: F.sum("sent_bytes"), F.sum)}
    return Kind(name, ("elb_status_code", *by), values, schema=ALB_SCHEMA, ts="time")


# --- what is stored ------------------------------------------------------------------------------------------


def _home(path: str, kind: Kind) -> str:
    return f"{path}/{PARTIALS}/{kind.name}"


def _slots(spark: SparkSession, path: str) -> set[Slot]:
    return {(d, h, b) for d in folders(spark, path) if d.startswith("date=") for h in folders(spark, f"{path}/{d}") for b in folders(spark, f"{path}/{d}/{h}")}


def _rows_of(spark: SparkSession, path: str, kind: Kind, slots: Sequence[Slot]) -> DataFrame:
    reader = spark.read.schema(T.StructType([*kind.schema.fields, T.StructField("batch", T.StringType())])).option("basePath", path)
    return reader.parquet(*["/".join((path, *s)) for s in sorted(slots)])


def _store(parts: DataFrame, path: str, kind: Kind) -> None:
    parts.repartition("date", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "hour", "batch").parquet(_home(path, kind))


def refresh(spark: SparkSession, path: str, kinds: Sequence[Kind]) -> int:
    """Store the partials of whole batches that have none, drop those of batches that are gone; returns how many were stored."""
    whole, added = {(d, h, b) for d, h, batches in _hours(spark, path) for b in batches}, 0
    for kind in kinds:
        stored = _slots(spark, _home(path, kind))
        for slot in stored - whole:
            remove(spark, "/".join((_home(path, kind), *slot)))
        if missing := whole - stored:
            _store(kind.of_rows(_rows_of(spark, path, kind, missing)), path, kind)
            # A batch whose rows give nothing (no field at all) is known by an empty folder.
            for slot in missing:
                _mark(spark, "/".join((_home(path, kind), *slot)))
            added += len(missing)
    return added


def _mark(spark: SparkSession, folder: str) -> None:
    if not exists(spark, folder):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def store_batch(spark: SparkSession, path: str, kinds: Sequence[Kind], batch: str) -> None:
    """Store the partials of a batch from its rows in the table; of its files only the columns that a kind needs are read. Written again
    they replace themselves; a batch that compaction has merged meanwhile is no more, nor are its partials."""
    if kinds and matching(spark, f"{path}/date=*/hour=*/batch={batch}"):
        for kind in kinds:
            _store(kind.of_rows(_scan(spark, path, kind.schema).filter(F.col("batch") == batch)), path, kind)


def compact_partials(spark: SparkSession, path: str, kinds: Sequence[Kind], min_files: int = 2) -> int:
    """As ``compact``, with the partials of the batches that it merges folded into those of the new ones; returns the hours merged."""
    finish_swaps(spark, path)
    schema, ts = kinds[0].schema, kinds[0].ts
    hours = [x for x in _hours(spark, path) if len(x[2]) >= min_files]
    commit_rewrite(spark, path, schema, hours, ts)
    for _, swap in _pending(spark, path):
        for kind in kinds:
            stored = _slots(spark, _home(path, kind))
            ready = [(*hour.split("/"), b) for hour, old in swap["hours"].items() if all((*hour.split("/"), b) in stored for b in old) for b in old]
            if ready:
                folded = kind.merge(_read(spark, path, kind, ready), "date", "hour", *kind.keys).withColumn("batch", F.lit(swap["batch"].removeprefix("batch=")))
                _store(folded, path, kind)
            for day, hour, _ in ready:
                _mark(spark, f"{_home(path, kind)}/{day}/{hour}/{swap['batch']}")
    finish_swaps(spark, path)
    refresh(spark, path, kinds)
    return len(hours)


def _read(spark: SparkSession, path: str, kind: Kind, slots: Sequence[Slot]) -> DataFrame:
    shape = kind.of_rows(_scan(spark, path, kind.schema)).schema
    return spark.read.schema(shape).option("basePath", _home(path, kind)).parquet(*["/".join((_home(path, kind), *s)) for s in sorted(slots)])


# --- what is asked -------------------------------------------------------------------------------------------


def _hour_start(slot: Slot) -> datetime | None:
    day, hour = (x.partition("=")[2] for x in slot[:2])
    return None if NO_VALUE in (day, hour) else datetime.strptime(f"{day} {hour}", "%Y-%m-%d %H")


def merged(spark: SparkSession, path: str, kind: Kind, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Partials (date, hour, batch, keys..., values...) of all rows between two times, both included."""
    slots, stored = _slots(spark, path), _slots(spark, _home(path, kind))
    low, high = start or datetime.min, end or datetime.max
    ranged = start is not None or end is not None
    whole, cut = [], []
    for slot in slots:
        at = _hour_start(slot)
        if at is None:
            (whole if slot in stored else cut).append(slot) if not ranged else None
        elif at <= high and at + timedelta(hours=1) > low:
            inside = at >= low and at + timedelta(hours=1) - timedelta(microseconds=1) <= high
            (whole if inside and slot in stored else cut).append(slot)
    begun = slots - {(d, h, b) for d, h, batches in _hours(spark, path) for b in batches}
    cut, whole = cut + [s for s in whole if s in begun], [s for s in whole if s not in begun]
    parts = []
    if whole:
        parts.append(_read(spark, path, kind, whole))
    if cut or not parts:
        rows = _rows_of(spark, path, kind, cut) if cut else _scan(spark, path, kind.schema).limit(0)
        rows = rows.filter(F.col(kind.ts) >= start) if start is not None else rows
        parts.append(kind.of_rows(rows.filter(F.col(kind.ts) <= end) if end is not None else rows))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def log_groups(parts: DataFrame, kind: Kind, prefix: str = "", limit: int = 50) -> DataFrame:
    """``catalog.log_groups`` from partials of streams."""
    rows = kind.merge(parts.filter(F.col("log_group_name").startswith(prefix)) if prefix else parts, "log_group_name")
    return rows.select("log_group_name", F.col("first_ingestion").alias("creation_time"), F.col("bytes").alias("stored_bytes")).orderBy("log_group_name").limit(limit)


def log_streams(parts: DataFrame, kind: Kind, group: str, limit: int = 50) -> DataFrame:
    """``catalog.log_streams`` from partials of streams, by name."""
    rows = kind.merge(parts.filter(F.col("log_group_name") == group), "log_stream_name")
    columns = [F.col("first_ingestion").alias("creation_time"), "first_event", "last_event", "last_ingestion", F.col("bytes").alias("stored_bytes")]
    return rows.select("log_stream_name", *columns).orderBy("log_stream_name").limit(limit)


def volume(parts: DataFrame, kind: Kind, by: str) -> DataFrame:
    """``catalog.volume`` from partials of streams."""
    return kind.merge(parts, *group_columns(parts, [by])).select(by, "bytes", F.col("n").alias("lines"))


def volume_range(parts: DataFrame, kind: Kind, by: str, step: int) -> DataFrame:
    """``catalog.volume_range`` in steps of whole hours."""
    return kind.merge(parts.filter("date IS NOT NULL"), _bucket(step).alias("bucket"), *group_columns(parts, [by])).select("bucket", by, F.col("bytes").alias("value"))


def _bucket(step: int) -> Column:
    if step % 3600:
        raise ValueError("partials are by the hour; steps must be whole hours")
    return floor_to(epoch_seconds(F.to_timestamp_ntz(F.concat_ws(" ", "date", "hour"), F.lit("yyyy-MM-dd HH"))), step)


def index_stats(parts: DataFrame, kind: Kind) -> DataFrame:
    """``catalog.index_stats`` from sketches: the streams are an estimate, all else is exact."""
    rows, entries = kind.merge(parts), F.coalesce("n", F.lit(0))
    chunks = F.greatest(F.lit(1), F.call_function("div", entries, F.lit(1000))).cast("long")
    return rows.select(F.coalesce(F.hll_sketch_estimate("streams"), F.lit(0)).alias("streams"), chunks.alias("chunks"), entries.alias("entries"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def detected_labels(parts: DataFrame, kind: Kind) -> DataFrame:
    """``catalog.detected_labels`` from sketches."""
    names = [c for c in parts.columns if c.startswith("label_")]
    wide = kind.merge(parts).select(*[F.coalesce(F.hll_sketch_estimate(c), F.lit(0)).alias(c) for c in names])
    return wide.unpivot([], names, "column", "cardinality").filter("cardinality > 0").select(F.regexp_replace("column", "^label_", "").alias("label"), "cardinality")


def detected_fields(parts: DataFrame, kind: Kind) -> DataFrame:
    """``catalog.detected_fields`` from sketches."""
    rows = kind.merge(parts, "field")
    return rows.select("field", F.when(F.col("numeric"), "number").otherwise("string").alias("type"), F.hll_sketch_estimate("sketch").alias("cardinality"), F.lit("logfmt").alias("parser"))


def quantiles(parts: DataFrame, kind: Kind, ranks: Mapping[str, float], step: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(bucket, by..., n, one column a rank): quantiles over steps of whole hours, or over everything; groups without a number are left out."""
    keys = ([_bucket(step).alias("bucket")] if step else []) + list(by)
    rows = kind.merge(parts.filter("n > 0" if not step else "n > 0 AND date IS NOT NULL"), *keys).filter("n > 0")
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in ranks.items()]
    return rows.select(*(["bucket"] if step else []), *by, "n", "low", "high", *found)


def _hits(low: int, high: int | None = None) -> Column:
    status = F.col("elb_status_code")
    hit = status >= low if high is None else (status >= low) & (status < high)
    return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0))


def _positive(hits: Column) -> Column:
    return F.nullif(hits, F.lit(0)).cast("double")


#: metric -> aggregate over partials of requests; null where the bucket has no value, as in ``alb.METRICS``.
REQUEST_METRICS: Mapping[str, Callable[[], Column]] = {
    "request_rate": lambda: F.sum("n").cast("double"),
    "error_rate": lambda: _positive(_hits(400)),
    "error_rate_pct": lambda: F.round(F.lit(100.0) * _hits(400) / F.sum("n"), 4),
    "2xx_rate": lambda: _positive(_hits(200, 300)),
    "3xx_rate": lambda: _positive(_hits(300, 400)),
    "4xx_rate": lambda: _positive(_hits(400, 500)),
    "5xx_rate": lambda: _positive(_hits(500)),
    "bandwidth_in": lambda: F.sum("received").cast("double"),
    "bandwidth_out": lambda: F.sum("sent").cast("double"),
}


def request_metrics(parts: DataFrame, metrics: Sequence[str] = tuple(REQUEST_METRICS), step: int = 3600) -> DataFrame:
    """``alb.alb_metrics`` but for latencies, in steps of whole hours: (metric, bucket, value)."""
    wide = parts.filter("date IS NOT NULL").groupBy(_bucket(step).alias("bucket")).agg(*[REQUEST_METRICS[m]().alias(m) for m in metrics])
    return wide.unpivot(["bucket"], list(metrics), "metric", "value").filter("value IS NOT NULL").select("metric", "bucket", "value")


def requests_by(parts: DataFrame, *by: Column | str, step: int | None = None) -> DataFrame:
    """(bucket, by..., requests, errors, received_bytes, sent_bytes): the counts behind the shares and dashboards by column."""
    parts = parts.filter("date IS NOT NULL") if step else parts
    keys = ([_bucket(step).alias("bucket")] if step else []) + list(by)
    return parts.groupBy(*keys).agg(F.sum("n").alias("requests"), _hits(400).alias("errors"), F.sum("received").alias("received_bytes"), F.sum("sent").alias("sent_bytes"))


def status_distribution(parts: DataFrame) -> DataFrame:
    """``alb.status_distribution`` from partials of requests."""
    counts = requests_by(parts.filter("elb_status_code IS NOT NULL"), F.col("elb_status_code").alias("status")).select("status", F.col("requests").alias("cnt"))
    return share(counts, "cnt", 2).orderBy("status")


def top_requests(parts: DataFrame, column: str, name: str, n: int = 20) -> DataFrame:
    """``alb.top_paths`` and ``alb.top_ips`` from partials of requests by that column: (name, requests, errors, error_pct)."""
    rows = requests_by(parts.filter(F.col(column).isNotNull()), F.col(column).alias(name)).select(name, "requests", "errors")
    return rows.orderBy(F.desc("requests"), name).limit(n).withColumn("error_pct", F.round(F.lit(100.0) * F.col("errors") / F.col("requests"), 2))


def request_summary(parts: DataFrame) -> DataFrame:
    """``alb.alb_summary`` but for latencies: one row, zeros for an empty table."""
    total, zero = F.coalesce(F.sum("n"), F.lit(0)), F.lit(0)
    return parts.agg(
        total.alias("total_requests"), _hits(400).alias("total_errors"),
        F.coalesce(F.round(F.lit(100.0) * _hits(400) / F.nullif(total, zero), 2), F.lit(0.0)).alias("error_rate_pct"),
        F.coalesce(F.sum("received"), zero).alias("total_rx_bytes"), F.coalesce(F.sum("sent"), zero).alias("total_tx_bytes"),
    )
