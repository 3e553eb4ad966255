"""Partitioned Parquet tables of logs and access logs: scans, appends, maintenance.

A table is laid out as ``date=/hour=/batch=``. A batch is one flush or append: writing it again replaces it, so a replay
after a failure never doubles rows. A stream's batches carry its id, so that several streams can write to one table. A batch's hours
come into place one by one; a stream's batch is noted as done once they all have, and until then maintenance leaves it
alone and a replay writes it again. A replay of a batch that is done is skipped.
Compaction merges a partition's batches into one: it stages the new files and checks the counts, then commits a
journal that names the folders to swap and the last batch of each stream that they hold. From there on the swap is bound
to happen: whoever maintains the table next finishes the journals that a killed job left, step by step as the job
would have, and a late replay of a merged batch is skipped. Deletion and repartitioning swap by the same journals.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, date, datetime, timedelta
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakelogs.functions.parsing import alb_columns, alb_fields
from lakelogs.functions.times import with_partitions
from lakelogs.operators.predicates import by_labels, by_levels, by_stream, by_text, in_range, newest
from lakelogs.operators.reports import enriched
from lakelogs.schema import ALB_SCHEMA, LOG_SCHEMA, RAW_SCHEMA
from lakelogs.sources.ingest import to_log_rows
from lakelogs.sources.paths import commit_text, exists, files, folders, move, qualified, read_text, remove, remove_matching, write_text

PARTITIONS = ("date", "hour", "batch")
#: Folder of the rows whose partition value is null.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
#: Hidden folders of a table: the last merged batch of each stream, the stream batches that are written whole and not merged yet, and the
#: swaps that are under way.
_MARKS, _DONE, _SWAPS = "_marks", "_done", "_swaps"
#: Hidden folder of what ``sources.rollups`` keeps of the batches.
PARTIALS = "_partials"
#: Bytes of an hour that one task writes as one file when hours are rewritten.
FILE_BYTES = 256 << 20
#: Parts of an hour in which the times of its rows are ranked.
PARTS = 100
#: Notes of a stream's whole batches that are kept, at least; replays concern the last one.
KEPT_NOTES = 100
#: Columns whose row groups have Bloom filters, for lookups of single values: streams and traces.
LOOKUPS = ("log_stream_name", "trace_id")


# --- scans --------------------------------------------------------------------------------------------------


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """With the explicit schema partition values stay text, and columns that older files lack are null."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).parquet(path)


def read_logs(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: T.StructType = LOG_SCHEMA, partitions: bool = True) -> DataFrame:
    """A log table; filters on it reach the files, and on ``date`` and ``hour`` the folders."""
    df = _scan(spark, path, schema).drop("batch")
    df = df if partitions else df.drop("date", "hour")
    return df.select(*columns) if columns else df


def read_alb(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    return read_logs(spark, path, columns, ALB_SCHEMA)


def read_landing(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Landed JSON lines as log rows, with the same columns and filters as the table."""
    return with_partitions(to_log_rows(spark.read.schema(schema).json(path)))


def query_logs(
    table: DataFrame, landing: DataFrame | None = None, *, group: str | None = None, stream: str | None = None, start: datetime | None = None, end: datetime | None = None,
    labels: Mapping[str, str] | None = None, levels: Sequence[str] = (), text: str | None = None, where: Column | None = None, columns: Sequence[str] | None = None, limit: int | None = None,
) -> DataFrame:
    """Both tiers as one table, filtered, ascending by time, then limited; the filters are pushed to either tier."""
    both = table.unionByName(landing, allowMissingColumns=True) if landing is not None else table
    rows = in_range(by_stream(both, group, stream), start, end)
    rows = by_levels(by_labels(rows, labels or {}), levels)
    rows = by_text(rows, text) if text else rows
    rows = newest(rows.filter(where) if where is not None else rows, limit)
    return rows.select(*columns) if columns else rows


def parse_alb(lines: DataFrame, line: str = "value") -> DataFrame:
    """Text lines -> typed access-log rows; lines that aren't any are skipped."""
    # A generated column isn't computed again by what is above it.
    fields = lines.select(F.explode(F.array(alb_fields(F.col(line)))).alias("f")).filter("f IS NOT NULL")
    rows = fields.select(*[c.cast(ALB_SCHEMA[n].dataType).alias(n) for n, c in alb_columns(F.col("f")).items()])
    rows = with_partitions(rows.withColumn("ingestion_time", F.current_timestamp().cast("timestamp_ntz")), "time")
    return rows.select(*ALB_SCHEMA.fieldNames())


def read_alb_text(spark: SparkSession, paths: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """Raw access-log files, plain or ``.gz``. A gzip file is read by one task, so lines are dealt out before they are parsed: over
    ``partitions``, or over all cores if there are fewer gzip files than those."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    packed, cores = [f for f in lines.inputFiles() if f.endswith(".gz")], spark.sparkContext.defaultParallelism
    partitions = partitions or (cores if 0 < len(packed) < cores else None)
    return parse_alb(lines.repartition(partitions) if partitions else lines)


def register_alb_views(spark: SparkSession, path: str, name: str = "alb_logs") -> None:
    """SQL views of the table, and of the dataset with status classes."""
    table = read_alb(spark, path)
    table.createOrReplaceTempView(name)
    enriched(table).createOrReplaceTempView(f"{name}_enriched")


# --- writes -------------------------------------------------------------------------------------------------


def _slice(ts: str, files: Column) -> Column:
    """The part of its hour that an event falls into, of so many equal parts."""
    return F.floor(F.coalesce(F.pmod(F.unix_seconds(F.col(ts).cast("timestamp")), F.lit(3600)), F.lit(0)) * files / 3600).cast("int")


def _writer(df: DataFrame, lookups: Sequence[str]) -> DataFrameWriter:
    writer = df.write.partitionBy(*PARTITIONS)
    for c in lookups:
        if c in df.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
    return writer


def append_table(df: DataFrame, path: str, ts: str = "timestamp", batch: str | None = None, files_per_hour: int = 1, lookups: Sequence[str] = LOOKUPS) -> str:
    """Add rows as one batch, one file a partition (or a few for very large hours), sorted by time; returns the batch's name.
    New columns are allowed, columns that are missing stay null. ``lookups`` get Bloom filters."""
    if batch:
        remove_matching(df.sparkSession, f"{path}/{PARTIALS}/*/*/*/batch={batch}")  # of rows that are replaced
    batch = batch or f"a{uuid.uuid4().hex}"
    rows = with_partitions(df, ts).withColumn("batch", F.lit(batch))
    keys = ["date", "hour"] + ([_slice(ts, F.lit(files_per_hour))] if files_per_hour > 1 else [])
    # A fixed number of tasks: few rows in many hours are slow to write in one.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, *keys).sortWithinPartitions("date", "hour", ts)
    _writer(dealt, lookups).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return batch


def stream_batch(epoch: int, stream: str = "") -> str:
    return f"s{stream}-{epoch:012d}"


def _merged_until(spark: SparkSession, path: str, stream: str) -> str:
    """The last batch of a stream that compaction has merged, or is bound to."""
    marks = [read_text(spark, f"{path}/{_MARKS}/{stream or '-'}") or "", *(swap["marks"].get(stream, "") for _, swap in _pending(spark, path))]
    return max(marks)


def is_written(spark: SparkSession, path: str, epoch: int, stream: str = "") -> bool:
    """Whether all rows of a stream's batch are in the table."""
    batch = stream_batch(epoch, stream)
    return exists(spark, f"{path}/{_DONE}/{batch}") or batch <= _merged_until(spark, path, stream)


def write_epoch(df: DataFrame, epoch: int, path: str, ts: str = "timestamp", stream: str = "") -> bool:
    """One micro-batch of a stream; returns whether it was written. One that is written whole is skipped, one that a failure left between
    its hours is written again. Streams that write to one table must have different ids (``streaming.flush.stream_id``)."""
    if is_written(df.sparkSession, path, epoch, stream):
        return False
    append_table(df, path, ts, stream_batch(epoch, stream))
    write_text(df.sparkSession, f"{path}/{_DONE}/{stream_batch(epoch, stream)}", "")
    if epoch % KEPT_NOTES == 0 and epoch:  # older ones are whole, as the stream has gone on
        for note in files(df.sparkSession, f"{path}/{_DONE}"):
            if note.startswith("s") and _stream_of(note) == stream and note < stream_batch(max(epoch - KEPT_NOTES, 0), stream):
                remove(df.sparkSession, f"{path}/{_DONE}/{note}")
    return True


def route_and_append(df: DataFrame, tables: Mapping[str, str], default: str, route: str = "table", epoch: int | None = None, stream: str = "") -> None:
    """Each row to the table that it names; rows that name none, or an unknown one, to the default."""
    to = F.when(F.col(route).isin(*tables), F.col(route)).otherwise(F.lit(default))
    rows = df.withColumn(route, to).persist()
    try:
        for name, path in tables.items():
            mine = rows.filter(F.col(route) == name).drop(route)
            if epoch is None:
                append_table(mine, path)
            else:
                write_epoch(mine, epoch, path, stream=stream)
    finally:
        rows.unpersist()


# --- maintenance --------------------------------------------------------------------------------------------


def table_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(files, rows, bytes, last_commit) of a scanned table, from the files' metadata."""
    keys = [F.col(c) for c in by]
    files = df.select(*keys, F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b"), F.col("_metadata.file_modification_time").alias("t"))
    each = files.groupBy(*by, "f").agg(F.count("*").alias("n"), F.max("b").alias("b"), F.max("t").alias("t"))
    return each.groupBy(*by).agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.max("t").alias("last_commit"))


def _all_hours(spark: SparkSession, path: str) -> list[tuple[str, str, list[str]]]:
    return [(d, h, folders(spark, f"{path}/{d}/{h}")) for d in folders(spark, path) if d.startswith("date=") for h in folders(spark, f"{path}/{d}")]


def _stream_of(batch: str) -> str:
    return batch[1:].rpartition("-")[0]


def _hours(spark: SparkSession, path: str) -> list[tuple[str, str, list[str]]]:
    """(date folder, hour folder, folders of whole batches) of a table, from names alone. A stream's batch is whole once it is noted
    or the stream has gone on to a later one."""
    found, done = _all_hours(spark, path), set(files(spark, f"{path}/{_DONE}"))
    written = {b.removeprefix("batch=") for _, _, batches in found for b in batches}
    last: dict[str, str] = {}
    for name in (n for n in written | done if n.startswith("s")):
        last[_stream_of(name)] = max(name, last.get(_stream_of(name), ""))
    begun = {f"batch={name}" for name in last.values() if name not in done}
    kept = [(d, h, [b for b in batches if b not in begun]) for d, h, batches in found]
    return [x for x in kept if x[2]]


def _pending(spark: SparkSession, path: str) -> list[tuple[str, dict[str, Any]]]:
    """(name, journal) of the swaps that are committed but not done."""
    names = [n for n in files(spark, f"{path}/{_SWAPS}") if n.endswith(".json")]
    return [(n, json.loads(text)) for n in names if (text := read_text(spark, f"{path}/{_SWAPS}/{n}"))]


def finish_swaps(spark: SparkSession, path: str) -> int:
    """Do what the committed journals say, also those of jobs that were killed halfway; returns their number. Each step may be repeated."""
    swaps = _pending(spark, path)
    for name, swap in swaps:
        for hour, old in swap["hours"].items():
            for batch in old:
                remove(spark, f"{path}/{hour}/{batch}")
            staged, new = f"{swap['staged']}/{hour}/{swap['batch']}", f"{path}/{hour}/{swap['batch']}"
            if exists(spark, staged):
                move(spark, staged, new)
            if not folders(spark, f"{path}/{hour}"):
                remove(spark, f"{path}/{hour}")
        for stream, last in swap["marks"].items():
            if last > (read_text(spark, f"{path}/{_MARKS}/{stream or '-'}") or ""):
                write_text(spark, f"{path}/{_MARKS}/{stream or '-'}", last)
        for note in files(spark, f"{path}/{_DONE}"):  # the marks stand for them from here on
            if note <= swap["marks"].get(_stream_of(note), ""):
                remove(spark, f"{path}/{_DONE}/{note}")
        remove(spark, f"{path}/{_SWAPS}/{name}")
        remove(spark, swap["staged"])
    return len(swaps)


def _marks(hours: list[tuple[str, str, list[str]]]) -> dict[str, str]:
    """stream -> its last batch among the folders."""
    last: dict[str, str] = {}
    for _, _, batches in hours:
        for name in (b.removeprefix("batch=") for b in batches if b.startswith("batch=s")):
            last[_stream_of(name)] = max(name, last.get(_stream_of(name), ""))
    return last


def _place(cuts: str, value: Column, most: int) -> Column:
    """How many of the ascending cuts aren't above a value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))]) if most else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(F.col(cuts), at + step - 1) <= value, at + step).otherwise(at))


def _bounds(rows: DataFrame, ts: str, files: Mapping[tuple[str | None, str | None], int]) -> dict[tuple[str | None, str | None], list[int]]:
    """The first times of all files but the first, for each of the rows' hours: that many files of as many rows each, but for rows of one
    time, which stay together. Times are ranked within parts of an hour, which a sketch of its times gives."""
    spark, name = rows.sparkSession, lambda c: F.coalesce(c, F.lit(NO_VALUE)).alias(c)
    times = rows.select(name("date"), name("hour"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).filter("at IS NOT NULL")
    sketched = times.groupBy("date", "hour").agg(F.percentile_approx("at", [k / PARTS for k in range(1, PARTS)]).alias("cuts"), F.count("*").alias("total")).collect()
    # A row a busy hour. A sketch that is computed twice may differ, and ranks need the same parts on both sides.
    wanted = {(d or NO_VALUE, h or NO_VALUE): n for (d, h), n in files.items()}
    cuts = spark.createDataFrame([(*r, wanted[r["date"], r["hour"]]) for r in sketched if (r["date"], r["hour"]) in wanted], "date string, hour string, cuts array<long>, total long, files long")
    each = times.groupBy("date", "hour", "at").agg(F.count("*").alias("n")).join(F.broadcast(cuts), ["date", "hour"])
    each = each.withColumn("part", _place("cuts", F.col("at"), PARTS - 1)).drop("cuts")
    by = Window.partitionBy("date", "hour", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.groupBy("date", "hour", "part").agg(F.sum("n").alias("n"))
    earlier = parts.select("date", "hour", "part", F.coalesce(F.sum("n").over(Window.partitionBy("date", "hour").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = each.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0))).join(F.broadcast(earlier), ["date", "hour", "part"])
    file = F.expr("(earlier + before) * files div total").alias("file")
    first = ranked.groupBy("date", "hour", file).agg(F.min("at").alias("at")).groupBy("date", "hour").agg(F.sort_array(F.collect_list("at")).alias("cuts"))
    found = {(r["date"], r["hour"]): r["cuts"][1:] for r in first.collect()}  # a row a busy hour, a time a file
    return {(d, h): found.get((d or NO_VALUE, h or NO_VALUE), []) for d, h in files}


def commit_rewrite(spark: SparkSession, path: str, schema: T.StructType, hours: list[tuple[str, str, list[str]]], ts: str, keep: Column | None = None, file_bytes: int = FILE_BYTES, lookups: Sequence[str] = LOOKUPS) -> int:
    """Stage the named hours as one batch each, in files of about ``file_bytes``, check the counts and commit the swap, which
    ``finish_swaps`` carries out; returns the rows that weren't kept. A busy hour's files are time ranges with about as many rows each."""
    if not hours:
        return 0
    staged, batch = f"{path}_staged_{uuid.uuid4().hex}", f"c{uuid.uuid4().hex}"
    value = lambda folder: None if (v := folder.partition("=")[2]) == NO_VALUE else v
    old = {(value(d), value(h)): [f"{path}/{d}/{h}/{b}" for b in batches] for d, h, batches in hours}
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.StringType())])).option("basePath", path)
    rows = reader.parquet(*(f for fs in old.values() for f in fs)).drop("batch")
    each = rows.groupBy("date", "hour", F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("b"))
    sizes = each.groupBy("date", "hour").agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()  # from footers, a row an hour
    kept = rows.filter(keep) if keep is not None else rows
    kept, tasks = kept.withColumn("batch", F.lit(batch)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    worth = {(r["date"], r["hour"]): -(-r["b"] // file_bytes) for r in sizes if r["b"] > file_bytes}
    if worth:
        bounds = _bounds(reader.parquet(*(f for k in worth for f in old[k])), ts, worth)
        # A task writes a file of each of several hours, about FILE_BYTES in all; files of one hour have tasks of their own.
        size = sum(r["b"] for r in sizes if (r["date"], r["hour"]) in worth)
        busy = max(max(map(len, bounds.values())) + 1, -(-size // FILE_BYTES), min(tasks, sum(len(cuts) + 1 for cuts in bounds.values())))
        parts, first = [], 0
        for (d, h), cuts in bounds.items():  # a row a busy hour: its cuts, and the first of its tasks
            parts.append((d or NO_VALUE, h or NO_VALUE, cuts, first))
            first = (first + len(cuts) + 1) % busy
        known = spark.createDataFrame(parts, "d string, h string, cuts array<long>, first long")
        on = (F.coalesce("date", F.lit(NO_VALUE)) == F.col("d")) & (F.coalesce("hour", F.lit(NO_VALUE)) == F.col("h"))
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        part = _place("cuts", micros, max(map(len, bounds.values())))
        task = F.coalesce(tasks + (F.col("first") + part) % busy, F.pmod(F.hash("date", "hour"), F.lit(tasks)))
        # The cuts grow with the hour, so they stay out of the shuffle.
        dealt = kept.join(F.broadcast(known), on, "left").withColumn("task", task.cast("int")).drop("d", "h", "cuts", "first").repartitionById(tasks + busy, "task").drop("task")
    else:
        dealt = kept.repartition(tasks, "date", "hour")
    _writer(dealt.sortWithinPartitions("date", "hour", ts), lookups).parquet(staged)
    written = _scan(spark, staged, schema).count() if folders(spark, staged) else 0
    total = sum(r["n"] for r in sizes)
    if written != (rows.filter(keep).count() if keep is not None else total):
        remove(spark, staged)
        raise RuntimeError("the staged rows differ from the table's; nothing was changed")
    _commit_swap(spark, path, staged, batch, {f"{d}/{h}": batches for d, h, batches in hours}, _marks(hours))
    return total - written


def _commit_swap(spark: SparkSession, path: str, staged: str, batch: str, hours: dict[str, list[str]], marks: dict[str, str]) -> None:
    """The journal of a swap: in each hour the named batches go and the staged one, if it has the hour, comes."""
    swap = {"staged": staged, "batch": f"batch={batch}", "hours": hours, "marks": marks}
    commit_text(spark, f"{path}/{_SWAPS}/{uuid.uuid4().hex}.json", json.dumps(swap))


def compact(spark: SparkSession, path: str, min_files: int = 2, schema: T.StructType = LOG_SCHEMA, ts: str = "timestamp", file_bytes: int = FILE_BYTES) -> int:
    """Merge the batches of each hour that has ``min_files`` or more into one, ascending by time; returns the hours merged.
    Batches that arrive meanwhile, or that aren't written whole, stay beside it; a reader that lists the table during the swap may miss an hour's rows. Only one
    maintenance job runs on a table at a time."""
    finish_swaps(spark, path)
    hours = [x for x in _hours(spark, path) if len(x[2]) >= min_files]
    commit_rewrite(spark, path, schema, hours, ts, file_bytes=file_bytes)
    finish_swaps(spark, path)
    return len(hours)


def enforce_retention(spark: SparkSession, path: str, days: int = 7, now: date | None = None) -> list[str]:
    """Drop the days before ``days`` days ago; returns their folder names."""
    limit = f"date={(now or datetime.now(UTC).date()) - timedelta(days=days):%Y-%m-%d}"
    old = [d for d in folders(spark, path) if d.startswith("date=") and d < limit and "__HIVE" not in d]
    for d in old:
        remove(spark, f"{path}/{d}")
    return old


def _read_below(spark: SparkSession, source: DataFrame, path: str) -> set[tuple[str, str, str]]:
    """(date folder, hour folder, batch folder) of the files of a table that a frame reads, as it listed them."""
    base = f"{qualified(spark, path)}/"
    return {tuple(f.removeprefix(base).split("/")[:3]) for x in source.inputFiles() if (f := qualified(spark, unquote(x))).startswith(base)}


def commit_repartition(spark: SparkSession, source: DataFrame, path: str, ts: str = "timestamp", files_per_hour: int = 1) -> int:
    """Stage a table anew under the partitions of its event time, check the counts and commit the swap, which ``finish_swaps`` carries out;
    returns the rows. What the source has read of ``path`` (everything, if it reads something else) is replaced; batches that came after
    it was listed stay, and what was merged stays noted. A batch that isn't written whole can't be read over."""
    finish_swaps(spark, path)
    held, read = _hours(spark, path), _read_below(spark, source, path)
    if read - {(d, h, b) for d, h, batches in held for b in batches}:
        raise RuntimeError("the source reads batches that aren't written whole; nothing was changed")
    old = [(d, h, [b for b in batches if not read or (d, h, b) in read]) for d, h, batches in held]
    staged, batch = f"{path}_staged_{uuid.uuid4().hex}", f"m{uuid.uuid4().hex}"
    append_table(source.drop("date", "hour"), staged, ts, batch, files_per_hour)
    n = source.count()
    if (spark.read.parquet(staged).count() if folders(spark, staged) else 0) != n:
        remove(spark, staged)
        raise RuntimeError("the rewritten rows differ from the source; nothing was changed")
    hours = {f"{d}/{h}": batches for d, h, batches in old if batches}
    hours |= {f"{d}/{h}": hours.get(f"{d}/{h}", []) for d, h, _ in _hours(spark, staged)}
    _commit_swap(spark, path, staged, batch, hours, _marks(old))
    return n


def repartition_table(spark: SparkSession, source: DataFrame, path: str, ts: str = "timestamp", files_per_hour: int = 1) -> int:
    """``commit_repartition``, and the swap; streams may go on writing meanwhile."""
    n = commit_repartition(spark, source, path, ts, files_per_hour)
    finish_swaps(spark, path)
    return n


def delete_logs(spark: SparkSession, path: str, group: str, stream: str | None = None, schema: T.StructType = LOG_SCHEMA) -> int:
    """Delete a group or one stream by rewriting only the hours that hold rows of it, those without a time included; returns the
    rows deleted. A batch that isn't written whole yet counts as one that comes later."""
    finish_swaps(spark, path)
    folder = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(F.col(c), F.lit(NO_VALUE)))
    gone = by_stream(_scan(spark, path, schema), group, stream).select(folder("date").alias("d"), folder("hour").alias("h")).distinct()
    hit = {(r["d"], r["h"]) for r in gone.collect()}  # a row an hour at most
    test = F.coalesce(F.col("log_group_name") == group, F.lit(False))
    test = test & F.coalesce(F.col("log_stream_name") == stream, F.lit(False)) if stream else test
    deleted = commit_rewrite(spark, path, schema, [x for x in _hours(spark, path) if (x[0], x[1]) in hit], "timestamp", ~test)
    finish_swaps(spark, path)
    return deleted
