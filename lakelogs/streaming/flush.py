"""Structured Streaming jobs: landing files to tables, access-log files to tables, standing counts.

Each micro-batch is written under its own ``batch`` folder and noted once it is whole, and the checkpoint holds what has been
read: no row is lost and none is written twice, also over restarts. A stream's id is kept in its checkpoint and is part of
its batches' names, so several streams can fill one table, and a new checkpoint is a new stream. ``max_files`` and ``max_bytes``
bound a batch (flush by size), the trigger sets flush by time; without one the job catches up and ends. ``land`` refuses rows
while too many are waiting (back-pressure); a stream with ``clean`` deletes what it has written. ``resent`` drops the events that a
producer sends again within that time. ``kinds`` are partial aggregates that are kept beside each batch (``sources.rollups``).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from lakelogs.functions.levels import detected_level
from lakelogs.operators.metrics import AGGREGATES
from lakelogs.operators.windows import STREAM
from lakelogs.schema import LABELS, RAW_SCHEMA, label_column
from lakelogs.sources.ingest import to_log_rows
from lakelogs.sources.paths import commit_text, exists, files, move, read_text, remove, write_text
from lakelogs.sources.rollups import Kind, store_batch
from lakelogs.sources.tables import parse_alb, route_and_append, stream_batch, write_epoch


def _trigger(writer: DataStreamWriter, every: str | None) -> DataStreamWriter:
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the stream with this checkpoint; made and kept there at the first call."""
    at = f"{checkpoint.rstrip('/')}/stream_id"
    if not exists(spark, at):
        commit_text(spark, at, uuid.uuid4().hex[:12])
    return read_text(spark, at).strip()


def _files(spark: SparkSession, max_files: int | None, max_bytes: int | None = None, clean: bool = False):
    if max_files and max_bytes:
        raise ValueError("a batch is bounded by files or by bytes, not by both")
    reader = spark.readStream
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    reader = reader.option("maxBytesPerTrigger", max_bytes) if max_bytes else reader
    return reader.option("cleanSource", "delete") if clean else reader


class TooManyWaiting(RuntimeError):
    """As many rows wait to be flushed as may; try again after the next flush."""


#: Hidden folders of a landing folder: arrivals that are written but not admitted yet, and what is known of those that wait.
_STAGED, _ARRIVALS = "_staged", "_arrivals"
#: Seconds after which an arrival that was never admitted counts as given up.
LEASE = 600


def _flushed(spark: SparkSession, checkpoint: str, since: int, arrivals: Sequence[str]) -> dict[str, int]:
    """Files of each arrival that the stream has committed in batches after ``since``, by its own log of sources."""
    done = max((int(n) for n in files(spark, f"{checkpoint}/commits") if n.isdigit()), default=-1)
    logs = [n for n in files(spark, f"{checkpoint}/sources/0") if n.removesuffix(".compact").isdigit() and int(n.removesuffix(".compact")) > since]
    if done <= since or not logs:
        return {}
    entry = F.from_json("value", "path string, batchId long")
    lines = spark.read.text([f"{checkpoint}/sources/0/{n}" for n in logs]).select(entry.alias("e")).filter((F.col("e.batchId") > since) & (F.col("e.batchId") <= done))
    arrival = lines.select("e.path", F.regexp_extract("e.path", r"/([0-9]{20}[0-9a-f]{12})-[^/]*$", 1).alias("arrival"))
    counts = arrival.filter(F.col("arrival").isin(*arrivals)).groupBy("arrival").agg(F.count_distinct("path").alias("n"))
    return {r["arrival"]: r["n"] for r in counts.collect()}  # a row an arrival that waited


def _committed(spark: SparkSession, checkpoint: str | None) -> int:
    return max((int(n) for n in files(spark, f"{checkpoint}/commits") if n.isdigit()), default=-1) if checkpoint else -1


def _waiting(spark: SparkSession, source: str) -> dict[str, int]:
    """arrival -> its rows, for those that aren't flushed; the others are forgotten. Admitted arrivals are moved into place, should their
    writer have died before."""
    home, checkpoint = f"{source}/{_ARRIVALS}", read_text(spark, f"{source}/{_ARRIVALS}/checkpoint")
    known = {n: json.loads(text) for n in files(spark, home) if n.endswith((".asked", ".json")) and (text := read_text(spark, f"{home}/{n}"))}
    for n in [n for n in known if n.endswith(".asked") and time.time() - int(n[:20]) / 1e9 > LEASE]:
        remove(spark, f"{home}/{n}")
        remove(spark, f"{source}/{_STAGED}/{n[:32]}")
        del known[n]
    for n in (n for n in known if n.endswith(".json")):
        _put_in_place(spark, source, n[:32])
    waits = {n[:32]: e for n, e in known.items()}
    begun = {a: e["since"] if e["checkpoint"] == checkpoint else -1 for a, e in waits.items()}
    flushed = _flushed(spark, checkpoint, min(begun.values()), list(waits)) if checkpoint and waits else {}
    for a in [a for a, e in waits.items() if flushed.get(a, 0) >= e["files"] > 0 or (e["files"] == 0 and exists(spark, f"{home}/{a}.json"))]:
        remove(spark, f"{home}/{a}.json")
        del waits[a]
    return {a: e["rows"] for a, e in waits.items()}


def _put_in_place(spark: SparkSession, source: str, arrival: str) -> None:
    staged = f"{source}/{_STAGED}/{arrival}"
    for name in (n for n in files(spark, staged) if n.startswith("part-")):
        try:
            move(spark, f"{staged}/{name}", f"{source}/{arrival}-{name}")
        except OSError:  # another writer was faster
            if not exists(spark, f"{source}/{arrival}-{name}"):
                raise
    remove(spark, staged)


def waiting_rows(spark: SparkSession, source: str) -> int:
    """Rows that ``land`` has let in and that the folder's stream hasn't flushed."""
    return sum(_waiting(spark, source).values())


def land(df: DataFrame, source: str, most: int = 500_000) -> int:
    """Write rows to the landing folder, all or none: none if more than ``most`` rows would wait there then. Returns the rows
    that wait. What is flushed is told by the stream's own log of sources, so nothing that waits is read again, and the folder needn't be emptied.

    Rows are staged first (``df`` is evaluated once), then asked for, and all that is asked for or let in counts: of two writers at
    the same time at most one too few is let in, never one too many. Files that come into the folder otherwise aren't counted."""
    spark, arrival, seen = df.sparkSession, f"{time.time_ns():020d}{uuid.uuid4().hex[:12]}", Observation()
    staged, home = f"{source}/{_STAGED}/{arrival}", f"{source}/{_ARRIVALS}"
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.json(staged)
    checkpoint = read_text(spark, f"{home}/checkpoint")
    entry = {"rows": seen.get["rows"], "files": sum(n.startswith("part-") for n in files(spark, staged)), "checkpoint": checkpoint, "since": _committed(spark, checkpoint)}
    commit_text(spark, f"{home}/{arrival}.asked", json.dumps(entry))
    waiting = sum(_waiting(spark, source).values())
    if waiting > most:
        remove(spark, f"{home}/{arrival}.asked")
        remove(spark, staged)
        raise TooManyWaiting(f"{waiting - entry['rows']} rows wait, {entry['rows']} more would be over {most}")
    move(spark, f"{home}/{arrival}.asked", f"{home}/{arrival}.json")
    _put_in_place(spark, source, arrival)
    return waiting


def _take_over(spark: SparkSession, source: str, checkpoint: str) -> None:
    """Note whose log tells what of a landing folder is flushed. One stream empties a folder."""
    at = f"{source}/{_ARRIVALS}/checkpoint"
    if exists(spark, source) and read_text(spark, at) != checkpoint:
        _waiting(spark, source)  # what the stream before has flushed
        write_text(spark, at, checkpoint)


def without_resent(df: DataFrame, within: str) -> DataFrame:
    """One of the events of equal time, message and stream that arrive within some time of each other. Kept state is bounded by when
    events arrive, so that late ones aren't lost; a batch's time is in the checkpoint, so a replay decides alike."""
    timed = df.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    return timed.dropDuplicatesWithinWatermark(["timestamp", "message", *STREAM]).drop("_arrived")


def _write(path: str, ts: str, stream: str, kinds: Sequence[Kind]) -> Callable[[DataFrame, int], None]:
    """What a stream does with a micro-batch: its rows to the table, and its partials, from the rows as they are stored, beside them."""
    def write(df: DataFrame, epoch: int) -> None:
        write_epoch(df, epoch, path, ts, stream)
        store_batch(df.sparkSession, path, kinds, stream_batch(epoch, stream))

    return write


def stream_landing(
    spark: SparkSession, source: str, path: str, checkpoint: str, every: str | None = "60 seconds", max_files: int | None = None, max_bytes: int | None = None, clean: bool = False,
    schema: T.StructType = RAW_SCHEMA, resent: str | None = None, kinds: Sequence[Kind] = (),
) -> StreamingQuery:
    """Landed JSON lines -> log table; ``resent``: without what is sent again within that time."""
    rows, stream = to_log_rows(_files(spark, max_files, max_bytes, clean).schema(schema).json(source)), stream_id(spark, checkpoint)
    _take_over(spark, source, checkpoint)
    rows = without_resent(rows, resent) if resent else rows
    writer = rows.writeStream.foreachBatch(_write(path, "timestamp", stream, kinds)).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def stream_routed(spark: SparkSession, source: str, tables: Mapping[str, str], default: str, checkpoint: str, every: str | None = "60 seconds", max_files: int | None = None, max_bytes: int | None = None, schema: T.StructType = RAW_SCHEMA) -> StreamingQuery:
    """Landed JSON lines of several tables, each row to the table that it names."""
    stream = stream_id(spark, checkpoint)

    def write(df: DataFrame, epoch: int) -> None:
        rows = to_log_rows(df.withColumn("label__table", F.col("table")), (*LABELS, "_table")).withColumnRenamed("label__table", "table")
        route_and_append(rows, tables, default, epoch=epoch, stream=stream)

    writer = _files(spark, max_files, max_bytes).schema(schema).json(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def stream_alb(spark: SparkSession, source: str, path: str, checkpoint: str, every: str | None = "60 seconds", max_files: int | None = None, max_bytes: int | None = None, partitions: int | None = None, kinds: Sequence[Kind] = ()) -> StreamingQuery:
    """New access-log files, plain or ``.gz`` -> access-log table; a gzip file is read by one task, so lines are dealt out
    before they are parsed, over ``partitions`` or all cores."""
    lines, stream = _files(spark, max_files, max_bytes).text(source), stream_id(spark, checkpoint)
    rows = parse_alb(lines.repartition(partitions or spark.sparkContext.defaultParallelism))
    writer = rows.writeStream.foreachBatch(_write(path, "time", stream, kinds)).option("checkpointLocation", checkpoint)
    return _trigger(writer, every).start()


def stream_counts(df: DataFrame, step: int, by: Sequence[str] = (), delay: str = "10 minutes") -> DataFrame:
    """The standing twin of count_over_time on a streaming log frame: (bucket, labels..., value) once a bucket is past the watermark."""
    keys = [detected_level(F.col("message")).alias(b) if b == "detected_level" else F.coalesce(F.col(label_column(b)), F.lit("unknown")).alias(b) for b in by]
    timed = df.withColumn("_ts", F.col("timestamp").cast("timestamp")).withWatermark("_ts", delay)
    counts = timed.groupBy(F.window("_ts", f"{step} seconds").alias("w"), *keys).agg(F.count("*").alias("value"))
    return counts.select(F.unix_seconds("w.start").alias("bucket"), *by, "value")


def stream_series(df: DataFrame, step: int, by: Sequence[str], fn: str, outer: Sequence[str] = (), delay: str = "10 minutes") -> DataFrame:
    """``fn by (outer)`` over the standing counts, as ``aggregate_series`` over ``count_over_time``: two stateful steps, each closed by the
    same watermark. (bucket, outer..., value); rows that come after their bucket is closed are counted by ``late_rows``."""
    keys = [detected_level(F.col("message")).alias(b) if b == "detected_level" else F.coalesce(F.col(label_column(b)), F.lit("unknown")).alias(b) for b in by]
    timed = df.withColumn("_ts", F.col("timestamp").cast("timestamp")).withWatermark("_ts", delay)
    counts = timed.groupBy(F.window("_ts", f"{step} seconds").alias("w"), *keys).agg(F.count("*").alias("value"))
    series = counts.groupBy(F.window("w", f"{step} seconds").alias("w"), *outer).agg(AGGREGATES[fn]("value").alias("value"))
    return series.select(F.unix_seconds("w.start").alias("bucket"), *outer, "value")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a standing query has dropped, for they came after the watermark, in the batches that it still tells of."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
