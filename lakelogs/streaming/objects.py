"""Ingest by notifications: objects are read because a message names them, without listing the bucket.

A micro-batch of messages gives the paths that it names (``object_paths``), once each. Those in the ledger are known already: queues
deliver a message more than once, and several may name one object. The rest is read inside the batch, which is written under
its epoch and then noted in the ledger, so that a replay between the two writes neither rows nor paths twice. A path that
isn't there (yet) is noted as missing, a message that can't be understood as its error; either is taken up again when it is named again.

The ledger lies in a hidden folder of the table, by the day on which a path was taken up; a batch looks at the last
``remember`` days, longer than the queue redelivers, and older days may be dropped (``forget_objects``).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakelogs.sources.ingest import object_paths
from lakelogs.sources.paths import exists, folders, remove
from lakelogs.sources.tables import read_alb_text, stream_batch, write_epoch
from lakelogs.streaming.flush import _files, _trigger, stream_id

_LEDGER = "_objects"
_ENTRY = "path string, status string, day string, batch string"


def read_ledger(spark: SparkSession, path: str, since: date | None = None) -> DataFrame:
    """(path, status, day, batch): read, missing, or the error of a message (then without a path)."""
    days = [d for d in folders(spark, f"{path}/{_LEDGER}") if since is None or d >= f"day={since:%Y-%m-%d}"]
    if not days:
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).option("basePath", f"{path}/{_LEDGER}").parquet(*[f"{path}/{_LEDGER}/{d}" for d in days])


def forget_objects(spark: SparkSession, path: str, before: date) -> int:
    """Drop the ledger's days before a date; returns their number."""
    old = [d for d in folders(spark, f"{path}/{_LEDGER}") if d < f"day={before:%Y-%m-%d}"]
    for d in old:
        remove(spark, f"{path}/{_LEDGER}/{d}")
    return len(old)


def ingest_objects(messages: DataFrame, epoch: int, path: str, stream: str = "", remember: int = 7, partitions: int | None = None, located: Column | None = None, today: date | None = None) -> dict[str, int]:
    """One micro-batch of notifications (``body``): read the objects that are new, write their rows, note them; returns how many
    paths had which status. ``located`` makes a readable path of ``path`` where the buckets are mounted elsewhere."""
    spark, day, batch = messages.sparkSession, today or date.today(), stream_batch(epoch, stream)
    named = object_paths(messages).withColumn("path", located if located is not None else F.col("path")).distinct()
    known = read_ledger(spark, path, day - timedelta(days=remember)).filter((F.col("status") == "read") & (F.col("batch") != batch)).select("path").distinct()
    # The paths of one micro-batch, which its bounds keep few; Spark's reader takes a list of paths.
    fresh = named.filter("path IS NOT NULL").select("path").join(known, "path", "left_anti").collect()
    failed = [(None, r["error"]) for r in named.filter("path IS NULL").select("error").collect()]
    with ThreadPoolExecutor(16) as pool:
        there = list(pool.map(lambda r: exists(spark, r["path"]), fresh))
    found = [r["path"] for r, ok in zip(fresh, there, strict=True) if ok]
    if found:
        write_epoch(read_alb_text(spark, found, partitions), epoch, path, "time", stream)
    noted = [(p, "read") for p in found] + [(r["path"], "missing") for r, ok in zip(fresh, there, strict=True) if not ok] + failed
    entries = spark.createDataFrame([(*e, f"{day:%Y-%m-%d}", batch) for e in noted], _ENTRY).coalesce(1)
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/{_LEDGER}")
    return {s: sum(x[1] == s for x in noted) for s in {x[1] for x in noted}}


def stream_objects(
    spark: SparkSession, source: str, path: str, checkpoint: str, every: str | None = "60 seconds", max_files: int | None = 100, remember: int = 7, partitions: int | None = None, located: Column | None = None
) -> StreamingQuery:
    """Landed notification messages (text files, one a line) -> the access logs that they name -> access-log table."""
    stream = stream_id(spark, checkpoint)
    messages = _files(spark, max_files).text(source).withColumnRenamed("value", "body")

    def batch(df: DataFrame, epoch: int) -> None:
        kept = df.persist()
        try:
            ingest_objects(kept, epoch, path, stream, remember, partitions, located)
        finally:
            kept.unpersist()

    return _trigger(messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), every).start()
