"""Standing sequence numbers: each stream's events get the numbers 1, 2, ... in the order in which they arrive, over batches and restarts.

The number so far is keyed state over (group, stream), in the RocksDB state store, which keeps it on disk and checkpoints changes. An event's number is written
with it, so a stream's latest n events are those numbered above its last number less n: a filter over the table
(``latest_per_stream``), without ranking it. The token after a batch is the last number plus 1, as ``assign_sequence`` has it.
A task numbers one stream's rows of one micro-batch at a time, which ``max_files`` or ``max_bytes`` bound.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lakelogs.operators.windows import STREAM
from lakelogs.schema import RAW_SCHEMA
from lakelogs.sources.ingest import to_log_rows
from lakelogs.sources.tables import write_epoch
from lakelogs.streaming.flush import _files, _trigger, stream_id

if TYPE_CHECKING:
    import pandas as pd

#: Order of a stream's events within a micro-batch.
ARRIVAL = ("ingestion_time", "timestamp", "message")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Numbering(StatefulProcessor):
    def __init__(self, order: Sequence[str], columns: Sequence[str]):
        self.order, self.columns = list(order), list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import pandas as pd

        events = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        last = self.last.get()[0] if self.last.exists() else 0
        events["sequence_token"] = range(last + 1, last + len(events) + 1)
        self.last.update((last + len(events),))
        yield events[self.columns]

    def close(self) -> None:
        pass


def numbered(rows: DataFrame, order: Sequence[str] = ARRIVAL) -> DataFrame:
    """A streaming log frame with ``sequence_token`` as the number of each event in its stream."""
    keyed = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in STREAM})
    return keyed.groupBy(*STREAM).transformWithStateInPandas(_Numbering(order, keyed.columns), keyed.schema, "Append", "None")


def stream_numbered(
    spark: SparkSession, source: str, path: str, checkpoint: str, every: str | None = "60 seconds", max_files: int | None = None, max_bytes: int | None = None,
    schema: T.StructType = RAW_SCHEMA, order: Sequence[str] = ARRIVAL,
) -> StreamingQuery:
    """Landed JSON lines -> log table, events numbered in their streams. One such query numbers a stream's events."""
    rows, stream = numbered(to_log_rows(_files(spark, max_files, max_bytes).schema(schema).json(source)), order), stream_id(spark, checkpoint)
    writer = rows.writeStream.foreachBatch(lambda df, epoch: write_epoch(df, epoch, path, stream=stream)).option("checkpointLocation", checkpoint)
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # read when the query starts
    try:
        return _trigger(writer.outputMode("append"), every).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def stream_tokens(table: DataFrame) -> DataFrame:
    """(group, stream, events, sequence_token) of numbered events: how many there are, and the token that the next batch needs."""
    return table.groupBy(*STREAM).agg(F.max("sequence_token").alias("events")).withColumn("sequence_token", F.col("events") + 1)


def latest_per_stream(table: DataFrame, n: int = 10_000) -> DataFrame:
    """The latest n of each stream's numbered events; a row a stream is joined, no event is ranked."""
    last = stream_tokens(table).select(*[F.col(c).alias(f"_{c}") for c in STREAM], F.col("events").alias("_last"))
    on = (F.col("log_group_name") == F.col("_log_group_name")) & (F.col("log_stream_name") == F.col("_log_stream_name"))
    return table.join(last, on).filter(F.col("sequence_token") > F.col("_last") - n).drop(*[f"_{c}" for c in STREAM], "_last")
