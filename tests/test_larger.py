"""Findings of larger tables: queries on copies of the events with shifted keys, and what their steps hand over."""

from collections import Counter
from random import SystemRandom

import duckdb
import pytest
from pyspark.sql import functions as F

from lakelogs.functions import parsing as X
from lakelogs.plans import flow_queries as Q
from lakelogs.sources import tables as S
from lakelogs.sources.paths import files, scratch
from lakelogs.streaming import flush as J
from lakelogs.streaming import objects as O

SF = "/root/testdata/sf0.001"


def larger(folder, copies: int, shift: int = 100_000) -> str:
    """Copies of the events at equal times, their keys shifted."""
    duckdb.sql(f"COPY (SELECT e.* REPLACE (event_id + i * {shift} AS event_id, user_id + i * {shift} AS user_id) FROM '{SF}/events.parquet' e, range({copies}) r(i)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def check(spark, name: str, sf: str) -> None:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    rows = con.execute(Q.ORACLES[name])
    names = [d[0] for d in rows.description]
    want = sorted(repr(sorted(zip(names, r, strict=True))) for r in rows.fetchall())
    assert sorted(repr(sorted(r.asDict().items())) for r in Q.QUERIES[name](spark, sf).collect()) == want


def test_addresses_of_large_user_ids(spark, tmp_path):
    check(spark, "i20_addresses", larger(tmp_path, 2))


def test_payloads_do_not_grow(spark, tmp_path):
    sf = larger(tmp_path, 8, 1_000)
    values = F.from_json("payload", "streams array<struct<values:array<array<string>>>>")["streams"]["values"]
    held = Q._payloads(spark, sf).select(F.aggregate(F.transform(values, F.size), F.lit(0), lambda a, n: a + n).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert held[0] <= 1000
    assert held[1] == spark.read.parquet(f"{sf}/events.parquet").count() > 1000
    check(spark, "a7_ingest_push", sf)


def test_files_of_equal_times(spark, tmp_path):
    """Each time comes thirty times, so cuts fall between few of them."""
    sf = larger(tmp_path, 30)
    check(spark, "k1_compact_burst", sf)
    check(spark, "k1_compact_busy_hours", sf)


def test_cuts_of_an_hour(spark):
    """As many files as asked for, even ones, also beyond the sketch's accuracy, and no time in two of them."""
    hour = spark.range(60_000).select(F.lit("d").alias("date"), F.lit("h").alias("hour"), F.timestamp_micros(F.col("id") % 30_000).cast("timestamp_ntz").alias("t"))
    assert S._bounds(hour, "t", {("d", "h"): 15_000})[("d", "h")] == list(range(2, 30_000, 2))


def test_cuts_do_not_depend_on_the_sketch(spark, monkeypatch):
    """A sketch may give other values each time that it is computed, as its parts are merged in the order in which they arrive."""
    sketch, other = F.percentile_approx, F.udf(lambda at: at + SystemRandom().randrange(-3_000, 3_000), "long")
    monkeypatch.setattr(S.F, "percentile_approx", lambda c, ranks: sketch(other(F.col(c)), ranks))
    hour = spark.range(60_000).select(F.lit("d").alias("date"), F.lit("h").alias("hour"), F.timestamp_micros(F.col("id") % 30_000).cast("timestamp_ntz").alias("t"))
    assert S._bounds(hour, "t", {("d", "h"): 15_000})[("d", "h")] == list(range(2, 30_000, 2))


def test_cuts_are_not_shuffled(spark):
    """A row's share of the shuffle doesn't grow with the files of its hour."""
    path = scratch(spark, "t")
    for k in range(2):
        S.append_table(spark.range(3_000).select(F.lit("g").alias("log_group_name"), F.timestamp_micros(1704067200000000 + F.col("id") * 2 + k).cast("timestamp_ntz").alias("timestamp"), F.sha2(F.col("id").cast("string"), 256).alias("message")), path)
    plans = []
    write = S._writer
    with pytest.MonkeyPatch.context() as m:
        m.setattr(S, "_writer", lambda df, lookups: plans.append(df._jdf.queryExecution().optimizedPlan()) or write(df, lookups))
        S.compact(spark, path, file_bytes=20_000)
    below = plans[0].children().head().children().head().output()
    shuffled = [below.apply(i).name() for i in range(below.size())]
    assert "task" in shuffled
    assert "cuts" not in shuffled


def test_a_task_writes_files_of_several_hours(spark, monkeypatch):
    """Small files don't take a task each; those of one hour are still as many, as even, and apart in time."""
    path, tasks, write = scratch(spark, "t"), [], S._writer
    for k in range(2):
        at = F.timestamp_micros(1704067200000000 + F.col("id") % 12 * 3_600_000_000 + F.col("id") * 2 + k).cast("timestamp_ntz")
        S.append_table(spark.range(12_000).select(F.lit("g").alias("log_group_name"), at.alias("timestamp"), F.sha2(F.col("id").cast("string"), 256).alias("message"), F.col("id").alias("sequence_token")), path)
    monkeypatch.setattr(S, "_writer", lambda df, lookups: tasks.append(df.rdd.getNumPartitions()) or write(df, lookups))
    S.compact(spark, path, file_bytes=10_000)
    rows = S.read_logs(spark, path).select("hour", "sequence_token", "timestamp", F.col("_metadata.file_path").alias("file"))
    each = rows.groupBy("hour", "file").agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).orderBy("hour", "a").collect()
    count = Counter(r["hour"] for r in each)  # by the hour's bytes
    assert len(count) == 12
    assert min(count.values()) > 10
    assert tasks[0] == 8 + max(count.values()) < len(each)
    assert all(abs(r["n"] - 2_000 / count[r["hour"]]) <= 1 for r in each)
    assert all(x["hour"] != y["hour"] or x["b"] < y["a"] for x, y in zip(each, each[1:]))
    assert rows.agg(F.count("*"), F.sum("sequence_token")).first()[:] == (24_000, 12_000 * 11_999)


@pytest.mark.parametrize("name", ["h2_stream_dedup", "f3_standing_numbers"])
def test_arrivals_of_several_files(spark, tmp_path, monkeypatch, name):
    """An arrival of a larger table is several files, written by several tasks, and one micro-batch."""
    sf, landed = larger(tmp_path, 2), []
    monkeypatch.setattr(Q, "EVENTS_A_FILE", 60)
    lots = Q._lots(spark, sf)
    assert lots > 3
    arrive = Q._arrive
    monkeypatch.setattr(Q, "_arrive", lambda rows, source, n: (arrive(rows, source, n), landed.append(sum(f.startswith("part-") for f in files(spark, source)))))
    check(spark, name, sf)
    assert landed == [lots, 2 * lots, 3 * lots]


@pytest.mark.parametrize(("name", "module"), [("j6_stream_alb", J), ("j6_notified_objects", O)])
def test_lines_of_gzip_files_are_dealt_out(spark, tmp_path, monkeypatch, name, module):
    """A stream's gzip files are parsed by all cores, not by a task a file."""
    sf, parts, write = larger(tmp_path, 1), [], module.write_epoch
    monkeypatch.setattr(module, "write_epoch", lambda df, *rest: parts.append(df.rdd.getNumPartitions()) or write(df, *rest))
    check(spark, name, sf)
    assert min(parts) >= spark.sparkContext.defaultParallelism > 4


@pytest.mark.parametrize("name", ["j6_stream_alb", "e39_standing", "e41_standing"])
def test_access_log_files_grow_with_the_table(spark, tmp_path, monkeypatch, name):
    """More files of a larger table, and two micro-batches of them still."""
    sf, batches, write = larger(tmp_path, 2), [], J.write_epoch
    monkeypatch.setattr(Q, "EVENTS_A_FILE", 60)
    names, alb_files = [], Q._alb_files
    monkeypatch.setattr(Q, "_alb_files", lambda *args: names.append(alb_files(*args)) or names[-1])
    monkeypatch.setattr(J, "write_epoch", lambda df, *rest: batches.append(df.storageLevel.useMemory) or write(df, *rest))
    check(spark, name, sf)
    assert sum(f.startswith("part-") for f in files(spark, names[0])) == 4 * Q._lots(spark, sf) > 12
    assert batches == [False, False]  # nor is a batch held in memory


def test_access_log_parser_is_compiled(spark):
    """Stages whose generated code the JVM would only interpret, as a method of it is too long, aren't fused."""
    Q.events(spark, SF)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_escaped_quotes_of_access_logs(spark):
    """An access-log line is skipped if a quote stays open, however many backslashes are before it."""
    head = "h2 2024-01-01T00:00:00Z e 1.1.1.1:1 - 0 0 0 200 - 1 1 "
    lines = [(head + '"GET / H" "' + "\\" * n + end, (n % 2 == 1) == (end == '" x"')) for n in range(6) for end in ('"', '" x"')]
    rows = spark.createDataFrame(lines, "value string, good boolean").select(X.alb_fields(F.col("value")).isNotNull().alias("found"), "good").collect()
    assert all(r["found"] == r["good"] for r in rows)


@pytest.mark.parametrize("name", ["e20_sketches", "e24_sketches", "e47_partials"])
def test_tables_with_partials_are_rendered_by_all_cores(spark, tmp_path, monkeypatch, name):
    """The events are one row group, which one task reads."""
    sf, tasks, write = larger(tmp_path, 2), [], S.write_epoch
    monkeypatch.setattr(Q.S, "write_epoch", lambda df, *rest: tasks.append(df.select(F.spark_partition_id()).distinct().count()) or write(df, *rest))
    check(spark, name, sf)
    assert min(tasks) > 4
