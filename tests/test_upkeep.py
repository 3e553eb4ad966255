"""Tables, landing folders and streams under failures, concurrent writers and late or repeated input."""

import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakelogs.operators import alb as A
from lakelogs.operators import catalog as K
from lakelogs.operators import windows as W
from lakelogs.schema import ALB_SCHEMA
from lakelogs.sources import rollups as R
from lakelogs.sources import tables as S
from lakelogs.sources.paths import files, folders, scratch, write_text
from lakelogs.streaming import flush as J
from lakelogs.streaming import objects as O
from lakelogs.streaming import sequence as Q

LOG = "log_group_name string, log_stream_name string, timestamp timestamp_ntz, message string, ingestion_time timestamp_ntz, sequence_token bigint, label_env string, label_service string, label_level string"


def logs(spark, n, start=0, hours=3):
    rows = [("g", f"s{i % 2}", datetime(2024, 1, 1, i % hours, i % 60) if i % 7 else None, f"m{i}", datetime(2024, 1, 1), i, ["prod", "", None][i % 3], f"svc{i % 4}", "info") for i in range(start, start + n)]
    return spark.createDataFrame(rows, LOG)


def tokens(df):
    return sorted(r["sequence_token"] for r in df.collect())


# --- tables -------------------------------------------------------------------------------------------------


def test_a_batch_between_its_hours_is_left_alone(spark):
    """Compaction, deletion and repartitioning pass by a batch that isn't whole; the replay brings all of it, once."""
    path, old, new = scratch(spark, "t"), logs(spark, 20), logs(spark, 20, 20)
    S.write_epoch(old, 0, path, stream="x")
    S.append_table(new.filter("hour(timestamp) = 1"), path, batch=S.stream_batch(1, "x"))  # died before the other hours
    S.append_table(logs(spark, 20, 40), path)
    assert not S.is_written(spark, path, 1, "x")
    S.compact(spark, path)
    assert any(b.startswith("batch=sx-") for b in folders(spark, f"{path}/date=2024-01-01/hour=01"))
    with pytest.raises(RuntimeError, match="whole"):
        S.repartition_table(spark, S.read_logs(spark, path), path)
    assert S.delete_logs(spark, path, "g", "s1") == 20
    assert S.write_epoch(new, 1, path, stream="x")
    assert not S.write_epoch(new, 1, path, stream="x")
    S.compact(spark, path)
    assert not S.write_epoch(old, 0, path, stream="x")
    assert tokens(S.read_logs(spark, path)) == sorted([*range(20, 40), *range(0, 20, 2), *range(40, 60, 2)])
    S.compact(spark, path)
    assert files(spark, f"{path}/_done") == []


def test_an_older_table_without_notes(spark):
    """Stream batches of before the notes count as whole once their stream has gone on."""
    path = scratch(spark, "t")
    for epoch in range(3):
        S.append_table(logs(spark, 10, 10 * epoch), path, batch=S.stream_batch(epoch, "x"))
    S.compact(spark, path)
    assert S.is_written(spark, path, 1, "x")
    assert not S.is_written(spark, path, 2, "x")
    S.write_epoch(logs(spark, 10, 20), 2, path, stream="x")
    assert tokens(S.read_logs(spark, path)) == list(range(30))


def test_notes_are_few(spark, monkeypatch):
    monkeypatch.setattr(S, "KEPT_NOTES", 2)
    path = scratch(spark, "t")
    for epoch in range(6):
        S.write_epoch(logs(spark, 2, 2 * epoch), epoch, path, stream="x")
        S.write_epoch(logs(spark, 2, 100 + 2 * epoch), epoch, path, stream="y") if epoch < 2 else None
    assert files(spark, f"{path}/_done") == [S.stream_batch(k, "x") for k in range(2, 6)] + [S.stream_batch(k, "y") for k in range(2)]
    S.compact(spark, path)
    assert tokens(S.read_logs(spark, path)) == [*range(12), *range(100, 104)]
    assert not S.write_epoch(logs(spark, 2), 0, path, stream="x")


@pytest.mark.parametrize("after", range(0, 14, 3))
def test_killed_repartitioning(spark, monkeypatch, after):
    path, source = scratch(spark, "t"), logs(spark, 12)
    S.append_table(source, path, "ingestion_time")
    steps = [0]

    def counted(real):
        def step(*args):
            steps[0] += 1
            if steps[0] > after:
                raise OSError("killed")
            return real(*args)

        return step

    with monkeypatch.context() as m:
        for name in ("remove", "move", "write_text", "commit_text"):
            m.setattr(S, name, counted(getattr(S, name)))
        try:
            S.repartition_table(spark, S.read_logs(spark, path), path)
        except OSError:
            pass
    S.write_epoch(logs(spark, 3, 12), 0, path, stream="later")
    S.finish_swaps(spark, path)
    assert tokens(S.read_logs(spark, path)) == list(range(15))


def test_repartitioning_from_another_table(spark):
    path, other = scratch(spark, "t"), scratch(spark, "o")
    S.write_epoch(logs(spark, 9), 0, path, stream="x")
    S.append_table(logs(spark, 5, 100), other, "ingestion_time")
    assert S.repartition_table(spark, S.read_logs(spark, other), path) == 5
    assert tokens(S.read_logs(spark, path)) == list(range(100, 105))
    assert not S.write_epoch(logs(spark, 9), 0, path, stream="x")


def test_files_of_a_busy_hour(spark):
    """A burst is cut by its rows; rows of one time stay together; untimed rows are kept."""
    path = scratch(spark, "t")
    burst = spark.range(4000).select(
        F.lit("g").alias("log_group_name"), F.concat(F.lit("s"), F.col("id") % 3).alias("log_stream_name"), F.when(F.col("id") > 9, F.timestamp_micros(1704067200000000 + F.when(F.col("id") < 3600, F.col("id")).otherwise(F.col("id") * 900_000))).cast("timestamp_ntz").alias("timestamp"),
        F.sha2(F.col("id").cast("string"), 256).alias("message"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ingestion_time"), F.col("id").alias("sequence_token"),
    )
    for k in range(2):
        S.append_table(burst.filter(F.col("id") % 2 == k), path)
    S.compact(spark, path, file_bytes=40_000)
    rows = S.read_logs(spark, path)
    assert tokens(rows) == list(range(4000))
    each = [r["n"] for r in rows.filter("hour = '00'").groupBy(F.col("_metadata.file_path")).agg(F.count("*").alias("n")).collect()]
    assert len(each) > 3
    assert max(each) <= 2 * sum(each) / len(each)


def test_lookups_skip_row_groups(spark):
    """Values that lie between a file's least and largest are still looked up in few files, by their Bloom filters."""
    path = scratch(spark, "t")
    for k in range(8):
        S.append_table(spark.range(3000).select(F.lit("g").alias("log_group_name"), F.format_string("%04d-%d", F.col("id"), F.lit(k)).alias("log_stream_name"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("timestamp"), F.lit("m").alias("message"), F.lit(None).cast("timestamp_ntz").alias("ingestion_time"), F.col("id").alias("sequence_token")), path)
    hit = S.read_logs(spark, path).filter("log_stream_name = '1504-3'")
    plan = hit._jdf.queryExecution().executedPlan()
    assert plan.executeCollect() is not None
    read = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    assert 0 < read <= 2 * 3000


# --- partial aggregates -------------------------------------------------------------------------------------


def test_partials_are_read_instead_of_rows(spark):
    path, kind = scratch(spark, "t"), R.streams_kind()
    for epoch in range(2):
        S.write_epoch(logs(spark, 40, 40 * epoch), epoch, path, stream="x")
    scan = lambda: sorted(map(tuple, K.volume(S.read_logs(spark, path), "env").collect()))
    kept = lambda: sorted(map(tuple, R.volume(R.merged(spark, path, kind), kind, "env").collect()))
    assert kept() == scan()
    assert R.refresh(spark, path, [kind]) > 0
    assert R.refresh(spark, path, [kind]) == 0
    assert all("_partials" in f for f in R.merged(spark, path, kind).inputFiles())
    assert kept() == scan()
    R.compact_partials(spark, path, [kind])
    assert all("_partials" in f for f in R.merged(spark, path, kind).inputFiles())
    assert kept() == scan()
    S.append_table(logs(spark, 5, 200), path, batch="b")
    R.refresh(spark, path, [kind])
    S.append_table(logs(spark, 9, 300), path, batch="b")  # replaced: its partials are gone
    assert kept() == scan()
    S.delete_logs(spark, path, "g", "s1")
    assert kept() == scan()
    assert R.refresh(spark, path, [kind]) > 0
    assert kept() == scan()


def test_partials_of_ranges_and_of_nothing(spark):
    path, kind = scratch(spark, "t"), R.streams_kind()
    S.append_table(logs(spark, 60, hours=5), path)
    R.refresh(spark, path, [kind])
    for start, end in ((datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2, 59, 59, 999999)), (datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 1, 3, 10)), (None, datetime(2024, 1, 1, 2)), (datetime(2024, 1, 1, 4), None), (datetime(2025, 1, 1), None)):
        rows = S.read_logs(spark, path).filter((F.col("timestamp") >= start if start else F.col("timestamp").isNotNull()) & (F.col("timestamp") <= end if end else F.col("timestamp").isNotNull()))
        parts = R.merged(spark, path, kind, start, end)
        assert sorted(map(tuple, R.volume(parts, kind, "service").collect())) == sorted(map(tuple, K.volume(rows, "service").collect()))
    whole = R.merged(spark, path, kind, datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 2, 59, 59, 999999))
    assert all("_partials" in f for f in whole.inputFiles())
    empty = scratch(spark, "none")
    S.append_table(logs(spark, 1).limit(0), empty)
    assert R.refresh(spark, empty, [kind, R.labels_kind()]) == 0
    with pytest.raises(ValueError, match="whole hours"):
        R.volume_range(whole, kind, "env", 60)


def test_partials_of_requests(spark):
    """Rates, tops, shares and totals are those of a scan; null codes, paths, bytes and times, and an empty table."""
    r, at = random.Random(5), datetime(2024, 1, 1)
    rows = [(at + timedelta(minutes=7 * i), r.choice([200, 301, 404, 503, None, 99]), r.choice(["/a", "/b", "/c", None]), r.choice([10, 20, None]), r.choice([5, 2**40])) for i in range(60)]
    rows += [(None, 500, "/a", 1, 1), (None, None, None, None, None), (at + timedelta(hours=9), None, None, None, None)]
    given = spark.createDataFrame(rows, "time timestamp_ntz, elb_status_code int, request_path string, received_bytes long, sent_bytes long")
    alb = given.select(*[F.col(f.name) if f.name in given.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ALB_SCHEMA])
    path, empty, kind = scratch(spark, "t"), scratch(spark, "none"), R.requests_kind(("request_path",), "paths")
    S.append_table(alb, path, "time")
    S.append_table(alb.limit(0), empty, "time")
    got = lambda df: sorted(map(repr, df.collect()))
    for where in (path, empty):
        for kept in (False, True):
            if kept:
                R.refresh(spark, where, [kind])
            scan, parts = S.read_alb(spark, where), R.merged(spark, where, kind)
            metrics = list(R.REQUEST_METRICS)
            assert got(R.request_metrics(parts, metrics, 7200)) == got(A.alb_metrics(scan.filter("time IS NOT NULL"), metrics, 7_200_000))
            assert got(R.top_requests(parts, "request_path", "path", 2)) == got(A.top_paths(scan, 2))
            assert got(R.status_distribution(parts)) == got(A.status_distribution(scan))
            totals = R.request_summary(parts)
            assert got(totals) == got(A.alb_summary(scan).select(totals.columns))
            assert got(R.requests_by(parts, "request_path").select("request_path", "requests")) == got(scan.groupBy("request_path").agg(F.count("*").alias("requests")))


# --- landing and streams ------------------------------------------------------------------------------------


def raw(spark, n, start=0):
    return spark.range(start, start + n).select(F.lit("g").alias("logGroupName"), F.concat(F.lit("s"), F.col("id") % 2).alias("logStreamName"), (F.col("id") + 1704067200).alias("timestamp"), F.concat(F.lit("m"), "id").alias("message"), F.col("id").alias("sequenceToken"))


def test_land_flush_land(spark):
    source, path, ckpt = scratch(spark, "l"), scratch(spark, "t"), scratch(spark, "c")
    for k in range(3):
        assert J.land(raw(spark, 10, 10 * k), source, 15) == 10
        with pytest.raises(J.TooManyWaiting, match="10 rows wait, 10 more"):
            J.land(raw(spark, 10), source, 15)
        J.stream_landing(spark, source, path, ckpt, every=None, max_files=1, clean=k > 0).awaitTermination()
        assert J.waiting_rows(spark, source) == 0
    assert tokens(S.read_logs(spark, path)) == list(range(30))
    assert files(spark, f"{source}/_arrivals") == ["checkpoint"]
    assert folders(spark, f"{source}/_staged") == []
    J.land(raw(spark, 10, 30), source, 15)
    J.stream_landing(spark, source, path, scratch(spark, "c"), every=None).awaitTermination()  # another stream takes over
    assert J.waiting_rows(spark, source) == 0


def test_two_writers_at_once(spark):
    source = scratch(spark, "l")

    def attempt(k):
        try:
            J.land(raw(spark, 10, 10 * k).coalesce(1), source, 25)
            return 1
        except J.TooManyWaiting:
            return 0

    with ThreadPoolExecutor(6) as pool:
        taken = sum(pool.map(attempt, range(6)))
    assert taken <= 2
    assert spark.read.json(source).count() == 10 * taken if taken else True
    assert J.waiting_rows(spark, source) == 10 * taken


def test_arrivals_whose_writers_died(spark, monkeypatch):
    """One that was let in but not moved is put in place by the next; one that was only asked for is given up in time."""
    source = scratch(spark, "l")
    with monkeypatch.context() as m:
        m.setattr(J, "_put_in_place", lambda *a: None)
        J.land(raw(spark, 4), source, 100)
    assert J.waiting_rows(spark, source) == 4
    assert spark.read.json(source).count() == 4
    write_text(spark, f"{source}/_arrivals/{1:020d}{'a' * 12}.asked", '{"rows": 1000, "files": 1, "checkpoint": null, "since": -1}')
    assert J.land(raw(spark, 4, 4), source, 100) == 8


def test_resent_and_late_events(spark):
    """What is sent again is dropped; an old event that is sent for the first time isn't, nor is one without a time."""
    source, path, ckpt = scratch(spark, "l"), scratch(spark, "t"), scratch(spark, "c")
    untimed = raw(spark, 2, 50).withColumn("timestamp", F.lit(None).cast("long"))
    for rows in (raw(spark, 5, 100), raw(spark, 5, 100).union(raw(spark, 1, -10_000_000)), untimed, raw(spark, 1, -10_000_000).union(raw(spark, 1, 7))):
        rows.coalesce(1).write.mode("append").json(source)
        J.stream_landing(spark, source, path, ckpt, every=None, resent="1 hour").awaitTermination()
    assert tokens(S.read_logs(spark, path)) == [-10_000_000, 7, 50, 51, 100, 101, 102, 103, 104]


def test_numbers_over_restarts(spark):
    source, path, ckpt = scratch(spark, "l"), scratch(spark, "t"), scratch(spark, "c")
    for k in range(3):
        raw(spark, 7, 7 * k).withColumn("logStreamName", F.when(F.col("sequenceToken") % 5 > 0, F.col("logStreamName"))).coalesce(1).write.mode("append").json(source)
        Q.stream_numbered(spark, source, path, ckpt, every=None).awaitTermination()
    table = S.read_logs(spark, path)
    for stream, ids in (("", [i for i in range(21) if i % 5 == 0]), ("s0", [i for i in range(21) if i % 5 and i % 2 == 0]), ("s1", [i for i in range(21) if i % 5 and i % 2])):
        rows = table.filter(F.col("log_stream_name") == stream).orderBy("sequence_token").collect()
        assert [(r["message"], r["sequence_token"]) for r in rows] == [(f"m{i}", n) for n, i in enumerate(ids, 1)]
    got = sorted(r["message"] for r in Q.latest_per_stream(table, 2).collect())
    assert got == sorted(r["message"] for r in W.cap_per_stream(table, 2).collect())
    assert {r["log_stream_name"]: r["sequence_token"] for r in Q.stream_tokens(table).collect()} == {"": 6, "s0": 9, "s1": 9}


def test_ledger_of_objects(spark):
    """A replayed batch, one that died before its ledger, and a path that is named again after the ledger has forgotten it."""
    objects, path = scratch(spark, "o"), scratch(spark, "t")
    line = 'https 2024-01-01T00:00:00.000000Z app/lb 1.2.3.4:1 10.0.0.1:80 0.001 0.002 0.000 200 200 1 2 "GET https://a.b:443/p HTTP/1.1" "ua" - - arn "Root=1" "d" "arn" 0 2024-01-01T00:00:00.000000Z "forward" "-" "-" "10.0.0.1:80" "200" "-" "-"'
    spark.createDataFrame([(line,)] * 3, "value string").coalesce(1).write.text(objects)
    name = next(n for n in files(spark, objects) if n.startswith("part-"))
    body = '{"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "%s"}}}]}'
    located = F.concat(F.lit(f"{objects}/"), F.substring_index("path", "/", -1))
    message = lambda key: spark.createDataFrame([(body % key,)], "body string")
    day = date(2024, 1, 10)
    take = lambda key, epoch, on=day: O.ingest_objects(message(key), epoch, path, "x", located=located, today=on)
    assert take("gone", 0) == {"missing": 1}
    S.write_epoch(S.read_alb_text(spark, [f"{objects}/{name}"]), 1, path, "time", "x")  # died before the ledger
    assert take(name, 1) == {"read": 1}
    assert take(name, 1) == {"read": 1}
    assert take(name, 2) == {}
    assert S.read_alb(spark, path).count() == 3
    assert O.forget_objects(spark, path, date(2024, 1, 11)) == 1
    assert O.read_ledger(spark, path).count() == 0
    assert O.ingest_objects(spark.createDataFrame([], "body string"), 3, path, "x", today=day) == {}
