"""Literal cases: truth tables of predicates, parameters and parsers, and the adverse inputs every operator meets."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lakelogs.functions import insights as I
from lakelogs.functions import levels as L
from lakelogs.functions import parsing as X
from lakelogs.functions.times import epoch_to_ns, epoch_to_ts
from lakelogs.operators import alb as A
from lakelogs.operators import catalog as K
from lakelogs.operators import metrics as M
from lakelogs.operators import predicates as P
from lakelogs.operators import windows as W
from lakelogs.schema import LOG_SCHEMA
from lakelogs.sources import ingest as G
from lakelogs.sources import tables as S
from lakelogs.sources.paths import scratch
from lakelogs.streaming import flush as J
from lakelogs.timeutil import bound, interval_seconds, step_seconds

LOG = "log_group_name string, log_stream_name string, timestamp timestamp_ntz, message string, ingestion_time timestamp_ntz, sequence_token bigint, label_env string, label_level string"


def logs(spark, messages, start=datetime(2024, 1, 1)):
    rows = [("g", f"s{i % 2}", start.replace(minute=i), m, start, i, ["prod", ""][i % 2], None if i % 3 == 0 else "info") for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, LOG)


def values(spark, texts, column, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, x {kind}").orderBy("i").select(column).collect()]


@pytest.mark.parametrize(("step", "want"), [("30s", 30), ("5m", 300), ("1h", 3600), ("5000ms", 5), ("60", 60), ("0s", 1), ("1d", 86400)])
def test_steps(step, want):
    assert step_seconds(step) == want


def test_bounds():
    want = datetime(2023, 11, 14, 22, 13, 20)
    assert all(bound(x) == want for x in (1_700_000_000, 1_700_000_000_000, 1_700_000_000_000_000, "1700000000000000000", "2023-11-14T22:13:20Z"))
    assert (interval_seconds(1000), interval_seconds(90_500), step_seconds(None, 86_400)) == (60, 90, 172)


def test_epochs(spark):
    n = [1_700_000_000, 1_700_000_000_000, 1_700_000_000_000_000, 1_700_000_000_000_000_000, None]
    assert values(spark, n, epoch_to_ns(F.col("x")), "bigint") == [1_700_000_000_000_000_000] * 4 + [None]
    assert values(spark, n, epoch_to_ts(F.col("x")), "bigint") == [datetime(2023, 11, 14, 22, 13, 20)] * 4 + [None]


PATTERN_CASES = [
    ("", "anything", True), ("ALL", "x", True), ("error", "An ERROR here", True), ("error", "fine", False), ("!error", "fine", True), ("!error", "Error", False),
    ("f like /err.r/", "an ERRoR", True), ("f like /err.r/", "er", False), ("f like /(/", "a ( b", True), ("[]", "x", True), ('[service="api"]', '{"service":"web"}', True), ('[service="api"]', "service", False),
    ('[msg != "x1"]', "has x1", False), ("100%_", "at 100%_ now", True), ("100%_", "at 1000 now", False),
]


def test_filter_patterns(spark):
    for pattern, text, want in PATTERN_CASES:
        assert values(spark, [text], P.filter_pattern(F.col("x"), pattern)) == [want], (pattern, text)


def test_conditions(spark):
    df = spark.createDataFrame([(x,) for x in ("400", "404", "499", "500", "300", "x", None)], "status string")
    both = P.insights_where(df, ("and", (">=", "status", "400"), ("<", "status", "500")))
    assert sorted(r[0] for r in both.collect()) == ["400", "404", "499"]
    assert P.insights_where(df, ("=", "@status", "")).count() == 1
    assert P.insights_where(df, ("not", ("in", "status", ["400", "x"]))).count() == 5
    words = spark.createDataFrame([("an error",), ("ERROR x",), ("Error",), ("fine",)], "message string")
    assert P.insights_where(words, ("like", "message", "ERROR")).count() == 3
    assert P.insights_where(words, ("=~", "message", "error")).count() == 1
    assert P.insights_where(words, ("like/", "message", "(?i)^error")).count() == 2


def test_levels(spark):
    texts = ["Fatal!", "an Exception", "WARNing", "debug it", "Info", "plain"]
    assert values(spark, texts, L.detected_level(F.col("x"))) == ["error", "error", "warn", "debug", "info", "unknown"]
    assert values(spark, texts, L.own_word_level(F.col("x"))) == ["other", "other", "warn", "debug", "info", "other"]
    assert values(spark, ["ERROR", "Warn", "plain"], L.field_level(F.col("x"))) == ["error", "warn", "info"]
    assert values(spark, ["ERROR", "Warn"], L.collector_level(F.col("x"))) == ["error", "info"]


def test_range_is_inclusive_and_ties_are_kept(spark):
    df = logs(spark, [f"m{i}" for i in range(10)])
    assert P.in_range(df, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 5)).count() == 6
    tied = df.withColumn("timestamp", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz"))
    assert [r["sequence_token"] for r in P.newest(tied, 3).collect()] == [0, 1, 2]
    assert P.in_range(df.withColumn("timestamp", F.lit(None).cast("timestamp_ntz")), datetime(2024, 1, 1)).count() == 0


def test_labels(spark):
    df = logs(spark, ["a", "b", "c", "d"])
    assert P.by_labels(df, {"env": ""}).count() == 4
    assert P.by_labels(df, {"nowhere": "x"}).count() == 0
    assert P.match(df, [("level", "!=", "info")]).count() == 2
    assert P.match(df, [("nowhere", "=~", "")]).count() == 4
    with pytest.raises(KeyError):
        P.match(df, [("env", "~", "x")])


def test_empty_inputs(spark):
    none = logs(spark, ["x"]).limit(0)
    assert M.count_over_time(none, 60).count() == 0
    assert K.label_names(none).count() == 0
    assert K.index_stats(none).first().asDict() == {"streams": 0, "chunks": 1, "entries": 0, "bytes": 0}
    alb = S.parse_alb(spark.createDataFrame([("# nothing",)], "value string"))
    assert A.latency_stats(alb).count() == 0
    summary = A.alb_summary(alb).first()
    assert (summary["total_requests"], summary["error_rate_pct"], summary["p50_latency"]) == (0, 0.0, None)


LINES = [
    'https 2024-01-15T12:00:01.123456Z app/lb/1 10.0.0.1:4000 10.1.0.2:80 0.001 0.250 0.000 200 200 100 200 "GET https://a.b/c/d?x=1 HTTP/1.1" "agent \\"q\\" v" TLS TLSv1.2 arn "Root=1" "a.b" "-" 0 2024-01-15T12:00:00Z "forward" "-" "-"',
    'h2 2024-01-15T12:00:02.000000Z app/lb/1 [2001:db8::1]:4000 - -1 -1 -1 504 - 0 0 "POST https://a.b HTTP/2.0" "-" - - arn "Root=2" "a.b" "-" 0 - "-" "-" "ConnectionError"',
    "# comment", "", "too short", 'h2 2024-01-15T12:00:02Z a b c 1 2 3 4 5 6 7 "open', 'http bad-time lb - - - - - - - - - "-"',
]


def test_alb_lines(spark):
    rows = S.parse_alb(spark.createDataFrame([(x,) for x in LINES], "value string")).orderBy("time").collect()
    bad, first, second = rows
    assert (first["client_ip"], first["client_port"], first["target_processing_time"], first["request_path"], first["user_agent"]) == ("10.0.0.1", 4000, 0.25, "/c/d", 'agent "q" v')
    assert first["time"] == datetime(2024, 1, 15, 12, 0, 1, 123456)
    assert (second["client_ip"], second["target_ip"], second["target_processing_time"], second["elb_status_code"], second["target_status_code"], second["error_reason"]) == ("2001:db8::1", None, None, 504, None, "ConnectionError")
    assert second["request_path"] == "https://a.b"
    assert (bad["time"], bad["elb"], bad["request_method"], bad["trace_id"]) == (None, "lb", None, None)


def test_alb_logfmt_quotes(spark):
    rows = S.parse_alb(spark.createDataFrame([(LINES[0],)], "value string"))
    line = rows.withColumn("request_path", F.lit('/a b="c')).select(A.alb_logfmt(rows).alias("x")).first()["x"]
    assert line.startswith('method=GET path="/a b=\\"c" status=200 latency=0.250s client=10.0.0.1')


def test_logfmt_duplicates(spark):
    line = 'a="1" a="2" msg="x \\"y\\"" time="t"'
    assert values(spark, [line, 'a="1"', None], X.logfmt_message(F.col("x"))) == ['x "y"', 'a="1"', None]
    assert values(spark, [line], X.logfmt_labels(F.col("x"))) == [{"a": "2"}]


def test_json_labels(spark):
    assert values(spark, ['{"app":"a","kubernetes":{"labels":{"app":"b","x-y":"1"}}}', "{broken", None], X.json_labels(F.col("x"))) == [{"app": "b", "x_y": "1"}, None, None]


def test_addresses(spark):
    texts = ["1.2.3.4", "256.1.1.1", "::1", "2001:db8::1", "1:2:3:4:5:6:7:8", "1::2::3", None]
    assert values(spark, texts, I.is_ipv4(F.col("x"))) == [True] + [False] * 6
    assert values(spark, texts, I.is_ipv6(F.col("x"))) == [False, False, True, True, True, False, False]
    assert values(spark, ["10.0.0.9", "10.0.1.0", "x"], I.in_ipv4_subnet(F.col("x"), "10.0.0.0/24")) == [True, False, False]
    assert values(spark, ["2001:db8::9", "::1", "x", None], I.in_ipv6_subnet(F.col("x"), "2001:db8::/32")) == [True, False, False, False]


def test_push_keeps_nanoseconds_to_microseconds(spark):
    payload = '{"streams":[{"stream":{"app":"api","env":"prod","x.y":"z"},"values":[["1700000000123456789","hello"],["bad","x"]]}]}'
    rows = G.ingest_push(spark.createDataFrame([(payload,), ("{broken",)], "payload string")).orderBy(F.col("timestamp").desc_nulls_last()).collect()
    assert rows[0]["timestamp"] == datetime(2023, 11, 14, 22, 13, 20, 123456)
    assert (rows[0]["log_group_name"], rows[0]["label_app"], rows[0]["label_service"], rows[1]["timestamp"]) == ("default", "api", "api", None)


def test_sequence_and_cap(spark):
    df = logs(spark, [str(i) for i in range(10)]).withColumn("batch", F.expr("sequence_token div 4"))
    tokens = {(r["log_stream_name"], r["batch"]): r["sequence_token"] for r in W.assign_sequence(df).collect()}
    assert tokens == {("s0", 0): 3, ("s1", 0): 3, ("s0", 1): 5, ("s1", 1): 5, ("s0", 2): 6, ("s1", 2): 6}
    assert sorted(r["sequence_token"] for r in W.cap_per_stream(df, 2).collect()) == [6, 7, 8, 9]


def test_table_life(spark):
    """Appends, a replayed batch, evolution, compaction, deletion and retention never change the rows they should not."""
    path = scratch(spark, "life")
    df = logs(spark, ["a", "b", "c", "d"], datetime(2024, 1, 1, 23))
    late = logs(spark, ["e", "f"], datetime(2024, 1, 2)).withColumn("label_host", F.lit("h"))
    S.append_table(df, path, batch="x")
    S.append_table(df, path, batch="x")
    S.append_table(late, path)
    table = S.read_logs(spark, path)
    assert (table.count(), table.filter("label_host = 'h'").count(), table.filter("date = '2024-01-02' AND hour = '00'").count()) == (6, 2, 2)
    S.append_table(df.limit(1), path)
    assert S.compact(spark, path) == 1
    table = S.read_logs(spark, path)
    assert table.count() == 7
    assert S.table_stats(table).first()["files"] == 2
    assert S.delete_logs(spark, path, "g", "s1") == 3
    assert S.read_logs(spark, path).filter("log_stream_name = 's1'").count() == 0
    assert S.enforce_retention(spark, path, 1, datetime(2024, 1, 3).date()) == ["date=2024-01-01"]
    assert [r["message"] for r in S.read_logs(spark, path).collect()] == ["e"]


def test_two_writers_and_marks(spark):
    """Streams with other ids share epochs and hours; each has a mark of its own once its batches are merged."""
    path, rows = scratch(spark, "t"), logs(spark, list("abcdefgh"))
    S.write_epoch(rows.filter("sequence_token < 3"), 0, path, stream="one")
    S.write_epoch(rows.filter("sequence_token >= 3"), 0, path, stream="two")
    assert S.read_logs(spark, path).count() == 8
    S.compact(spark, path)
    S.write_epoch(rows, 0, path, stream="one")  # a late replay
    assert S.read_logs(spark, path).count() == 8
    S.write_epoch(rows, 0, path, stream="three")
    S.write_epoch(rows, 1, path, stream="one")
    assert S.read_logs(spark, path).count() == 24
    S.repartition_table(spark, S.read_logs(spark, path), path, files_per_hour=2)
    S.write_epoch(rows, 1, path, stream="one")
    assert S.read_logs(spark, path).count() == 24


@pytest.mark.parametrize("after", range(8))
def test_killed_swaps_are_finished(spark, monkeypatch, after):
    """A compaction that dies after any number of its steps leaves all rows once, as soon as the next job has run."""
    path, rows = scratch(spark, "t"), logs(spark, list("abcdefgh")).withColumn("timestamp", F.expr("timestamp + make_interval(0, 0, 0, 0, sequence_token % 2)"))
    for epoch in range(2):
        S.write_epoch(rows.filter(F.col("sequence_token") < 5 if epoch else F.col("sequence_token") >= 5), epoch, path, stream="x")
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
            S.compact(spark, path)
        except OSError:
            pass
    for epoch in range(2):
        S.write_epoch(rows.filter(F.col("sequence_token") < 5 if epoch else F.col("sequence_token") >= 5), epoch, path, stream="x")
    S.compact(spark, path)
    assert sorted(r["sequence_token"] for r in S.read_logs(spark, path).collect()) == list(range(8))
    assert S.finish_swaps(spark, path) == 0


def test_delete_counts_rows_without_a_time(spark):
    path, rows = scratch(spark, "t"), logs(spark, list("abcdef"))
    S.append_table(rows.withColumn("timestamp", F.when(F.col("sequence_token") > 2, F.col("timestamp"))), path)
    assert S.delete_logs(spark, path, "g", "s1") == 3
    assert sorted(r["sequence_token"] for r in S.read_logs(spark, path).collect()) == [0, 2, 4]
    assert S.delete_logs(spark, path, "g", "s1") == 0


def test_landing_refuses_whole_arrivals(spark):
    source, rows = scratch(spark, "landing"), spark.range(10).select(F.col("id").alias("timestamp"))
    assert J.land(rows, source, 25) == 10
    assert J.land(rows, source, 25) == 20
    with pytest.raises(J.TooManyWaiting, match="25"):
        J.land(rows, source, 25)
    assert spark.read.text(source).count() == 20
    with pytest.raises(ValueError, match="both"):
        J.stream_landing(spark, source, scratch(spark, "t"), scratch(spark, "c"), max_files=1, max_bytes=1)


def test_json_labels_of_equal_names(spark):
    body = '{"app":"a","kubernetes":{"pod_name":"p","labels":{"x-y":"1","x.y":"2","app":"b"}}}'
    got = values(spark, [body, "[1", None, "{}"], X.json_labels(F.col("x")))
    assert got == [{"pod": "p", "x_y": "2", "app": "b"}, None, None, {}]
    plan = spark.range(1).select(X.json_labels(F.col("id").cast("string")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 1


def test_approximate_latencies(spark):
    rows = spark.range(1000).select(F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("time"), F.when(F.col("id") > 0, F.col("id").cast("double")).alias("target_processing_time"), F.lit(200).alias("elb_status_code"), F.lit(1).alias("received_bytes"), F.lit(1).alias("sent_bytes"))
    assert A.alb_timeseries(rows, "latency_p99", approx=True).first()["value"] == 990
    assert A.alb_summary(rows, approx=True).first()["p50_latency"] == 500
    assert {r["stat"]: r["value"] for r in A.latency_stats(rows, approx=True).collect()}["p75"] == 750


def test_filters_reach_the_scan(spark):
    path = scratch(spark, "plan")
    S.append_table(logs(spark, ["a", "b"]), path)
    plan = M.count_over_time(P.in_range(S.read_logs(spark, path), datetime(2024, 1, 1), datetime(2024, 1, 2)), 60)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "GreaterThanOrEqual(timestamp" in plan
    assert "message" not in plan.split("ReadSchema")[1]
    assert set(LOG_SCHEMA.fieldNames()) >= {"date", "hour", "label_env"}
