"""The pipeline against plain versions of its stages, and the corpus queries that have SQL, at the smallest scale."""

from collections import Counter

import duckdb
import pytest

from lakelogs.llm import decontaminate, mixing, quality, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {}
    for d, r in docs.items():
        n, _, _, _, repeated, covered, longest = brute.quality(r["text"], quality.MIN_REPEAT)
        if n >= 50 and 100 * repeated <= 50 * n and covered <= quality.MAX_COVERED * n and longest <= quality.MAX_LONGEST:
            good[d] = r
    ids = sorted(good)
    prints = [brute.fingerprint(good[d]["text"]) for d in ids]
    root = brute.classes(len(ids), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    single = [d for i, d in enumerate(ids) if root[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = brute.contamination([(d, docs[d]["text"]) for d in single], items)
    clean = [d for d, (n, hit, _) in zip(single, judged, strict=True) if not (hit and 20 * hit >= n)]
    assert len(docs) > len(good) > len(single) >= len(clean) > 50
    mixed = mixing.mix(spark.createDataFrame([docs[d] for d in clean])).collect()
    want = Counter({r["doc_id"]: r["repeats"] for r in mixed if r["repeats"]})
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in out) == want
    assert sum({r["shard"]: r["shard_docs"] for r in out}.values()) == len(out)


def test_stages_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = lambda *r: spark.createDataFrame([(i, t, "s") for i, t in r], "doc_id long, text string, source string")
    kept = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    docs = rows((None, a), (None, a), (1, b), (1, b), (5, b), (5, c), (None, d), (7, d))
    assert kept(corpus_pipeline.near_dedup(spark, docs, SF)) == sorted([(None, a), (1, b), (5, c), (7, d)], key=repr)
    items = spark.createDataFrame([(1, a)], "item_id long, text string")
    docs = rows((None, a), (None, b), (1, a), (1, c))
    assert kept(decontaminate.keep_clean(docs, items)) == sorted([(None, b), (1, c)], key=repr)
    # 1.5 times 6 rows of 60 words: 9 rows, none more than twice.
    docs = rows((1, a), (1, b), (2, a), (None, c), (None, c), (None, d))
    out = Counter((r["doc_id"], r["text"]) for r in mixing.mixed_documents(docs).collect())
    assert sum(out.values()) == 9
    assert all(1 <= n <= (4 if k == (None, c) else 2) for k, n in out.items())


CLASHES = ("row", "nth", "none", "id", "h", "fp", "q", "n", "repeats", "bad_id", "bad_h", "taken", "component")


def test_stages_keep_rows_whole(spark):
    """Empty tables, nulls in any column, empty and long texts, and columns with the names that the stages use themselves."""
    import corpus_pipeline

    a, b, long = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 60), ("b", 70), ("l", 30_000)))
    rows = [(1, a, "s"), (2, None, "s"), (3, "", None), (4, b, None), (None, long, "t"), (None, None, None), (6, a, "u")]
    docs = spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} long" for c in CLASHES))
    tail = tuple(range(len(CLASHES)))
    want = {"quality_rules": {1, 4, None, 6}, "simhash_near_dedup": {1, 2, 4, None}, "benchmark_decontamination": {1, 2, 3, 4, None, 6}, "mixing": {1, 4, None, 6}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert {r["doc_id"] for r in got} <= want[name], name
        assert {r["doc_id"] for r in got} >= want[name] - ({1, 4, 6} if name == "mixing" else set()), name
        assert all(tuple(r)[3:] == tail for r in got), name
        assert {tuple(r)[:3] for r in got} <= set(rows), name
        none = stage(spark, docs.limit(0), SF)
        assert (none.columns, none.count()) == (docs.columns, 0), name
    shards = corpus_pipeline.STAGES[-1][1]
    assert shards(spark, docs, SF).count() == len(rows)
    assert shards(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = sorted(repr(sorted(zip(names, r, strict=True))) for r in cur.fetchall())
    assert sorted(repr(sorted(r.asDict().items())) for r in queries.QUERIES[name](spark, SF).collect()) == want
