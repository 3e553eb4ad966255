"""Every registered query of the log engine against its SQL in DuckDB, at the smallest scale."""

import duckdb
import pytest

from lakelogs.plans import alb_queries, flow_queries, log_queries

SF = "/root/testdata/sf0.001"
CASES = [(m, n) for m in (log_queries, alb_queries, flow_queries) for n in m.QUERIES]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("events", "documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    return None if value is None or value != value else value


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_matches_oracle(spark, con, module, name):
    df = module.QUERIES[name](spark, SF)
    got = sorted(repr([(k, plain(v)) for k, v in sorted(r.asDict().items())]) for r in df.collect())
    cur = con.execute(module.ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr([(k, plain(v)) for k, v in sorted(zip(names, r, strict=True))]) for r in cur.fetchall())
    assert got == want
