"""Every query with SQL equals DuckDB's answer; the others give rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import catalogue, store  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert len(set(df.columns)) == len(df.columns)
        return
    want = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_reads_only_what_it_needs(spark):
    from palimpsest.sources.tables import scan

    plan = scan(spark, f"{SF}/events.parquet", 3).select("event_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan
