"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from candlespark.plans.queries import QUERIES, SQL

TABLES = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(TABLES):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, TABLES)
    rows = df.collect()
    if name not in SQL:
        assert df.columns
        return
    found = oracle.execute(SQL[name])
    names = [d[0] for d in found.description]
    columns = sorted(names)
    assert columns == sorted(df.columns)
    assert sorted(tuple(repr(r[c]) for c in columns) for r in rows) == sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_folds_use_hash_aggregation_and_a_broadcast_calendar(spark):
    plan = QUERIES["resample_15m"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "BroadcastHashJoin" in plan and "Python" not in plan


def test_range_reads_push_their_predicates_to_the_scan(spark):
    from candlespark.operators import read
    from candlespark.plans import adapters

    plan = read.between(adapters.read(spark, TABLES, "events"), "2024-01-02", "2024-01-03").select("ts")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan


def test_sessions_list_days_without_ticks(spark, tmp_path):
    import datetime as dt

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name, ts, days in (("few", ["2024-01-10 15:00:00"], 22), ("later", ["2024-01-10 15:00:00", "2024-02-06 15:00:00"], 26), ("none", [], 22)):
        (tmp_path / name).mkdir()
        rows = [(dt.datetime.fromisoformat(t), "click", 1.0, "{}", i) for i, t in enumerate(ts)]
        spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double, props string, event_id long").write.parquet(f"{tmp_path}/{name}/events.parquet")
        c.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/{name}/events.parquet/*.parquet'")
        found = sorted(map(tuple, QUERIES["sessions"](spark, f"{tmp_path}/{name}").collect()))
        assert len(found) == days and found == sorted(c.execute(SQL["sessions"]).fetchall())
