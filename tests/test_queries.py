"""Every registered query is planned on the smallest tables; those that nothing else runs are run."""

import time

import pytest

from paceline import registered

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registered.queries(), registered.oracle_sql()
#: These run streams while they are planned; tests/test_streaming.py has their parts.
LIVE = {k for k in QUERIES if k.endswith("_live") or k in ("M1_detections", "M4_area_streaks")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LIVE))
def test_query_is_planned(spark, name):
    out = QUERIES[name](spark, SF)
    assert out.columns and len({c.lower() for c in out.columns}) == len(out.columns)
    if name not in SQL:  # the others are run against their SQL by oracle_check.py
        assert out._jdf.queryExecution().executedPlan() is not None


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, SF).count() > 0, name


def test_sql_names_queries():
    assert set(SQL) <= set(QUERIES)


def test_sql_equals_the_query(spark):
    """A few queries of each kind against their SQL in DuckDB (oracle_check.py does all)."""
    import duckdb

    from oracle_check import TABLES, rows

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ("G1_assign_without_door", "G4_work_areas", "T5_suppressed_poses", "M4_area_streaks", "S1_tracker"):
        began = time.time()
        got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got).equals(rows(want)), name
        print(name, round(time.time() - began, 1))
