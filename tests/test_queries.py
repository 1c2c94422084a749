"""Every registered query of the core against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from pitspark import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
    return v.isoformat() if hasattr(v, "isoformat") else v


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, db, name):
    df = queries.queries()[name](spark, SF)
    got = _sorted(df.collect(), df.columns)
    if name not in queries.oracle_sql():
        assert got[1]
        return
    answer = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert got == _sorted(answer.fetchall(), columns)


@pytest.mark.parametrize("name", ["factor_engine", "factor_pipeline", "pct_change"])
def test_bases_of_0_as_in_sql(spark, tmp_path, name):
    """Purchases of the first days are 0 for a third of the users, and later ones for some of them: changes are infinite or NaN."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN user_id % 3 = 0 AND (ts < '2024-01-10' OR user_id % 2 = 0) THEN 0.0 ELSE value END AS value)
      FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    odd = con.execute(f"SELECT count(*) FILTER (isinf(value)), count(*) FILTER (isnan(value)) FROM ({queries.oracle_sql()['pct_change']})").fetchall()[0]
    assert all(odd)
    df = queries.queries()[name](spark, str(tmp_path))
    answer = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert _sorted(df.collect(), df.columns) == _sorted(answer.fetchall(), columns)


def _plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan_of_a_stored_table(spark, tmp_path):
    """On a table with the stored columns, not on computed ones, the predicates themselves are pushed."""
    from pitspark.operators import pit

    at = str(tmp_path / "obs")
    queries.observations(spark, SF).write.parquet(at)
    stored = spark.read.parquet(at)
    plan = _plan(pit.pit_read(stored, as_of_ns=queries.MID_NS, signal_type="evt.click", event_start_ns=5, series_id="a"))
    for predicate in (f"LessThanOrEqual(knowledge_time_ns,{queries.MID_NS})", "EqualTo(signal_type,evt.click)", "GreaterThanOrEqual(event_time_ns,5)", "EqualTo(series_id,a)"):
        assert predicate in plan
    assert "WindowGroupLimit" in plan
    cuts = pit.embargoed_cuts(queries._dates(spark), 1)
    plan = _plan(pit.pit_read_dates(stored, cuts))
    last = cuts.agg({"as_of_ns": "max"}).first()[0]
    assert f"LessThanOrEqual(knowledge_time_ns,{last})" in plan and "NestedLoop" not in plan


def test_pipeline_reads_events_once(spark):
    assert _plan(queries.factor_pipeline(spark, SF)).count("FileScan") == 1
