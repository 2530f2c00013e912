import os

import duckdb
import pytest

from glintframe.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = ("events", "lineitem")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(table):
    names = sorted(table.column_names)
    return sorted(map(repr, zip(*(table.column(n).to_pylist() for n in names))))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toArrow()
    want = duck.sql(SQL[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_crop_reaches_the_scan(spark):
    from glintframe.operators.select import crop

    df = spark.range(10).selectExpr("id as `timestamp [ns]`", "'a' as `recording id`")
    plan = crop(df, 2, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_baseline_circular_at_half_turns_and_zeros(spark, tmp_path):
    """Angles that the last bits put on either side of half a turn or of zero; means of one or two samples, so no order of rows matters."""
    at = "timestamp '2024-01-05' + to_hours(%s)"
    one = "SELECT k AS user_id, v AS value, h FROM (SELECT k, unnest([6000 + k * 7, k * 7]) / 100 AS v, unnest([6, 9]) AS h FROM range(900) r(k))"
    two = "SELECT 1000 + k, v, h FROM (SELECT k, unnest([k * 13, k * 19, k * 16]) / 100 AS v, unnest([3, 6, 9]) AS h FROM range(900) r(k))"
    c = duckdb.connect()
    c.sql(f"CREATE TABLE events AS SELECT row_number() OVER () AS event_id, {at % 'h'} AS ts, user_id, CASE h WHEN 6 THEN 'purchase' ELSE 'view' END AS event_type, value FROM ({one} UNION ALL {two})")
    c.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    want = rows(c.sql(SQL["baseline_circular"]).to_arrow_table())
    assert {x.rpartition(" ")[2] for x in want} >= {"180.0)", "-180.0)", "-0.0)", "0.0)"}
    assert rows(QUERIES["baseline_circular"](spark, str(tmp_path)).toArrow()) == want
