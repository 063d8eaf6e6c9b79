"""Every registered query against its SQL in DuckDB, on small tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tidelight.queries import registry

DATA = "/root/testdata/sf0.01"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if (sql := registry.oracle_sql().get(name)) is None:
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9) if all(isinstance(x, int | float) for x in a) else a == b


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_unscheduled_minutes_are_of_every_task(spark, duck):
    """a16, i5: no task's unscheduled minutes are left out of the sums and counts."""
    minutes = dict(duck.execute("SELECT o_orderkey, (CAST(floor(o_totalprice) AS BIGINT) % 300 + 15) // 2 FROM orders WHERE o_orderstatus <> 'F'").fetchall())
    assert {r.task_id: r.unscheduled for r in registry.queries()["a16_study_minutes_by_task"](spark, DATA).collect()} == minutes
    tasks = dict(duck.execute("SELECT o_orderkey // 25, count(*) FROM orders GROUP BY 1").fetchall())
    assert {r.plan_id: r.n_unscheduled for r in registry.queries()["i5_plan_status"](spark, DATA).collect()} == tasks


def test_places_that_repeat_are_taken_in_order_of_the_event(spark, duck, tmp_path):
    """w2: events whose places repeat have one result, whatever the order of the rows in the table."""
    path = f"{tmp_path}/events.parquet"
    again = "SELECT event_id + 1000003 * i AS event_id, ts - to_days(i) AS ts, user_id, event_type, value, props FROM events, range(3) r(i)"
    duck.execute(f"COPY (SELECT * FROM ({again}) ORDER BY event_id DESC) TO '{path}' (FORMAT parquet)")
    got = {r.event_id: r.backwards for r in registry.queries()["w2_out_of_order_flag"](spark, str(tmp_path)).collect()}
    sql = registry.oracle_sql()["w2_out_of_order_flag"].replace("% 1000003)", "% 1000003, event_id)").replace("FROM events", f"FROM '{path}'")
    assert got == dict(duck.execute(sql).fetchall())
