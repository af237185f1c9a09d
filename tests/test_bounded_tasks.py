"""Uses and series lie in tasks of a bounded number of rows, whatever the number of shuffle partitions; rows as by the views' text."""

import datetime as dt

import pytest

from tidemark.operators import rollups, series, uses
from tidemark.plans import views

DIR = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(views, "LINES_A_TASK", 500)
    monkeypatch.setattr(views, "ROWS_A_TASK", 2000)
    views._OPEN.clear()
    yield
    views._OPEN.clear()


def test_more_lines_make_more_tasks(spark, small_tasks):
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    n = -(-lines // 500)
    assert n > 4 and views.tasks(spark, DIR)["uses"] == n
    plan = _plan(views.view(spark, DIR, "fx_uses"))
    assert plan.count(f", {n}), REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_uses_have_the_rows_of_the_view(spark):
    day = dt.datetime(2001, 1, 1)
    # An order twice, once with another day; an order without lines; lines without an order; a part twice in an order; no key.
    orders = [(1, day, 10.4), (1, day, 10.4), (2, day, 7.0), (2, day + dt.timedelta(days=1), 7.0), (3, None, None), (4, day, 1.0), (None, day, 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp, o_totalprice double").createOrReplaceTempView("orders")
    spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 5), (3, None), (3, 7), (9, 5), (None, 5)], "l_orderkey long, l_partkey long").createOrReplaceTempView("lineitem")
    views._OPEN.clear()
    got, want = spark.sql(views.USES), spark.sql(views.VIEWS["fx_uses"])
    assert got.dtypes == want.dtypes
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, want.collect())) and len(rows) == 6


def test_used_by_reads_the_uses_once(spark):
    more = spark.sparkContext.accumulator(0)
    rows = [("model", "x/m", "dataset", "o/1"), ("space", "y/s", "dataset", "o/1"), ("space", "o/s", "dataset", "o/1"), ("space", "o/t", "dataset", "p/1"), ("model", "q/n", "dataset", "p/1"), ("model", "x/m", "paper", "o/1")]

    def count(batches):
        for b in batches:
            more.add(b.num_rows)
            yield b

    u = spark.createDataFrame(rows, "src_kind string, src string, dst_kind string, dst string")
    u = u.mapInArrow(count, u.schema)
    d = spark.createDataFrame([("o/1", "o"), ("p/1", "p")], "id string, author string")
    m = spark.createDataFrame([("x/m", "x", None)], "id string, author string, dl30 long")
    s = spark.createDataFrame([("o/t", "p")], "id string, author string")
    # p: the Space's owner is known to be p itself; q/n is not known.
    assert [tuple(r) for r in uses.used_by(u, d, m, s, 3).collect()] == [("o", 1, 0, 1, "x/m", "o/1")]
    assert more.value == len(rows)


def test_new_users_are_dealt_over_the_given_tasks(spark):
    u = spark.createDataFrame([(1, "2001-01-05"), (1, "2001-01-09"), (1, "2001-03-01"), (2, None), (None, "2001-03-01")], "dst long, created string").selectExpr("dst", "CAST(created AS date) AS created")
    got = rollups.new_users(u, 7)
    plan = _plan(got)
    m = lambda k: dt.date(2001, k, 1)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, m(1), 2, 2), (1, m(3), 1, 3), (2, None, 1, 1), (None, m(3), 1, 1)], key=str)
    assert plan.count(", 7), REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_more_days_of_series_make_more_tasks(spark, small_tasks):
    plan = _plan(views.view(spark, DIR, "fx_series"))
    n = views.tasks(spark, DIR)["series"]
    days = spark.sql("SELECT datediff(max(l_shipdate), min(l_shipdate)) + 1 FROM lineitem").first()[0]
    assert n == -(-spark.table("supplier").count() * days // 2000) > 4
    assert f", {n}), REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan
    assert _plan(series.weekly(series.by_day(views.view(spark, DIR, "fx_series"), "dl_all"), "v")).count("hashpartitioning(id") == plan.count("hashpartitioning(id")
