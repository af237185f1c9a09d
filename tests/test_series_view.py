"""The series as Spark builds it, against the text of its view."""

import datetime as dt

from tidemark.plans import views

DAYS = [dt.datetime(2001, 1, 1) + dt.timedelta(days=k) for k in (*range(20), *range(25, 70))]
SHIPS = "l_suppkey long, l_quantity double, l_returnflag string, l_shipdate timestamp"


def _both(spark, ships, suppliers=4):
    spark.createDataFrame(ships, SHIPS).createOrReplaceTempView("lineitem")
    spark.createDataFrame([(k, k % 3) for k in range(suppliers)], "s_suppkey long, s_nationkey int").createOrReplaceTempView("supplier")
    views._OPEN.clear()
    return spark.sql(views.SERIES), spark.sql(views.VIEWS["fx_series"])


def test_moves_of_sums_give_the_rows_of_the_grid(spark):
    ships = [(k % 3, float(k % 7 + 1), "RAN"[k % 3], DAYS[k * k % len(DAYS)]) for k in range(150)]
    # The whole calendar; two rows a day; no quantity; a supplier that is not known; supplier 3 ships nothing.
    ships += [(0, 1.0, "A", d) for d in DAYS] + [(1, None, "R", DAYS[5]), (9, 50.0, "R", DAYS[6]), (2, 4.0, "R", DAYS[-1]), (2, 4.0, "R", DAYS[-1]), (1, 2.0, None, DAYS[0])]
    got, want = _both(spark, ships)
    assert got.dtypes == want.dtypes
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) and len(rows) == 4 * len(DAYS)
    assert {(r[2], r[3]) for r in rows if r[0] == "org0/repo3"} == {(0, 0)}


def test_what_follows_by_id_shuffles_no_day_again(spark):
    got, _ = _both(spark, [(k % 3, 1.0, "R", d) for k, d in enumerate(DAYS)])
    plain, by_id = (d._jdf.queryExecution().executedPlan().toString() for d in (got, got.groupBy("id").count()))
    assert by_id.count("Exchange hashpartitioning") == plain.count("Exchange hashpartitioning")
