"""Series of families by moves of their members, against sums of every member's row by day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import graph

R = random.Random(5)
DAYS = [dt.date(2000, 12, 20) + dt.timedelta(days=k) for k in range(30)]


def _plainly(pairs, series, roots):
    both = pairs.unionByName(roots.select(F.col("anc").alias("id"), "anc")).distinct()
    return series.join(both, "id").groupBy("anc", "day").agg(F.sum("dl30").alias("dl30"), F.sum("dl_all").alias("dl_all"), F.count("*").alias("members"))


@pytest.mark.parametrize("members, tasks", [(1000, None), (2, 5)])
def test_moves_give_the_sums_of_rows(spark, monkeypatch, members, tasks):
    monkeypatch.setattr(graph, "MEMBERS", members)
    rows = []
    for i in range(1, 13):
        total = 0
        for day in DAYS:
            total += R.choice([0, 0, 0, 5])
            # Days without a row, values that are not known, two rows a day.
            for _ in range(R.choice([0, 1, 1, 1, 2])):
                rows.append((f"o/{i}", day, R.choice([None, 7, 7]), None if i % 4 == 3 else total))
    rows.append(("o/5", None, 1, 2))
    series = spark.createDataFrame(rows, "id string, day date, dl30 int, dl_all long")
    pairs = [(f"o/{i}", f"o/{i >> k}") for i in range(1, 13) for k in (1, 2, 3) if i >> k] + [("o/3", "p/none"), ("o/7", "p/none")]
    pairs = spark.createDataFrame(pairs, "id string, anc string")
    roots = pairs.select("anc").distinct()
    got, want = graph.family_series(pairs, series, roots, tasks), _plainly(pairs, series, roots)
    assert got.dtypes == want.dtypes
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, want.collect())) and "None" in "".join(rows)


def test_a_row_is_not_sent_once_a_family(spark):
    """What goes from ids to families is one list a year, not a row a day."""
    series = spark.range(40).selectExpr("concat('o/', id % 4) AS id", "date_add(DATE '2001-03-01', CAST(id div 4 AS INT)) AS day", "7 AS dl30", "9L AS dl_all")
    pairs = spark.createDataFrame([(f"o/{i}", "o/0") for i in (1, 2, 3)], "id string, anc string")
    got = graph.family_series(pairs, series, pairs.select("anc").distinct(), 2)
    assert [r.members for r in got.collect()] == [4] * 10
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("RepartitionByExpression [anc#", plan.index("RepartitionByExpression [anc#") + 1) :]
    assert "collect_list" in join and join.index("Join Inner") < join.index("collect_list")
