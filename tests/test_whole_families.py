"""Families of any depth and size: all descendants count, and small families have a series too."""

import datetime as dt
import os
import random
from collections import defaultdict

import pytest

import __spark_entry__
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.plans import views

DIR, R = "/root/testdata/sf0.001", random.Random(9)


def _pairs(edges):
    up = defaultdict(set)
    for i, p in edges:
        if None not in (i, p):
            up[i].add(p)
    out = set()
    for i in list(up):
        todo, seen = [i], set()
        while todo:
            new = up.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out |= {(i, a) for a in seen if a != i}
    return out


def test_a_closure_without_bound_has_all_pairs(spark):
    chain = [(k, k - 1) for k in range(1, 21)]
    ring = [(100 + k, 100 + (k + 1) % 7) for k in range(7)] + [(99, 100), (106, 20)]
    web = [(200 + i, 200 + R.randrange(30)) for i in range(30) for _ in range(2)]
    for edges in (chain, ring + chain, web, [(1, 1), (None, 2), (3, None), (5, 4), (5, 4)], []):
        got = [tuple(r) for r in graph.whole_closure(spark.createDataFrame(edges, "id long, parent long")).collect()]
        assert len(got) == len(set(got)) and set(got) == _pairs(edges)


def test_the_query_has_all_families_and_all_their_members(spark, tmp_path):
    """Ten generations; families of one descendant and of all."""
    n, days = 599, [dt.datetime(2001, 1, 1), dt.datetime(2001, 1, 2), dt.datetime(2001, 2, 20)]
    for t in views.TABLES:
        if t not in ("supplier", "lineitem"):
            os.symlink(f"{DIR}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.createDataFrame([(k, k % 3) for k in range(n)], "s_suppkey long, s_nationkey int").write.parquet(str(tmp_path / "supplier.parquet"))
    sold = [(k, float(k % 7), "R", d) for k in range(n) for d in days[k % 2 :]]
    spark.createDataFrame(sold, "l_suppkey long, l_quantity double, l_returnflag string, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = __spark_entry__.queries()["jn8_family_members_series"](spark, str(tmp_path)).collect()
    views._OPEN.clear()
    families = defaultdict(set)
    for i in range(1, n):
        up = i
        while up:
            up //= 2
            families[up] |= {i, up}
    name = lambda k: f"org{k % 3}/repo{k}"
    total = {k: sum(q for i, q, _, _ in sold if i in m) for k, m in families.items()}
    assert {(r.anc, r.day, r.members) for r in got} == {(name(k), d.date(), len(m)) for k, m in families.items() for d in days}
    assert {r.anc: r.dl_all for r in got if r.day == days[-1].date()} == {name(k): t for k, t in total.items()}
    assert len(got) == 3 * 300 and min(map(len, families.values())) == 2 and len(families[0]) == n


@pytest.mark.parametrize("members", [1, 3, 50])
def test_families_that_overlap_have_the_sums_of_rows(spark, monkeypatch, members):
    monkeypatch.setattr(graph, "MEMBERS", members)
    pairs = spark.createDataFrame(list({(f"o/{R.randrange(30)}", f"a/{R.randrange(12) ** 2 // 12}") for _ in range(90)}), "id string, anc string")
    series = spark.range(300).selectExpr("concat('o/', id % 30) AS id", "date_add(DATE '2001-12-27', CAST(id div 30 AS INT)) AS day", "id % 7 AS dl30", "id * id AS dl_all")
    got = graph.family_series(pairs, series, pairs.select("anc").distinct(), 5)
    want = series.join(pairs, "id").groupBy("anc", "day").agg(F.sum("dl30"), F.sum("dl_all"), F.count("*"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_an_id_goes_out_once_whatever_its_families(spark):
    """The list of an id and year is dealt before it is repeated for each family, and is not dealt again until it is summed."""
    series = spark.range(40).selectExpr("concat('o/', id % 4) AS id", "date_add(DATE '2001-03-01', CAST(id div 4 AS INT)) AS day", "7 AS dl30", "9L AS dl_all")
    pairs = spark.createDataFrame([(f"o/{i}", f"o/{j}") for i in range(4) for j in range(i)], "id string, anc string")
    got = graph.family_series(pairs, series, pairs.select("anc").distinct(), 2)
    assert {(r.anc, r.members) for r in got.collect()} == {("o/0", 4), ("o/1", 3), ("o/2", 2)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    first = plan.index("RepartitionByExpression [anc#")
    assert "explode(above#" in plan[first : plan.index("RepartitionByExpression [anc#", first + 1)]
    physical = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in physical and "hashpartitioning(home#" not in physical
