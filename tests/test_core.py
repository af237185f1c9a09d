from datetime import date, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import graph, identity, quality, ranks, series, windows
from tidemark.operators import verdicts as verdicts_
from tidemark.sources import snapshots
from tidemark.streaming import settling
from tidemark.streaming.incremental import append_days

D = date(2025, 1, 1)


def days(values):
    return pd.Series([float(v) for v in values], index=[D + timedelta(days=k) for k in range(len(values))])


def rows_of(df):
    return rows(df)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def windows_(spark, v):
    """Windows of one series, found by Spark and by the daily fold alike."""
    hub = spark.createDataFrame([("s", D + timedelta(k), float(x)) for k, x in enumerate(v)], "series string, day date, dl double")
    none = spark.createDataFrame([], "series string, day date, share double")
    found = [(r.start, r.end) for r in windows.find(hub, none, 0.25).collect()]
    assert found == settling.windows_of(days(v).astype(float), {}, 0.25, [])
    return found


def test_full_stall_and_smoothing(spark):
    v = [100] * 30
    v[15], v[16] = 5, 195
    assert windows_(spark, v) == [(D + timedelta(15), D + timedelta(16))]
    hub = spark.createDataFrame([(D + timedelta(k), "t", x) for k, x in enumerate(v)], "day date, pipeline_tag string, dl long")
    wins = spark.createDataFrame([(D + timedelta(15), D + timedelta(16))], "start date, end date")
    assert {r.dl for r in quality.smooth(hub, wins).collect()} == {100}


def test_stall_at_the_end_waits(spark):
    v = [100] * 30
    v[28] = v[29] = 5
    assert windows_(spark, v) == []


def test_half_dip(spark):
    v = [100] * 30
    v[15], v[16] = 60, 140
    assert windows_(spark, v) == [(D + timedelta(15), D + timedelta(16))]
    v[16] = 100
    assert windows_(spark, v) == []


def test_rollback_recovers_or_releases(spark):
    def verdicts(levels, partial=()):
        rows = [(f"a/{i}", D + timedelta(k), v) for k, v in enumerate(levels) for i in range(1 if k in partial else 4)]
        return [(r.verdict, r.base and (r.base - D).days) for r in sorted(verdicts_.usable_snapshots(spark.createDataFrame(rows, "id string, day date, dl_all long")).collect())]

    got = verdicts([1000, 900, 905, 910, 995, 1010])
    assert got == [("first", None), ("hold", None), ("hold", None), ("hold", None), ("use", 0), ("use", 4)]
    got = verdicts([1000] + [900] * 9 + [901])
    assert got == [("first", None)] + [("release", k) for k in range(9)] + [("use", 9)]
    assert verdicts([1000, 1001, 1002], partial=(1,)) == [("first", None), ("partial", None), ("use", 0)]
    assert verdicts_.usable_snapshots(spark.createDataFrame([], "id string, day date, dl_all long")).count() == 0


def test_measured_through_released_snapshots(spark):
    rows = [("a/x", D, 100), ("a/x", D + timedelta(1), 50), ("a/x", D + timedelta(3), 70), ("b/y", D, None), ("b/y", D + timedelta(1), 5), ("b/y", D + timedelta(3), 15)]
    series_ = spark.createDataFrame(rows, "id string, day date, dl_all long")
    tags = spark.createDataFrame([("a/x", "t")], "id string, pipeline_tag string")
    chain = spark.createDataFrame([(D, "first", None), (D + timedelta(1), "release", D), (D + timedelta(3), "release", D + timedelta(1))], "day date, verdict string, base date")
    assert rows_of(quality.measured(series_, tags, chain)) == [(D + timedelta(1), "t", 0), (D + timedelta(2), "other", 5), (D + timedelta(2), "t", 10), (D + timedelta(3), "other", 5), (D + timedelta(3), "t", 10)]


def test_gap_is_spread(spark):
    s = spark.createDataFrame([("a/x", D, 0), ("a/x", D + timedelta(1), 0), ("a/x", D + timedelta(5), 40)], "id string, day date, dl_all long")
    tags = spark.createDataFrame([("a/x", "t")], "id string, tag string")
    assert rows(series.hub_increment(s, tags)) == [(D + timedelta(1), "t", 0), *[(D + timedelta(k), "t", 10) for k in range(2, 6)]]


def test_renames(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "old string, new string")
    assert dict(rows(identity.resolve(r)))["a"] == "c"
    prev = spark.createDataFrame([("o/m", 2000)], "id string, dl_all long")
    cur = spark.createDataFrame([("p/m", 2001), ("o/n", 2002)], "id string, dl_all long")
    assert rows(identity.find_renames(prev, cur)) == []
    assert rows(identity.find_renames(prev, cur.filter("id = 'p/m'"))) == [("o/m", "p/m")]


def test_closure_stops_at_seven_hops_and_survives_cycles(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(50, 51), (51, 50)], "id long, parent long")
    got = set(rows(graph.closure(e)))
    assert (0, 7) in got and (0, 8) not in got and (50, 50) not in got and (50, 51) in got


def test_rank_is_one_plus_strictly_greater(spark):
    d = spark.createDataFrame([("a", 5), ("b", 5), ("c", 3), ("d", None)], "id string, v int")
    assert {r.id: r.k for r in ranks.global_rank(d, "v", "k").collect()} == {"a": 1, "b": 1, "c": 3, "d": None}


def test_milestones(spark):
    s = spark.createDataFrame([("a", D, 5000), ("a", D + timedelta(3), 12000)], "id string, day date, dl_all long")
    got = sorted((r.mark, r.day, r.before) for r in series.milestones(s).collect())
    assert got == [(1000, None, True), (10000, D + timedelta(3), False), (100000, None, False), (1000000, None, False)]


def test_card_items(spark):
    cards = ['{"datasets": "x"}', '{"datasets": ["a", 1, " b ", "a", ""]}', "{bad", "{}", None]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cards)], "k int, card string")
    from pyspark.sql import functions as F

    got = [r.v for r in df.orderBy("k").select(scalars.card_items(F.col("card"), "datasets").alias("v")).collect()]
    assert got == [["x"], ["a", "b"], [], [], []]


def test_series_round_trip_and_day_replace(spark, tmp_path):
    s = spark.createDataFrame([("a", D, 1, 10, 0), ("b", D, 2, 20, 0), ("a", D + timedelta(1), 3, 30, 0)], "id string, day date, dl30 int, dl_all long, likes int")
    path = str(tmp_path / "series")
    snapshots.write_series(s, path)
    new = spark.createDataFrame([("a", D, 7, 11, 0)], "id string, day date, dl30 int, dl_all long, likes int")
    for _ in range(2):
        snapshots.upsert_day(path, str(tmp_path / "staging"), new, D)
        got = spark.read.parquet(path)
        assert sorted((r.id, r.day, r.dl30) for r in got.collect()) == [("a", D, 7), ("a", D + timedelta(1), 3)]


def test_incremental_equals_batch_and_replaces(spark, tmp_path):
    for k in range(2):
        pd.DataFrame({"id": ["a", "b"], "downloads": [k, k + 1], "downloadsAllTime": [10 + k, 20 + k], "likes": [0, 0]}).to_parquet(tmp_path / f"{D + timedelta(k)}.parquet")
    args = (str(tmp_path) + "/*.parquet", str(tmp_path / "out"), str(tmp_path / "cp"))
    append_days(spark, *args)
    append_days(spark, *args)
    batch = snapshots.counters(snapshots.read_days(spark, args[0]))
    assert sorted((r.id, r.day, r.dl30) for r in spark.read.parquet(args[1]).collect()) == sorted((r.id, r.day, r.dl30) for r in batch.collect())
