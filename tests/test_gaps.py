"""Windows and low days of series with days without a snapshot."""

import random
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import windows
from tidemark.streaming import settling

D = date(2001, 1, 1)


def day(k):
    return D + timedelta(k)


def series(changed):
    return pd.Series([changed.get(k, 100.0) for k in range(40)], index=[day(k) for k in range(40)])


def snaps(*missing):
    return [day(k) for k in range(40) if k not in missing]


def found(spark, tot, taken=None, frozen=()):
    """Windows of one series, found by Spark and by the daily fold alike."""
    hub = spark.createDataFrame([("s", d, float(x)) for d, x in tot.items()], "series string, day date, dl double")
    shares = spark.createDataFrame([("s", d, x) for d, x in frozen], "series string, day date, share double")
    marks = None if taken is None else spark.createDataFrame([("s", d) for d in taken], "series string, day date")
    got = sorted((r.start, r.end) for r in windows.find(hub, shares, 0.25, marks).collect())
    assert got == settling.windows_of(tot.astype(float), dict(frozen), 0.25, taken or [])
    return got


def test_a_window_takes_a_whole_gap(spark):
    tot = series({16: 10, 17: 120, 18: 120})
    assert found(spark, tot) == [(day(16), day(17))]
    assert found(spark, tot, snaps(17)) == [(day(16), day(18))]
    assert found(spark, series({16: 10, 37: 10, 38: 100}), snaps(38)) == [(day(16), day(17))]


def test_a_pair_weighs_the_days_of_a_measurement(spark):
    assert found(spark, series({15: 50, 16: 50, 17: 190}), snaps(15)) == [(day(15), day(17))]
    assert found(spark, series({15: 40, 16: 40, 17: 140}), snaps(15)) == []


def test_catch_up_early_booking_and_a_run_inside_another(spark):
    # Booked two days early, made up on the third and fourth day after; a frozen day of that catch-up opens nothing of its own.
    tot = series({13: 160, 14: 160, 15: 10, 18: 150, 19: 150})
    assert found(spark, tot, frozen=[(day(17), 1.0), (day(19), 0.3)]) == [(day(13), day(19))]
    # A run that goes on behind the catch-up opens one of its own, which joins it.
    assert found(spark, tot, frozen=[(day(19), 1.0), (day(20), 1.0)]) == [(day(13), day(21))]
    assert found(spark, tot) == [(day(13), day(19))]


def test_spark_and_fold_find_the_same(spark):
    r = random.Random(5)
    hubs, shares, marks, want = [], [], [], []
    for k in range(40):
        tot = pd.Series([100.0 * r.choice([1, 1, 1, 1, 0.05, 0.5, 0.65, 1.4, 1.6, 2]) + r.randrange(5) for _ in range(60)], index=[day(x) for x in range(60)])
        frozen = {day(x): 1.0 for x in range(60) if r.random() < 0.06}
        taken = [day(x) for x in range(60) if r.random() < 0.85]
        hubs += [(str(k), d, x) for d, x in tot.items()]
        shares += [(str(k), d, x) for d, x in frozen.items()]
        marks += [(str(k), d) for d in taken]
        want += [(str(k), *w) for w in settling.windows_of(tot, frozen, 0.25, taken)]
    got = windows.find(spark.createDataFrame(hubs, "series string, day date, dl double"), spark.createDataFrame(shares, "series string, day date, share double"), 0.25, spark.createDataFrame(marks, "series string, day date"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 60


def test_settling_again_changes_nothing(spark):
    """Windows are found to a fixed point, totals are kept up to rounding, and nothing opens in what is settled."""
    hub = spark.createDataFrame([(s, d, t, int(v)) for s in ("a", "b") for t in ("x", "y") for d, v in series({16: 10, 17: 120, 18: 120, 25: 50, 26: 150}).items()], "series string, day date, pipeline_tag string, dl long")
    frozen = spark.createDataFrame([("b", day(30), 0.95)], "series string, day date, share double")
    taken = spark.createDataFrame([(s, d) for s in ("a", "b") for d in snaps(17)], "series string, day date")
    wins, settled = windows.settle(hub, frozen, 0.9, taken)
    assert sorted(map(tuple, wins.collect())) == [("a", day(16), day(18)), ("a", day(25), day(26)), ("b", day(16), day(18)), ("b", day(25), day(26)), ("b", day(30), day(31))]
    assert windows.settle(settled, frozen.limit(0), 0.9, taken)[0].isEmpty()
    sums = lambda h: sorted((r.series, r.pipeline_tag, round(r.s, -1)) for r in h.groupBy("series", "pipeline_tag").agg(F.sum("dl").alias("s")).collect())
    assert sums(hub) == sums(settled)


def test_low_days_go_by_measurement_and_run(spark):
    hub = spark.createDataFrame([("s", d, v) for d, v in series({10: 40, 15: 40, 16: 95, 22: 20, 23: 20, 24: 190}).items()], "series string, day date, dl double")
    none = spark.createDataFrame([], "series string, day date, share double")
    facts = windows.day_facts(hub, none, 0.25, spark.createDataFrame([("s", d) for d in snaps(15)], "series string, day date"))
    one = spark.createDataFrame([("s", k, 1.0) for k in range(1, 8)], "series string, weekday int, factor double")
    short = spark.createDataFrame([("s", day(10))], "series string, day date")
    assert sorted(r.day for r in windows.low_days(facts, one, short.limit(0)).collect()) == [day(10), day(15), day(16)]
    assert sorted(r.day for r in windows.low_days(facts, one, short).collect()) == [day(15), day(16)]
