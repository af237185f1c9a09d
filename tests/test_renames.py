"""Renames between every two neighbouring snapshot days."""

import datetime as dt

from tidemark.operators import identity


def test_new_count_may_lie_within_one_percent_under_the_bound(spark):
    prev = spark.createDataFrame([("o/m", 1000), ("o/k", 1000), ("o/low", 999)], "id string, dl_all long")
    cur = spark.createDataFrame([("p/m", 990), ("p/k", 989), ("p/low", 999)], "id string, dl_all long")
    assert [tuple(r) for r in identity.find_renames(prev, cur).collect()] == [("o/m", "p/m")]


def test_every_pair_of_days_gives_what_the_pair_alone_gives(spark):
    d = [dt.date(2001, 1, k) for k in (1, 2, 5, 6)]
    on = {
        d[0]: {"o/a": 2000, "o/b": 5000, "x/y": 7000, "u/v": 1000},
        d[1]: {"p/a": 2010, "o/b": 5000, "x/y": 7000, "w/v": 991},
        d[2]: {"p/a": 2020, "q/b": 5040, "z/y": 7001, "zz/y": 7002},
        d[3]: {"o/a": 2020, "q/b": 5100, "z/y": 9000, "zz/y": 9000},
    }
    series = spark.createDataFrame([(i, day, n) for day, ids in on.items() for i, n in ids.items()], "id string, day date, dl_all long")
    want = set()
    for a, b in zip(d, d[1:]):
        one = [series.filter(series.day == x).select("id", "dl_all") for x in (a, b)]
        want |= {(b, r.old, r.new) for r in identity.find_renames(*one).collect()}
    got = [tuple(r) for r in identity.find_renames_by_day(series).collect()]
    assert sorted(got) == sorted(want) == [(d[1], "o/a", "p/a"), (d[1], "u/v", "w/v"), (d[2], "o/b", "q/b"), (d[3], "p/a", "o/a")]
    assert (d[2], "x/y", "z/y") in {tuple(r) for r in identity.rename_candidates_by_day(series).collect()}


def test_neighbouring_days_are_met_in_one_pass(spark, monkeypatch):
    """Rows that come twice, quiet days and unknown counts; and the series is read for its days and once more, not once a join."""
    d = [dt.date(2001, 1, k) for k in (1, 2, 3)]
    rows = [("o/a", d[0], 2000), ("o/a", d[0], 2000), ("p/a", d[1], 2001), ("p/a", d[2], 2001), ("o/b", d[0], None), ("p/b", d[1], 1000), ("o/c", d[2], 3000), (None, d[1], 2000), ("o/z", None, 2000)]
    series = spark.createDataFrame(rows, "id string, day date, dl_all long")
    kept, cut = [], identity.cut
    monkeypatch.setattr(identity, "cut", lambda df: kept.append(df) or cut(df))
    got = identity.rename_candidates_by_day(series)
    assert [tuple(r) for r in got.collect()] == [(d[1], "o/a", "p/a")]
    assert len(kept) == 2 and "Join" not in kept[1]._jdf.queryExecution().optimizedPlan().toString().replace("Join Inner, (day", "")
