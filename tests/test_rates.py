"""Rates, steps and sums of ids that come late, pause, lose counts or have none, against values worked out by hand."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.operators import quality, ranks, rollups, search, series

D = date(2025, 6, 30)


def back(n):
    return D - timedelta(n)


def history(spark, points):
    """points: {id: {days back: (dl30, dl_all, likes)}}"""
    return spark.createDataFrame([(i, back(n), *v) for i, days in points.items() for n, v in days.items()], "id string, day date, dl30 int, dl_all long, likes int")


def test_metrics(spark):
    s = history(
        spark,
        {
            "a/steady": {35: (300, 1000, 1), 28: (300, 1070, 2), 14: (300, 1210, 4), 8: (300, 1280, 5), 3: (300, 1300, 6), 1: (300, 1300, 6), 0: (300, 1320, 7)},
            "a/new": {4: (70, 60, 3), 0: (70, 90, 5)},
            "a/paused": {60: (50, 10, 1), 20: (50, 40, 1), 5: (70, 60, 2), 0: (70, 70, 2)},
            "a/still": {31: (20, 500, 0), 7: (20, 500, 0), 0: (20, 500, 0)},
            "a/unknown": {10: (20, None, 1), 0: (20, 500, 2)},
            "a/gone": {7: (1, 1, 1)},
        },
    )
    got = {r.id: r for r in series.metrics(s).collect()}
    assert set(got) == {"a/steady", "a/new", "a/paused", "a/still", "a/unknown"}
    r = got["a/steady"]
    assert (r.dl_7d, r.dl_prev7d, round(r.dl_base7d, 6), r.likes_7d) == (35, 82, 73.5, 2)  # 40 in 8 days; 70 in 6; 210 in 20
    assert (r.peak_share, r.steps, r.growth_7d) == (0.5, 3, None)
    r = got["a/new"]
    assert (r.dl_7d, r.likes_7d, r.dl_base7d, r.peak_share, r.steps) == (70, 5, None, 1.0, 1)
    r = got["a/paused"]  # no snapshot 7 to 17 days back, and not new: unknown
    assert (r.dl_7d, r.likes_7d, r.peak_share, r.steps) == (None, None, 1.0, 1)
    r = got["a/still"]
    assert (r.dl30, r.dl_7d, r.peak_share, r.steps) == (0, 0, None, 1)
    assert (got["a/unknown"].dl_7d, got["a/unknown"].likes_7d) == (None, 1)
    skipped = series.metrics(s, spark.createDataFrame([(back(8),), (back(0),)], "day date")).filter("id = 'a/steady'").first()
    assert skipped.dl_7d == 55  # 110 in 14 days


def test_spaces(spark):
    s = history(spark, {"a/x": {33: (0, 0, 10), 8: (0, 0, 12), 0: (0, 0, 20)}, "a/new": {2: (0, 0, 3), 0: (0, 0, 5)}, "a/old": {50: (0, 0, 1), 20: (0, 0, 2), 0: (0, 0, 9)}, "a/less": {7: (0, 0, 9), 0: (0, 0, 4)}})
    got = {r.id: (r.likes, r.likes_7d, r.likes_30d) for r in series.space_metrics(s).collect()}
    assert got == {"a/x": (20, 7, 9), "a/new": (5, 5, 5), "a/old": (9, None, None), "a/less": (4, 0, 4)}


def test_increments_and_signals(spark):
    s = history(spark, {"a/x": {3: (90, 100, 0), 2: (90, 100, 0), 0: (90, 120, 0)}, "b/y": {3: (10, 50, 0), 2: (10, 40, 0), 0: (99, 40, 0)}, "c/z": {3: (95, 7, 0), 2: (95, None, 0), 0: (95, 9, 0)}})
    tags = spark.createDataFrame([("a/x", "t"), ("c/z", "u")], "id string, tag string")
    got = sorted(tuple(r) for r in series.hub_increment(s, tags).collect())
    assert got == sorted([(back(2), "t", 0), (back(2), "other", 0), (back(1), "t", 10), (back(0), "t", 10), (back(1), "other", 0), (back(0), "other", 0)])
    signals = {r.day: (r.frozen, r.back) for r in quality.signals(s, 80, 1).collect()}
    assert signals == {back(2): (1.0, 0.5), back(0): (0.0, 0.0)}


def test_a_quiet_day_keeps_its_week(spark):
    points = {n: (0, 1000 - (n // 7) * 10, 0) for n in range(0, 40)}
    repos, spans = rollups.summed_gaps(rollups.gap_gains(history(spark, {"a/x": points}), spark.createDataFrame([("a/x", "a")], "id string, author string"), back(30), back(0)))
    r = rollups.year_summary(repos, spans, str(back(30)), str(back(0))).first()
    assert r.rank == 1 and r.top_id == "a/x" and r.best_week is not None
    assert rollups.by_days(spans).filter("gain = 0").count() > 20


def test_a_long_gap_falls_into_weeks_and_months_by_its_days(spark):
    """Gaps of many days that cross both ends of the window, weeks and months: the same as day by day."""
    points = {n: (0, v, 0) for n, v in {77: 0, 70: 70, 20: 1070, 19: 900, 3: 1100, 0: 1103}.items()}
    repos, spans = rollups.summed_gaps(rollups.gap_gains(history(spark, {"a/x": points, "a/y": points}), spark.createDataFrame([("a/x", "a"), ("a/y", "a")], "id string, author string"), back(65), back(1)))
    daily = {}
    stamps = sorted(points, reverse=True)
    for a, b in zip(stamps, stamps[1:]):
        for n in range(b, a):
            if 65 > n and b >= 1 and a <= 75:
                daily[back(n)] = daily.get(back(n), 0) + 2 * max(0, points[b][1] - points[a][1]) / (a - b)
    for unit, begin in (("week", lambda d: d - timedelta(d.weekday())), ("month", lambda d: d.replace(day=1))):
        want = {}
        for d, v in daily.items():
            want[begin(d)] = want.get(begin(d), 0) + v
        assert {r.period: round(r.v, 6) for r in rollups.by_periods(spans, unit).collect()} == {k: round(v, 6) for k, v in want.items()}
    assert {r.day: r.gain for r in rollups.by_days(spans).collect()} == {d: round(v, 4) for d, v in daily.items()}
    assert abs(sum(r.downloads for r in repos.collect()) - sum(daily.values())) < 1e-6


def test_likes_of_an_author_are_summed_before_the_floor(spark):
    s = history(spark, {"a/x": {12: (0, 0, 50), 0: (0, 0, 60)}, "a/y": {11: (0, 0, 90), 0: (0, 0, 40)}, "b/z": {40: (0, 0, 30), 0: (0, 0, 35)}})
    authors = spark.createDataFrame([("a/x", "a"), ("a/y", "a"), ("b/z", "b")], "id string, author string")
    assert sorted(tuple(r) for r in rollups.likes_gained(s, authors, back(10), back(0)).collect()) == [("a", 0, 0), ("b", 35, 0)]


def test_other_and_untagged_are_no_top_tags(spark):
    hub = spark.createDataFrame([(back(90), "a", 5), (back(91), "b", 50), (back(0), "other", 99), (back(0), "c", 1)], "day date, pipeline_tag string, dl long")
    assert {r.pipeline_tag for r in rollups.hub_chart(hub, 2).collect()} == {"a", "c", "other"}
    mix = spark.createDataFrame([("x", None, 80), ("x", "a", 15), ("x", "b", 5), ("y", "a", 3), ("y", "b", 1)], "author string, tag string, v long")
    assert sorted((r.author, r.tag, r.share) for r in rollups.task_mix(mix).collect()) == [("x", "a", None), ("x", "b", None), ("y", "a", 0.75), ("y", "b", 0.25)]


def test_search_knows_whom_a_request_means(spark):
    index = spark.createDataFrame([("Qwen/Qwen3-0.6B", 900, None), ("other/qwen-0.6b-copy", 5000, None), ("qwen", 1, None), ("z/thing", 3, "Qwen talk"), ("qwenlike/best", 4000, None), ("a/qwen", 100, None), ("b/qwen", 4999, None), ("z/none", None, None)], "id string, pop long, title string")
    ask = spark.createDataFrame([(1, "qwen 0.6b"), (2, "  QWEN "), (3, ""), (4, "qw"), (5, "none")], "qid int, q string")
    got = {}
    for r in search.ranked(ask, index, 20).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got[1] == ["Qwen/Qwen3-0.6B", "other/qwen-0.6b-copy"]
    assert got[2] == ["qwen", "Qwen/Qwen3-0.6B", "b/qwen", "other/qwen-0.6b-copy", "qwenlike/best", "a/qwen", "z/thing"]
    assert 3 not in got and len(got[4]) == 7 and got[5] == ["z/none"]


def test_a_kept_index_answers_without_its_texts(spark, tmp_path):
    """Written once and read for each of ten requests, short ones among them: the same rows, and no text is cut into runs again."""
    index = spark.createDataFrame([(f"o{k % 7}/model-{k}", k * 37 % 101, "a b" if k % 5 else None) for k in range(200)], "id string, pop long, title string")
    asks = [(1, "model-1"), (2, "o3"), (3, "o"), (4, "1"), (5, "a b"), (6, "zz"), (7, "o1 9"), (8, "MODEL-77"), (9, "mo el"), (10, "6/m")]
    want = sorted(map(tuple, search.ranked(spark.createDataFrame(asks, "qid int, q string"), index, 5).collect()))
    search.index_of(index).write(str(tmp_path / "index"))
    kept, got = search.Index.read(spark, str(tmp_path / "index")), []
    for ask in asks:
        one = spark.createDataFrame([ask], "qid int, q string")
        plan = kept.holding(search.asked_for(one))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == 1 and "Cartesian" not in plan and "Cross" not in plan
        got += map(tuple, search.ranked(one, kept, 5).collect())
    assert sorted(got) == want
    for qid, q in asks:
        assert bool([r for r in want if r[0] == qid]) == (q != "zz")


def test_a_request_that_many_share_is_matched_once(spark, monkeypatch):
    index = spark.createDataFrame([(f"o{k % 7}/model-{k}", k * 37 % 101, None) for k in range(100)], "id string, pop long, title string")
    met, holding = [], search.Index.holding
    monkeypatch.setattr(search.Index, "holding", lambda self, requests, *more: met.append(holding(self, requests, *more)) or met[-1])
    asks = spark.createDataFrame([(k, ("Model", " model ", "model-7 o0")[k % 3]) for k in range(60)], "qid int, q string")
    got = {}
    for r in search.ranked(asks, index, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id))
    assert met[0].count() == 100 + 3  # not 40 times 100 and 20 times 3
    assert len(got) == 60 and got[0] == got[1] == got[57] and [r for r, _ in got[0]] == [1, 2, 3, 4, 5]
    assert got[2] == got[59] and sorted(i for _, i in got[2]) == ["o0/model-7", "o0/model-70", "o0/model-77"]
    assert search.index_of(index, search.asked_for(asks)).counts.count() < search.index_of(index).counts.count()


def test_boards(spark):
    m = spark.createDataFrame([("a/x", "a", back(90), 10, 10, 5, 2.0, 0, None, None, 0), ("b/y", None, back(3), 20, 20, 9, 0.0, 1, None, 0.9, 4), ("c/z", "c", back(9), 1, 1, 1, 0.0, 1, None, 0.9, 2)], "id string, author string, first_seen date, dl30 int, dl_all long, dl_7d long, dl_base7d double, likes_7d long, growth_7d double, peak_share double, steps int")
    got = {}
    for r in ranks.model_boards(m, F.lit(D)).orderBy("board", "rank").collect():
        got.setdefault(r.board, []).append(r.id)
    assert got["gainers_7d"] == ["b/y", "a/x", "c/z"] and got["breakouts"] == ["c/z"] and got["authors_dl30"] == ["a", "c"]
