from datetime import date

from pyspark.sql import functions as F

from tidemark.operators import boards, galaxy, summary, uses

D = date(2025, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_papers(spark):
    e = spark.createDataFrame([("a", ["arxiv:2401.01234", "arxiv: 2401.01234", "arxiv:24.1"]), ("b", ["arxiv:2401.01234"]), ("c", None)], "id string, tags array<string>")
    refs = uses.paper_refs(e)
    assert rows(refs) == [("a", "2401.01234"), ("b", "2401.01234")]
    m = spark.createDataFrame([("a", None, 3), ("b", 5, 7)], "id string, dl30 long, dl_all long")
    got = uses.paper_models(refs, m).first()
    assert (got.models, got.dl30, got.dl_all, [tuple(t) for t in got.top]) == (2, 5, 10, [("b", 5), ("a", 0)])


def test_used_by_counts_a_model_once_and_skips_the_owner(spark):
    u = spark.createDataFrame([("model", "x/m", "dataset", "o/1"), ("model", "x/m", "dataset", "o/2"), ("model", "o/m", "dataset", "o/1"), ("space", "y/s", "dataset", "o/1"), ("space", "o/s", "dataset", "o/1")], "src_kind string, src string, dst_kind string, dst string")
    d = spark.createDataFrame([("o/1", "o"), ("o/2", "o")], "id string, author string")
    m = spark.createDataFrame([("x/m", "x", 9), ("o/m", "o", 50)], "id string, author string, dl30 long")
    none = spark.createDataFrame([], "id string, author string")
    assert rows(uses.used_by(u, d, m, none)) == [("o", 1, 9, 1, "x/m", "o/1")]


def test_focus(spark):
    n = spark.createDataFrame([("r", "r", None, 0), ("r", "a", "r", 1), ("r", "b", "a", 2), ("r", "c", "b", 3), ("r", "d", "r", 1)], "root string, id string, parent string, depth int")
    picks = spark.createDataFrame([("r", "b")], "root string, pick string")
    assert rows(galaxy.focus(n, picks)) == [("r", "b", "a", "above"), ("r", "b", "c", "below")]


def test_rising_asks_for_ten_likes_before(spark):
    s = spark.createDataFrame([("a", 50, 23, 46, 1, D), ("b", 50, 20, 25, 1, D)], "id string, likes long, likes_7d long, likes_30d long, trending long, created_at date")
    got = boards.live_space_boards(s, F.lit(D)).filter("board = 'rising'")
    assert rows(got.select("id", "value")) == [("a", round(23 / 7 - 1, 6))]


def test_like_concentration_empty_and_ties(spark):
    empty = spark.createDataFrame([], "likes long")
    assert rows(summary.like_concentration(empty)) == [(0, None, None, 0)]
    some = spark.createDataFrame([(1,)] * 99 + [(1001,)] * 2 + [(None,)], "likes long")
    assert rows(summary.like_concentration(some)) == [(101, round(99 / 101, 6), round(2002 / 2101, 6), 2)]


def test_rebuilt(spark):
    h = spark.createDataFrame([(D, "t", 4)], "day date, pipeline_tag string, dl long")
    assert rows(summary.rebuilt(h, h.limit(0), h, h.limit(0))) == [(4, 1, 0, 0, 0, 1)]
