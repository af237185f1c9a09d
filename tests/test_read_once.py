"""Steps that read a long series once where they read it several times."""

import datetime as dt

from tidemark.operators import quality, report, rollups
from tidemark.sources import snapshots

D = [dt.date(2001, 1, 30) + dt.timedelta(days=k) for k in range(4)]


def _reads(spark, df, seen, name):
    """df, counting its rows each time that they are made."""
    more = spark.sparkContext.accumulator(0)
    seen[name] = more

    def count(batches):
        for b in batches:
            more.add(b.num_rows)
            yield b

    return df.mapInArrow(count, df.schema)


def test_authors_of_the_last_day_follow_from_the_sums(spark):
    rows = [("a/x", D[0], 1, 900, 1), ("a/y", D[3], 5, None, 2), ("a/x", D[3], 2, 996, 3), ("b/z", D[0], 1, 5000, 1), ("c/q", D[3], 7, 999, 1)]
    series = spark.createDataFrame(rows, "id string, day date, dl30 long, dl_all long, likes long")
    authors = series.selectExpr("id", "split_part(id, '/', 1) AS author").distinct()
    seen = {}
    got = rollups.author_series(_reads(spark, series, seen, "n"), authors, 1000).collect()
    assert sorted(map(tuple, got)) == [("a", D[0], 1, 900, 1, 1), ("a", D[3], 7, 996, 5, 2)]
    assert seen["n"].value <= 2 * len(rows)


def test_both_ranks_come_from_one_reading(spark):
    df = spark.createDataFrame([(k, 10 - k) for k in range(10)] + [(None, 1)], "a long, b long")
    seen = {}
    assert report.spearman(_reads(spark, df, seen, "n"), "a", "b").first().rho == -1.0
    assert seen["n"].value == 11


def test_a_writer_that_knows_its_months_does_not_count_them(spark, tmp_path):
    series = spark.createDataFrame([("a/x", d, k) for k, d in enumerate(D)], "id string, day date, dl30 long")
    seen = {}
    snapshots.write_series(_reads(spark, series, seen, "n"), str(tmp_path / "s"), files=1, months=2)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).select("id", "day", "dl30").collect())) == [("a/x", d, k) for k, d in enumerate(D)]
    assert seen["n"].value == 2 * 4  # once for its ranges, once to be written


def test_signals_come_from_one_reading(spark):
    # b has no total on the second day, c no row, d comes late; the third day is the first one's next neighbour for none.
    rows = [("a", D[0], 90, 5), ("a", D[1], 90, 5), ("a", D[2], 90, 4), ("b", D[0], 90, 7), ("b", D[1], 90, None), ("b", D[2], 90, 7), ("c", D[0], 90, 1), ("c", D[2], 90, 0), ("d", D[3], 90, 3)]
    series = spark.createDataFrame(rows, "id string, day date, dl30 long, dl_all long")
    seen = {}
    got = quality.signals(_reads(spark, series, seen, "n"), 50, 1)
    assert sorted(map(tuple, got.collect())) == [(D[1], 1.0, 0.0), (D[2], 0.0, 1.0)]
    assert seen["n"].value == len(rows)
