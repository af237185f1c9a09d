"""Which snapshots to measure from: rollbacks that recover, lasting corrections, partial snapshots.

What the rules ask for are facts of a day: its number of counters, the share of them that fell since the day before, and what they
are short of the day before each fall of the last eight. Spark works these out for all series and days at once. The verdicts are
then a fold over the facts of a series, one small row a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the rules.
BACK, RECOVERED, MOST_HELD, PARTIAL = 0.05, 0.10, 8, 0.5

_OUT = "array<struct<p:int,verdict:string,base:int>>"


def whole_days(sizes: DataFrame) -> DataFrame:
    """(series, p, day, n): numbered days of sizes(series, day, n) with at least half as many rows as the whole day before."""

    def step(done, x):
        partial = (F.size(done) > 0) & (x["n"] < F.lit(PARTIAL) * F.element_at(done, -1)["n"])
        return F.when(partial, done).otherwise(F.concat(done, F.array(x)))

    days = sizes.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("day", F.col("n").cast("long").alias("n")))).alias("days"))
    kept = F.aggregate("days", F.array().cast("array<struct<day:date,n:bigint>>"), step)
    return days.select("series", F.posexplode(kept).alias("p", "x")).select("series", "p", "x.day", "x.n")


def facts(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(days, gaps) of series(series, id, day, dl_all): days(series, p, day, n, back) and gaps(series, since, p, missing).

    back: share of the counters of a whole day and the one before that fell. missing: what the counters of day p are short of
    those of the day before `since`, a day at which more than BACK of them fell, up to MOST_HELD days earlier.
    """
    counted = series.filter("dl_all IS NOT NULL").select("series", "id", "day", "dl_all")
    whole = whole_days(counted.groupBy("series", "day").agg(F.count("*").alias("n")))
    rows = counted.join(whole, ["series", "day"])
    w = W.partitionBy("series", "id").orderBy("p")
    met = F.lag("p").over(w) == F.col("p") - 1
    fell = rows.select("series", "p", F.when(met, F.col("dl_all") < F.lag("dl_all").over(w)).alias("fell")).groupBy("series", "p").agg(F.avg(F.col("fell").cast("int")).alias("back"))
    days = whole.join(fell, ["series", "p"], "left")
    falls = days.filter(F.col("back") > BACK).select("series", F.col("p").alias("since"))
    base = rows.join(falls.withColumn("p", F.col("since") - 1), ["series", "p"]).select("series", "since", "id", F.col("dl_all").alias("had"))
    behind = falls.select("series", "since", F.explode(F.sequence("since", F.col("since") + MOST_HELD)).alias("p"))
    lost = rows.join(behind, ["series", "p"]).join(base, ["series", "since", "id"])
    return days, lost.groupBy("series", "since", "p").agg(F.sum(F.greatest(F.lit(0), F.col("had") - F.col("dl_all"))).cast("double").alias("missing"))


def judged(days: DataFrame, gaps: DataFrame) -> DataFrame:
    """(series, day, verdict, base) by a fold over the days of each series; see `usable_snapshots`."""
    known = gaps.groupBy("series", "p").agg(F.map_from_entries(F.collect_list(F.struct("since", "missing"))).alias("missing"))
    row = F.struct("p", F.coalesce("back", F.lit(0.0)).alias("back"), "missing")
    line = days.join(known, ["series", "p"], "left").groupBy("series").agg(F.array_sort(F.collect_list(row), lambda a, b: a["p"] - b["p"]).alias("line"))
    none = F.lit(None).cast("int")

    def entry(p, verdict, base):
        return F.array(F.struct(p.cast("int").alias("p"), F.lit(verdict).alias("verdict"), base.cast("int").alias("base")))

    def state(since, first, more, done):
        return F.struct(since.cast("int").alias("since"), first.cast("double").alias("first"), F.concat(done["out"], more).alias("out"))

    def step(done, x):
        p, since, calm = x["p"], done["since"], F.lit(-1)
        missing = F.coalesce(F.try_element_at(x["missing"], F.when(since < 0, p).otherwise(since)), F.lit(0.0))
        released = F.transform(F.sequence(since, p), lambda q: F.struct(q.cast("int").alias("p"), F.lit("release").alias("verdict"), (q - 1).cast("int").alias("base")))
        return (
            F.when(p == 0, state(calm, F.lit(0.0), entry(p, "first", none), done))
            .when((since < 0) & (x["back"] <= BACK), state(calm, F.lit(0.0), entry(p, "use", p - 1), done))
            .when(since < 0, state(p, missing, entry(p, "hold", none), done))
            .when(missing <= RECOVERED * done["first"], state(calm, F.lit(0.0), entry(p, "use", since - 1), done))
            .when(p - since >= MOST_HELD, state(calm, F.lit(0.0), released, done))
            .otherwise(state(since, done["first"], entry(p, "hold", none), done))
        )

    start = F.struct(F.lit(-1).alias("since"), F.lit(0.0).alias("first"), F.array().cast(_OUT).alias("out"))
    out = line.select("series", F.posexplode(F.aggregate("line", start, step)["out"]).alias("at", "x"))
    # A held day that is released after all is listed twice; the last entry counts.
    last = out.groupBy("series", F.col("x.p").alias("p")).agg(F.max_by("x", "at").alias("x"))
    named = days.select("series", F.col("p").alias("base"), F.col("day").alias("base_day"))
    return last.select("series", "x.*").join(days.select("series", "p", "day"), ["series", "p"]).join(named, ["series", "base"], "left").select("series", "day", "verdict", F.col("base_day").alias("base"))


def usable_by_series(series: DataFrame) -> DataFrame:
    """`usable_snapshots` for each series of (series, id, day, dl_all): (series, day, verdict, base)."""
    days, gaps = facts(series)
    whole = judged(days, gaps)
    partial = series.filter("dl_all IS NOT NULL").select("series", "day").distinct().join(days.select("series", "day"), ["series", "day"], "left_anti")
    return whole.unionByName(partial.withColumns({"verdict": F.lit("partial"), "base": F.lit(None).cast("date")}))


def usable_snapshots(series: DataFrame) -> DataFrame:
    """(day, verdict, base): what to do with each snapshot of (id, day, dl_all): first, use, hold, release or partial, and the one it is measured from.

    A snapshot with under half the rows of the one before is partial and left out. One in which over 5 % of the counters fell
    against the one before opens an episode against the last used one: it and those after it are held until what is missing to
    that base is a tenth of what it was (use), or until eight are held and the lower level is accepted (release; the held ones
    then count after all, one after the other).
    """
    return usable_by_series(series.withColumn("series", F.lit(""))).drop("series")
