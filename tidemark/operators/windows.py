"""Stalls, dips and low days of day series, as set operations over all series at once.

A series has one row a day. Facts of a day (its ratio to the local median, how far a catch-up behind it or an early booking before it
goes, the stretch that its snapshot measured) come from window functions over the series; runs are islands of neighbouring rows,
and measurements are blocks that look at the block before and after. Only which of two overlapping runs opens a window depends on
the one before: that is a fold over the few runs of a series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.staging import cut

#: Fixed values of the rules.
STALL, DIP, HIGH, EARLY = 0.3, 0.7, 1.3, 1.5
PAIR_LOW, PAIR_HIGH = 1.6, 2.4
AROUND, LEAST_AROUND = 7, 5
MERGE_DAYS, ROUNDS = 2, 10
MADE_UP, MADE_UP_DAYS = 0.5, 3


def _series():
    return W.partitionBy("series")


def _by_day():
    return _series().orderBy("day")


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def day_facts(hub: DataFrame, frozen: DataFrame, least_frozen: float, snaps: DataFrame | None = None) -> DataFrame:
    """One row a series and day of hub(series, day, dl).

    k, n: place of the day and number of days; last: the series' last day. stalled: far under the median, or most counters frozen
    by frozen(series, day, share). reach: how many days behind a stall that ends here belong to it; early: how many before one
    that begins here. closes: the snapshot that measured the day; opened: the one before; block: the day of the measurement, for
    days behind the last snapshot its own. Without snaps(series, day) each day is a measurement.
    """
    around = _by_day().rowsBetween(-AROUND, AROUND)
    t = hub.groupBy("series", "day").agg(F.sum("dl").cast("double").alias("tot"))
    t = t.withColumn("median", F.when(F.count("*").over(around) >= LEAST_AROUND, F.percentile("tot", 0.5).over(around)))
    t = t.withColumns({"ratio": F.when(F.col("median") > 0, F.col("tot") / F.col("median")).otherwise(1.0), "k": F.row_number().over(_by_day()) - 1, "n": F.count("*").over(_series()).cast("int"), "last": F.max("day").over(_series())})
    high = [_is(F.lead("ratio", d).over(_by_day()) > HIGH) for d in range(5)]
    booked = [_is(F.lag("ratio", d).over(_by_day()) > EARLY) for d in range(3)]
    t = t.withColumns({"reach": F.when(high[3] & high[4], 4).when(high[3], 3).when(high[2], 2).otherwise(1), "early": F.when(booked[1] & booked[2], 2).when(booked[1], 1).otherwise(0)})
    t = t.join(frozen.groupBy("series", "day").agg(F.max("share").alias("share")), ["series", "day"], "left")
    t = t.withColumn("stalled", (F.col("ratio") < STALL) | _is(F.col("share") >= least_frozen)).drop("share")
    none = F.lit(None).cast("date")
    if snaps is None:
        return t.withColumns({"closes": none, "opened": none, "block": F.col("day")})
    facts = [c for c in t.columns if c not in ("series", "day")]
    both = t.select("series", "day", F.struct(*facts).alias("f"), none.alias("s")).unionByName(snaps.select("series", "day", F.lit(None).alias("f"), F.col("day").alias("s")))
    one = both.groupBy("series", "day").agg(F.max("f").alias("f"), F.max("s").alias("s"))
    closes, opened = F.min("s").over(_by_day().rowsBetween(0, W.unboundedFollowing)), F.max("s").over(_by_day().rowsBetween(W.unboundedPreceding, -1))
    one = one.withColumns({"closes": closes, "opened": opened, "block": F.coalesce(closes, F.max("s").over(_series()), "day")})
    return one.filter("f IS NOT NULL").select("series", "day", "f.*", "closes", "opened", "block")


def stalls(facts: DataFrame) -> DataFrame:
    """(series, start, end, opened, closes): runs of stalled days with the days that belong to them.

    A run inside the days of the one before belongs to it; of a run that goes on behind them, the rest is a run of its own. A
    window that reaches the last day waits.
    """
    rows = facts.filter("stalled").withColumn("_run", F.col("k") - F.row_number().over(_by_day()))
    early = F.transform(F.array_sort(F.collect_list(F.struct("k", "early"))), lambda x: x["early"])
    run = rows.groupBy("series", "_run").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max_by("reach", "k").alias("reach"), early.alias("early"))
    runs = run.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("first", "last", "reach", "early"))).alias("runs"))

    def step(done, r):
        begin = F.greatest(r["first"], done["until"] + 1)
        end = r["last"] + r["reach"]
        opened = F.struct((begin - F.get(r["early"], begin - r["first"])).alias("a"), end.alias("b"))
        return F.when(begin > r["last"], done).otherwise(F.struct(end.alias("until"), F.concat(done["found"], F.array(opened)).alias("found")))

    start = F.struct(F.lit(-1).alias("until"), F.array().cast("array<struct<a:int,b:int>>").alias("found"))
    found = runs.select("series", F.explode(F.aggregate("runs", start, step)["found"]).alias("w")).select("series", "w.a", "w.b")
    first = facts.select("series", F.col("k").alias("a"), F.col("day").alias("start"), "opened")
    final = facts.filter("k < n - 1").select("series", F.col("k").alias("b"), F.col("day").alias("end"), "closes", "last")
    return found.join(first, ["series", "a"]).join(final, ["series", "b"]).select("series", "start", "end", "opened", "closes", "last")


def dips(facts: DataFrame) -> DataFrame:
    """(series, start, end, opened, closes): measurements of half depth that the one before or behind makes up.

    A measurement is one value spread over its days, so its days weigh in the sum of the two. The one before comes first.
    """
    block = facts.groupBy("series", "block", "last").agg(
        F.min("k").alias("lo"), F.max("k").alias("hi"), F.max("n").alias("n"), F.count("*").alias("w"), F.avg("ratio").alias("r"), F.min("day").alias("from"), F.max("day").alias("to"), F.min_by("opened", "k").alias("opened"), F.max_by("closes", "k").alias("closes")
    )
    order = _series().orderBy("lo")
    whole = F.struct("w", "r", "from", "to", "opened", "closes")
    block = block.withColumns({"a": F.lag(whole).over(order), "b": F.lead(whole).over(order)})
    half = (F.col("r") >= STALL) & (F.col("r") < DIP) & (F.greatest("lo", F.lit(1)) <= F.least(F.col("hi"), F.col("n") - 3))

    def made_up(other: str) -> Column:
        mean = 2 * (F.col("r") * F.col("w") + F.col(f"{other}.r") * F.col(f"{other}.w")) / (F.col("w") + F.col(f"{other}.w"))
        return _is((F.col(f"{other}.r") > HIGH) & mean.between(PAIR_LOW, PAIR_HIGH))

    before = F.struct(F.col("a.from").alias("start"), F.col("to").alias("end"), F.col("a.opened").alias("opened"), "closes")
    behind = F.struct(F.col("from").alias("start"), F.col("b.to").alias("end"), "opened", F.col("b.closes").alias("closes"))
    w = F.when(made_up("a"), before).when(made_up("b") & (F.col("hi") + 1 < F.col("n") - 1), behind)
    return block.filter(half).select("series", w.alias("w"), "last").filter("w IS NOT NULL").select("series", "w.*", "last")


def merged(wins: DataFrame, gap: int = MERGE_DAYS) -> DataFrame:
    """Windows (series, start, end) at most `gap` days apart become one."""
    order = _series().orderBy("start", "end")
    m = wins.withColumn("_to", F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)))
    m = m.withColumn("_g", F.count_if(~_is(F.col("start") <= F.date_add("_to", gap))).over(order))
    return m.groupBy("series", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def find(hub: DataFrame, frozen: DataFrame, least_frozen: float, snaps: DataFrame | None = None) -> DataFrame:
    """(series, start, end): windows of stalls and dips. A window takes a whole stretch without snapshots or none of it; one that reaches the last day waits."""
    facts = cut(day_facts(hub, frozen, least_frozen, snaps))
    found = stalls(facts).unionByName(dips(facts))
    # greatest and least pass over nulls: without a snapshot on that side the day itself bounds the window.
    whole = found.select("series", F.least("start", F.date_add("opened", 1)).alias("start"), F.greatest("end", "closes").alias("end"), "last")
    return merged(whole.filter(F.col("end") < F.col("last")).drop("last"))


def days_of(wins: DataFrame, hub: DataFrame) -> DataFrame:
    """(series, start, end, day): the days of the hub inside windows."""
    inside = wins.select("series", "start", "end", F.explode(F.sequence("start", "end")).alias("day"))
    return inside.join(hub.select("series", "day").distinct(), ["series", "day"], "left_semi")


def but_last(days: DataFrame) -> DataFrame:
    """The days of windows without the last one of each."""
    last = F.max("day").over(W.partitionBy("series", "start", "end"))
    return days.withColumn("_last", last).filter("day < _last").drop("_last")


def spread(hub: DataFrame, days: DataFrame) -> DataFrame:
    """hub(series, day, pipeline_tag, dl) with each window's total of a tag spread evenly over its days, also those on which it had none."""
    window = ["series", "start", "end"]
    total = hub.join(days, ["series", "day"]).groupBy(*window, "pipeline_tag").agg(F.sum("dl").alias("_t"))
    flat = days.withColumn("_n", F.count("*").over(W.partitionBy(*window))).join(total, window)
    flat = flat.select("series", "day", "pipeline_tag", F.bround(F.col("_t") / F.col("_n")).cast("long").alias("dl"))
    return hub.join(days, ["series", "day"], "left_anti").select("series", "day", "pipeline_tag", F.col("dl").cast("long").alias("dl")).unionByName(flat)


def settle(hub: DataFrame, frozen: DataFrame, least_frozen: float, snaps: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(windows, settled hub): windows of hub(series, day, pipeline_tag, dl) found again after spreading until none is new.

    Spreading moves the medians around a window and may show a smaller one beside it. A window is new if a day of it but the last
    lies in no earlier one. All series go through a round together; each round is written, ten at most.
    """
    hub, frozen, snaps = cut(hub), cut(frozen), snaps and cut(snaps)
    settled, wins = hub.select("series", "day").limit(0), hub.select("series", F.col("day").alias("start"), F.col("day").alias("end")).limit(0)
    for _ in range(ROUNDS):
        open_ = frozen.join(settled, ["series", "day"], "left_anti")
        days = days_of(find(hub, open_, least_frozen, snaps), hub)
        fresh = but_last(days).join(settled, ["series", "day"], "left_anti").select("series", "start", "end").distinct()
        days = cut(days.join(fresh, ["series", "start", "end"], "left_semi"))
        if days.isEmpty():
            break
        hub = cut(spread(hub, days))
        settled = cut(settled.unionByName(but_last(days).select("series", "day")).distinct())
        wins = wins.unionByName(days.select("series", "start", "end").distinct())
    return wins, hub


def weekday_factor(facts: DataFrame) -> DataFrame:
    """(series, weekday, factor): the median ratio of a weekday, over the days measured on their own that have a local median."""
    alone = F.count("*").over(W.partitionBy("series", "block")) == 1
    ratio = F.when(F.col("median") > 0, F.col("tot") / F.col("median"))
    return facts.withColumn("_alone", alone).filter("_alone").groupBy("series", (F.weekday("day") + 1).alias("weekday")).agg(F.percentile(ratio, 0.5).alias("factor"))


def low_days(facts: DataFrame, factor: DataFrame, short: DataFrame) -> DataFrame:
    """(series, day, r): runs of days under 0.7 of their weekday-adjusted median that hold no day of short(series, day) and are not made up by half within three days; the last two days wait.

    Days that share a measurement are judged together. r: the day's part of what was expected.
    """
    j = facts.withColumn("weekday", F.weekday("day") + 1).join(factor, ["series", "weekday"], "left").withColumn("exp", F.col("median") * F.col("factor"))
    j = j.join(short.select("series", "day", F.lit(True).alias("short")).distinct(), ["series", "day"], "left")
    known = F.col("exp").isNotNull()
    part = W.partitionBy("series", "block")
    j = j.withColumns({"_tot": F.sum(F.when(known, F.col("tot"))).over(part), "_exp": F.sum("exp").over(part)})
    j = j.withColumn("low", _is(known & (F.col("_exp") > 0) & (F.col("_tot") < DIP * F.col("_exp")) & (F.col("k") < F.col("n") - 2)))
    j = j.select("series", "day", "k", "tot", "exp", "short", "low")
    nth = F.row_number().over(_by_day())
    rows = j.filter("low").withColumn("run", F.struct((F.col("k") - nth).alias("k"), F.date_sub("day", nth).alias("d")))
    run = rows.groupBy("series", "run").agg(F.min("k").alias("first"), F.max("k").alias("final"), F.sum(F.col("exp") - F.col("tot")).alias("lost"), F.bool_or(_is(F.col("short"))).alias("short")).filter("NOT short")
    beside = F.concat(F.sequence(F.col("first") - MADE_UP_DAYS, F.col("first") - 1), F.sequence(F.col("final") + 1, F.col("final") + MADE_UP_DAYS))
    near = run.select("series", "run", F.explode(beside).alias("k")).join(j.filter(known).select("series", "k", F.greatest(F.lit(0.0), F.col("tot") - F.col("exp")).alias("more")), ["series", "k"])
    back = near.groupBy("series", "run").agg(F.sum("more").alias("back"))
    stay = run.join(back, ["series", "run"], "left").filter(F.coalesce("back", F.lit(0.0)) < MADE_UP * F.col("lost")).select("series", "run")
    return rows.join(stay, ["series", "run"], "left_semi").select("series", "day", F.round(F.when(F.col("exp") > 0, F.col("tot") / F.col("exp")), 6).alias("r"))
