"""Entity metrics from a small state an id, kept up to date day by day.

A ring holds an id's snapshots of the last 42 days, all that weekly rates look at, and the day it was first seen. Rings of parts of a
history merge into that of the whole, so a day's metrics follow from yesterday's rings and today's snapshot: neither the history
nor forty days of it are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import LOOKBACK, WINDOW_DAYS, finished

KEPT = 31 + LOOKBACK
SCHEMA = "id string, first_seen date, ring array<struct<day:date,dl30:bigint,dl_all:bigint,likes:bigint>>"


def rings_of(series: DataFrame, last) -> DataFrame:
    """(id, first_seen, ring) of series(id, day, dl30, dl_all, likes) up to the day `last`."""
    entry = F.struct("day", *[F.col(c).cast("long").alias(c) for c in ("dl30", "dl_all", "likes")])
    kept = F.collect_list(F.when(F.col("day") >= F.date_sub(F.lit(last), KEPT), entry))
    return series.groupBy("id").agg(F.min("day").alias("first_seen"), F.array_sort(kept).alias("ring"))


def merge(old: DataFrame, new: DataFrame, last, days: list = ()) -> DataFrame:
    """Rings of both. What `new` says of a day counts; `days`: delivered again, so that what `old` has of them goes for all ids. One shuffle by id."""
    again = F.array(*[F.lit(d).cast("date") for d in days]) if days else F.array().cast("array<date>")
    told = F.transform("n.ring", lambda x: x["day"])
    stays = F.filter("o.ring", lambda x: ~F.array_contains(again, x["day"]) & ~F.coalesce(F.array_contains(told, x["day"]), F.lit(False)))
    none = F.array().cast("array<struct<day:date,dl30:bigint,dl_all:bigint,likes:bigint>>")
    both = F.array_sort(F.concat(F.coalesce(stays, none), F.coalesce("n.ring", none)))
    ring = F.filter(both, lambda x: x["day"] >= F.date_sub(F.lit(last), KEPT))
    joined = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
    return joined.select(F.coalesce("o.id", "n.id").alias("id"), F.least("o.first_seen", "n.first_seen").alias("first_seen"), ring.alias("ring"))


def metrics(rings: DataFrame, last, skip: DataFrame | None = None) -> DataFrame:
    """`series.metrics` of the day `last` from rings alone, id by id, without a shuffle. skip(day): snapshots left out, of which the last weeks' count."""
    day = F.lit(last).cast("date")
    if skip is None:
        rings = rings.withColumn("_skip", F.array().cast("array<date>"))
    else:
        recent = skip.filter(F.col("day").between(F.date_sub(day, KEPT), F.date_sub(day, 1)))
        rings = rings.crossJoin(F.broadcast(recent.agg(F.collect_set("day").alias("_skip"))))
    used = F.filter("ring", lambda x: x["day"].between(F.date_sub(day, WINDOW_DAYS), day) & ~F.array_contains("_skip", x["day"]))
    df = rings.select("id", "first_seen", used.alias("_used"))

    def of(low: int, high: int):
        return F.filter("_used", lambda x: x["day"].between(F.date_sub(day, low), F.date_sub(day, high)))

    three = lambda x: F.struct(x["day"].alias("day"), x["dl_all"].alias("dl_all"), x["likes"].alias("likes"))
    refs = {f"ref_{back}": F.array_max(F.transform(of(back + LOOKBACK, back), three)) for back in (7, 14, 28, 31)}
    now = F.get(F.transform(of(0, 0), lambda x: F.struct(x["dl30"].alias("dl30"), x["dl_all"].alias("dl_all"), x["likes"].alias("likes"))), 0)
    week = {"_points": F.transform(of(7 + LOOKBACK, 0), lambda x: F.struct(x["day"].alias("day"), x["dl_all"].alias("dl_all"))), "_ref": F.array_max(F.transform(of(7 + LOOKBACK, 7), lambda x: x["day"]))}
    return finished(df.withColumns(refs | {"now": now} | week).filter("now IS NOT NULL"), day)
