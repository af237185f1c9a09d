"""Summaries for reports: derivative shares, days to a mark, likes, stacked charts, and a rebuilt series against the old one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def derivative_share(entities: DataFrame) -> DataFrame:
    """(relation, dl30, share): each declared relation's part of all downloads, and of "any" relation."""
    by = entities.groupBy("base_relation").agg(F.sum("dl30").alias("dl30"))
    total = by.agg(F.sum("dl30").alias("t"))
    known = by.filter("base_relation IS NOT NULL")
    rows = known.select(F.col("base_relation").alias("relation"), "dl30").unionByName(known.agg(F.sum("dl30").alias("dl30")).select(F.lit("any").alias("relation"), "dl30"))
    return rows.crossJoin(F.broadcast(total)).select("relation", "dl30", F.round(F.col("dl30") / F.col("t"), 6).alias("share"))


def days_to(milestones: DataFrame, first: DataFrame, mark: int) -> DataFrame:
    """(id, days) from an entity's first day to the mark; those that had it before their first row are left out."""
    m = milestones.filter((F.col("mark") == mark) & F.col("day").isNotNull()).select("id", "day")
    return m.join(first, "id").select("id", F.datediff("day", "first_seen").alias("days"))


def days_by_relation(days: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities past the mark and their median days, per relation; "original" where none is declared."""
    j = days.join(relations.select("id", "base_relation"), "id")
    return j.groupBy(F.coalesce("base_relation", F.lit("original")).alias("relation")).agg(F.count("*").alias("n"), F.round(F.median("days"), 6).alias("median_days"))


def fastest(days: DataFrame, n: int) -> DataFrame:
    return days.orderBy("days", "id").limit(n)


def like_concentration(entities: DataFrame, many: int = 1000) -> DataFrame:
    """Of entities with a like: how many, the share with exactly one, the share of likes that the top hundredth hold, how many over `many`.

    Likes are counted by value first, so that the ordered window holds one row for each distinct number of likes.
    """
    c = entities.filter("likes > 0").groupBy("likes").agg(F.count("*").alias("n"))
    over = W.orderBy(F.col("likes").desc())
    c = c.withColumn("before", F.coalesce(F.sum("n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = c.agg(F.sum("n").alias("liked"), F.sum(F.col("n") * F.col("likes")).alias("total"))
    top = F.greatest(F.lit(0), F.least(F.col("n"), F.ceil(F.col("liked") / 100) - F.col("before")))
    j = c.crossJoin(F.broadcast(total))
    return j.agg(
        F.coalesce(F.max("liked"), F.lit(0)).alias("liked"),
        F.round(F.sum(F.when(F.col("likes") == 1, F.col("n"))) / F.max("liked"), 6).alias("exactly_one"),
        F.round(F.sum(top * F.col("likes")) / F.max("total"), 6).alias("top_percent"),
        F.coalesce(F.sum(F.when(F.col("likes") > many, F.col("n"))), F.lit(0)).alias("over"),
    )


def likes_by_month(series: DataFrame) -> DataFrame:
    """Likes given per month: the sum of an entity's increases, losses counting as nothing."""
    gain = F.col("likes") - F.lag("likes").over(W.partitionBy("id").orderBy("day"))
    s = series.select("id", "day", F.greatest(gain, F.lit(0)).alias("g"))
    return s.groupBy(F.trunc("day", "month").alias("month")).agg(F.coalesce(F.sum("g"), F.lit(0)).alias("likes"))


def stacked(hub: DataFrame, tags: list[str], days: int = 7) -> DataFrame:
    """One row a day, one column a tag: trailing means (absent: 0), each on top of the tags before it."""
    wide = hub.groupBy("day").pivot("pipeline_tag", tags).agg(F.sum("dl")).fillna(0)
    w = W.orderBy("day").rowsBetween(1 - days, 0)  # one row a day, whatever the data
    smooth = wide.select("day", *[F.avg(F.col(f"`{t}`")).over(w).alias(t) for t in tags])
    up_to = lambda k: sum((F.col(f"`{t}`") for t in tags[1 : k + 1]), F.col(f"`{tags[0]}`"))
    return smooth.select("day", *[F.round(up_to(k), 6).alias(t) for k, t in enumerate(tags)])


def window_tags(hub: DataFrame, wins: DataFrame) -> DataFrame:
    """(day, pipeline_tag, total): every tag of a window on every day of it, with the tag's total over the window. wins is short."""
    inside = hub.join(F.broadcast(wins), F.col("day").between(F.col("start"), F.col("end")))
    g = inside.groupBy("start", "end", "pipeline_tag").agg(F.sum("dl").alias("total"))
    return g.select(F.explode(F.sequence("start", "end")).alias("day"), "pipeline_tag", "total")


def rebuilt(old: DataFrame, new: DataFrame, old_skip: DataFrame, new_skip: DataFrame) -> DataFrame:
    """One row: total and days before and after, and how many skip days were added and dropped."""
    side = lambda df, name: df.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias(f"total_{name}"), F.countDistinct("day").alias(f"days_{name}"))
    skips = old_skip.select("day", F.lit(1).alias("o")).distinct().join(new_skip.select("day", F.lit(1).alias("n")).distinct(), "day", "full_outer")
    moved = skips.agg(F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("dropped"))
    return side(old, "before").crossJoin(F.broadcast(side(new, "after"))).crossJoin(F.broadcast(moved))
