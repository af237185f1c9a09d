"""Report analytics: shares, concentration, cohorts, launch curves and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranks import global_rank
from tidemark.plans.staging import cut, running_by


def monthly_totals(series: DataFrame) -> DataFrame:
    """Per month: total at its start less total at the next one's start, between neighbours in time interpolated linearly."""
    t = series.groupBy("day").agg(F.sum("dl_all").alias("t"))
    months = t.select(F.trunc("day", "month").alias("m")).distinct()
    before = t.join(months, F.col("day") <= F.col("m")).groupBy("m").agg(F.max(F.struct("day", "t")).alias("b"))
    after = t.join(months, F.col("day") >= F.col("m")).groupBy("m").agg(F.min(F.struct("day", "t")).alias("a"))
    j = before.join(after, "m")
    share = F.when(F.col("a.day") > F.col("b.day"), F.datediff("m", F.col("b.day")) / F.datediff(F.col("a.day"), F.col("b.day"))).otherwise(0.0)
    at = j.select("m", (F.col("b.t") + (F.col("a.t") - F.col("b.t")) * share).alias("v"))
    w = W.orderBy("m")
    return at.withColumn("total", F.round(F.lead("v").over(w) - F.col("v"), 6)).filter("total IS NOT NULL").select(F.col("m").alias("month"), "total")


def month_estimate(series: DataFrame) -> DataFrame:
    """A month from its last 30-day count, scaled to the month's length."""
    t = series.groupBy("day").agg(F.sum("dl30").alias("d"))
    g = t.groupBy(F.trunc("day", "month").alias("month")).agg(F.max_by("d", "day").alias("d"))
    return g.select("month", F.round(F.col("d") * F.dayofmonth(F.last_day("month")) / 30, 6).alias("estimate"))


def yearly_rate(hub: DataFrame) -> DataFrame:
    """Daily rate of a tag by year, and its ratio to the year before."""
    g = hub.groupBy("pipeline_tag", F.year("day").alias("year")).agg((F.sum("dl") / F.countDistinct("day")).alias("rate"))
    p = F.lag("rate").over(W.partitionBy("pipeline_tag").orderBy("year"))
    return g.withColumn("ratio", F.round(F.col("rate") / p, 6)).withColumn("rate", F.round("rate", 6))


def shares(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    g = df.groupBy(group, key).agg(F.sum(value).alias("v"))
    return g.withColumn("share", F.round(F.col("v") / F.sum("v").over(W.partitionBy(group)), 6))


def concentration(df: DataFrame, value: str) -> DataFrame:
    """Share of the largest 10, 100, 1,000 and of the largest hundredth."""
    total = df.agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    big = df.orderBy(F.col(value).desc(), "id").limit(1000).withColumn("k", F.row_number().over(W.orderBy(F.col(value).desc(), "id")))
    tops = big.agg(*[F.sum(F.when(F.col("k") <= k, F.col(value))).alias(f"top_{k}") for k in (10, 100, 1000)])
    ranked = global_rank(df, value, "r").crossJoin(F.broadcast(total)).filter(F.col("r") <= F.ceil(F.col("n") / 100)).agg(F.sum(value).alias("top_percent"))
    j = tops.crossJoin(ranked).crossJoin(total)
    return j.select(*[F.round(F.col(c) / F.col("s"), 6).alias(c) for c in ("top_10", "top_100", "top_1000", "top_percent")])


def bands(value: Column, edges: list[float]) -> Column:
    out = F.lit(f">= {edges[-1]:g}")
    for e in reversed(edges):
        out = F.when(value < e, f"< {e:g}").otherwise(out)
    return out


def launch_curve(series: DataFrame, first: DataFrame, least: int, weeks: int = 26) -> DataFrame:
    """Mean share of an entity's first 26 weeks by week since its first day, of entities with `least` in them."""
    w = W.partitionBy("id").orderBy("day")
    s = series.join(first, "id").withColumn("g", F.col("dl_all") - F.coalesce(F.lag("dl_all").over(w), F.lit(0))).withColumn("week", F.floor(F.datediff("day", "first_seen") / 7))
    g = s.filter(F.col("week") < weeks).groupBy("id", "week").agg(F.sum("g").alias("g"))
    g = g.withColumn("t", F.sum("g").over(W.partitionBy("id"))).filter(F.col("t") >= least)
    return g.groupBy("week").agg(F.round(F.avg(F.col("g") / F.col("t")), 6).alias("share"), F.count("*").alias("n"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties."""
    known = cut(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b))
    d = global_rank(known, a, "ra", average=True)
    return global_rank(d, b, "rb", average=True).agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


def weighted_quantiles(df: DataFrame, group: list[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """A row a group: for each share the smallest value up to which that share of the weight lies, and the weighted mean.

    Exact: weights are summed by value, and the sums added up by ranges of (group, value). Values without weight and null values
    say nothing; a group of only these has no row.
    """
    hist = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*group, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"))
    run = running_by(hist, group, "_v", "_w")
    total = hist.groupBy(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(group)]).agg(F.sum("_w").alias("_t"))
    same = F.lit(True)
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_k{k}"))
    at = {name: F.min(F.when(F.col("before") + F.col("_w") >= F.lit(share) * F.col("_t"), F.col("_v"))) for name, share in shares.items()}
    mean = F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")
    return run.join(total, same).groupBy(*group).agg(*[x.alias(name) for name, x in at.items()], mean.alias("mean"))


def rank_by_month(df: DataFrame, key: str, value: str) -> DataFrame:
    g = df.groupBy(F.trunc("day", "month").alias("month"), key).agg(F.sum(value).alias("v"))
    return g.withColumn("rank", F.rank().over(W.partitionBy("month").orderBy(F.col("v").desc())).cast("int"))


def cohort_share(m: DataFrame, born) -> DataFrame:
    """(cohort, dl30, share): the share of all downloads by a cohort column, such as the year of creation; no cohort is none of them."""
    total = m.agg(F.sum("dl30").alias("_t"))
    g = m.groupBy(born.alias("cohort")).agg(F.sum("dl30").alias("dl30")).crossJoin(F.broadcast(total))
    return g.filter("cohort IS NOT NULL").select("cohort", "dl30", F.round(F.col("dl30") / F.col("_t"), 6).alias("share"))


def volume_bands(m: DataFrame, value: str = "dl30", bounds: tuple = (10, 100), over: int = 1_000_000) -> DataFrame:
    """Numbers of repos under each bound, and over the last."""
    return m.agg(*[F.count_if(F.col(value) < b).alias(f"under_{b}") for b in bounds], F.count_if(F.col(value) > over).alias("over_1m"))
