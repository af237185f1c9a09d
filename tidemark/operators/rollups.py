"""Roll-ups by owner, tag, day and kind; usage graph; summaries of a year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import week
from tidemark.plans.staging import cut, dealt


def author_series(series: DataFrame, authors: DataFrame, least: int = 1000) -> DataFrame:
    """Series of the authors whose entities come to `least` on the last day; authors(id, author).

    The series is summed once by author and day; which authors stay follows from the sums of the last day.
    """
    g = series.join(authors, "id").groupBy("author", "day")
    sums = cut(g.agg(F.sum("dl30").alias("dl30"), F.sum("dl_all").alias("dl_all"), F.sum("likes").alias("likes"), F.count("*").alias("models"), F.sum(F.coalesce("dl_all", "dl30")).alias("_t")))
    last = series.agg(F.max("day").alias("day"))
    big = sums.join(F.broadcast(last), "day").filter(F.col("_t") >= least).select("author")
    return sums.join(big, "author", "left_semi").drop("_t")


def author_totals(m: DataFrame) -> DataFrame:
    g = m.groupBy("author").agg(F.sum("dl30").alias("dl30"), F.sum("dl_7d").alias("dl_7d"), F.sum("dl_base7d").alias("base"), F.count("*").alias("models"))
    return g.withColumn("growth", F.round(F.when(F.col("base") >= 1000, F.col("dl_7d") / F.col("base") - 1), 6)).drop("base")


def having(totals: DataFrame, value: str, least: float) -> DataFrame:
    return totals.filter(F.col(value) >= least)


def use_counts(uses: DataFrame) -> DataFrame:
    kinds = [F.count_if(F.col("src_kind") == k).alias(f"n_{k}s") for k in ("model", "space")]
    return uses.groupBy("dst").agg(*kinds)


def uses_each(uses: DataFrame) -> DataFrame:
    return uses.groupBy("src").agg(F.count("*").alias("n_uses"))


def new_users(uses: DataFrame, tasks: int | None = None) -> DataFrame:
    """New users of a target per month and their running total; `tasks` is how many tasks the uses are dealt over."""
    months = dealt(uses.select("dst", F.trunc("created", "month").alias("month")), tasks, "dst", "month")
    g = dealt(months.groupBy("dst", "month").agg(F.count("*").alias("n")), tasks, "dst")
    return g.withColumn("total", F.sum("n").over(W.partitionBy("dst").orderBy("month")))


def top_users(uses: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("dst").orderBy(F.col("weight").desc_nulls_last(), "src")
    return uses.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def per_day(events: DataFrame, tag: str) -> DataFrame:
    return events.groupBy("day", F.coalesce(tag, F.lit("other")).alias("tag")).agg(F.count("*").alias("n"))


def top_tags(df: DataFrame, tag: str, value, n: int, days: int) -> DataFrame:
    """The n largest tags of the last days in the table."""
    last = df.agg(F.max("day").alias("_last"))
    r = df.crossJoin(F.broadcast(last)).filter(F.col("day") > F.date_sub("_last", days))
    return r.groupBy(tag).agg(value.alias("_v")).orderBy(F.col("_v").desc(), tag).limit(n).select(tag)


def with_other(df: DataFrame, tag: str, best: DataFrame) -> DataFrame:
    """Tags outside the best become "other"."""
    b = F.broadcast(best.select(tag, F.lit(True).alias("_b")))
    return df.join(b, tag, "left").withColumn(tag, F.when(F.col("_b"), F.col(tag)).otherwise("other")).drop("_b")


def new_by_week(events: DataFrame, tag: str, n: int = 5, days: int = 365) -> DataFrame:
    best = top_tags(events, tag, F.count("*"), n, days)
    return with_other(events, tag, best).groupBy(week(F.col("day")).alias("week"), tag).agg(F.count("*").alias("n"))


def hub_chart(hub: DataFrame, n: int = 7, days: int = 90) -> DataFrame:
    """Daily totals of the largest tags since `days` before the last day, that day too; "other" is never one of them."""
    best = top_tags(hub.filter("pipeline_tag <> 'other'"), "pipeline_tag", F.sum("dl"), n, days + 1)
    return with_other(hub, "pipeline_tag", best).groupBy("day", "pipeline_tag").agg(F.sum("dl").alias("dl"))


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """Last day of each kind and how far it is behind the latest."""
    out = None
    for kind, df in tables.items():
        row = df.agg(F.max("day").alias("last")).withColumn("kind", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("behind", F.datediff(F.max("last").over(W.partitionBy()), F.col("last")))


def coverage(series: DataFrame) -> DataFrame:
    return series.agg(F.countDistinct("day").alias("days"), F.min("day").alias("first"), F.max("day").alias("last"), F.countDistinct("id").alias("ids"))


def gap_gains(series: DataFrame, authors: DataFrame, start, last, skip: DataFrame | None = None) -> DataFrame:
    """(author, id, first, final, each): what an id gained a day on the days first to final between two of its snapshots, as far as
    they lie after `start` and up to `last` (dates).

    The first snapshot may be ten days before the start. Losses and quiet days count as 0. `skip` (day): snapshots left out. A gap
    stays one row, however long: what falls into a week or a month is its daily part times the days that they share.
    """
    start, last = F.lit(start).cast("date"), F.lit(last).cast("date")
    rows = series.filter(F.col("day").between(F.date_sub(start, 10), last)).select("id", "day", "dl_all")
    rows = rows if skip is None else rows.join(F.broadcast(skip.select("day").distinct()), "day", "left_anti")
    w = W.partitionBy("id").orderBy("day")
    s = rows.withColumn("p", F.lag("dl_all").over(w)).withColumn("pd", F.lag("day").over(w)).filter("p IS NOT NULL AND dl_all IS NOT NULL").filter(F.col("day") > start)
    each = F.greatest(F.lit(0), F.col("dl_all") - F.col("p")) / F.datediff("day", "pd")
    gaps = s.select("id", F.greatest(F.date_add("pd", 1), F.date_add(start, 1)).alias("first"), F.col("day").alias("final"), each.alias("each"))
    return gaps.join(authors, "id").select("author", "id", "first", "final", "each")


def summed_gaps(gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repos(author, id, downloads), spans(author, first, final, each)): gains of each repo, and an author's gains by gap, from one pass over the gaps."""
    size = F.datediff("final", "first") + 1
    sets = gaps.withColumn("_g", F.col("each") * size).groupingSets([["author", "id"], ["author", "first", "final"]], "author", "id", "first", "final")
    both = cut(sets.agg(F.sum("_g").alias("gain"), F.sum("each").alias("each"), F.grouping("id").alias("_s")))
    return both.filter("_s = 0").select("author", "id", F.col("gain").alias("downloads")), both.filter("_s = 1").select("author", "first", "final", "each")


def year_gaps(series: DataFrame, authors: DataFrame, year: int) -> DataFrame:
    return gap_gains(series, authors, f"{year - 1}-12-31", f"{year}-12-31")


def by_days(spans: DataFrame) -> DataFrame:
    """(author, day, gain)."""
    days = spans.select("author", F.explode(F.sequence("first", "final")).alias("day"), "each")
    return days.groupBy("author", "day").agg(F.round(F.sum("each"), 4).alias("gain"))


def by_periods(spans: DataFrame, unit: str) -> DataFrame:
    """(author, period, v): gains of the weeks (from Monday) or months that spans meet, by the days that they share."""
    step, size = {"week": (F.expr("interval 7 days"), F.expr("interval 6 days")), "month": (F.expr("interval 1 month"), None)}[unit]
    begin = lambda c: F.date_trunc(unit, F.col(c)).cast("date")
    met = spans.select("author", "first", "final", "each", F.explode(F.sequence(begin("first"), begin("final"), step)).alias("period"))
    end = F.last_day("period") if size is None else (F.col("period") + size).cast("date")
    shared = F.datediff(F.least("final", end), F.greatest("first", "period")) + 1
    return met.groupBy("author", "period").agg(F.sum(F.col("each") * shared).alias("v"))


def top_repos(repos: DataFrame, n: int = 5) -> DataFrame:
    """(author, rank, id, downloads): an author's repos by gain, those with a gain."""
    w = W.partitionBy("author").orderBy(F.col("downloads").desc(), "id")
    g = repos.select("author", "id", F.round("downloads", 6).alias("downloads")).filter("downloads > 0")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("author", "rank", "id", "downloads")


def period_months(spans: DataFrame) -> DataFrame:
    return by_periods(spans, "month").select("author", F.col("period").alias("month"), F.round("v", 4).alias("downloads"))


def year_summary(repos: DataFrame, spans: DataFrame, start: str, last: str) -> DataFrame:
    """A row for each author with a gain: total, seconds per download and downloads per minute, rank among authors, top repo and its share, best full week.

    A week is full if its Monday is after `start` and before that of `last`.
    """
    from tidemark.operators.ranks import global_rank

    total = repos.groupBy("author").agg(F.round(F.sum("downloads"), 4).alias("downloads")).filter("downloads > 0")
    best = top_repos(repos, 1).select("author", F.col("id").alias("top_id"), F.col("downloads").alias("top_v"))
    full = by_periods(spans, "week").filter((F.col("period") > F.lit(start).cast("date")) & (F.col("period") < week(F.lit(last).cast("date"))))
    weeks = full.groupBy("author").agg(F.min(F.struct(-F.round("v", 6), "period"))["period"].alias("best_week"))
    out = global_rank(total, "downloads", "rank").join(best, "author", "left").join(weeks, "author", "left")
    seconds = 365 * 86400
    cadence = [F.round(seconds / F.col("downloads"), 2).alias("every_seconds"), F.round(F.col("downloads") / (seconds / 60), 6).alias("per_minute")]
    return out.select("author", "downloads", *cadence, "rank", "top_id", F.round(F.col("top_v") / F.col("downloads"), 6).alias("top_share"), "best_week")


def year_record(gaps: DataFrame, likes: DataFrame, tags: DataFrame, ripple: DataFrame, start: str, last: str) -> DataFrame:
    """The year of each author in one row: the summary, its standing in percent, the months, and beside them

    likes(author, likes, models_new), the mix of tasks by tags(id, tag), and ripple(author, built, dl30, biggest): what others built
    on the author's repos. `months`, `mix` and `top` are text, as lists of name:value in their order. The gaps are read once.
    """
    repos, spans = summed_gaps(gaps)
    year = year_summary(repos, spans, start, last)
    listed = lambda rows, order, name, value: rows.groupBy("author").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.concat_ws(":", name, F.round(value).cast("long")).alias("_x")))), lambda x: x["_x"]), ",").alias("_l"))
    months = listed(by_periods(spans, "month").withColumn("name", F.date_format("period", "yyyy-MM")), "period", "name", "v").withColumnRenamed("_l", "months")
    top = listed(top_repos(repos), "rank", "id", "downloads").withColumnRenamed("_l", "top")
    mix = task_mix(repos.join(tags.select("id", "tag"), "id", "left").select("author", "tag", F.col("downloads").alias("v"))).filter("share IS NOT NULL")
    mix = listed(mix.withColumn("permille", F.col("share") * 1000), "rank", "tag", "permille").withColumnRenamed("_l", "mix")
    n = year.agg(F.count("*").alias("_n"))
    out = year.crossJoin(F.broadcast(n)).withColumn("top_percent", F.round(100 * F.col("rank") / F.col("_n"), 2)).drop("_n")
    for more in (months, top, mix, likes.select("author", F.col("likes").alias("likes_gained"), "models_new"), ripple.select("author", "built", F.col("dl30").alias("built_dl30"), "biggest")):
        out = out.join(more, "author", "left")
    return out.na.fill(0, ["built", "built_dl30"])


def task_mix(m: DataFrame, n: int = 5) -> DataFrame:
    """An author's five largest tags and their shares among them; no share when they are under 30 % of all, the untagged included."""
    g = m.groupBy("author", "tag").agg(F.sum("v").alias("v")).withColumn("total", F.sum("v").over(W.partitionBy("author"))).filter("tag IS NOT NULL AND v > 0")
    w = W.partitionBy("author").orderBy(F.col("v").desc(), "tag")
    t = g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).withColumn("top", F.sum("v").over(W.partitionBy("author")))
    return t.select("author", "tag", "rank", "v", F.round(F.when(F.col("top") >= 0.3 * F.col("total"), F.col("v") / F.col("top")), 6).alias("share"))


def likes_gained(series: DataFrame, authors: DataFrame, start, last) -> DataFrame:
    """(author, likes, models_new): an author's likes on the last day less those of its repos at the start (looked up to ten days back), not under 0; and its repos first seen since."""
    start, last = F.lit(start).cast("date"), F.lit(last).cast("date")
    then = F.when(F.col("day").between(F.date_sub(start, 10), start), F.col("day"))
    w = series.groupBy("id").agg(F.max(F.when(F.col("day") == last, F.col("likes"))).alias("now"), F.max_by("likes", then).alias("then"), F.min("day").alias("first_seen"))
    w = w.join(authors, "id").groupBy("author")
    gained = F.greatest(F.lit(0), F.sum(F.coalesce("now", F.lit(0))) - F.sum(F.coalesce("then", F.lit(0))))
    return w.agg(gained.alias("likes"), F.count_if(F.col("first_seen") > start).alias("models_new"))


def author_index(tables: dict[str, DataFrame]) -> DataFrame:
    """(author, n_<kind>..., dl30): one row an author over tables(author, dl30) of several kinds."""
    kinds = list(tables)
    rows = None
    for kind in kinds:
        part = tables[kind].filter("author IS NOT NULL").groupBy("author").agg(F.count("*").alias(f"n_{kind}"), F.sum("dl30").alias("dl30"))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return rows.groupBy("author").agg(*[F.coalesce(F.sum(f"n_{k}"), F.lit(0)).alias(f"n_{k}") for k in kinds], F.coalesce(F.sum("dl30"), F.lit(0)).alias("dl30"))


def resolve_author(names: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(asked, author): names(asked) without regard to case, in the first of tables(author) that knows them; exact spellings first, then the smallest."""
    known = None
    for k, t in enumerate(tables):
        part = t.filter("author IS NOT NULL").select("author").distinct().withColumn("order", F.lit(k))
        known = part if known is None else known.unionByName(part)
    met = names.withColumn("low", F.lower("asked")).join(known.withColumn("low", F.lower("author")), "low")
    return met.groupBy("asked").agg(F.min(F.struct("order", (F.col("author") != F.col("asked")).cast("int").alias("other"), "author"))["author"].alias("author"))


def change_between(series: DataFrame, authors: DataFrame, start, last, most_back: int = 10) -> DataFrame:
    """(author, gain): what an author's totals gained between two days, each read up to ten days back, of repos known at both; not under 0 for each."""
    at = lambda d: F.max_by("dl_all", F.when(F.col("day").between(F.date_sub(F.lit(d).cast("date"), most_back), F.lit(d).cast("date")), F.col("day")))
    w = series.filter("dl_all IS NOT NULL").groupBy("id").agg(at(start).alias("a"), at(last).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return w.join(authors, "id").groupBy("author").agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.col("a"))).alias("gain"))


def citing_authors(uses: DataFrame, kinds: DataFrame) -> DataFrame:
    """(year, tag, n, share): authors whose repos of a year use something of a kind, and their share of that year's using authors.

    uses(author, dst, created), kinds(id, tag).
    """
    u = uses.select(F.year("created").alias("year"), "author", F.col("dst").alias("id"))
    total = u.groupBy("year").agg(F.countDistinct("author").alias("c"))
    n = u.join(kinds.select("id", "tag"), "id").groupBy("year", "tag").agg(F.countDistinct("author").alias("n"))
    return n.join(total, "year").select("year", "tag", "n", F.round(F.col("n") / F.col("c"), 6).alias("share"))


def sum_known(df: DataFrame, group: str, value: str) -> DataFrame:
    """Sums that stay null where nothing is known."""
    return df.groupBy(group).agg(F.sum(value).alias("total"))


def users_with_meta(uses: DataFrame, entities: DataFrame) -> DataFrame:
    """uses(src, dst) with the target's author and tag; unknown targets keep nulls."""
    return uses.join(entities.select(F.col("id").alias("dst"), "author", "tag"), "dst", "left").select("src", "dst", "author", "tag")


def creators(uses: DataFrame) -> DataFrame:
    """(quarter, src_kind, creators, share_new): distinct creators a quarter, and the share of them that had none before."""
    q = uses.select("src_kind", "src", F.date_trunc("quarter", "created").cast("date").alias("quarter"))
    first = q.groupBy("src_kind", "src").agg(F.min("quarter").alias("first"))
    both = q.distinct().join(first, ["src_kind", "src"])
    fresh = F.count_if(F.col("quarter") == F.col("first"))
    return both.groupBy("quarter", "src_kind").agg(F.count("*").alias("creators"), F.round(fresh / F.count("*"), 6).alias("share_new"))
