"""Ranks, top-k and boards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.staging import cut, running_by, running_total

#: Distinct values whose ranks are broadcast: about 5 MB.
MOST_BROADCAST = 200_000


def _joined(df: DataFrame, ranks: DataFrame, on) -> DataFrame:
    """Rows with the rank of their value. Up to MOST_BROADCAST values are broadcast, so that the many rows of a common small value are not gathered by it."""
    return df.join(F.broadcast(ranks) if ranks.count() <= MOST_BROADCAST else ranks, on, "left")


def global_rank(df: DataFrame, value: str, name: str, average: bool = False) -> DataFrame:
    """df with the rank of a value, descending, nulls without one; ties share the smallest rank, or the average of theirs.

    Values are counted, their counts summed in order by ranges, and ranks joined back: no window holds all rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    rank = F.col("before") + (F.col("_c") + 1) / 2 if average else (F.col("before") + 1).cast("int")
    ranks = running_total(counts, -F.col("_v"), F.col("_c")).select("_v", rank.alias(name))
    return _joined(df, ranks, df[value] == ranks["_v"]).drop("_v")


def rank_within(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Rank inside a group; a null group is one of its own, null values have no rank.

    Ranks follow from the counts of values, summed by ranges of (group, value) in one pass, so no task sorts a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("_k"), F.col(value).alias("_v"), (-F.col(value)).alias("_o")).agg(F.count("*").alias("_c"))
    ranks = running_by(counts, ["_k"], "_o", "_c").select("_k", "_v", (F.col("before") + 1).cast("int").alias(name))
    return _joined(df, ranks, df[group].eqNullSafe(ranks["_k"]) & (df[value] == ranks["_v"])).drop("_k", "_v")


def top(df: DataFrame, by: str, n: int, tie: str = "id") -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), tie).limit(n)


def top_each(df: DataFrame, group: str, by: str, n: int, tie: str = "id") -> DataFrame:
    w = W.partitionBy(group).orderBy(F.col(by).desc_nulls_last(), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def board(df: DataFrame, name: str, by: str, n: int = 100) -> DataFrame:
    """A board of at most n rows: (board, rank, id, value)."""
    w = W.orderBy(F.col(by).desc_nulls_last(), "id")
    rows = top(df.filter(F.col(by).isNotNull()), by, n).select(F.lit(name).alias("board"), F.row_number().over(w).alias("rank"), "id", F.round(F.col(by).cast("double"), 6).alias("value"))
    return rows


def boards(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def model_boards(m: DataFrame, last: Column, n: int = 100) -> DataFrame:
    """Boards of an entity table: growth asks for a base of 1,000 and 10,000 in 30 days, and leaves single spikes out; breakouts were first seen within 30 days. Authors without a name have none."""
    from tidemark.operators.series import steady

    m = cut(m)
    authors = m.filter("author IS NOT NULL").groupBy(F.col("author").alias("id")).agg(F.sum("dl30").alias("dl30"), F.sum("dl_7d").alias("dl_7d"))
    risen = steady(m.filter((F.col("dl_base7d") >= 1000) & (F.col("dl30") >= 10000)))
    fresh = steady(m.filter(F.col("first_seen") >= F.date_sub(last, 30)), 0.8, 3)
    return boards(
        [
            board(m, "gainers_7d", "dl_7d", n),
            board(m, "dl30", "dl30", n),
            board(m, "dl_all", "dl_all", n),
            board(risen, "growth_7d", "growth_7d", n),
            board(fresh, "breakouts", "dl_7d", n),
            board(m.filter("dl30 >= 1000"), "likes_7d", "likes_7d", n),
            board(authors, "authors_dl30", "dl30", n),
            board(authors, "authors_7d", "dl_7d", n),
        ]
    )


def position(totals: DataFrame, key: str, value: str) -> DataFrame:
    """1 + how many have strictly more, and the share of all that this is."""
    n = totals.agg(F.count("*").alias("n"))
    return global_rank(totals, value, "place").crossJoin(F.broadcast(n)).withColumn("top_percent", F.round(100.0 * F.col("place") / F.col("n"), 6)).drop("n")


def standing(df: DataFrame) -> DataFrame:
    tier = F.when(F.col("place") <= 10, "top 10").when(F.col("place") <= 100, "top 100").when(F.col("place") <= 1000, "top 1000")
    return df.withColumn("tier", tier.otherwise(F.concat(F.lit("top "), F.ceil("top_percent").cast("string"), F.lit(" %"))))


def chunks(df: DataFrame, by: str, size: int = 25_000) -> DataFrame:
    """Number of the file that each row of a ranked list goes to."""
    placed = running_total(df.select("id", by), F.struct((-F.col(by)).alias("v"), F.col("id")), F.lit(1))
    return placed.select("id", F.floor(F.col("before") / size).cast("long").alias("chunk"))
