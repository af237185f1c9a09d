"""Boards of datasets and Spaces, and what changed on any of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranks import board, boards
from tidemark.operators.series import steady
from tidemark.plans.staging import cut


def dataset_boards(m: DataFrame, since: Column, n: int = 100) -> DataFrame:
    """m: metrics with created_at and used_by_models. Growth and breakouts leave single spikes out; breakouts are newer than `since`."""
    m = cut(m)
    risen = steady(m.filter((F.col("dl_base7d") >= 1000) & (F.col("dl30") >= 10000)))
    fresh = steady(m.filter(F.col("created_at") >= since), share=0.8, min_steps=3)
    parts = [(m, "gainers_7d", "dl_7d"), (m, "dl30", "dl30"), (m, "dl_all", "dl_all"), (risen, "growth_7d", "growth_7d"), (fresh, "breakouts", "dl_7d"), (m, "used_by_models", "used_by_models")]
    return boards([board(df, name, by, n) for df, name, by in parts])


def space_boards(s: DataFrame, since: Column, n: int = 100) -> DataFrame:
    """s: likes, likes_7d, likes_30d, trending, created_at."""
    s = cut(s)
    fresh = s.filter(F.col("created_at") >= since)
    parts = [(s, "likes_7d", "likes_7d"), (s, "likes_30d", "likes_30d"), (s, "trending", "trending"), (fresh, "breakouts", "likes_7d"), (s, "most_liked", "likes")]
    return boards([board(df, name, by, n) for df, name, by in parts])


def pace(s: DataFrame) -> DataFrame:
    """s with growth_7d: likes of the week against the weekly pace of the month's other 23 days, where these had ten or more."""
    rest = F.col("likes_30d") - F.col("likes_7d")
    return s.withColumn("growth_7d", F.when(rest >= 10, F.col("likes_7d") / (rest * 7 / 23.0) - 1))


def live_space_boards(s: DataFrame, since: Column, sdk: str | None = None, n: int = 100) -> DataFrame:
    """The Space boards and "rising" (20 likes this week or more), for one SDK or all."""
    s = cut(pace(s if sdk is None else s.filter(F.col("sdk") == sdk)))
    return space_boards(s, since, n).unionByName(board(s.filter("likes_7d >= 20"), "rising", "growth_7d", n))


def changed(by_kind: dict[str, DataFrame]) -> DataFrame:
    """Distinct (kind, id) of everything on any board."""
    out = None
    for kind, df in by_kind.items():
        rows = df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


#: By rank, likes and family members; a kind without a rule by a column has none by it.
NOTABLE = {"models": {"rank_dl30": 10_000, "likes": 100, "fam_members": 20}, "datasets": {"rank_dl30": 3_000, "likes": 50}, "spaces": {"likes": 50}}


def notable(entities: DataFrame, kind: str, rules: dict | None = None) -> DataFrame:
    """Entities that a list of notable ones holds: of a rank up to a bound, or of as many likes or family members or more. Unknown values meet no rule."""
    met = F.lit(False)
    for column, bound in (rules or NOTABLE[kind]).items():
        met = met | F.coalesce(F.col(column) <= bound if column.startswith("rank") else F.col(column) >= bound, F.lit(False))
    return entities.filter(met)


def outliers(m: DataFrame, n: int, use: str = "dl30", liked: str = "likes") -> DataFrame:
    """(side, rank, id, likes, dl30, ratio): most liked for their use, and most used for their likes, of those with both."""
    known = m.filter((F.col(use) > 0) & (F.col(liked) > 0)).withColumn("ratio", F.round(F.col(liked) / F.col(use), 6))
    out = None
    for side, order in (("liked", F.col("ratio").desc()), ("used", F.col("ratio").asc())):
        rows = known.orderBy(order, "id").limit(n)
        rows = rows.withColumn("rank", F.row_number().over(W.orderBy(order, "id"))).select(F.lit(side).alias("side"), "rank", "id", liked, use, "ratio")
        out = rows if out is None else out.unionByName(rows)
    return out
