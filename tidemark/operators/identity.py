"""Renames: finding them between snapshots, following them, and stitching histories."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import name, owner
from tidemark.plans.staging import cut


def _alike(gone: DataFrame, came: DataFrame, least: int, within: float, by: list[str]) -> DataFrame:
    """(by, old, new): gone and come ids of one name or one owner. Two equi joins, not an OR. A new count may lie under `least` as far as it may lie under the old one.

    Counts within a share of each other lie in the same band of their logarithm or in neighbouring ones, so the join goes by name
    or owner and band: an owner of very many repos is as many keys as its counts fill bands, and pairs apart are not met.
    """
    width = -math.log1p(-within) * (1 + 1e-9)

    def cols(d: DataFrame, low: float) -> DataFrame:
        c = F.col("dl_all").cast("double")
        return d.filter(F.col("dl_all") >= low).select(*by, "id", F.lower(owner(F.col("id"))).alias("o"), F.lower(name(F.col("id"))).alias("n"), c.alias("c"), F.floor(F.log(F.greatest(c, F.lit(1.0))) / width).alias("band"))

    bands = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band")
    gone, came = cols(gone, least), cols(came, least * (1 - within))
    out = None
    for key in ("n", "o"):
        j = gone.select(*by, F.col("id").alias("old"), key, F.col("c").alias("c0"), bands).join(came.select(*by, F.col("id").alias("new"), key, F.col("c").alias("c1"), "band"), [*by, key, "band"])
        j = j.filter(F.abs(F.col("c1") - F.col("c0")) <= within * F.col("c0")).select(*by, "old", "new")
        out = j if out is None else out.unionByName(j)
    return out.distinct()


def rename_candidates(prev: DataFrame, cur: DataFrame, least: int = 1000, within: float = 0.01) -> DataFrame:
    """(old, new): an id gone and one come, of one name or one owner, with all-time counts within 1 %."""
    return _alike(prev.join(cur, "id", "left_anti"), cur.join(prev, "id", "left_anti"), least, within, [])


def rename_candidates_by_day(series: DataFrame, least: int = 1000, within: float = 0.01) -> DataFrame:
    """(day, old, new): the candidates between each snapshot day and the one before it; series(id, day, dl_all)."""
    days = cut(series.select("day").distinct().filter("day IS NOT NULL").withColumn("snap", F.row_number().over(W.orderBy("day"))))
    bounds = days.agg(F.max("snap").alias("_last"))
    at = W.partitionBy("id").orderBy("snap")
    here = lambda k: F.count("*").over(at.rangeBetween(k, k)) > 0
    rows = series.select("id", "day", "dl_all").join(F.broadcast(days), "day").select("id", "snap", "dl_all").withColumns({"_before": here(-1), "_after": here(1)})
    # One pass finds where ids end and begin; of all rows only these few are kept.
    ends = cut(rows.filter("NOT _before OR NOT _after").filter(F.col("dl_all") >= least * (1 - within)))
    gone = ends.filter("NOT _after").crossJoin(F.broadcast(bounds)).filter("snap < _last").select("id", (F.col("snap") + 1).alias("snap"), "dl_all")
    came = ends.filter("NOT _before AND snap > 1").select("id", "snap", "dl_all")
    return _alike(gone, came, least, within, ["snap"]).join(F.broadcast(days), "snap").select("day", "old", "new")


def unambiguous(pairs: DataFrame, by: tuple = ()) -> DataFrame:
    """Pairs whose old id has one candidate; of these, those whose new id has one; each within `by`."""
    one = pairs.withColumn("_c", F.count("*").over(W.partitionBy(*by, "old"))).filter("_c = 1")
    return one.withColumn("_c", F.count("*").over(W.partitionBy(*by, "new"))).filter("_c = 1").drop("_c")


def find_renames(prev: DataFrame, cur: DataFrame, least: int = 1000) -> DataFrame:
    return unambiguous(rename_candidates(prev, cur, least))


def find_renames_by_day(series: DataFrame, least: int = 1000) -> DataFrame:
    """(day, old, new): the renames between each snapshot day and the one before it."""
    return unambiguous(rename_candidates_by_day(series, least), ("day",))


def resolve(renames: DataFrame) -> DataFrame:
    """(old, new) with new at the end of its chain, by pointer jumping.

    No chain is longer than there are renames, so twice their logarithm of rounds ends every one; only ids that lead into a
    cycle, which has no end, move on until then.
    """
    r = cut(renames.select("old", "new").distinct())
    for _ in range(r.count().bit_length() + 1):
        nxt = r.select(F.col("old").alias("new"), F.col("new").alias("_n"))
        moved = cut(r.join(nxt, "new", "left").select("old", F.when(F.col("_n") == F.col("old"), F.col("new")).otherwise(F.coalesce("_n", "new")).alias("new")))
        if moved.join(r, ["old", "new"], "left_anti").isEmpty():
            break
        r = moved
    return r


def before_rename(series: DataFrame, renames: DataFrame) -> DataFrame:
    """A renamed id's rows only up to the day before the new one came."""
    cut_at = renames.groupBy(F.col("old").alias("id")).agg(F.min("came").alias("_came"))
    return series.join(cut_at, "id", "left").filter(F.col("_came").isNull() | (F.col("day") < F.col("_came"))).drop("_came")


def with_renamed(df: DataFrame, key: str, renames: DataFrame) -> DataFrame:
    """Rows of a key repeated for the ids it once had."""
    old = df.join(renames.select(F.col("new").alias(key), "old"), key).drop(key).withColumnRenamed("old", key)
    return df.unionByName(old).distinct()


def stitched(series: DataFrame, renames: DataFrame, cols: list[str]) -> DataFrame:
    """History under the current id: on each day and column the current id's value, else an old one's."""
    s = series.join(renames.select(F.col("old").alias("id"), "new"), "id", "left")
    s = s.withColumn("_p", F.when(F.col("new").isNull(), 0).otherwise(1)).withColumn("_id", F.coalesce("new", "id"))
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct("_p", F.col("id").alias("_i"), F.col(c).alias("v"))))["v"].alias(c) for c in cols]
    return s.groupBy(F.col("_id").alias("id"), "day").agg(*first)


def lookup(wanted: DataFrame, ids: DataFrame, renames: DataFrame) -> DataFrame:
    """(asked, id): exact, else the same but for case, else by rename."""
    exact = wanted.join(ids, wanted.asked == ids.id).select("asked", "id", F.lit(0).alias("p"))
    folded = wanted.join(ids, F.lower("asked") == F.lower("id")).select("asked", "id", F.lit(1).alias("p"))
    moved = wanted.join(renames, wanted.asked == renames.old).select("asked", F.col("new").alias("id"), F.lit(2).alias("p"))
    return exact.unionByName(folded).unionByName(moved).groupBy("asked").agg(F.min(F.struct("p", "id"))["id"].alias("id"))
