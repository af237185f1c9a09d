"""Plan helpers: shared checkpoints and order over whole tables without a single-partition window."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the session. A local session that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named := tempfile.mkdtemp(prefix="tidemark-"))
    return named


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """As many tasks as leave each at most about `each` rows, and no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df dealt by keys over so many tasks; as it is where no number is given."""
    return df.repartition(tasks, *keys) if tasks else df


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the session's shared checkpoint folder; lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def running_total(df: DataFrame, order: Column, size: Column) -> DataFrame:
    """df with `before`: the sum of `size` over the rows that come earlier in `order` (unique). One row a range is gathered."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.withColumn("_o", order).repartitionByRange(parts, "_o").withColumn("_range", F.spark_partition_id()).withColumn("_s", size.cast("long")))
    totals = ranged.groupBy("_range").agg(F.sum("_s").alias("_t"))
    starts = totals.select("_range", F.coalesce(F.sum("_t").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum("_s").over(W.partitionBy("_range").orderBy("_o").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(starts), "_range").withColumn("before", F.col("_start") + inside).drop("_range", "_s", "_start", "_o")


def running_by(df: DataFrame, group: list[str], order: str, size: str) -> DataFrame:
    """df with `before`: the sum of `size` over the rows of its group that come earlier in `order`, which is unique within a group.

    Rows are dealt by range of (group, order), so that one pass serves all groups and a large one fills many ranges. What is
    broadcast is one total a range: that of the group that goes on from the range before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *group, order).withColumn("_range", F.spark_partition_id()))
    w = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("_range", *group).agg(F.sum(size).alias("_t")).withColumn("_start", F.sum("_t").over(w)).filter("_start IS NOT NULL")
    starts = F.broadcast(starts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)], "_start"))
    same = ranged["_range"] == starts["_r"]
    for k, c in enumerate(group):
        same &= F.col(c).eqNullSafe(F.col(f"_g{k}"))
    inside = F.sum(size).over(W.partitionBy("_range", *group).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    before = F.coalesce("_start", F.lit(0)) + F.coalesce("_inside", F.lit(0))
    return ranged.withColumn("_inside", inside).join(starts, same, "left").withColumn("before", before).select(*df.columns, "before")
