"""Spark helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch; documents may be long. A session that names a bound keeps its own.
BATCH_BYTES, _BOUND = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """df; what its session hands to Python comes in batches of bounded bytes."""
    conf = df.sparkSession.conf
    if _BOUND not in conf.getAll:
        conf.set(_BOUND, str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder, so that a lost executor costs only a read.

    The folder is the session's `spark.checkpoint.dir`; only where it is unset (tests) a temporary one is taken.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named := tempfile.mkdtemp(prefix="tidemark-"))
    return named


class Shelf:
    """Tables of one run in the shared folder, as Parquet: smaller than checkpoints, and dropped by name once they are used."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/shelf-{uuid.uuid4().hex}", {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path, compression="zstd")
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            path, _ = self.paths[id(df)]
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(*cols: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def id_filter(ids: DataFrame, bits: int = 1 << 24):
    """A test `ids array -> may be wanted`, of fixed size: a bitmap of id modulo `bits`. It may let others through, never the reverse."""
    import numpy as np

    at = F.pmod(F.col(ids.columns[0]), F.lit(bits)) + 1
    rows = ids.select(at.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("b")).collect()
    flags = np.zeros(bits // 8, np.uint8)
    for r in rows:  # at most bits / 32768 rows of 4 KB
        flags[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.b), np.uint8)

    def wanted(values):
        p = np.mod(values, bits)
        return (flags[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1

    return wanted


def positions(df: DataFrame, key: str, size: str = None) -> DataFrame:
    """df in ranges of ascending `key`, with `before`: the sum of `size` (default: rows) over all rows of smaller keys.

    `key` must be unique. Rows are dealt by range of the key; only one total a range is gathered, and no window spans ranges'
    borders.
    """
    from pyspark.sql import Window as W

    size_of = F.col(size).cast("long") if size else F.lit(1).cast("long")
    ranged = cut(df.repartitionByRange(shuffle_count(df), key).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.sum(size_of).alias("_total"))
    # One row a range: its number is the number of shuffle partitions, whatever the data.
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_total")
    inside = F.coalesce(F.sum(size_of).over(W.partitionBy("_range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(offsets), "_range").withColumn("before", F.col("_offset") + inside).drop("_range", "_offset")


EDGES_A_TASK = 1_000_000


def _forest(batches):
    """Edges (u, v) of one bounded part, as stars: each id with the smallest one that the part's edges reach from it."""
    import numpy as np
    import pandas as pd

    parts = [b for b in batches if len(b)]
    if not parts:
        return
    ids, at = np.unique(np.concatenate([b[["u", "v"]].to_numpy(np.int64) for b in parts]), return_inverse=True)
    u, v = at.reshape(-1, 2).T
    root = np.arange(len(ids))
    while True:
        last, low = root.copy(), np.minimum(root[u], root[v])
        for side in (u, v):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == last).all():
            break
    moved = root != np.arange(len(ids))
    yield pd.DataFrame({"u": ids[moved], "v": ids[root[moved]]})


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) for every id that occurs in edges (a, b); component_id is the smallest id reachable.

    Parts of a bounded number of edges become stars first; one part is the whole answer. Else large-star and small-star rounds
    join the parts' stars until nothing moves: each replaces the edges by as many or fewer, and the number of rounds is
    logarithmic. Minima are aggregated before they are shuffled; the join that hands them back may be split where an id has
    very many edges. Nothing is collected but one flag a round.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    e = cut(edges.distinct())
    parts = -(-e.count() // EDGES_A_TASK) or 1
    e = cut((e.coalesce(1) if parts == 1 else e.repartition(parts, "u", "v")).mapInPandas(_forest, "u long, v long"))
    while parts > 1:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = cut(both.join(low, both.u == low.k).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        joined = large.join(least, large.u == least.k)
        e = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
        # Stars: every id has one edge, and no centre has an edge of its own.
        if e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
