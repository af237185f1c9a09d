"""Snapshot files as they land, day by day, as a series of Parquet partitions. For all that follows from a day see `daily`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.snapshots import RAW, counters


def file_day():
    """The day in a file's name; what stands between it and the ending tells deliveries apart."""
    return F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})[^/]*\.parquet", 1))


def append_days(spark: SparkSession, landing: str, out: str, checkpoint: str, schema: str = RAW, then=None) -> None:
    """Reads what has newly landed and writes it under out/day=...; a day that is delivered again replaces itself.

    The query stops when the folder is read (availableNow); its checkpoint remembers files by name. So a day delivered again
    comes under a name of its own, as `2025-01-01.2.parquet`. One file is one batch; `then(day)` follows each.
    """

    def land(batch: DataFrame, _: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(out)
        days = sorted(r.day for r in batch.select("day").distinct().collect())
        batch.unpersist()
        for day in days if then else ():
            then(day)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing)
    days = counters(stream.withColumn("day", file_day()))
    days.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(land).start().awaitTermination()
