"""Scans of daily snapshots and long series, and their writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RAW = "id string, downloads long, downloadsAllTime long, likes long"
RAW_LIKES = "id string, likes long, trendingScore double"


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of the schema, in order: absent ones as typed nulls, present ones cast (overflow raises)."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def read_days(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Daily snapshot files, or folders of files, named by their day; columns that a file lacks are null."""
    df = spark.read.schema(schema).parquet(path)
    return df.withColumn("day", F.to_date(F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})[^/]*\.parquet(/|$)", 1)))


def counters(df: DataFrame) -> DataFrame:
    """Series rows from raw model or dataset snapshots."""
    return df.select("id", "day", F.col("downloads").cast("int").alias("dl30"), F.col("downloadsAllTime").alias("dl_all"), F.col("likes").cast("int").alias("likes"))


def like_counters(df: DataFrame) -> DataFrame:
    return df.select("id", "day", F.col("likes").cast("int").alias("likes"), F.col("trendingScore").cast("float").alias("trending"))


def latest_upload(log: DataFrame, taken: str, commit: str) -> DataFrame:
    """The last commit of each UTC day; ties by the greater commit."""
    return log.groupBy(F.to_date(taken).alias("day")).agg(F.max(F.struct(taken, commit)).alias("m")).select("day", F.col(f"m.{commit}").alias(commit))


def not_landed(days: DataFrame, landed: DataFrame) -> DataFrame:
    return days.join(landed.select("day").distinct(), "day", "left_anti")


def in_months(series: DataFrame, months: list[str]) -> DataFrame:
    """Rows of some months; with a `month` partition column the scan is pruned."""
    col = F.col("month") if "month" in series.columns else F.date_format("day", "yyyy-MM")
    return series.filter(col.isin(months))


def snapshot(series: DataFrame, day: Column) -> DataFrame:
    return series.filter(F.col("day") == day)


def entity_metadata(raw: DataFrame) -> DataFrame:
    """Nested metadata to columns: base models, sizes and the values of tags."""
    from tidemark.functions.scalars import tag_value

    return raw.select(
        "id",
        "author",
        "pipeline_tag",
        F.to_timestamp_ntz(F.col("createdAt")).alias("created_at"),
        F.col("safetensors.total").alias("params"),
        F.col("baseModels.relation").alias("base_relation"),
        F.transform("baseModels.models", lambda m: m["id"]).alias("base_ids"),
        tag_value(F.col("tags"), "license:").alias("license"),
        F.array_contains("tags", "gguf").alias("is_gguf"),
    )


def _given(raw: DataFrame, name: str, kind: str) -> Column:
    """A column of the raw file as a type; null where the file lacks it. Times keep their zone-less wall clock."""
    if name not in raw.columns:
        return F.lit(None).cast(kind)
    return F.to_timestamp_ntz(F.col(name)) if kind == "timestamp_ntz" else F.col(name).cast(kind)


def dataset_metadata(raw: DataFrame) -> DataFrame:
    """As entity_metadata, of datasets: the task category stands where entities have their tag; descriptions are cut to 300 characters, as pages show them."""
    from tidemark.functions.scalars import tag_value

    tags = {"pipeline_tag": "task_categories:", "size": "size_categories:", "license": "license:", "modality": "modality:"}
    columns = [tag_value(F.col("tags"), prefix).alias(name) for name, prefix in tags.items()]
    given = {"createdAt": ("created_at", "timestamp_ntz"), "lastModified": ("last_modified", "timestamp_ntz"), "trendingScore": ("trending", "double"), "gated": ("gated", "string")}
    return raw.select("id", "author", *[_given(raw, k, kind).alias(name) for k, (name, kind) in given.items()], *columns, F.left("description", F.lit(300)).alias("description"))


def space_metadata(raw: DataFrame) -> DataFrame:
    """As entity_metadata, of Spaces: title, emoji and short description out of the card's JSON; null where it is none."""
    from tidemark.functions.scalars import json_field

    card = [json_field(F.col("cardData"), f"$.{c}").alias(c) for c in ("title", "emoji", "short_description")]
    given = {"createdAt": ("created_at", "timestamp_ntz"), "lastModified": ("last_modified", "timestamp_ntz"), "likes": ("likes", "long"), "trendingScore": ("trending", "double")}
    return raw.select("id", "author", "sdk", *[_given(raw, k, kind).alias(name) for k, (name, kind) in given.items()], *card)


def write_series(series: DataFrame, path: str, key: str = "id", files: int = 4, level: int = 9, months: int | None = None) -> None:
    """By month, each month in about `files` files by range of the key, sorted by key and day, compressed at a level of zstandard.

    `months`: how many there are, where it is known; else the rows are asked.
    """
    rows = series.withColumn("month", F.date_format("day", "yyyy-MM"))
    parts = max(1, files) * max(1, months or rows.select("month").distinct().count())
    dealt = rows.repartitionByRange(parts, "month", key).sortWithinPartitions("month", key, "day")
    dealt.write.mode("overwrite").partitionBy("month").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)


def upsert_day(path: str, staging: str, rows: DataFrame, day) -> None:
    """Replaces one day in its month. The month is staged first: a path is never overwritten while it is read."""
    spark = rows.sparkSession
    month = f"{day:%Y-%m}"
    old = spark.read.parquet(path).filter((F.col("month") == month) & (F.col("day") != F.lit(day)))
    new = rows.withColumn("month", F.lit(month)).select(*old.columns)
    old.unionByName(conform(new, old.schema)).write.mode("overwrite").parquet(staging)
    back = spark.read.parquet(staging).sortWithinPartitions(*[c for c in ("id", "day") if c in old.columns])
    back.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_entities(df: DataFrame, path: str, key: str = "id") -> None:
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def keep_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the last in the order."""
    w = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
