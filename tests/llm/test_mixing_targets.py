"""Sources of few and very unlike texts come near their targets; rows without id spread over groups."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.mixing")
from tidemark.llm import mixing  # noqa: E402

R = random.Random(6)


def test_sources_with_long_texts_come_near_their_targets(spark):
    rows = []
    for s in range(12):
        sizes = [int(20 * R.paretovariate(0.9)) for _ in range(150)]
        # One text that holds half of its source has nothing to be made up by.
        sizes = [min(n, sum(sizes) // 4) for n in sizes]
        rows += [(len(rows) + k, "w " * min(n, 20_000), f"s{s}") for k, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).withColumn("taken", F.col("copies") * F.col("size"))
    assert got.filter("taken > 2 * size").isEmpty()
    for r in got.groupBy("key").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("most"), F.expr("percentile(size, 0.5)").alias("middle")).collect():
        # Off by part of one text, which is not one of the long ones.
        assert abs(r.t - r.target) <= max(r.middle, 0.01 * r.target) and r.most > 5 * r.middle


def test_rows_of_one_id_fill_no_group(spark):
    rows = [(None, f"{k} " + "same size " * 4, "a") for k in range(6000)] + [(7, "twin text", "a")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.sized(docs)
    assert sized.count() == 9000 and sized.select("order").distinct().count() == 9000
    groups = sized.groupBy(F.pmod("order", F.lit(9))).count().agg(F.max("count")).first()[0]
    assert groups < 1.2 * 1000
    got = mixing.mix(docs).groupBy("doc_id").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.sum("size").alias("size")).collect()
    assert abs(sum(r.taken for r in got) - 1.5 * sum(r["size"] for r in got)) <= 9
    assert sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
