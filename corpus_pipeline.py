"""From raw documents to packed training sequences, stage by stage.

Each stage takes any number of rows with the columns of documents, nulls in any of them, and no rows at all. A null text is an
empty one and follows it: the classifier judges it, it has no lines to lose, no near copies, no words to be taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import line_dedup, mixing, ngram_join, packing, quality
from tidemark.llm.shared import cut, table
from tidemark.llm.token_counts import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, rows without doc_id too. It learns from the labelled ones among docs; without any of both labels all get one score."""
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), net).filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; those with nothing left go. Rows without doc_id stay as they are."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS)).filter("NOT emptied")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: its smallest doc_id, in one row. Rows without doc_id belong to no group and stay."""
    first = ngram_join.near_duplicates(docs).filter("doc_id = component_id").select("doc_id")
    row = F.min_by(F.struct(*[F.col(c) for c in COLUMNS]), F.struct(F.xxhash64("text"), F.xxhash64(*COLUMNS))).alias("row")
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(row).select("row.*")
    return kept.unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Equal rows are as many documents."""
    marks = {"row_a": F.xxhash64(*COLUMNS), "row_b": F.xxhash64(F.lit(1), *COLUMNS)}
    docs = docs.select(*COLUMNS).withColumns(marks)
    taken = mixing.mix(docs, carry=tuple(marks)).groupBy(*marks).agg(F.sum("copies").alias("copies")).filter("copies > 0")
    once = docs.groupBy(*marks).agg(*[F.first(c).alias(c) for c in COLUMNS])
    return once.join(taken, list(marks)).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. A document that the mix takes twice is packed twice."""
    return packing.pack(packing.pieces(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier decides in the first stage, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
