"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch is the SIZE smallest of the distinct hashes (HASH_BITS bits) of a text's 5-word shingles, ascending. Sketches of parts
merge into that of the whole; from two of them follow estimates of resemblance and containment, from one the number of
distinct shingles.

Defined results: a null text is empty; a text without words has an empty sketch, and two empty sketches are alike (1.0). A text
with fewer than five words has one shingle. Every row is a document and is returned once. The order is by doc_id, a null one
being the smallest; rows of one doc_id follow each other by a hash of their texts, and of equal rows each but one has its own
copy as the next document. Extra columns are ignored. In an empty table there is nothing; a single document is its own next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, shuffle_count, table

WIDTH, SIZE, HASH_BITS = 5, 128, 40


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\s]+"), lambda w: w != "")


def sketch(words: Column, size: int = SIZE) -> Column:
    """Sketch of a column of words; it must be a column of its own, as every shingle reads it."""
    n = F.size(words)
    places = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n - (WIDTH - 1), F.lit(1))))
    hashes = F.transform(places, lambda k: F.shiftrightunsigned(F.xxhash64(F.slice(words, k, WIDTH)), 64 - HASH_BITS))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """Sketch of two parts together. Shingles that span the parts are in neither."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of the Jaccard similarity of the shingle sets."""
    both = merge(a, b, size)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both).cast("double"))


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimate of the number of distinct shingles; exact where a sketch is not full."""
    last = F.element_at(a, -1).cast("double") + 1
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) * float(1 << HASH_BITS) / last)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimate of the share of a's shingles that b has too."""
    union = distinct_shingles(merge(a, b, size), size)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, size) * union / distinct_shingles(a, size)))


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), HASH_BITS // 4, "0")), "")


def takers(ids: DataFrame) -> DataFrame:
    """ids(d, h, doc_id, half) with `taker`: the document whose next one this is, with its key and how much it takes.

    Next is by descending order, so the taker is the next greater; the smallest takes from the greatest. Only ids and lengths
    are moved. Ranges of ids are tasks; one row a range tells where the next begins.
    """
    order = ["doc_id", "h"]
    ranged = cut(ids.repartitionByRange(shuffle_count(ids), *order).withColumn("_range", F.spark_partition_id()))
    taker = F.struct(*order, "d", "half")
    firsts = ranged.groupBy("_range").agg(F.min(taker).alias("f"))
    over = W.orderBy("_range")
    wrap = F.first("f").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    firsts = firsts.select("_range", F.coalesce(F.lead("f").over(over), wrap).alias("f"))
    inside = F.lead(taker).over(W.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("n", inside).join(F.broadcast(firsts), "_range").select("d", "h", F.coalesce("n", "f").alias("taker"))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs(doc_id, text), of their edited texts, and how alike these and the next documents are.

    A text is sketched once, before it is moved; its sketch goes with it to its own row and to that of its taker.
    """
    # (d, h) is a row's key, without nulls, so that the grouping below and both joins deal rows alike.
    key = [F.coalesce(F.col("doc_id"), F.lit(0).cast("long")).alias("d"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("h")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(*key, "doc_id", "text")
    ids = texts.select("d", "h", "doc_id", F.floor(F.length("text") / 2).cast("int").alias("half")).groupBy("d", "h").agg(F.first("doc_id").alias("doc_id"), F.first("half").alias("half"))
    # Equal rows become one with a number before they are moved. The filter, which every row passes, makes both uses read all
    # columns, so that one shuffle serves them.
    rows = texts.withColumn("words", word_list(F.col("text"))).withColumn("own", sketch(F.col("words")))
    rows = rows.groupBy("d", "h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("own").alias("own"), F.count("*").alias("copies"))
    rows = rows.filter("copies > 0 OR doc_id IS NULL OR text IS NULL OR own IS NULL")
    given = rows.join(takers(ids), ["d", "h"])
    given = given.select(F.col("taker.d").alias("d"), F.col("taker.h").alias("h"), F.expr("left(text, taker.half)").alias("gift"), F.col("own").alias("next_own"))
    met = rows.join(given, ["d", "h"]).withColumn("n_chars", F.length("text").cast("long"))
    nexts = F.array(F.struct("gift", "next_own"))
    copy = F.struct(F.expr("left(text, cast(n_chars div 2 as int))").alias("gift"), F.col("own").alias("next_own"))
    met = met.withColumn("next", F.explode(F.when(F.col("copies") == 1, nexts).otherwise(F.concat(nexts, F.array_repeat(copy, (F.col("copies") - 1).cast("int"))))))
    met = met.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 2 as int))"), "next.gift"))
    met = met.select("doc_id", "n_chars", "own", F.sha2("edited", 256).alias("edited_sha256"), F.col("next.next_own").alias("next_own"), word_list(F.col("edited")).alias("words"))
    met = met.withColumn("changed", sketch(F.col("words")))
    return met.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
        resemblance(F.col("own"), F.col("next_own")).alias("near_next"),
        distinct_shingles(F.col("own")).alias("n_shingles"),
        containment(F.col("own"), F.col("changed")).alias("in_edited"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return compare(table(spark, sf_dir, "documents"))
