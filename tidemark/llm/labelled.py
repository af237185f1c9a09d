"""Folds and bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of all training: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int):
    """Texts and labels to learn from, whole, by hash of the id: at most `most` labelled rows that are not held out, and no more
    of these than have `most_bytes` together. A text that does not fit into what is left of the bytes is passed over, and the next
    one tried.

    Rows without a label or text are left out, equal texts of one id count once. The ids are cut to the bound before they meet the
    documents, and lengths are read before texts, so neither the broadcast nor what reaches the driver grows with the data.
    """
    rows = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y"))
    rows = rows.filter(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id").limit(most).dropDuplicates(["_id"])
    texts = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("_id"))
    texts = texts.withColumns({"_h": F.xxhash64("_id"), "_t": F.xxhash64("text")})
    # An id may stand in many rows; of those only as many as the bound, with the smallest hashes, count.
    sizes = texts.groupBy("_h", "_id", "_t").agg(F.max(F.octet_length("text")).alias("_n")).orderBy("_h", "_id", "_t").limit(most).collect()
    left, fits = most_bytes, []
    for r in sizes:
        if r["_n"] <= left:
            left -= r["_n"]
            fits.append((r["_id"], r["_t"]))
    chosen = F.broadcast(docs.sparkSession.createDataFrame(fits, "_id long, _t long"))
    got = texts.join(chosen, ["_id", "_t"]).groupBy("_id", "_t").agg(F.min("text").alias("text"), F.first("_y").alias("_y")).select("_id", "text", "_y").toPandas()
    return got.sort_values(["_id", "text"], kind="stable").reset_index(drop=True)
