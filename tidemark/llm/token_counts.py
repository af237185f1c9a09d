"""Token counts: lengths only, from batch encoding inside Arrow tasks.

Rows are taken in slices of bounded bytes, not of a number of rows, so that a very long text fills a slice of its own. Texts
are cut at safe boundaries (see `encoding`), and the pieces of a slice are encoded in one call.

Defined results: a null text counts as empty (0 bytes, 0 tokens). Repeated rows are counted each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scan
from tidemark.llm.encoding import encoder as encoder_of
from tidemark.llm.shared import bounded_batches, table

LIMIT = 2048


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of docs(doc_id, text) by the tokenizer file at `path`, which every executor can open."""

    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            size, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, data, off in scan.texts(batch.column("text")):
                size.append(np.diff(off))
                count.append(encoder.counts(data, off))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(size)), pa.array(np.concatenate(count))], ["doc_id", "n_bytes", "n_tokens"])

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts(docs, tokenizer_path("word_bpe_49k.json")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
