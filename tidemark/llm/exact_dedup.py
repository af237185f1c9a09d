"""Exact dedup by two Bloom passes, in DataFrame functions alone.

Texts are equal when they are identical after deletion of space and the controls 9 to 13. The first pass sets BITS_A_ROW bits of
room for each row's hash, PROBES bits a hash, and a second filter keeps those bits that two rows or more have set. The second
pass asks that filter: a hash that occurs twice has set all its bits twice, so a row that lacks one of them occurs once and
passes straight through, without a shuffle. The others, those that repeat and about one in seventy that does not, are grouped by
the SHA-256 of the text that remains, which decides.

A filter is a table of blocks of 4 KB; all bits of a hash lie in one block. Up to FILTER_BYTES (32 million rows) it is broadcast.
Beyond, blocks are joined by their number: digests are shuffled then, texts never.

Of equal texts, the row with the most code points stays, then that of the smallest doc_id (null last), then the first in the
table. Groups that hold a thousandth of all rows or more, a thousand of them at most, are broadcast to their rows, so that no
task gathers a large group.

Defined results: a null text is empty; all texts without other characters are equal. Rows that share a doc_id, or have none, are
rows like others, and each is returned; keep_id is null where the row that stays has no doc_id. `decide` ignores extra columns,
`dedup` keeps them, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, table

BITS_A_ROW, PROBES, BLOCK_BITS = 16, 2, 1 << 15
FILTER_BYTES, HOT_SHARE = 64 << 20, 1000


def normal(text: Column) -> Column:
    """The text without space and the controls 9 to 13; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\v\f":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _bits() -> list[Column]:
    return [F.pmod(F.xxhash64("digest", F.lit(k)), F.lit(BLOCK_BITS)) for k in range(PROBES)]


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(blocks))


def repeated_filter(digests: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the bits that two rows or more of digests(digest) have set."""
    spots = digests.select(_block(blocks).alias("block"), F.explode(F.array_distinct(F.array(*_bits()))).alias("bit"))
    twice = spots.groupBy("block", "bit").count().filter("count > 1")
    return twice.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def with_maybe(rows: DataFrame, digests: DataFrame, n: int) -> DataFrame:
    """rows(digest, ...) with `maybe`: false where the digest occurs once in digests, a table of n rows, for certain."""
    blocks = -(-n * BITS_A_ROW // BLOCK_BITS) or 1
    bits = cut(repeated_filter(digests, blocks))
    if blocks * BLOCK_BITS // 8 <= FILTER_BYTES:
        bits = F.broadcast(bits)
    byte = lambda bit: F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.lit(True)
    for bit in _bits():
        maybe &= F.getbit(byte(bit), bit.bitwiseAND(7).cast("int")) == 1
    probed = rows.withColumn("block", _block(blocks)).join(bits, "block", "left")
    return probed.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("block", "bits")


def _digest() -> Column:
    return F.unhex(F.sha2(normal(F.col("text")), 256))


def decide(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("place"))
    rows = cut(rows)
    total = rows.count()
    probed = with_maybe(rows, rows, total)
    once = probed.filter("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    again = cut(probed.filter("maybe").drop("maybe"))
    # The greatest of all: bitwise not turns an order round without overflow.
    best = F.max(F.struct("n", F.bitwise_not(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("i"), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("place").alias("p"), "doc_id"))
    groups = cut(again.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("b")).select("digest", "group_size", F.col("b.doc_id").alias("keep_id"), F.bitwise_not("b.p").alias("stays")))
    hot = F.broadcast(groups.filter(F.col("group_size") * HOT_SHARE >= total))
    found = again.join(hot, "digest").unionByName(again.join(hot.select("digest"), "digest", "left_anti").join(groups, "digest"))
    out = once.unionByName(found.select("doc_id", "keep_id", "group_size", (F.col("place") == F.col("stays")).alias("kept"), "digest"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs, one row of each group of equal texts. Rows that occur once are passed on as they are read."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _digest().alias("digest"))
    digests = cut(rows.select("digest"))
    probed = with_maybe(rows, digests, digests.count())
    n, doc_id = F.coalesce(F.length("row.text"), F.lit(0)), F.col("row.doc_id").cast("long")
    order = F.struct(n, F.bitwise_not(F.coalesce(doc_id, F.lit((1 << 63) - 1))), doc_id.isNotNull(), F.xxhash64("row.text"))
    again = probed.filter("maybe").groupBy("digest").agg(F.max_by("row", order).alias("row"))
    return probed.filter("NOT maybe").select("row.*").unionByName(again.select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    return decide(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM t GROUP BY text_sha256)
SELECT t.doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, t.doc_id = keep_id AS kept, t.text_sha256 FROM t JOIN g ON g.text_sha256 = t.text_sha256
"""
