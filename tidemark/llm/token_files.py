"""Token-id files with bit-plane shuffled, compressed blocks and a block index.

A dataset has two parts, both written by Spark's own committer, so a lost task leaves nothing behind:

`segments/`: one row holds the ids of consecutive whole documents (doc_ids, lengths) as `blocks`. A block is up to BLOCK_IDS
ids; bit b of all its ids is one plane, packed eight to a byte, and each plane is a zstandard frame. Blocks have as many planes
as their largest id needs bits.
`index/`: one row for each block: shard, segment, block, start (ids before it in the whole dataset), n_ids, n_bytes. A range of
ids is read by it: only the blocks that hold some are decompressed (`read_range`).

Rows are dealt by ranges of doc_id, so shards, segments and documents follow each other in ascending order of doc_id.

Defined results: a null text is empty and has its end id only. Rows with one doc_id stay apart and are ordered by text. A null
doc_id comes first. An empty table gives an empty dataset. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import scan
from tidemark.llm.encoding import encoder as encoder_of
from tidemark.llm.shared import bounded_batches, shared_folder, shuffle_count, table
from tidemark.llm.token_counts import tokenizer_path

BLOCK_IDS, SEGMENT_IDS, END, LEVEL = 1 << 16, 1 << 19, 0, 3
SEGMENTS = "shard int, segment int, before long, n_ids long, doc_ids array<long>, lengths array<long>, block_ids array<int>, block_planes array<int>, planes array<binary>"


def to_planes(ids: np.ndarray, compress) -> list[bytes]:
    """Compressed bit planes of a block, lowest bit first."""
    bits = max(1, int(ids.max()).bit_length())
    return [compress(np.packbits(((ids >> np.uint32(b)) & np.uint32(1)).astype(np.uint8), bitorder="little").tobytes()) for b in range(bits)]


def from_planes(planes: list[bytes], n: int, decompress) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for b, raw in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(decompress(raw), np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(b)
    return ids


def _writer(path: str, end: int):
    def run(batches):
        import zstandard
        from pyspark import TaskContext

        compress, encoder = zstandard.ZstdCompressor(level=LEVEL).compress, encoder_of(path)
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 2, pa.list_(pa.binary())]

        def row(docs, lengths, parts):
            ids = np.concatenate(parts)
            blocks = [ids[k : k + BLOCK_IDS] for k in range(0, len(ids), BLOCK_IDS)]
            planes = [to_planes(b, compress) for b in blocks]
            flat = [p for ps in planes for p in ps]
            return [shard, segment, before, len(ids), docs, lengths, [len(b) for b in blocks], [len(p) for p in planes], flat]

        docs, lengths, parts, held = [], [], [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, data, off in scan.texts(batch.column("text")):
                tokens, at = encoder.encode(data, off)
                for k in range(len(at) - 1):
                    own = np.append(tokens[at[k] : at[k + 1]], np.uint32(end))
                    docs.append(ids[lo + k])
                    lengths.append(len(own))
                    parts.append(own)
                    held += len(own)
                    if held >= SEGMENT_IDS:
                        yield pa.record_batch([pa.array([v], t) for v, t in zip(row(docs, lengths, parts), kinds)], names)
                        segment, before = segment + 1, before + held
                        docs, lengths, parts, held = [], [], [], 0
        if docs:
            yield pa.record_batch([pa.array([v], t) for v, t in zip(row(docs, lengths, parts), kinds)], names)

    return run


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end: int = END) -> None:
    """Writes the ids of docs(doc_id, text) to `folder`, a path that all executors share."""
    rows = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange(shuffle_count(rows), "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(_writer(tokenizer, end), SEGMENTS).write.parquet(f"{folder}/segments", compression="none")
    spark = docs.sparkSession
    parts = spark.read.parquet(f"{folder}/segments")
    size = F.transform(F.sequence(F.lit(1), F.size("block_ids")), lambda k: F.get("block_planes", k - 1))
    blocks = parts.select("shard", "segment", "before", "block_ids", size.alias("each"), F.transform("planes", F.octet_length).alias("bytes"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    blocks = blocks.select("shard", "segment", "before", "block_ids", "each", "bytes", F.posexplode("block_ids").alias("block", "n_ids"))
    here = F.col("before") + total(F.slice("block_ids", F.lit(1), F.col("block")))
    n_bytes = total(F.slice("bytes", (total(F.slice("each", F.lit(1), F.col("block"))) + 1).cast("int"), F.get("each", F.col("block"))))
    index = blocks.select("shard", "segment", "block", here.alias("inside"), "n_ids", n_bytes.alias("n_bytes"))
    index.join(F.broadcast(_shard_starts(parts)), "shard").select("shard", "segment", "block", (F.col("inside") + F.col("shard_start")).alias("start"), "n_ids", "n_bytes").write.parquet(f"{folder}/index")


def _shard_starts(parts: DataFrame) -> DataFrame:
    """Ids before each shard. One row a shard: there are as many as the writing job had tasks, whatever the data."""
    totals = parts.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))


def _reader(batches):
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for r in batch.to_pylist():
            at, parts = 0, []
            for n, planes in zip(r["block_ids"], r["block_planes"]):
                parts.append(from_planes(r["planes"][at : at + planes], n, decompress))
                at += planes
            ids, ends = np.concatenate(parts).astype("<u4"), np.cumsum(r["lengths"])
            starts = ends - r["lengths"]
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.record_batch([pa.array([r["shard"]] * len(sums), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["before"], pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array(sums, pa.int64())], ["shard", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files. A segment stands alone: nothing is shuffled."""
    parts = bounded_batches(spark.read.parquet(f"{folder}/segments"))
    rows = parts.select("shard", "before", "doc_ids", "lengths", "block_ids", "block_planes", "planes").mapInArrow(_reader, "shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(_shard_starts(parts)), "shard").select("doc_id", (F.col("inside") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def _block_reader(first: int, last: int):
    def run(batches):
        import zstandard

        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for r in batch.to_pylist():
                opens = np.concatenate([[0], np.cumsum(r["block_planes"])])
                for b in r["wanted"]:
                    ids = from_planes(r["planes"][opens[b["block"]] : opens[b["block"] + 1]], b["n_ids"], decompress)
                    lo, hi = max(0, first - b["start"]), min(len(ids), last - b["start"])
                    yield pa.record_batch([pa.array(b["start"] + np.arange(lo, hi)), pa.array(ids[lo:hi].astype(np.int64))], ["position", "id"])

    return run


def read_range(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """(position, id) of the ids at places first to last - 1 of the dataset, found by the index. Places that it has not are left out."""
    held = spark.read.parquet(f"{folder}/index").filter((F.col("start") < last) & (F.col("start") + F.col("n_ids") > first))
    held = held.groupBy("shard", "segment").agg(F.collect_list(F.struct("block", "start", "n_ids")).alias("wanted"))
    parts = bounded_batches(spark.read.parquet(f"{folder}/segments")).select("shard", "segment", "block_planes", "planes")
    return parts.join(held, ["shard", "segment"]).select("block_planes", "planes", "wanted").mapInArrow(_block_reader(first, last), "position long, id long")


def query(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder)
    return read_documents(spark, folder)
