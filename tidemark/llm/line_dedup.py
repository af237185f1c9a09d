"""Line dedup across documents by a deletion-neighbourhood join over words.

A line is its sequence of words (A-Z lower-cased). Lines of fewer than MIN_WORDS words always stay. Of equal lines the
earliest occurrence stays (smallest doc_id, then line number). A line of NEAR_WORDS words or more also goes when an earlier
line lies within one edit of a word (one word replaced, added or left out).

Near lines are found without comparing pairs. A line emits its variants with one word deleted as hashed keys: with the place
deleted (two lines that share such a key differ by a replaced word) and without it (a line equal to another's variant differs
by an added word). Under each key the earliest line of each kind is aggregated; every line takes the earliest that it meets,
and the edit distance to it is verified on the words. Only lines that share the first or the second half of their words with
another line emit variants: a single edit leaves one of the halves whole, so none is lost.

Defined results: a null or empty text has one empty line and stays as it is. A row without doc_id has no place in the order:
its text stays as it is, with no line removed, and its lines take none from other documents. Rows with one doc_id: line numbers count in each
row, and what is kept is decided once for the id and line number. Extra columns are kept. Documents in which nothing but white
space is left after lines went are marked `emptied`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from tidemark.llm import scan
from tidemark.llm.shared import bounded_batches, cut, id_filter, table

MIN_WORDS, NEAR_WORDS = 5, 10
_LINES = "doc_id long, line long, h long, n int, halves array<long>"


def lines_of(data: np.ndarray, off: np.ndarray):
    """For a slice of texts: text index and number of each line, its first word and word count, and the words' hashes."""
    starts, ends, doc = scan.line_spans(data, off)
    number = np.arange(len(starts)) - np.searchsorted(doc, doc)
    small = scan.lower(data)
    first, last, _ = scan.spans(small, off)
    words = scan.span_hashes(small, first, last)
    begin, end = np.searchsorted(first, starts), np.searchsorted(first, ends)
    return starts, ends, doc, number, begin, end, words


def prefix_sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, powers, inverse powers) from which the hash of any run of words follows."""
    p = scan.powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * p[0][:-1], out=total[1:])
    return total, *p


def run_hash(sums, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total, _, down = sums
    return (total[end] - total[begin]) * down[begin]


def named(h: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
    return scan.mix(h + scan.mix(n.astype(np.uint64) * np.uint64(64) + np.uint64(kind))).view(np.int64)


def _lines(batches):
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for lo, data, off in scan.texts(batch.column("text")):
            _, _, doc, number, begin, end, words = lines_of(data, off)
            n = end - begin
            keep = n >= MIN_WORDS
            doc, number, begin, end, n = (x[keep] for x in (doc, number, begin, end, n))
            sums = prefix_sums(words)
            # Of n words, the first k are whole when the edit is behind them, the last n - k when it is before. A line with
            # one word more or less cuts at its own half, so both cuts that may meet are named.
            cuts = [(begin, begin + n // 2, 0), (begin, begin + (n + 1) // 2, 0), (begin + n // 2, end, 1), (begin + n - (n + 1 - (n + 1) // 2), end, 1)]
            halves = np.stack([named(run_hash(sums, a, b), b - a, kind) for a, b, kind in cuts], 1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * 4, pa.int32()), pa.array(halves.ravel()))
            yield pa.record_batch([pa.array(ids[lo + doc].astype(np.int64)), pa.array(number.astype(np.int64)), pa.array(named(run_hash(sums, begin, end), n, 2)), pa.array(n.astype(np.int32)), lists], ["doc_id", "line", "h", "n", "halves"])


def _words_of(wanted):
    """Words of each occurrence of a line that may be wanted."""

    def run(batches):
        for batch in batches:
            for _, data, off in scan.texts(batch.column("text")):
                _, _, _, _, begin, end, words = lines_of(data, off)
                keep = end - begin >= NEAR_WORDS
                begin, end = begin[keep], end[keep]
                h = named(run_hash(prefix_sums(words), begin, end), end - begin, 2)
                at = np.flatnonzero(wanted(h))
                at = at[np.unique(h[at], return_index=True)[1]]
                yield pa.record_batch([pa.array(h[at]), pa.array([words[b:e].tobytes() for b, e in zip(begin[at], end[at])], pa.binary())], ["h", "words"])

    return run


def _variants(batches):
    """Keys of each line: `role` 0 its own words (met by variants), 1 a variant (meets own words), 2 a variant with its place."""
    for batch in batches:
        raw = batch.column("words").to_pylist()
        keys, roles, owner = [], [], []
        for k, w in enumerate(raw):
            w = np.frombuffer(w, np.uint64)
            n = len(w)
            p = scan.powers(n + 1)[0]
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(w * p[:n], out=total[1:])
            # Words behind the deleted one move one place down.
            down = scan.powers(2)[1][1]
            less = total[:n] + (total[n] - total[1:]) * down
            size = np.full(n, n - 1)
            keys += [named(total[n:], np.array([n]), 3), named(less, size, 3), named(less + scan.mix(np.arange(n, dtype=np.uint64)), size, 4)]
            roles += [np.zeros(1, np.int8), np.ones(n, np.int8), np.full(n, 2, np.int8)]
            owner.append(np.full(2 * n + 1, k))
        if keys:
            o = np.concatenate(owner)
            yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(roles)), batch.column("rank").take(pa.array(o))], ["key", "role", "rank"])


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sequences lie within one edit."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return bool((a[k + (len(a) == len(b)) :] == b[k + 1 :]).all())


def _verify(batches):
    for batch in batches:
        ok = [within_one(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("words").to_pylist(), batch.column("other_words").to_pylist())]
        got = batch.filter(pa.array(ok, pa.bool_()))
        yield pa.record_batch([got.column("h")], ["h"])


def near_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(h) of the distinct lines that have an earlier line within one edit."""
    keys = classes.filter(F.col("n") >= NEAR_WORDS).select("h", F.explode(F.array_distinct("halves")).alias("half"))
    shared = keys.groupBy("half").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("half")
    wanted = keys.join(shared, "half").select("h").distinct()
    # `rank` follows (doc_id, line): one number stands for the place of a line in all that is shuffled by key.
    wanted = classes.select("h", "doc_id", "line").join(wanted, "h", "left_semi").repartitionByRange("doc_id", "line", "h").sortWithinPartitions("doc_id", "line", "h")
    wanted = cut(wanted.select("h", F.monotonically_increasing_id().alias("rank")))
    words = docs.select("text").mapInArrow(_words_of(id_filter(wanted.select("h"))), "h long, words binary").join(wanted, "h")
    words = cut(words.groupBy("h").agg(F.first("words").alias("words"), F.first("rank").alias("rank")))
    variants = words.select("words", "rank").mapInArrow(_variants, "key long, role byte, rank long")
    # A key is met by few lines or by many; either way one row a key is left after partial aggregation.
    earliest = variants.groupBy("key").agg(*(F.min(F.when(F.col("role") == r, F.col("rank"))).alias(f"e{r}") for r in (0, 1, 2)), F.count("*").alias("c")).filter("c > 1").drop("c")
    met = variants.join(earliest, "key").withColumn("e", F.when(F.col("role") == 0, F.col("e1")).when(F.col("role") == 1, F.col("e0")).otherwise(F.col("e2")))
    witness = met.filter("e < rank").groupBy("rank").agg(F.min("e").alias("e"))
    pairs = witness.join(words, "rank").join(words.select(F.col("rank").alias("e"), F.col("words").alias("other_words")), "e")
    return pairs.select("h", "words", "other_words").mapInArrow(_verify, "h long")


def _rewrite(fields: list[str]):
    def run(batches):
        for batch in batches:
            kept, texts, n_lines, n_gone = batch.column("kept").to_pylist(), [], [], []
            no_id = batch.column("doc_id").is_null().to_pylist()
            for lo, data, off in scan.texts(batch.column("text")):
                starts, ends, doc, number, begin, end, _ = lines_of(data, off)
                raw, bounds = data.tobytes(), np.searchsorted(doc, np.arange(len(off)))
                for k in range(len(off) - 1):
                    a, b = bounds[k], bounds[k + 1]
                    stays = no_id[lo + k] | (end[a:b] - begin[a:b] < MIN_WORDS) | np.isin(number[a:b], kept[lo + k] or [])
                    texts.append(raw[off[k] : off[k + 1]] if stays.all() else b"\n".join(raw[s:e] for s, e in zip(starts[a:b][stays].tolist(), ends[a:b][stays].tolist())))
                    n_lines.append(int(b - a))
                    n_gone.append(int((~stays).sum()))
            null = batch.column("text").is_null().to_pylist()
            new = pa.array([None if z else t.decode("utf-8", "replace") for t, z in zip(texts, null)], pa.string())
            emptied = pa.array([g > 0 and not t.strip() for t, g in zip(texts, n_gone)], pa.bool_())
            yield pa.record_batch([*(new if f == "text" else batch.column(f) for f in fields), pa.array(n_lines, pa.int64()), pa.array(n_gone, pa.int64()), emptied], [*fields, "n_lines", "n_removed", "emptied"])

    return run


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with shortened texts, and n_lines, n_removed, emptied."""
    extra = {"n_lines", "n_removed", "emptied", "kept"}
    docs = bounded_batches(docs).select(*[c for c in docs.columns if c not in extra]).withColumn("doc_id", F.col("doc_id").cast("long"))
    lines = cut(docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_lines, _LINES))
    first = F.min(F.struct("doc_id", "line"))
    classes = lines.groupBy("h").agg(first.alias("f"), F.first("n").alias("n"), F.first("halves").alias("halves")).select("h", "n", "halves", "f.doc_id", "f.line")
    classes = cut(classes)
    stay = classes.join(near_lines(docs, classes), "h", "left_anti").groupBy("doc_id").agg(F.collect_list("line").alias("kept"))
    # A document keeps at most as many lines as it has, so the lists are no longer than the texts.
    rows = docs.join(stay, "doc_id", "left")
    fields = [f for f in docs.schema]
    schema = StructType([*(StructField("text", StringType()) if f.name == "text" else f for f in fields), StructField("n_lines", LongType()), StructField("n_removed", LongType()), StructField("emptied", BooleanType())])
    names = [f.name for f in fields]
    return rows.select(*names, "kept").mapInArrow(_rewrite(names), schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "emptied", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
