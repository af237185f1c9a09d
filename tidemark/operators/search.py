"""Ranked search over ids, titles and authors, many requests at once.

An index is built once and kept: its texts, the runs of one to three characters that each holds, sorted by run, and how many texts
hold a run. A request reads the postings of the rarest run of its words and those texts alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import part
from tidemark.plans.staging import cut

GRAM = 3
#: Distinct requests or runs that are broadcast: a few tens of MB.
MOST_BROADCAST = 200_000
#: Parts that a request's matches are cut to `limit` in before they meet.
SALTS = 32


def runs(text, size):
    """Distinct runs of `size` characters."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda k: k + size - 1 <= F.length(text))
    return F.array_distinct(F.transform(at, lambda k: F.substring(text, k, F.lit(size))))


def asked_runs(words):
    """The runs of a request that each text with all its words holds."""
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= GRAM, runs(w, GRAM)).otherwise(F.array(w)))))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


@dataclass
class Index:
    """texts(_key, _text, ...), postings(run, _key) and counts(run, n)."""

    texts: DataFrame
    postings: DataFrame
    counts: DataFrame

    @classmethod
    def of(cls, rows: DataFrame, text: str, requests: DataFrame | None = None) -> Index:
        """The index of rows. With requests(words) it serves these alone: only their runs are counted, and postings are made as they are read, not kept."""
        texts = cut(rows.withColumns({"_text": F.col(text), "_key": F.monotonically_increasing_id()}))
        every = F.flatten(F.array(*[runs(F.col("_text"), k) for k in range(1, GRAM + 1)]))
        postings = texts.select(F.explode(every).alias("run"), "_key")
        if requests is None:
            postings = cut(postings)
        else:
            postings = postings.join(_small(cut(requests.select(F.explode(asked_runs("words")).alias("run")).distinct())), "run", "left_semi")
        return cls(texts, postings, cut(postings.groupBy("run").agg(F.count("*").alias("n"))))

    def write(self, folder: str) -> None:
        """Postings and texts in ranges of what they are read by, so that a reader skips the rest by its bounds."""
        self.texts.repartitionByRange("_key").sortWithinPartitions("_key").write.parquet(f"{folder}/texts")
        self.postings.repartitionByRange("run", "_key").sortWithinPartitions("run", "_key").write.parquet(f"{folder}/postings")
        self.counts.sort("run").write.parquet(f"{folder}/counts")

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Index:
        return cls(*(spark.read.parquet(f"{folder}/{name}") for name in ("texts", "postings", "counts")))

    def holding(self, requests: DataFrame, few: bool = False) -> DataFrame:
        """requests(qid, words, ...) with the texts that hold every word. `few` requests go to the postings, not these to them."""
        of = requests.select("qid", F.explode(asked_runs("words")).alias("run")).join(self.counts, "run", "left")
        rarest = of.groupBy("qid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "run"))["run"].alias("run"))
        keys = self.postings.join(F.broadcast(rarest) if few else rarest, "run").select("qid", "_key")
        found = keys.join(self.texts, "_key").join(requests, "qid")
        return found.filter(F.forall("words", lambda w: F.contains(F.col("_text"), w))).drop("_key", "_text")


def first_rows(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first `limit` rows of each qid, with `rank`; a request with very many matches is cut in parts first."""
    parts = df.withColumn("_s", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    parts = parts.withColumn("_k", F.row_number().over(W.partitionBy("qid", "_s").orderBy(*order))).filter(F.col("_k") <= limit)
    return parts.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order))).filter(F.col("rank") <= limit).drop("_s", "_k")


def asked_for(queries: DataFrame) -> DataFrame:
    """(qid, q, words): requests in lower case with single spaces; empty ones have no answer."""
    q = queries.select("qid", F.filter(F.split(F.lower("q"), r"\s+"), lambda w: w != "").alias("words"))
    return q.filter(F.size("words") > 0).withColumn("q", F.array_join("words", " "))


def _once(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked(qid, q), requests(qid, q, words)): who asks what, and each text of a request once, under itself as its qid.

    Requests that many share, as short ones do, are matched and ranked once: else the matches grow with the product of both.
    """
    asked = cut(asked_for(queries))
    return asked.select("qid", "q"), cut(asked.groupBy("q").agg(F.first("words").alias("words")).withColumn("qid", F.col("q")))


def _handed_out(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of each text of a request, for all who ask it."""
    return asked.join(rows.withColumnRenamed("qid", "q"), "q").drop("q")


def index_of(rows: DataFrame, requests: DataFrame | None = None) -> Index:
    """The index of rows(id, pop) and, if there is one, their title."""
    title = F.lower("title") if "title" in rows.columns else F.lit(None).cast("string")
    return Index.of(rows.select("id", F.lower("id").alias("lid"), "pop", title.alias("lt")).withColumn("hay", F.concat_ws("\n", "lid", "lt")), "hay", requests)


def ranked(queries: DataFrame, index: DataFrame | Index, limit: int) -> DataFrame:
    """(qid, rank, id) for queries(qid, q) over rows(id, pop[, title]) or their index: every word must occur in id or title.

    Order: the exact id; repos of an owner that the request names; one of the request's very name with 5 % of the best match or
    more; of other owners, those with every word in the name, or a well-used owner that begins with the first word; popularity
    (none last); id.
    """
    asked, requests = _once(queries)
    index = index if isinstance(index, Index) else index_of(index, requests)
    j = cut(index.holding(requests, requests.count() <= MOST_BROADCAST))
    j = j.join(j.groupBy("qid").agg(F.max("pop").alias("best")), "qid").withColumn("n", part(F.col("lid"), 2)).withColumn("o", part(F.col("lid"), 1))
    enough = F.coalesce(F.col("pop") >= 0.05 * F.col("best"), F.lit(False))
    same = (F.col("n") == F.col("q")) | F.coalesce(F.col("lt") == F.col("q"), F.lit(False))
    own = F.array_contains("words", F.col("o"))
    in_name = F.forall("words", lambda w: F.contains(F.col("n"), w) | F.coalesce(F.contains(F.col("lt"), w), F.lit(False)))
    keys = [F.col("lid") == F.col("q"), own, same & enough, ~own & (in_name | (F.startswith("o", F.get("words", 0)) & enough))]
    rows = first_rows(j, [*(k.cast("int").desc() for k in keys), F.col("pop").desc_nulls_last(), F.col("id")], limit)
    return _handed_out(asked, rows.select("qid", "rank", "id")).select("qid", "rank", "id")


def authors(queries: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """index(author, pop): every word occurs; exact first, then by prefix, then popularity."""
    asked, requests = _once(queries)
    j = Index.of(index.withColumn("la", F.lower("author")), "la", requests).holding(requests, requests.count() <= MOST_BROADCAST)
    order = [(F.col("la") == F.col("q")).cast("int").desc(), F.startswith(F.col("la"), F.col("q")).cast("int").desc(), F.col("pop").desc(), F.col("author")]
    return _handed_out(asked, first_rows(j, order, limit).select("qid", "rank", "author")).select("qid", "rank", "author")


def by_kind(queries: DataFrame, indexes: dict[str, DataFrame | Index], limit: int = 5) -> DataFrame:
    """(kind, qid, rank, id): the best of each kind."""
    out = None
    for kind, index in indexes.items():
        rows = ranked(queries, index, limit).select(F.lit(kind).alias("kind"), "qid", "rank", "id")
        out = rows if out is None else out.unionByName(rows)
    return out
