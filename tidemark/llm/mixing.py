"""Mixing sources to target weights by pivotal dependent rounding.

Each document wants `target / source_size` copies of itself, mostly a fraction. Two documents of a source are paired: words
move from one's expected copies to the other's, in a random direction chosen so that expectations hold, until one of the two
counts is whole. The other goes on to the next pair. A group of bounded size leaves at most one fraction; those residuals meet
again, FANIN groups at a time, level by level, until a source has one, which is rounded to the nearer side.

Long texts come first. Chance alone may leave one of them open when the short ones run out, and its rounding would then miss the
target by many words. So once the rest of a group holds less than twice what a text lacks to the nearer whole number, its words
move that way. What is left open is mostly a short text, and a source takes its target but for part of that.

Random numbers come from hashes of the pair, and groups from hashes of ids, texts and, of equal rows, their number: reruns agree
whatever the partitioning, and no id fills a group.

Defined results: a null text has size 0 and is taken 0 words. A null source is a source of its own, the last one. Rows with
one doc_id are rounded each. No documents, or none with words: every target is 0. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scan
from tidemark.llm.shared import cut, positions, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
GROUP, FANIN = 1024, 64
_WHOLE = 1e-9
#: A plan of at most so many sources, and bytes of their names, is broadcast; a larger one is joined by shuffle.
PLAN_ROWS, PLAN_BYTES = 10_000, 1 << 20


def sized(docs: DataFrame, carry: tuple = ()) -> DataFrame:
    """(doc_id, key, size, order, carry): `order` is a hash that differs from row to row. Equal rows are counted before they are numbered."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")).alias("key"), words.alias("size"), F.xxhash64("text").alias("_t"), *carry)
    every = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return every.select("doc_id", "key", "size", F.xxhash64("doc_id", "size", "_t", "_k").alias("order"), *carry)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source_size, members, target) from (key, source_size, members): weights by order of key, capped at `most` times a source."""
    placed = positions(sizes, "key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("before") % len(weights) + 1).cast("int"))
    placed = cut(placed.withColumn("weight", w).drop("before"))
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, last = 0.0, None
    while last is None or level > last:  # rises until no more sources reach their cap: two numbers a round
        last = level
        over = F.col("source_size") * most < F.lit(level) * F.col("weight")
        row = placed.agg(F.sum(F.when(over, F.col("source_size") * most)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if not row.open:
            break
        level = (share * total - (row.full or 0.0)) / row.open
    return placed.withColumn("target", F.least(F.lit(level) * F.col("weight"), F.col("source_size") * most)).drop("weight")


def _pivot(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rounds the fractions of one group; at most one row stays open, mostly a short one, as the longest are paired first."""
    pdf = pdf.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    f, size, ids = pdf["fraction"].to_numpy(float).copy(), pdf["size"].to_numpy(float), pdf["order"].to_numpy(np.int64).view(np.uint64)
    fit = np.where((f > _WHOLE) & (f < 1 - _WHOLE), size, 0.0)
    # What this row and those behind it can give and take.
    give, take = (np.cumsum((fit * x)[::-1])[::-1] for x in (f, 1 - f))
    held = -1
    for k in range(len(f)):
        if not _WHOLE < f[k] < 1 - _WHOLE:
            continue
        if held < 0:
            held = k
            continue
        up = min(size[held] * (1 - f[held]), size[k] * f[k])
        down = min(size[held] * f[held], size[k] * (1 - f[k]))
        with np.errstate(over="ignore"):
            u = int(scan.mix(ids[held] * np.uint64(3) + ids[k])) / 2.0**64
        more, less = size[held] * (1 - f[held]), size[held] * f[held]
        scarce = 2 * more > give[k] if more <= less else 2 * less > take[k]
        grows = more <= less if scarce else u * (up + down) < down
        move = up if grows else -down
        f[held] += move / size[held]
        f[k] -= move / size[k]
        if not _WHOLE < f[held] < 1 - _WHOLE:
            held = k if _WHOLE < f[k] < 1 - _WHOLE else -1
    opened = (f > _WHOLE) & (f < 1 - _WHOLE)
    return pdf.assign(fraction=np.where(opened, f, np.round(f)), open=opened)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, carry: tuple = ()) -> DataFrame:
    """(doc_id, key, size, source_size, target, copies) of docs(doc_id, text, source), and columns of docs of type long to carry along."""
    rows = cut(sized(docs, carry))
    plan = cut(targets(rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("members")), weights, share, most))
    extent = plan.agg(F.max("members").alias("members"), F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes")).first()
    small = extent.n <= PLAN_ROWS and (extent.bytes or 0) <= PLAN_BYTES
    wanted = rows.join(F.broadcast(plan) if small else plan, "key").withColumn("want", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    wanted = wanted.withColumn("base", F.floor(F.col("want") + _WHOLE)).withColumn("fraction", F.greatest(F.col("want") - F.col("base"), F.lit(0.0)))
    groups = F.ceil(F.col("members") / GROUP)
    wanted = wanted.withColumn("salt", F.pmod("order", groups))
    names = ["doc_id", "key", "size", "source_size", "target", "base", "order", "salt", "fraction", *carry]
    schema = "doc_id long, key string, size long, source_size long, target double, base long, order long, salt long, fraction double, " + "".join(f"{c} long, " for c in carry) + "open boolean"
    # Rows without words or without a fraction need no partner.
    settled = (F.col("size") == 0) | (F.col("fraction") <= _WHOLE) | (F.col("fraction") >= 1 - _WHOLE)
    done = [wanted.filter(settled).select(*names).withColumn("open", F.lit(False)).withColumn("fraction", F.round("fraction"))]
    todo = wanted.filter(~settled).select(*names)
    levels, widest = 1, -(-(extent.members or 1) // GROUP)
    while widest > 1:
        levels, widest = levels + 1, -(-widest // FANIN)
    for level in range(levels):
        # Dealt by both columns, as a join by shuffle leaves all groups of a source in one task.
        after = cut(todo.repartition("key", "salt").groupBy("key", "salt").applyInPandas(_pivot, schema))
        done.append(after.filter("NOT open"))
        todo = after.filter("open").withColumn("salt", F.floor(F.col("salt") / FANIN)).select(*names)
    out = todo.withColumn("open", F.lit(False)).withColumn("fraction", F.round("fraction"))
    for part in done:
        out = out.unionByName(part)
    return out.select("doc_id", "key", "size", "source_size", "target", (F.col("base") + F.col("fraction")).cast("long").alias("copies"), *carry)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
