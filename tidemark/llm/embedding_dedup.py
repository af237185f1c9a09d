"""Embedding near-duplicates by randomised-rotation binary codes.

Vectors of one label are compared by cosine. Equal vectors form one class. A class's unit vector is turned by random rotations
and only the signs are kept, with a stored correction factor (how well the signs stand for the vector). Runs of the sign bits
are bucket keys: vectors within the bound share at least one of TABLES keys with probability RECALL or more. In a bucket, signs
of one vector times the turned other one over the correction factor is an unbiased estimate of their inner product; only pairs
whose upper confidence bound reaches the threshold are recomputed exactly, in double precision. A pair counts in the first table
where it meets. Large buckets are cut into blocks, pairs of which are separate tasks; a task returns a count and one edge a
vector, never pairs. Keys are dealt first, without vectors; these are moved once for each block that they are compared in. The
number of tables follows from the largest label, and the number of tasks from the bytes that they are to read.

Defined results: a vector that is null, of no length, zero, or that holds a null or a non-finite number, and one whose label is
null, links with nothing and is its own component. Vectors of unlike lengths do not link. Rows with one vec_id count as separate
vectors. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, bucket_of, components, cut, shuffle_count, table

THRESHOLD = 0.93
RECALL = 0.998
#: Classes wanted in a bucket, and classes of one block of a large bucket.
BUCKET, BLOCK = 128, 1024
#: Bytes dealt to one task.
TASK_BYTES = 16 << 20
#: Half-width of the confidence bound of an estimate, in standard errors.
SURE = 5.0


def plan_tables(n: int) -> tuple[int, int]:
    """(bits of a key, number of tables) for n classes of one label: longer keys for more classes, and as many tables as the recall needs."""
    bits = max(6, math.ceil(math.log2(max(2, n) / BUCKET)))
    meet = (1 - math.acos(THRESHOLD) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def rotations(dim: int, bits: int) -> np.ndarray:
    """Random rotations side by side, as many as give that many sign bits: (dim, dim * number)."""
    r = np.random.default_rng(dim)
    return np.concatenate([np.linalg.qr(r.normal(size=(dim, dim)))[0] for _ in range(max(2, -(-bits // dim)))], axis=1)


def turned(vectors: np.ndarray, bits: int) -> np.ndarray:
    return vectors @ rotations(vectors.shape[1], bits)


def encode(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sign bits packed, correction factors) of unit vectors."""
    z = turned(vectors, bits)
    return np.packbits(z > 0, axis=1, bitorder="little"), np.abs(z).sum(1) / math.sqrt(vectors.shape[1]) / (z.shape[1] // vectors.shape[1])


def estimates(codes: np.ndarray, factor: np.ndarray, z: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unbiased estimates of the inner products of the coded vectors with those turned to z, their half-widths)."""
    times = z.shape[1] // dim
    signs = np.unpackbits(codes, axis=1, count=z.shape[1], bitorder="little").astype(np.float32) * 2 - 1
    got = signs @ z.T.astype(np.float32) / (math.sqrt(dim) * times) / factor[:, None]
    spread = np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(1, dim - 1) * times)
    return got, SURE * spread


def _unit(raw: list, dim: int) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in raw]) if len(raw) else np.zeros((0, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _encoder(bits: int, tables: int):
    def run(batches):
        for pdf in batches:
            for dim, g in pdf.groupby("dim"):
                x = _unit(g["embedding"].tolist(), int(dim))
                codes, factor = encode(x, bits * tables)
                flat = np.unpackbits(codes, axis=1, bitorder="little")[:, : bits * tables].reshape(len(g), tables, bits)
                keys = (flat * (1 << np.arange(bits))).sum(2).astype(np.int32)
                yield pd.DataFrame({"id": g["id"], "label": g["label"], "dim": g["dim"], "weight": g["weight"], "code": [c.tobytes() for c in codes], "factor": factor, "keys": [k.tobytes() for k in keys], "vector": [v.tobytes() for v in x]})

    return run


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the pairs (i, j)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            return root


def _bucket_links(bits: int, tables: int):
    def links(left: pd.DataFrame, right: pd.DataFrame | None, t: int, dim: int):
        """Index pairs of linked classes of one bucket (of two blocks if right is given)."""
        both = left if right is None else right
        x, y = (np.frombuffer(b"".join(p["vector"]), np.float64).reshape(len(p), dim) for p in (left, both))
        codes = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(len(left), -1)
        guess, wide = estimates(codes, left["factor"].to_numpy(), turned(y, bits * tables), dim)
        ok = guess + wide[:, None] >= THRESHOLD
        if right is None:
            ok = np.triu(ok, 1)
        i, j = np.nonzero(ok)
        a, b = (np.frombuffer(b"".join(p["keys"]), np.int32).reshape(len(p), tables)[:, :t] for p in (left, both))
        new, out = np.zeros(len(i), bool), np.zeros(len(i), bool)
        for lo in range(0, len(i), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            new[s] = ~(a[i[s]] == b[j[s]]).any(1)
            out[s] = new[s] & (np.einsum("nd,nd->n", x[i[s]], y[j[s]]) >= THRESHOLD)
        return i[out], j[out]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, degree, root = [], [], []
        for (_, dim, t, _, lo, hi), g in pdf.groupby(["label", "dim", "t", "key", "lo", "hi"], sort=False):
            if len(g) < 2:
                continue
            g = g.sort_values("id", kind="stable")
            first, second = (g, None) if lo == hi else (g[g["block"] == lo], g[g["block"] == hi])
            if second is not None and (not len(first) or not len(second)):
                continue
            i, j = links(first, second, int(t), int(dim))
            if not len(i):
                continue
            who = first if second is None else pd.concat([first, second])
            j = j if second is None else j + len(first)
            w, at = who["weight"].to_numpy(), who["id"].to_numpy()
            n = np.bincount(i, w[j], len(who)) + np.bincount(j, w[i], len(who))
            linked = np.flatnonzero(n)
            ids.append(at[linked])
            degree.append(n[linked].astype(np.int64))
            root.append(at[_roots(len(who), i, j)[linked]])
        cat = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
        return pd.DataFrame({"id": cat(ids), "links": cat(degree), "root": cat(root)})

    return run


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors(vec_id, embedding, label)."""
    parts = shuffle_count(vectors)
    rows = bounded_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & some & F.col("vec_id").isNotNull(), F.lit(False)))
    # -0.0 and 0.0 are one number here.
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
    key = ["label", "h1", "h2"]
    classes = rows.filter("usable").groupBy(*key).agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    classes = cut(classes.withColumn("dim", F.size("embedding"))).withColumn("id", F.monotonically_increasing_id())
    bits, tables = plan_tables(classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    coded = classes.select("id", "label", "dim", "weight", "embedding").mapInPandas(_encoder(bits, tables), "id long, label string, dim int, weight long, code binary, factor double, keys binary, vector binary")
    coded = cut(coded)
    t = F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))
    entries = coded.select("id", "label", "dim", "keys", t.alias("t")).withColumn("key", F.expr("substring(keys, t * 4 + 1, 4)")).drop("keys")
    place = ["label", "dim", "t", "key"]
    sizes = entries.groupBy(*place).agg(F.count("*").alias("members")).filter("members > 1").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")).drop("members")
    entries = entries.join(sizes, place).withColumn("block", F.when(F.col("blocks") > 1, bucket_of("id", n=1 << 30) % F.col("blocks")).otherwise(0))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    entries = cut(entries.select(*place, "lo", "hi", "block", "id"))
    width = coded.agg(F.max(F.octet_length("vector") + F.octet_length("code") + F.octet_length("keys"))).first()[0] or 0
    lanes = max(parts, entries.count() * (width + 64) // TASK_BYTES + 1)
    held = coded.select("id", "weight", "code", "factor", "keys", "vector")
    dealt = entries.join(held, "id").withColumn("lane", bucket_of(*place, "lo", "hi", n=lanes))
    found = cut(dealt.groupBy("lane").applyInPandas(_bucket_links(bits, tables), "id long, links long, root long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component_id", "label_id")
    # The smallest vec_id of each component of classes.
    least = classes.select("id", "first").join(whole, "id").groupBy("label_id").agg(F.min("first").alias("component_id"))
    named = classes.select(*key, "id", "first", "weight").join(links, "id", "left").join(whole.join(least, "label_id"), "id", "left")
    named = named.select(*key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"), F.lit(True).alias("usable"))
    out = rows.select("vec_id", *key, "usable").join(named, [*key, "usable"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(deg.n_links, 0) AS BIGINT) AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v JOIN comp ON comp.a = v.vec_id LEFT JOIN deg ON deg.a = v.vec_id
"""
