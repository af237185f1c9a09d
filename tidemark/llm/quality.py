"""Quality classifier: a byte-level convolutional network, trained and applied in numpy.

A document is cut into overlapping chunks that cover it to its last byte. Learned byte embeddings pass through learned
filters; each filter's largest response over a chunk is kept, and the largest and the mean over all chunks are combined into
one probability. Training reads whole texts of a sample of labelled documents that are not held out, of at most TRAIN_ROWS rows
and TRAIN_BYTES together.

Defined results: a null text counts as empty; an empty text is one chunk of padding and gets a score too. Repeated rows are
scored each. A null doc_id has a null held_out. Without any labelled row of either class every score is the share of label 1 in the sample (0.5 if there is none).
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import scan
from tidemark.llm.labelled import held_out, sample
from tidemark.llm.shared import bounded_batches, table

CHUNK, STRIDE, WIDTH = 512, 448, 6
DIMS, FILTERS = 6, 16
TRAIN_ROWS, TRAIN_BYTES = 3000, 32 << 20
#: Passes over the sample, or more where it is small, so that a network takes STEPS steps at least.
EPOCHS, STEPS, BATCH = 6, 400, 48
#: Chunks whose responses are held at once.
AT_ONCE = 96
THRESHOLD = 0.3


def chunk_starts(off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, text index) of the chunks; an empty text has one."""
    n = np.diff(off)
    count = np.maximum(1, -(-np.maximum(n - (CHUNK - STRIDE), 1) // STRIDE))
    owner = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    return off[:-1][owner] + k * STRIDE, owner


def chunk_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One row of CHUNK bytes for each chunk, zeros after a text's end."""
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    padded = data if len(data) else np.zeros(1, np.uint8)
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)], 0).astype(np.uint8)


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.p = {
            "bytes": r.normal(0, 0.5, (256, DIMS)),
            "filters": r.normal(0, 0.4, (WIDTH, DIMS, FILTERS)),
            "bias": np.zeros(FILTERS),
            "top": r.normal(0, 0.3, FILTERS),
            "mean": r.normal(0, 0.3, FILTERS),
            "out": np.zeros(1),
        }
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0

    def tables(self) -> list[np.ndarray]:
        """Response of the filters to each pair of neighbouring bytes, for each pair of places in the window."""
        one = np.einsum("bd,kdf->kbf", self.p["bytes"], self.p["filters"]).astype(np.float32)
        return [(one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def responses(self, rows: np.ndarray, tables: list[np.ndarray], where: bool = False):
        """Largest response of each filter over each chunk, and where it is."""
        pairs = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        n = rows.shape[1] - WIDTH + 1
        got = tables[0][pairs[:, :n]]
        for k in range(1, WIDTH // 2):
            got += tables[k][pairs[:, 2 * k : 2 * k + n]]
        if not where:
            return got.max(1), None
        at = got.argmax(1)
        return np.take_along_axis(got, at[:, None, :], 1)[:, 0], at

    def pooled(self, data: np.ndarray, off: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        starts, owner = chunk_starts(off)
        ends, best = off[1:][owner], []
        for lo in range(0, len(starts), AT_ONCE):
            best.append(self.responses(chunk_bytes(data, starts[lo : lo + AT_ONCE], ends[lo : lo + AT_ONCE]), tables)[0])
        best = np.maximum(np.concatenate(best) + self.p["bias"], 0)
        first = np.searchsorted(owner, np.arange(len(off) - 1))
        return np.maximum.reduceat(best, first), np.add.reduceat(best, first) / np.bincount(owner, minlength=len(off) - 1)[:, None]

    def scores(self, data: np.ndarray, off: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        top, mean = self.pooled(data, off, tables)
        return 1 / (1 + np.exp(-np.clip(top @ self.p["top"] + mean @ self.p["mean"] + self.p["out"], -30, 30)))

    def step(self, rows: np.ndarray, owner: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One gradient step; rows are chunks, owner their texts (ascending), y the texts' labels."""
        p, count, tables = self.p, np.bincount(owner, minlength=len(y)), self.tables()
        best, at = (np.concatenate(x) for x in zip(*(self.responses(rows[lo : lo + AT_ONCE], tables, True) for lo in range(0, len(rows), AT_ONCE))))
        act = np.maximum(best + p["bias"], 0)
        first = np.searchsorted(owner, np.arange(len(y)))
        top, mean = np.maximum.reduceat(act, first), np.add.reduceat(act, first) / count[:, None]
        score = 1 / (1 + np.exp(-np.clip(top @ p["top"] + mean @ p["mean"] + p["out"], -30, 30)))
        d = (score - y) / len(y)
        g = {"top": top.T @ d, "mean": mean.T @ d, "out": d.sum(keepdims=True)}
        back = (act == top[owner]) * (d[:, None] * p["top"])[owner] + (d / count)[owner][:, None] * p["mean"]
        back *= act > 0
        g["bias"] = back.sum(0)
        seen = np.zeros((WIDTH, 256, FILTERS))
        f = np.arange(FILTERS)
        for k in range(WIDTH):
            np.add.at(seen[k], (np.take_along_axis(rows, at + k, 1), f), back)
        g["filters"] = np.einsum("bd,kbf->kdf", p["bytes"], seen)
        g["bytes"] = np.einsum("kbf,kdf->bd", seen, p["filters"])
        self.t += 1
        for k, x in g.items():
            x = x + 1e-5 * p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * x
            self.v[k] = 0.99 * self.v[k] + 0.01 * x * x
            p[k] = p[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-8)


def train(texts: list[str], y: np.ndarray, seed: int = 3) -> Network:
    net, r = Network(seed), np.random.default_rng(seed)
    y = np.asarray(y, float)
    share = (y.sum() + 1) / (len(y) + 2)
    net.p["out"] = np.array([np.log(share / (1 - share))])
    if len(set(y.tolist())) < 2:
        net.p["top"], net.p["mean"] = net.p["top"] * 0, net.p["mean"] * 0
        return net
    data, off = scan.column_bytes(pa.array(texts, pa.large_string()))
    starts, owner = chunk_starts(off)
    bounds = np.searchsorted(owner, np.arange(len(off)))
    steps = -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // steps))
    total = epochs * steps
    for _ in range(epochs):
        order = r.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            which = order[lo : lo + BATCH]
            flat = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in which])
            rows = chunk_bytes(data, starts[flat], off[1:][owner[flat]])
            net.step(rows, np.repeat(np.arange(len(which)), bounds[which + 1] - bounds[which]), y[which], 0.02 * (1 - net.t / total) + 0.001)
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """docs with `score`, a probability of label 1. The network, of fixed size, travels with the task."""
    others = [f for f in docs.schema if f.name != "score"]
    names = [f.name for f in others]

    def run(batches):
        tables = net.tables()
        for batch in batches:
            got = [net.scores(data, off, tables) for _, data, off in scan.texts(batch.column("text"))]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(np.concatenate([np.zeros(0), *got]))], [*names, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return bounded_batches(docs).select(*names).mapInArrow(run, StructType([*others, StructField("score", DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Network:
    rows = sample(docs, labels, "quality", most, TRAIN_BYTES)
    return train(rows["text"].tolist(), rows["_y"].to_numpy())


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
