"""Scores and targets against the same worked out step by step, without slices, tables or vectors of words."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tokenizers")
from tidemark.llm import labelled, mixing, quality, scan, toxicity  # noqa: E402

R = random.Random(31)
TEXTS = ["", "a", "Moron! what a sentence, é", "x" * 700, " ".join("".join(R.choice("abcdé 😀.") for _ in range(9)) for _ in range(400)), "\n\n", "short one"]


def test_quality_scores_by_direct_convolution():
    net = quality.Network(8)
    r = np.random.default_rng(1)
    net.p |= {"bias": r.normal(size=quality.FILTERS), "out": np.array([0.3])}

    def score(text):
        raw, pooled = text.encode(), []
        at = 0
        while True:
            chunk = np.frombuffer(raw[at : at + quality.CHUNK].ljust(quality.CHUNK, b"\0"), np.uint8)
            vectors = net.p["bytes"][chunk]
            places = [sum(vectors[i + k] @ net.p["filters"][k] for k in range(quality.WIDTH)) for i in range(quality.CHUNK - quality.WIDTH + 1)]
            pooled.append(np.maximum(np.max(places, axis=0) + net.p["bias"], 0))
            at += quality.STRIDE
            if at + quality.CHUNK - quality.STRIDE >= len(raw):
                break
        z = np.max(pooled, axis=0) @ net.p["top"] + np.mean(pooled, axis=0) @ net.p["mean"] + net.p["out"][0]
        return 1 / (1 + np.exp(-z))

    got = np.concatenate([net.scores(d, o, net.tables()) for _, d, o in scan.texts(pa.array(TEXTS), 300)])
    assert np.allclose(got, [score(t) for t in TEXTS], atol=1e-5)
    wide = np.concatenate([net.scores(d, o, net.tables()) for _, d, o in scan.texts(pa.array(TEXTS))])
    assert np.allclose(got, wide)


def test_toxicity_scores_word_by_word():
    model = toxicity.Model(2)
    model.p["grams"] = np.random.default_rng(3).normal(size=model.p["grams"].shape)
    model.p["bias"] = np.array([0.2, -0.4])
    side = model.p["grams"] @ (model.p["classes"][:, 1] - model.p["classes"][:, 0])

    def number(b):
        return int(scan.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0] % np.uint64(toxicity.BUCKETS))

    def score(text):
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        means = []
        for w in filter(None, re.split(rb"[\x20\x09-\x0D.,;:!?%$#&*()\[\]{}\"/|\-+=@~<>_']+", low)):
            w = b"<" + w + b">"
            means.append(np.mean([side[number(w)], *(side[number(w[k : k + g])] for g in toxicity.GRAMS for k in range(len(w) - g + 1))]))
        return 1 / (1 + np.exp(-((np.mean(means) if means else 0.0) - 0.6)))

    parts, bias = model.parts()
    memo = toxicity._Words(parts)
    got = np.concatenate([memo.means(d, o) for _, d, o in scan.texts(pa.array(TEXTS), 100)]) + bias
    assert np.allclose(1 / (1 + np.exp(-got)), [score(t) for t in TEXTS], atol=1e-9)


def test_a_small_table_of_known_values_forgets_but_never_errs():
    memo, r = scan.Memo(1, np.int64, bits=3), np.random.default_rng(4)
    for _ in range(40):
        h = r.integers(0, 60, 50).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        assert (memo.look(h, lambda at: (h[at] % np.uint64(1 << 40)).astype(np.int64)[:, None])[:, 0] == (np.maximum(h, np.uint64(1)) % np.uint64(1 << 40)).astype(np.int64) * (h > 0)).all()


def test_targets_by_pouring(spark):
    rows, sizes = [], {}
    for k in range(600):
        source = R.choice([None, "", "Z", "a", "b", "é", "small"]) if k % 50 else "small"
        text = None if k % 17 == 0 else " ".join(["w"] * R.randrange(0, 40 if source != "small" else 3))
        rows.append((k, text, source))
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        per = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if per * weight[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left, open_ = left - sum(2.0 * sizes[s] for s in over), open_ - over
    target |= {s: per * weight[s] for s in open_}
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {k: s for k, _, s in rows}
    taken = {}
    for r in got:
        assert r.source_size == sizes[by[r.doc_id]] and abs(r.target - target[by[r.doc_id]]) < 1e-6 and 0 <= r.copies <= 2
        taken[by[r.doc_id]] = taken.get(by[r.doc_id], 0) + r.copies * r["size"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in order)


def test_samples_are_whole_and_bounded(spark):
    docs = spark.createDataFrame([(k, "x" * (1000 if k == 3 else 10), "z") for k in range(40)] + [(None, "y", "z"), (5, None, "z"), (6, "again", "z")], "doc_id long, text string, extra string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(38)] + [(38, None), (None, 1)], "doc_id long, quality int")
    every = labelled.sample(docs, labels, "quality", 1000, 1 << 20)
    held = {r.doc_id for r in docs.filter(labelled.held_out(docs.doc_id)).collect()}
    want = sorted([(k, "x" * (1000 if k == 3 else 10)) for k in range(38) if k not in held] + ([(6, "again")] if 6 not in held else []))
    assert sorted(zip(every["_id"], every["text"])) == want
    some = labelled.sample(docs, labels, "quality", 10, 1 << 20)
    assert len(set(some["_id"])) <= 10 and len(some) <= 10
    few = labelled.sample(docs, labels, "quality", 1000, 60)
    assert 0 < len(few) <= 6 and few["text"].str.len().sum() <= 60 + 10
    assert len(labelled.sample(docs.filter("false"), labels, "quality", 10, 100)) == 0
