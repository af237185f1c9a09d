"""Fingerprints against edited texts and similarities worked out one by one."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")
from tidemark.llm import fingerprints  # noqa: E402

R = random.Random(9)
WORDS = ["".join(R.choice("abcdefgé") for _ in range(R.randrange(2, 7))) for _ in range(400)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_every_row_by_brute_force(spark):
    base = [R.choice(WORDS) for _ in range(700)]
    texts = [" ".join(base[R.randrange(200) :][: R.randrange(1, 500)]) for _ in range(40)] + [None, "", " ", "one", "Ünï cödé 😀 words here and there"]
    rows = [(k * 3 - 20, t) for k, t in enumerate(texts)]
    rows += [(None, "text without an id at all, of nine words"), (1, "another text of the id one"), rows[4], rows[4], rows[4], (None, None)]
    R.shuffle(rows)
    got = fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("x")).repartition(5)).collect()
    assert len(got) == len(rows)
    hashes = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i is not None, i or 0, hashes[t or ""], t or "") for i, t in rows), reverse=True)
    want = []
    for k, (known, i, _, text) in enumerate(order):
        after = order[(k + 1) % len(order)][3]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((i if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(text, edited), alike(text, after)))
    key = lambda r: (str(r[0]), r[1], r[2])
    for r, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(r)[:3] == w[:3]
        # Exact where both sketches hold every shingle, else within five standard errors of 128 samples.
        for estimate, truth in ((r.near_edited, w[3]), (r.near_next, w[4])):
            assert abs(estimate - truth) <= 5 * (max(truth * (1 - truth), 0.01) / fingerprints.SIZE) ** 0.5


def test_one_document_is_its_own_next(spark):
    r = fingerprints.compare(spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"a b c a b c"[:6] + b"a b c").hexdigest()
