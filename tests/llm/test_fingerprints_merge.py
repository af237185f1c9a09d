"""Sketches of parts merge into that of the whole; containment is estimated."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.fingerprints")
from tidemark.llm import fingerprints as f  # noqa: E402


def test_merge_and_containment(spark):
    r = random.Random(1)
    words = [f"w{k}" for k in range(4000)]
    rows = []
    for k in range(12):
        a = [r.choice(words) for _ in range(r.randrange(3, 900))]
        rows.append((k, a, a[: len(a) // 2] + [r.choice(words) for _ in range(r.randrange(1, 900))]))
    rows += [(50, [], []), (51, ["one"], []), (52, ["a"] * 50, ["a"] * 9)]
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    df = df.select("k", *[f.sketch(F.col(c), n).alias(f"{c}{n}") for c in "ab" for n in (f.SIZE, 10**6)])
    got = df.select("*", f.merge(F.col(f"a{f.SIZE}"), F.col(f"b{f.SIZE}")).alias("m"), f.containment(F.col(f"a{f.SIZE}"), F.col(f"b{f.SIZE}")).alias("c"), f.distinct_shingles(F.col("m")).alias("n")).collect()
    assert len(got) == 15
    for x in got:
        a, b = set(x[f"a{10**6}"]), set(x[f"b{10**6}"])
        assert x.m == sorted(a | b)[: f.SIZE]
        true = len(a & b) / len(a) if a else 1.0
        assert abs(x.c - true) < 0.3 and (len(a | b) >= f.SIZE or abs(x.c - true) < 1e-9)
        assert abs(x.n - len(a | b)) <= (0.4 * len(a | b) if len(a | b) >= f.SIZE else 0)
