"""Components in many bounded parts against union-find."""

import random

import pytest

pytest.importorskip("tokenizers")
from tidemark.llm import shared  # noqa: E402


@pytest.mark.parametrize("bound", [1_000_000, 20])
def test_components_by_union_find(spark, monkeypatch, bound):
    monkeypatch.setattr(shared, "EDGES_A_TASK", bound)
    r = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 130)] + [(500, 500 + k) for k in range(40)] + [(r.randrange(60), r.randrange(60)) for _ in range(30)] + [(7, 7), (900, 901), (901, 900)]
    r.shuffle(edges)
    low = {x: x for e in edges for x in e}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        low[q] = p
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = shared.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in linked)
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0
