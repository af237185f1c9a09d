"""Large families of near copies, repeated and missing ids, against brute force."""

import random

import pytest

pytest.importorskip("tokenizers")
from tidemark.llm import ngram_join  # noqa: E402

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randrange(2, 7))) for _ in range(300)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected(rows):
    """{doc_id: (n_shingles, component_id)} by comparing every pair."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    low = {i: i for i, _ in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(a), root(b)))
                low[q] = p
    return {i: (max(len(s) for j, s in sets if j == i), root(i)) for i in low}


def family(base, size, edits):
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(R.randrange(edits + 1)):
            words[R.randrange(len(words))] = R.choice(WORDS)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block, many", [(1024, 256), (16, 2)])
def test_families_by_brute_force(spark, monkeypatch, block, many):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "MANY", many)
    licence = [R.choice(WORDS) for _ in range(40)]
    texts = family([R.choice(WORDS) for _ in range(100)], 60, 6) + family([R.choice(WORDS) for _ in range(60)], 40, 3)
    texts += [" ".join([R.choice(WORDS) for _ in range(R.randrange(20, 60))] + licence) for _ in range(50)] + ["", None, "one two"]
    rows = list(enumerate(texts))
    R.shuffle(rows)
    # An id with two texts, one without an id, one row twice.
    rows += [(3, texts[-10]), (None, texts[0]), (None, None), rows[0], rows[1]]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    named = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert named == expected(rows) and len(got) == len(named) + 2
    assert sorted((r.n_shingles, r.component_id) for r in got if r.doc_id is None) == [(0, None), (len(shingles(texts[0])), None)]
