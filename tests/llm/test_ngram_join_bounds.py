"""Few pairs of a large family of copies that do not link are left to compare: bitmaps tell most of them apart."""

import numpy as np
import pandas as pd
import pytest

pytest.importorskip("tokenizers")
from tidemark.llm import ngram_join  # noqa: E402


def test_pairs_below_the_bound_are_told_by_their_bitmaps():
    r = np.random.default_rng(3)
    base, sets = r.integers(0, 1 << 63, 100, dtype=np.uint64), []
    for k in range(150):
        s = base.copy()
        s[r.permutation(100)[: 3 if k < 10 else 12]] = r.integers(0, 1 << 63, 3 if k < 10 else 12, dtype=np.uint64)
        sets.append(np.unique(s))
    rows = pd.DataFrame({"gid": 1, "left": 0, "right": 0, "block": 0, "node": range(150), "first": [int(s[0]) >> 1 for s in sets], "n": [len(s) for s in sets], "comp": range(150), "low": [[1]] * 150, "bits": [ngram_join.bitmap(s) for s in sets]})
    got = {tuple(p) for p in ngram_join._candidates(rows, None)[["a", "b"]].to_numpy().tolist()}
    linked = set()
    for a in range(150):
        for b in range(a + 1, 150):
            both = len(np.intersect1d(sets[a], sets[b]))
            if ngram_join.OF * both >= ngram_join.NEED * (len(sets[a]) + len(sets[b]) - both):
                linked.add((a, b))
    assert linked and linked <= got
    assert len(got - linked) < 0.15 * 150 * 149 / 2, len(got - linked)
