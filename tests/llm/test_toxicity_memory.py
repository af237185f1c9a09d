"""What training holds follows the bytes of its sample, not their n-grams, and changes nothing that is learned."""

import random
import tracemalloc

import numpy as np
import pytest

from tidemark.llm import scan, toxicity


def texts(n, words, seed=6):
    r = random.Random(seed)
    known = ["".join(r.choice("abcdeé龘") for _ in range(r.randrange(1, 9))) for _ in range(words)]
    return [" ".join(r.choice(known) + r.choice(["", ".", "x"]) for _ in range(r.randrange(0, 90))) + (" moronic" if k % 3 == 0 else "") for k in range(n)]


def peak(*args):
    tracemalloc.start()
    try:
        toxicity.train(*args)
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("kind", ["words", "unbroken"])
def test_memory_follows_the_bytes(monkeypatch, kind):
    monkeypatch.setattr(toxicity, "STEPS", 1)
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    scan.powers(toxicity.PART_BYTES + 8)
    if kind == "words":
        r = random.Random(2)
        some = [" ".join(f"{r.randrange(1 << 40):x}" for _ in range(60)) for _ in range(10_000)]
    else:
        some = ["龘龙龚" * 300_000, *texts(20, 50)]
    size = sum(len(t.encode()) for t in some)
    y = np.arange(len(some)) % 2
    # The model takes 25 MB with its moments, one part of words at most about 70 MB.
    assert peak(some, y) < 14 * size + (100 << 20)


def test_parts_and_kept_grams_change_nothing_that_is_learned(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 12)
    some = texts(150, 60) + ["龘龙" * 70 + " " + "q" * 300, "", "z" * 129 + "." + "z" * 129]
    y = np.array(["moronic" in t for t in some]).astype(int)
    whole = toxicity.train(some, y).parts()
    monkeypatch.setattr(toxicity, "HELD_GRAMS", 0)
    made = toxicity.train(some, y).parts()
    assert np.array_equal(whole[0], made[0]) and whole[1] == made[1]
    for held in (0, 1 << 24):
        monkeypatch.setattr(toxicity, "HELD_GRAMS", held)
        for part in (128, 1000):
            monkeypatch.setattr(toxicity, "PART_BYTES", part)
            got = toxicity.train(some, y).parts()
            assert np.allclose(got[0], whole[0], atol=1e-6) and abs(got[1] - whole[1]) < 1e-6


def test_words_are_those_of_the_whole_texts_wherever_parts_end(monkeypatch):
    some = ["", "one two-three", "x" * 40, "", "y" * 9 + " " + "x" * 40 + "é", "  ", "One", "y" * 9]
    for part in (1 << 19, 1, 7, 8, 9, 10, 40, 41):
        monkeypatch.setattr(toxicity, "PART_BYTES", part)
        data, spans, word, doc = toxicity.vocabulary(some)
        got = [(int(d), bytes(data[a:b]).decode()) for d, (a, b) in zip(doc, spans[word])]
        assert got == [(1, "one"), (1, "two"), (1, "three"), (2, "x" * 40), (4, "y" * 9), (4, "x" * 40 + "é"), (6, "one"), (7, "y" * 9)]
        assert len(spans) == 6 and len(data) == sum(len(w.encode()) for w in {w for _, w in got})
        raw = np.frombuffer(b"some bytes of a word", np.uint8)
        assert toxicity.whole_hash(raw) == scan.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
