import numpy as np

from tidemark.llm import toxicity


def test_parts_do_not_change_the_words(monkeypatch):
    texts = ["", "one two, one", "  ", "three two", "one " * 50, "!!"]
    whole = toxicity.vocabulary(texts)
    monkeypatch.setattr(toxicity, "PART_BYTES", 4)
    for a, b in zip(whole, toxicity.vocabulary(texts)):
        assert np.array_equal(a, b)
    assert np.bincount(whole[3], minlength=6).tolist() == [0, 3, 0, 2, 50, 0]


def test_wordless_texts_train():
    parts, bias = toxicity.train(["", " "], np.array([0, 1])).parts()
    assert np.isfinite(parts).all() and np.isfinite(bias)
