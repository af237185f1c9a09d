"""Every byte of a word counts, however long the word is."""

import random

import numpy as np

from tidemark.llm import scan, toxicity

SIGNS = [chr(0x4E00 + k) for k in range(400)]


def test_signs_far_behind_in_unbroken_texts_decide(spark):
    r = random.Random(3)
    plain = ["".join(r.choice(SIGNS) for _ in range(80)) for _ in range(240)]
    y = [k % 3 == 0 for k in range(240)]
    assert min(len(t.encode()) for t in plain) > 3 * 64
    model = toxicity.train([t + "龘龙龚" * 8 if v else t for t, v in zip(plain, y)], np.array(y))
    fresh = "".join(r.choice(SIGNS) for _ in range(80))
    docs = spark.createDataFrame([(0, fresh), (1, fresh + "龘龙龚" * 8), (2, "x" * 64 + " y"), (3, "x" * 65 + " y")], "doc_id long, text string")
    s = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert s[1] > 0.5 > s[0] and s[2] != s[3]


def test_features_are_those_of_the_whole_word(monkeypatch):
    r = random.Random(4)
    raw = [bytes(r.randrange(97, 123) for _ in range(n)) for n in (1, 2, 5, 64, 65, 66, 200, 7, 1000, 3)]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    parts = np.random.default_rng(1).normal(size=toxicity.BUCKETS).astype(np.float32)

    def number(b):
        return int(scan.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0] % np.uint64(toxicity.BUCKETS))

    want = []
    for w in (b"<" + x + b">" for x in raw):
        want.append([number(w), *(number(w[k : k + g]) for g in toxicity.GRAMS for k in range(len(w) - g + 1))])
    ids, who = toxicity.subwords(data, off[:-1], off[1:])
    assert [sorted(ids[who == k].tolist()) for k in range(len(raw))] == [sorted(x) for x in want]
    for part in (1 << 19, 150, 66, 8):
        monkeypatch.setattr(toxicity, "PART_BYTES", part)
        assert np.allclose(toxicity.word_means(parts, data, off[:-1], off[1:]), [np.mean(parts[x], dtype=float) for x in want])
