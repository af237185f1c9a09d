"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.spelling")
from tidemark.llm import spelling  # noqa: E402

R = random.Random(11)
BASE = ["".join(R.choice("abcdeéßÿaeiou") for _ in range(R.randrange(7, 13))) for _ in range(60)] + ["".join(R.choice("abcdefgh") for _ in range(50)) for _ in range(4)]


def edited(w):
    k = R.randrange(len(w))
    return R.choice([w[:k] + w[k + 1 :], w[:k] + R.choice("abyÿ") + w[k:], w[:k] + R.choice("abyÿ") + w[k + 1 :]])


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def want(rows):
    n = Counter()
    for i, t in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    near = {w: sorted((-n[x], x) for x in n if one_edit(w, x)) for w in n}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 10 * n[w] else None for w in n}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, str(form[w]), root(w), n[w], len(near[w]), str(n.get(form[w]))) for w in n)


@pytest.mark.parametrize("node_words", [3, 40, 8192])
def test_variants_by_brute_force(spark, node_words):
    """Words of every edit, forms of forms, one word that fills a third of all texts, words of 50 letters; nulls and repeated ids."""
    variants = [edited(w) for w in BASE for _ in range(3)]
    pool = BASE * 12 + variants + [edited(w) for w in variants] + [BASE[0]] * 600
    rows = [(R.choice([k, k, 3, None]), R.choice([" ", "-", "×", "9"]).join(R.choice(pool) if R.random() > 0.1 else R.choice(pool).upper() for _ in range(30))) for k in range(120)]
    rows += [(900 + k, f"{BASE[1]} " * 40 + f"{BASE[1][:-1]}é " * 2) for k in range(20)] + [(7, None), (8, ""), (9, "ab " * 50)]
    rows += [(950 + k, "planthouses " * 45 + "planthousee " * 3 + "planthouzee " * (k < 2)) for k in range(20)]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1)}).repartition(5), node_words)
    result = sorted((r.word, str(r.form), r.root, r.n, r.n_near, str(r.form_n)) for r in got.collect())
    assert result == want(rows)
    assert any(r[1] != "None" for r in result) and any(r[1] not in ("None", r[2]) for r in result)


def test_large_leaves(spark, monkeypatch):
    """Words of the same letters: their halves are looked up."""
    monkeypatch.setattr(spelling, "MANY", 4)
    ws = sorted({"".join(R.sample("abcdabcd", 8)) + R.choice(["", "a", "d"]) for _ in range(900)})
    n = [R.randrange(2, 50) for _ in ws]
    got = {r["word"]: r for r in spelling.near_in_node(pa.table([ws, n, [True] * len(ws)], ["word", "n", "own"])).to_pylist()}
    for w in ws:
        near = sorted((-n[k], x) for k, x in enumerate(ws) if one_edit(w, x))
        assert (got[w]["n_near"], got[w]["near_word"]) == (len(near), near[0][1] if near else None)


def test_no_words(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(none).collect() == [] and spelling.variants(spark.createDataFrame([(1, "a b")], none.schema)).collect() == []
