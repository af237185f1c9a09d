"""Near lines against comparing every pair of lines."""

import random

from tidemark.llm import line_dedup


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def test_one_edit_at_every_place(spark):
    r = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    lines = []
    for n in (11, 12, 13, 16):
        for kind in ("replace", "add", "remove"):
            for k in range(n + (kind == "add")):
                a = [r.choice(vocabulary) for _ in range(n)]
                b = a[:k] + ([] if kind == "remove" else ["new"]) + a[k + (kind != "add") :]
                lines += [a, b]
        lines += [[*a[:2], "x", *a[3:5], "y", *a[6:]], [r.choice(vocabulary) for _ in range(n)]]
    r.shuffle(lines)
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text string")
    got = {x.doc_id for x in line_dedup.dedup_lines(docs).filter("emptied").collect()}
    assert got == {k for k in range(len(lines)) if any(one_edit(lines[k], lines[j]) for j in range(k))}
    assert len(got) >= 150
