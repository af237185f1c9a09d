"""Exact dedup and the Merkle manifest against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidemark.llm.merkle")
from tidemark.llm import exact_dedup, merkle  # noqa: E402

R = random.Random(4)
ROWS = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain(text):
    return "".join(c for c in text or "" if c not in " \t\n\v\f\r")


def docs_of(n, hot):
    """Groups of copies that differ in their spaces, one of them with a third of the rows; null and repeated ids."""
    rows = []
    for k in range(n):
        words = [f"w{k // 3}é", "x", " y"] if k % 3 else [f"{hot}"]
        rows.append((R.choice([k, k, k - 1, None]), R.choice([" ", "\n", "\t\t", " \v"]).join(words), "en", "s", k))
    return [*rows, (5, None, None, None, None), (4, "", "", "", 0), (4, " \n", "", "", 0), rows[7], rows[7]]


def test_exact_dedup_by_brute_force(spark):
    rows = docs_of(300, "hot")
    got = exact_dedup.decide(spark.createDataFrame(rows, ROWS).withColumn("maybe", F.lit(1)).repartition(5)).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(H(plain(t)), []).append((-len(t or ""), i is None, i or 0, i))
    assert sorted((str(r.doc_id), r.text_sha256, r.group_size, str(r.keep_id)) for r in got) == sorted((str(i), h, len(g), str(min(g)[3])) for h, g in groups.items() for *_, i in g)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
    one = exact_dedup.dedup(spark.createDataFrame(rows, ROWS).withColumns({"row": F.lit(1), "digest": F.lit(2)})).collect()
    assert sorted((H(plain(r.text)), -len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in one) == sorted((h, *min(g)[:3]) for h, g in groups.items())
    assert {r.row for r in one} == {1} and len(one[0]) == 7


def test_only_possible_repeats_are_grouped(spark):
    """Few of the rows that occur once are taken for repeated ones, and none of the others is missed."""
    rows = spark.range(40_000).select(F.unhex(F.sha2(F.greatest(F.col("id"), F.lit(2_000)).cast("string"), 256)).alias("digest"), "id")
    got = exact_dedup.with_maybe(rows, rows, 40_000)
    assert got.filter("id <= 2000 AND NOT maybe").isEmpty()
    assert got.filter("id > 2000 AND maybe").count() < 0.03 * 38_000


def test_blocks_beyond_the_bound_are_joined(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FILTER_BYTES", 0)
    rows = docs_of(60, "h")
    got = exact_dedup.decide(spark.createDataFrame(rows, ROWS)).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len({plain(t) for _, t, *_ in rows})


def test_no_documents(spark):
    none = spark.createDataFrame([], ROWS)
    assert exact_dedup.decide(none).collect() == [] and exact_dedup.dedup(none).collect() == [] and merkle.manifest(none, F.col("text")).collect() == []


def tree(digests):
    """(root, siblings of each leaf, level by level, folds of each leaf) of a list."""
    groups, paths = [[k] for k in range(len(digests))], [[] for _ in digests]
    while len(digests) > 1:
        runs = [list(range(k, min(k + 3, len(digests)))) for k in range(0, len(digests), 3)]
        for run in runs:
            for node in run:
                for leaf in groups[node]:
                    paths[leaf].append([digests[x] for x in run if x < node] + [None] + [digests[x] for x in run if x > node])
        digests, groups = [H("".join(digests[x] for x in run)) for run in runs], [[leaf for x in run for leaf in groups[x]] for run in runs]
    return digests[0], paths


def folded(leaf, path):
    for level in path:
        leaf = H("".join(leaf if x is None else x for x in level))
    return leaf


def want(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    trees = {s: tree([leaf(r, r[1]) for r in by[s]]) for s in names}
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for r, path in zip(by[s], trees[s][1]):
            cut = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            path = path + top
            fold = folded(leaf(r, r[1].replace("\n", "") if cut else r[1]), path)
            out.append((r[0], leaf(r, r[1]), trees[s][0], root, H("".join(x for level in path for x in level if x)), fold, fold == root))
    return out


def found():
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_by_brute_force(spark, height):
    """Several rounds of subtrees, runs of one, lone leaves, a source with most rows, repeated rows, null and repeated ids."""
    rows = [(k, R.choice(["a\nb", "x", None, "", "é\n\n" * 40]), R.choice(["en", None]), "hot" if k % 3 else f"s{k % 7}", R.choice([k, None])) for k in range(190)]
    rows += [rows[3]] * 4 + [(None, "n\nn", "en", None, 1), (None, None, None, None, None), (9, "again", "de", "hot", 1), (1, "one", "", "", 0), (2, "tw\no", "en", "é", 3)]
    got = merkle.manifest(spark.createDataFrame(rows, ROWS).withColumns({"g": F.lit(1), "idx": F.lit(2)}).repartition(5), found(), height).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want(rows)))
    assert any(r.verified for r in got) and not all(r.verified for r in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_manifest_of_few_rows(spark, n):
    rows = [(k, "t\nt", "en", "only", 3) for k in range(n)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, merkle.manifest(spark.createDataFrame(rows, ROWS), found()).collect())) == sorted(map(key, want(rows)))


def test_a_sha_block_is_right():
    import numpy as np

    d = np.array([[int(H(str(k))[8 * j : 8 * j + 8], 16) for j in range(8)] for k in range(3)], np.uint32)
    state = np.tile(merkle.START, (1, 1))
    for k in range(3):
        assert merkle._hexes(merkle.finish(state, np.array([k])))[0].as_py() == H("".join(H(str(j)) for j in range(k)))
        state = merkle.absorb(state, d[k : k + 1])
