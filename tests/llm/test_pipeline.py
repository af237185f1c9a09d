"""Each stage on a fixture with nulls, repeated rows and no rows, and the whole run."""

import os
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

R = random.Random(21)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randrange(2, 7))) for _ in range(150)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    good = [prose(60) for _ in range(60)]
    out = [(k, t, "en", "abc"[k % 3], len(t)) for k, t in enumerate(good)]
    out += [(100 + k, prose(60).upper().replace(" ", "!! "), "en", "a", 9) for k in range(30)]
    out += [(200, good[0] + " more", "en", "a", 1), (201, None, None, None, None), (None, good[1], "en", "b", 2), (None, prose(20), None, None, None), out[5], out[5]]
    return out


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, int(k < 100), 0) for k in [*range(60), *range(100, 130)]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def stage(name, spark, docs, sf_dir):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir)


def test_quality_keeps_clean_documents(spark, rows, sf_dir):
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = stage("quality", spark, docs, sf_dir)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(60)) <= set(ids) and not any(i is not None and 100 <= i < 130 for i in ids) and ids.count(None) == 2 and ids.count(5) == 3


def test_lines_that_an_earlier_document_has_go(spark, sf_dir):
    a, b, c = prose(12), prose(12), prose(12)
    docs = spark.createDataFrame([(1, f"{a}\n{b}", "en", "x", 1), (2, f"{b}\n{c}", "en", "x", 1), (3, a, "en", "x", 1), (None, a, "en", "x", 1)], SCHEMA)
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in stage("line_dedup", spark, docs, sf_dir).collect())
    assert got == [("1", f"{a}\n{b}", len(a) + len(b) + 1), ("2", c, len(c)), ("None", a, len(a))]


def test_one_of_each_group_stays(spark, rows, sf_dir):
    got = stage("ngram_jaccard", spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    want = {*range(60), *range(100, 130), 201}
    ids = [r.doc_id for r in got]
    assert {i for i in ids if i is not None} == want and len(ids) == len(want) + 2


def test_mix_takes_what_the_operator_says(spark, rows, sf_dir):
    from tidemark.llm import mixing

    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.text): r["count"] for r in stage("mixing", spark, docs, sf_dir).groupBy("doc_id", "text").count().collect()}
    want = {}
    for r in mixing.mix(docs.withColumn("h", F.xxhash64("text")), carry=("h",)).collect():
        want[r.doc_id, r.h] = want.get((r.doc_id, r.h), 0) + r.copies
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    assert {(i, hashes[t]): n for (i, t), n in got.items()} == {k: n for k, n in want.items() if n}
    assert got[5, rows[5][1]] <= 6


def test_packing_packs_every_row(spark, rows, sf_dir):
    got = stage("packing", spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    assert len(got) == len(rows) and len({(r.sequence_id, r.offset) for r in got}) == len(rows)


def test_no_rows(spark, sf_dir):
    none = spark.createDataFrame([], SCHEMA)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, sf_dir).count() == 0, name


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert got and {r.doc_id for r in got} <= {*range(60), 200, 201, None}
    assert max(r.offset + r.length for r in got) <= 1024
    assert not os.path.exists(f"{sf_dir}/out")
