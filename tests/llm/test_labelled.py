"""The bounded sample that classifiers learn from."""

import pytest

pytest.importorskip("tidemark.llm.labelled")
from tidemark.llm import labelled, quality  # noqa: E402


def test_a_text_that_does_not_fit_is_passed_over(spark):
    rows = [(k, f"text {k} " + "word " * 20) for k in range(60)] + [(3, "text 3 " + "word " * 20), (4, "another text of 4"), (5, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(6, None), (None, 1), (7, 1)], "doc_id long, quality int")
    all_ = labelled.sample(docs, labels, "quality", 1000, 1 << 20)
    assert len(all_) == len(set(all_["_id"])) + 1 and set(all_[all_["_id"] == 4]["text"]) == {"another text of 4", rows[4][1]}
    for k in sorted(set(all_["_id"]))[:12]:
        long = docs.filter(f"doc_id IS DISTINCT FROM {k}").unionByName(spark.createDataFrame([(k, "very long " * 200_000)], docs.schema))
        got = labelled.sample(long, labels, "quality", 1000, 1 << 20)
        assert set(got["_id"]) == set(all_["_id"]) - {k}
    few = labelled.sample(docs, labels, "quality", 1000, 400)
    assert 0 < len(few) < len(all_) and sum(map(len, few["text"])) <= 400
    assert len(labelled.sample(docs, labels, "quality", 7, 1 << 20)) <= 8


def test_no_rows_to_learn_from(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int")
    assert len(labelled.sample(docs, labels, "quality", 10, 10)) == 0
    assert quality.score(spark.createDataFrame([(1, "x")], docs.schema), quality.fit(docs, labels)).count() == 1
