"""Rows without doc_id keep their texts and take no lines from others."""

from tidemark.llm import line_dedup

A = "these seven words stand in one line"
B = "a line of ten words or more that only one has"


def test_rows_without_id_keep_their_text(spark):
    rows = [(None, f"{A}\n{B}\nshort", "x"), (None, B, "y"), (None, None, "z"), (1, f"{A}\n{A}", "u"), (2, f"{A}\n{B}", "v")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    got = {r.source: (r.doc_id, r.text, r.n_lines, r.n_removed, r.emptied) for r in out}
    assert got == {"x": (None, f"{A}\n{B}\nshort", 3, 0, False), "y": (None, B, 1, 0, False), "z": (None, None, 1, 0, False), "u": (1, A, 2, 1, False), "v": (2, B, 2, 1, False)}
    assert len(out) == len(rows)


def test_stage_keeps_rows_without_id(spark):
    import corpus_pipeline

    rows = [(None, B, "en", "s", 1), (1, B, "en", "s", 1), (2, B, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in got) == [(0, B, len(B)), (1, B, len(B))]
