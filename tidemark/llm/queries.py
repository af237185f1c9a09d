"""The training-data operators as queries over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from tidemark.llm import embedding_dedup, exact_dedup, fingerprints, line_dedup, merkle, mixing, new_sql, ngram_join, packing, quality, spelling, token_counts, token_files, toxicity
from tidemark.llm.shared import table


def ngram_jaccard(spark, sf_dir: str):
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_ngram_jaccard_join": ngram_jaccard,
        "op2_quality_classifier": quality.query,
        "op3_token_counts": token_counts.query,
        "op4_line_dedup": line_dedup.query,
        "op5_source_mixing": mixing.query,
        "op6_document_fingerprints": fingerprints.query,
        "op7_toxicity": toxicity.query,
        "op8_embedding_near_dedup": embedding_dedup.query,
        "op9_best_fit_packing": packing.query,
        "op10_token_id_files": token_files.query,
        "op11_exact_dedup": exact_dedup.query,
        "op12_spelling_variants": spelling.query,
        "op13_merkle_manifest": merkle.query,
        "pipeline": pipeline,
    }


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] ELSE list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i+4], ' ')) END)) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.component_id
FROM w JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op1_ngram_jaccard_join": OP1_SQL, "op8_embedding_near_dedup": embedding_dedup.ORACLE} | new_sql.TWINS
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
