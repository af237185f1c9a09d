"""SQL twins of exact dedup, spelling variants and the Merkle manifest."""

from __future__ import annotations

from tidemark.llm import exact_dedup

_TURNS = ", ".join(["-1"] * 8)


def _crc32(steps: str) -> str:
    """crc32 of a list of steps: a byte is taken in, -1 shifts the register by a bit."""
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _steps(text: str) -> str:
    """Steps for the UTF-8 bytes of a text of Latin-1 letters and ASCII."""
    return f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT), {_TURNS}] ELSE [195, {_TURNS}, CAST(unicode(ch) - 64 AS BIGINT), {_TURNS}] END))"


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {_field(text)})"


def _tree(name: str, start: str) -> str:
    """Nodes of all levels, and the way of each node of the lowest: (g, k, i, lvl, fold, proof)."""
    return f"""
{name}_node AS (SELECT g, 0 AS lvl, idx, n, digest FROM {start} UNION ALL
  SELECT g, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name}_node WHERE n > 1 GROUP BY g, lvl, idx // 3, n),
{name}_way AS (SELECT g, idx AS k, idx AS i, 0 AS lvl, changed AS fold, proof FROM {start} UNION ALL
  SELECT w.g, k, i // 3, w.lvl + 1, sha256(string_agg(CASE WHEN idx = i THEN fold ELSE digest END, '' ORDER BY idx)), any_value(proof) || coalesce(string_agg(digest, '' ORDER BY idx) FILTER (idx <> i), '')
  FROM {name}_way w JOIN {name}_node m ON m.g = w.g AND m.lvl = w.lvl AND m.idx // 3 = w.i // 3 WHERE m.n > 1 GROUP BY w.g, k, i, w.lvl),
{name}_top AS (SELECT g, digest FROM {name}_node WHERE n = 1)"""


# The sources' tree is climbed once for each source with its own top; a leaf's fold then goes on from what it has become.
MERKLE = f"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || source, '') AS g, {_leaf("text")} AS digest,
  CASE WHEN {_crc32(_steps("coalesce(CAST(doc_id AS VARCHAR), '1')"))} % 2 = 0 AND doc_id IS NOT NULL THEN replace(text, chr(10), '') ELSE text END AS now FROM documents),
l AS (SELECT g, doc_id, digest, {_leaf("now")} AS changed, '' AS proof, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree("a", "l")},
s AS (SELECT '' AS g, g AS name, digest, digest AS changed, '' AS proof, row_number() OVER (ORDER BY encode(g)) - 1 AS idx, count(*) OVER () AS n FROM a_top),
{_tree("b", "s")},
top AS (SELECT digest AS root FROM b_top),
low AS (SELECT w.g, w.k, w.fold, w.proof FROM a_way w JOIN (SELECT g, max(lvl) AS lvl FROM a_node GROUP BY g) m ON m.g = w.g AND m.lvl = w.lvl),
up AS (SELECT low.g, low.k, s.idx AS i, 0 AS lvl, low.fold, low.proof FROM low JOIN s ON s.name = low.g UNION ALL
  SELECT up.g, k, i // 3, up.lvl + 1, sha256(string_agg(CASE WHEN m.idx = i THEN fold ELSE m.digest END, '' ORDER BY m.idx)), any_value(proof) || coalesce(string_agg(m.digest, '' ORDER BY m.idx) FILTER (m.idx <> i), '')
  FROM up JOIN b_node m ON m.lvl = up.lvl AND m.idx // 3 = up.i // 3 WHERE m.n > 1 GROUP BY up.g, k, i, up.lvl),
done AS (SELECT * FROM up WHERE lvl = (SELECT max(lvl) FROM b_node))
SELECT l.doc_id, l.digest AS leaf, a_top.digest AS subroot, root, sha256(done.proof) AS proof_sha256, done.fold AS folded_root, done.fold = root AS verified
FROM l JOIN a_top ON a_top.g = l.g JOIN done ON done.g = l.g AND done.k = l.idx CROSS JOIN top
"""

SPELLING = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n, length(run) AS size FROM runs GROUP BY doc_id, run HAVING length(run) >= 7),
h AS (SELECT *, {_crc32(_steps("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM c),
v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % size AS INT)) || substr(run, CAST(h % size AS INT) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w),
e AS (SELECT word, k, substr(word, 1, CAST(k AS INT) - 1) || substr(word, CAST(k AS INT) + 1) AS less FROM x),
near AS (SELECT a.word, b.word AS other FROM e a JOIN e b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
  UNION SELECT e.word, w.word FROM e JOIN w ON e.less = w.word UNION SELECT w.word, e.word FROM e JOIN w ON e.less = w.word),
m AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY w.n DESC, encode(other)) AS other, max(w.n) AS other_n FROM near JOIN w ON w.word = near.other GROUP BY near.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM w LEFT JOIN m ON m.word = w.word),
r AS (SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM f UNION ALL SELECT r.word, coalesce(f.form, f.word), f.form IS NULL FROM r JOIN f ON f.word = r.root WHERE NOT ended)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word WHERE ended
"""

TWINS = {"op11_exact_dedup": exact_dedup.ORACLE, "op12_spelling_variants": SPELLING, "op13_merkle_manifest": MERKLE}
