"""Queries on uses, papers, boards, galaxies and report summaries, added to the registry's."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import boards, galaxy, graph, ranks, search, series, summary, uses
from tidemark.plans.views import view
from tidemark.registry import _board_sql as _ranked_board
from tidemark.registry import _BOARDS, _mt, _ORDER, _RANKED, _WORDS, _GAPPY, _RUNS, GAPPY, LAST, _as_of_sql, _wins, entry


def _table(v, name):
    view(v.spark, v.sf_dir, "fx_parts")
    return v.spark.table(name)


@entry("jn12_window_tags", f"WITH {_RUNS}, b AS (SELECT start, fin, pipeline_tag, CAST(sum(dl) AS BIGINT) AS total FROM fx_hub JOIN wins ON day BETWEEN start AND fin GROUP BY ALL) SELECT CAST(unnest(generate_series(start, fin, INTERVAL 1 DAY)) AS DATE) AS day, pipeline_tag, total FROM b")
def _(v):
    return summary.window_tags(v.hub, _wins(v))


_REFS = "r AS (SELECT DISTINCT l_orderkey AS src, 'dataset' AS dst_kind, l_partkey AS dst FROM lineitem), i AS (SELECT o_orderkey AS src, o_orderdate AS created, round(o_totalprice) AS weight FROM orders)"


@entry("gr7_references", f"WITH {_REFS} SELECT 'model' AS src_kind, r.src, dst_kind, dst, CAST(created AS DATE) AS created, CAST(weight AS BIGINT) AS weight FROM r JOIN i ON i.src = r.src WHERE r.src % 3 <> 0 AND i.src % 2 = 0 UNION ALL SELECT 'space', r.src, dst_kind, dst, CAST(created AS DATE), CAST(weight AS BIGINT) FROM r LEFT JOIN (SELECT * FROM i WHERE src % 2 = 0) i ON i.src = r.src WHERE r.src % 3 = 0")
def _(v):
    refs = _table(v, "lineitem").select(F.col("l_orderkey").alias("src"), F.lit("dataset").alias("dst_kind"), F.col("l_partkey").alias("dst")).distinct()
    info = v.spark.table("orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("src"), F.col("o_orderdate").alias("created"), F.round("o_totalprice").alias("weight"))
    return uses.uses(refs.filter("src % 3 <> 0"), info, refs.filter("src % 3 = 0"), info)


_PAPERS = "pr AS (SELECT id, lpad(CAST(id % 40 AS VARCHAR), 4, '0') || '.' || lpad(CAST(dl30 % 10 AS VARCHAR), 5, '0') AS paper FROM fx_parts WHERE id % 3 <> 0)"


def _papers(v):
    number = lambda width: F.concat(F.lpad((F.col("id") % 40).cast("string"), 4, "0"), F.lit("."), F.lpad((F.col("dl30") % 10).cast("string"), width, "0"))
    tagged = v.parts.select("id", F.array(F.col("tag"), F.concat(F.lit("arxiv:"), F.when(F.col("id") % 3 != 0, number(5)).otherwise(number(3))), F.concat(F.lit("arxiv: "), F.when(F.col("id") % 3 != 0, number(5)))).alias("tags"))
    return uses.paper_refs(tagged)


@entry("gr8_paper_refs", f"WITH {_PAPERS} SELECT DISTINCT id, paper FROM pr")
def _(v):
    return _papers(v)


@entry("ag19_paper_models", f"WITH {_PAPERS}, m AS (SELECT paper, p.id, dl30, row_number() OVER (PARTITION BY paper ORDER BY dl30 DESC, p.id) AS k FROM pr JOIN fx_parts p ON p.id = pr.id) SELECT paper, count(*) AS models, CAST(sum(dl30) AS BIGINT) AS dl30, string_agg(id || ':' || dl30, ' ' ORDER BY k) FILTER (k <= 5) AS top FROM m GROUP BY paper")
def _(v):
    got = uses.paper_models(_papers(v), v.parts.withColumn("dl_all", F.col("dl30") * 2))
    return got.select("paper", "models", "dl30", F.array_join(F.transform("top", lambda t: F.concat(t["id"].cast("string"), F.lit(":"), t["dl30"].cast("string"))), " ").alias("top"))


_MODELS = "mo AS (SELECT o_orderkey AS id, 'Brand#' || (o_custkey % 5 + 1) || (o_orderkey % 5 + 1) AS author, CAST(round(o_totalprice) AS BIGINT) AS dl30 FROM orders)"


@entry("ag26_used_by", f"WITH {_MODELS}, u AS (SELECT src_kind, src, dst, p.author AS ofx, m.author, m.dl30 FROM fx_uses JOIN fx_parts p ON p.id = dst JOIN mo m ON m.id = src WHERE m.author <> p.author), o AS (SELECT ofx, src, min(dst) AS dataset, any_value(dl30) AS dl30 FROM u WHERE src_kind = 'model' GROUP BY ALL), a AS (SELECT ofx, count(*) AS models, sum(dl30) AS dl30, arg_min(src, (-dl30, src)) AS top_id, arg_min(dataset, (-dl30, src)) AS top_dataset FROM o GROUP BY ofx), s AS (SELECT ofx, count(DISTINCT src) AS spaces FROM u WHERE src_kind = 'space' GROUP BY ofx) SELECT coalesce(a.ofx, s.ofx) AS author, coalesce(models, 0) AS models, CAST(coalesce(dl30, 0) AS BIGINT) AS dl30, coalesce(spaces, 0) AS spaces, top_id, top_dataset FROM a FULL JOIN s ON s.ofx = a.ofx")
def _(v):
    owners = F.concat(F.lit("Brand#"), (F.col("o_custkey") % 5 + 1).cast("string"), (F.col("o_orderkey") % 5 + 1).cast("string"))
    models = _table(v, "orders").select(F.col("o_orderkey").alias("id"), owners.alias("author"), F.round("o_totalprice").cast("long").alias("dl30"))
    return uses.used_by(v.uses, v.parts.select("id", "author"), models, models, v.tasks("uses"))


@entry("ag28_author_repos", "WITH d AS (SELECT author, count(*) AS datasets, CAST(sum(dl30) AS BIGINT) AS datasets_dl30 FROM fx_parts WHERE author < 'Brand#4' GROUP BY author), s AS (SELECT author, count(*) AS spaces, CAST(sum(id % 7) AS BIGINT) AS spaces_likes FROM fx_parts WHERE author > 'Brand#2' GROUP BY author) SELECT coalesce(d.author, s.author) AS author, coalesce(datasets, 0) AS datasets, coalesce(datasets_dl30, 0) AS datasets_dl30, coalesce(spaces, 0) AS spaces, coalesce(spaces_likes, 0) AS spaces_likes FROM d FULL JOIN s ON s.author = d.author")
def _(v):
    return uses.author_repos(v.parts.filter("author < 'Brand#4'"), v.parts.filter("author > 'Brand#2'").withColumn("likes", F.col("id") % 7))


_TREE = """WITH RECURSIVE e AS (SELECT DISTINCT id, parent FROM fx_edges WHERE id <> parent AND parent > 0),
 g AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS depth UNION SELECT e.id, depth + 1 FROM g JOIN e ON e.parent = g.id WHERE depth < 8),
 m AS (SELECT id, min(depth) AS depth FROM g GROUP BY id),
 t AS (SELECT m.id, m.depth, arg_min(e.parent, (-coalesce(q.dl30, 0), e.parent)) AS parent FROM m JOIN e ON e.id = m.id JOIN m mp ON mp.id = e.parent AND mp.depth = m.depth - 1 LEFT JOIN fx_parts q ON q.id = e.parent GROUP BY m.id, m.depth)"""


def _tree(v):
    return graph.galaxy(v.edges_distinct, v.parts, v.spark.range(1, 2).select(F.col("id").alias("root")))


@entry("gr6_focus", f"{_TREE}, dn AS (SELECT id FROM t WHERE parent = 5 UNION SELECT t.id FROM t JOIN dn ON t.parent = dn.id), up AS (SELECT parent AS id FROM t WHERE id = 5 UNION SELECT t.parent FROM t JOIN up ON t.id = up.id) SELECT CAST(1 AS BIGINT) AS root, CAST(5 AS BIGINT) AS pick, id, 'below' AS role FROM dn UNION ALL SELECT 1, 5, id, 'above' FROM up WHERE id <> 1")
def _(v):
    return galaxy.focus(_tree(v), v.spark.range(1, 2).select(F.col("id").alias("root"), F.lit(5).cast("long").alias("pick")))


@entry("ag29_builders", f"{_TREE}, b AS (SELECT author, count(*) AS n, CAST(sum(dl30) AS BIGINT) AS dl30 FROM t JOIN fx_parts p ON p.id = t.id WHERE author <> (SELECT author FROM fx_parts WHERE id = 1) GROUP BY author), r AS (SELECT *, CAST(row_number() OVER (ORDER BY dl30 DESC, author) AS INTEGER) AS rank FROM b) SELECT CAST(1 AS BIGINT) AS root, author, n, dl30, rank FROM r WHERE rank <= 6")
def _(v):
    return galaxy.builders(_tree(v), v.parts)


@entry("se4_found_in_galaxy", f"{_TREE}, r AS (SELECT p.id, CAST(row_number() OVER (ORDER BY dl30 DESC, p.id) AS INTEGER) AS rank FROM t JOIN fx_parts p ON p.id = t.id WHERE contains(lower(author || '/' || p.id), 'brand#1')) SELECT CAST(1 AS BIGINT) AS root, id, rank FROM r WHERE rank <= 8")
def _(v):
    return galaxy.found(_tree(v), v.parts.withColumn("name", F.concat_ws("/", "author", F.col("id").cast("string"))), " Brand#1 ")


_SPACES = f"{_GAPPY}, a AS ({_as_of_sql(7)}), b AS ({_as_of_sql(30)}), sp AS (SELECT g.id, g.likes, greatest(likes - likes_7, 0) AS likes_7d, greatest(likes - likes_30, 0) AS likes_30d, CAST(split_part(g.id, 'repo', 2) AS BIGINT) AS k FROM g LEFT JOIN a ON a.id = g.id LEFT JOIN b ON b.id = g.id WHERE g.day = {LAST}), sq AS (SELECT *, likes % 97 AS trending, CASE WHEN likes_30d - likes_7d >= 10 THEN likes_7d / ((likes_30d - likes_7d) * 7 / 23.0) - 1 END AS growth_7d FROM sp)"


def _board_sql(parts, n=20):
    one = "SELECT '{0}' AS board, CAST(row_number() OVER (ORDER BY {1} DESC, id) AS INTEGER) AS rank, id, round(CAST({1} AS DOUBLE), 6) AS value FROM sq WHERE {1} IS NOT NULL AND {2}"
    return "SELECT * FROM (" + " UNION ALL ".join(one.format(*p) for p in parts) + f") WHERE rank <= {n}"


_SPACE_PARTS = [("likes_7d", "likes_7d", "true"), ("likes_30d", "likes_30d", "true"), ("trending", "trending", "true"), ("breakouts", "likes_7d", "k % 60 <= 30"), ("most_liked", "likes", "true")]


def _spaces(v):
    k = F.expr("CAST(split_part(id, 'repo', 2) AS BIGINT)")
    s = series.space_metrics(v.gappy, v.last_day).withColumn("trending", F.col("likes") % 97).withColumn("sdk", F.when(k % 2 == 0, "gradio").otherwise("static"))
    return s.withColumn("created_at", F.date_sub(v.last(), (k % 60).cast("int")))


_DATASETS = " UNION ALL ".join([*_BOARDS[:5], _ranked_board("used_by_models", "used_by_models", "(SELECT id, likes % 50 AS used_by_models FROM mm)")])


@entry("tk3_dataset_boards", f"WITH {_mt()} {_DATASETS}")
def _(v):
    m = series.metrics(v.ragged, last=v.last_day).withColumn("created_at", F.col("first_seen")).withColumn("used_by_models", F.col("likes") % 50)
    return boards.dataset_boards(m, F.date_sub(v.last(), 30), 20)


@entry("tk4_space_boards", f"WITH {_SPACES} {_board_sql(_SPACE_PARTS)}")
def _(v):
    return boards.space_boards(_spaces(v), F.date_sub(v.last(), 30), 20)


@entry("tk5_live_space_boards", f"WITH {_SPACES} {_board_sql([(b, by, w + ' AND k % 2 = 0') for b, by, w in [*_SPACE_PARTS, ('rising', 'growth_7d', 'likes_7d >= 20')]])}")
def _(v):
    return boards.live_space_boards(_spaces(v), F.date_sub(v.last(), 30), "gradio", 20)


@entry("tk12_changed", f"WITH {_SPACES}, bd AS ({_board_sql(_SPACE_PARTS)}) SELECT DISTINCT 'space' AS kind, id FROM bd UNION SELECT 'model', id FROM (SELECT CAST(id AS VARCHAR) AS id FROM fx_parts ORDER BY dl30 DESC, fx_parts.id LIMIT 20)")
def _(v):
    return boards.changed({"space": boards.space_boards(_spaces(v), F.date_sub(v.last(), 30), 20), "model": ranks.board(v.parts, "dl30", "dl30", 20)})


_HUB_TAGS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
_HUB_COLS = ", ".join(f"avg(coalesce(t{k}, 0)) OVER w AS s{k}" for k in range(3))
_HUB_SUMS = ", ".join("sum(dl) FILTER (pipeline_tag = '" + t + f"') AS t{k}" for k, t in enumerate(_HUB_TAGS))
_HUB_OUT = ", ".join("round(" + " + ".join(f"s{j}" for j in range(k + 1)) + f', 6) AS "{t}"' for k, t in enumerate(_HUB_TAGS))


@entry("mt13_stacked", f"WITH d AS (SELECT day, {_HUB_SUMS} FROM fx_hub GROUP BY day), s AS (SELECT day, {_HUB_COLS} FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT day, {_HUB_OUT} FROM s")
def _(v):
    return summary.stacked(v.hub, _HUB_TAGS)


@entry("dq17_rebuilt", f"WITH {_GAPPY}, n AS (SELECT * FROM fx_hub WHERE dayofyear(day) % 17 NOT IN (3, 4)) SELECT (SELECT CAST(sum(dl) AS BIGINT) FROM fx_hub) AS total_before, (SELECT count(DISTINCT day) FROM fx_hub) AS days_before, (SELECT CAST(sum(dl) AS BIGINT) FROM n) AS total_after, (SELECT count(DISTINCT day) FROM n) AS days_after, (SELECT count(DISTINCT day) FROM fx_hub WHERE day NOT IN (SELECT day FROM fx_hub WHERE dl < 3) AND day IN (SELECT day FROM fx_hub WHERE dl > 5)) AS added, (SELECT count(DISTINCT day) FROM fx_hub WHERE dl < 3 AND day NOT IN (SELECT day FROM fx_hub WHERE dl > 5)) AS dropped")
def _(v):
    return summary.rebuilt(v.hub, v.hub.filter(F.expr(GAPPY)), v.hub.filter("dl < 3"), v.hub.filter("dl > 5"))


_KINDS = "ix AS (SELECT 'model' AS kind, p_brand || '/' || p_name AS id, CAST(round(p_retailprice) AS BIGINT) AS pop, NULL AS title FROM part UNION ALL SELECT 'space', 'brand/' || s_name, CAST(s_suppkey AS BIGINT), NULL FROM supplier)"


@entry("se3_search_all", f"WITH {_KINDS}, qs AS (SELECT s_suppkey AS qid, CASE s_suppkey % 40 WHEN 0 THEN 'Brand' ELSE s_name END AS q FROM supplier WHERE s_suppkey % 20 = 0), {_WORDS}, {_RANKED.replace('SELECT qid, q, ws, id', 'SELECT kind, qid, q, ws, id').replace('PARTITION BY qid', 'PARTITION BY kind, qid')}, r AS (SELECT kind, qid, id, CAST(row_number() OVER (PARTITION BY kind, qid ORDER BY {_ORDER}) AS INTEGER) AS rank FROM k) SELECT kind, qid, rank, id FROM r WHERE rank <= 5")
def _(v):
    models = _table(v, "part").select(F.concat_ws("/", "p_brand", "p_name").alias("id"), F.round("p_retailprice").cast("long").alias("pop"))
    spaces = v.spark.table("supplier").select(F.concat(F.lit("brand/"), "s_name").alias("id"), F.col("s_suppkey").cast("long").alias("pop"))
    asks = v.spark.table("supplier").filter("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("qid"), F.when(F.col("s_suppkey") % 40 == 0, "Brand").otherwise(F.col("s_name")).alias("q"))
    return search.by_kind(asks, {"model": models, "space": spaces}, 5)


_REL = "p AS (SELECT dl30, CASE WHEN id % 5 <> 0 THEN base_relation END AS rel FROM fx_parts)"


@entry("rp5_derivative_share", f"WITH {_REL} SELECT rel AS relation, CAST(sum(dl30) AS BIGINT) AS dl30, round(sum(dl30) / (SELECT sum(dl30) FROM p), 6) AS share FROM p WHERE rel IS NOT NULL GROUP BY rel UNION ALL SELECT 'any', CAST(sum(dl30) AS BIGINT), round(sum(dl30) / (SELECT sum(dl30) FROM p), 6) FROM p WHERE rel IS NOT NULL")
def _(v):
    return summary.derivative_share(v.parts.withColumn("base_relation", F.when(F.col("id") % 5 != 0, F.col("base_relation"))))


_DAYS_TO = "f AS (SELECT id, min(day) AS fs, arg_min(dl_all, day) AS v0 FROM fx_series GROUP BY id), dt AS (SELECT s.id, CAST(min(day) - min(fs) AS INTEGER) AS days FROM fx_series s JOIN f ON f.id = s.id WHERE dl_all >= 1000 AND v0 < 1000 GROUP BY s.id)"


def _days_to(v):
    return summary.days_to(series.milestones(v.series), series.first_seen(v.series), 1000)


@entry("rp6_days_by_relation", f"WITH {_DAYS_TO} SELECT CASE length(id) % 2 WHEN 0 THEN 'merge' ELSE 'original' END AS relation, count(*) AS n, round(median(days), 6) AS median_days FROM dt GROUP BY 1")
def _(v):
    rel = v.series.select("id").distinct().withColumn("base_relation", F.when(F.length("id") % 2 == 0, "merge"))
    return summary.days_by_relation(_days_to(v), rel)


@entry("rp6_fastest", f"WITH {_DAYS_TO} SELECT id, days FROM dt ORDER BY days, id LIMIT 9")
def _(v):
    return summary.fastest(_days_to(v), 9)


@entry("rp15_like_concentration", "WITH l AS (SELECT id % 40 + CASE WHEN id % 50 = 0 THEN 2000 ELSE 0 END AS likes FROM fx_parts), r AS (SELECT likes, row_number() OVER (ORDER BY likes DESC) AS k, count(*) OVER () AS n FROM l WHERE likes > 0) SELECT count(*) AS liked, round(count(*) FILTER (likes = 1) / count(*), 6) AS exactly_one, round(sum(likes) FILTER (k <= ceil(n / 100)) / sum(likes), 6) AS top_percent, count(*) FILTER (likes > 1000) AS \"over\" FROM r")
def _(v):
    return summary.like_concentration(v.parts.select((F.col("id") % 40 + F.when(F.col("id") % 50 == 0, 2000).otherwise(0)).alias("likes")))


@entry("rp15_likes_by_month", "WITH s AS (SELECT day, greatest(likes - lag(likes) OVER (PARTITION BY id ORDER BY day), 0) AS g FROM fx_series) SELECT CAST(date_trunc('month', day) AS DATE) AS month, CAST(coalesce(sum(g), 0) AS BIGINT) AS likes FROM s GROUP BY 1")
def _(v):
    return summary.likes_by_month(v.series)
