"""Queries on kept state, published versions, trees by intervals and ranks by ranges, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import galaxy, graph, ranks, report, rings, rollups, series
from tidemark.plans.staging import cut
from tidemark.registry import _ALL, _FAM, _GAPPY, _REPOS, _YEAR, LAST, NUMBER, _families, _folder, _spark_sql, entry, r6
from tidemark.sources import snapshots
from tidemark.streaming.store import Store


def _same_sql(name):
    """The twin of another query, views and all."""

    def add(f):
        _ALL[name[0]] = (f, _ALL[name[1]][1])
        return f

    return add


@_same_sql(("st1_metrics_by_rings", "mt6_entity_metrics"))
def _(v):
    s = v.ragged
    days = sorted(r.day for r in s.select("day").distinct().collect())
    kept = cut(rings.rings_of(s.filter(F.col("day") <= F.lit(days[-4])), days[-4]))
    for day in days[-3:]:
        kept = cut(rings.merge(kept, rings.rings_of(s.filter(F.col("day") == F.lit(day)), day), day))
    m = rings.metrics(kept, days[-1])
    return m.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


@entry("snk6_published_series", f"SELECT id, day, CASE WHEN strftime(day, '%Y-%m') = strftime({LAST}, '%Y-%m') THEN dl30 + 1 ELSE dl30 END AS dl30 FROM fx_series WHERE strftime(day, '%Y-%m') <> '1997-03'")
def _(v):
    """Published in two versions, the second of which replaces the last month and drops another; a third is not committed."""
    store, rows = Store(v.spark, _folder(v, "store")), v.series.select("id", "day", "dl30", F.date_format("day", "yyyy-MM").alias("month"))
    first = store.begin()
    first.put("series", rows.repartition("month"), "month")
    first.commit()
    second, last = store.begin(), store.reader().keys("series")[-1]
    second.put("series", store.reader().read("series", [last]).withColumn("dl30", F.col("dl30") + 1), "month")
    second.drop("series", ["1997-03"])
    second.commit()
    store.begin().put("series", rows.filter(F.col("month") == last).withColumn("dl30", F.lit(-1).cast("long")), "month")
    return store.read("series").select("id", "day", "dl30")


@entry("snk4_entities", "SELECT id, author, tag, dl30, base_relation FROM fx_parts")
def _(v):
    path = _folder(v, "entities")
    snapshots.write_entities(v.parts, path)
    return v.spark.read.parquet(path)


@entry("snk5_json_rankings", "SELECT CAST(rank() OVER (ORDER BY dl30 DESC) AS BIGINT) AS rank, id, dl30 FROM fx_parts")
def _(v):
    path = _folder(v, "rankings")
    snapshots.write_json(ranks.global_rank(v.parts, "dl30", "rank").select("rank", "id", "dl30"), path)
    return v.spark.read.schema("rank long, id long, dl30 long").json(path)


#: Kept trees of every root that 20 divides.
_TREES = """WITH RECURSIVE e AS (SELECT DISTINCT id, parent FROM fx_edges WHERE id <> parent AND parent > 0),
 g AS (SELECT id AS root, id, 0 AS depth FROM fx_parts WHERE id % 20 = 0 UNION SELECT g.root, e.id, depth + 1 FROM g JOIN e ON e.parent = g.id WHERE depth < 8),
 m AS (SELECT root, id, min(depth) AS depth FROM g GROUP BY root, id),
 t AS (SELECT m.root, m.id, m.depth, arg_min(e.parent, (-coalesce(q.dl30, 0), e.parent)) AS parent FROM m JOIN e ON e.id = m.id JOIN m mp ON mp.root = m.root AND mp.id = e.parent AND mp.depth = m.depth - 1 LEFT JOIN fx_parts q ON q.id = e.parent WHERE m.depth > 0 GROUP BY m.root, m.id, m.depth),
 c AS (SELECT root, id, parent AS anc FROM t UNION ALL SELECT c.root, c.id, t.parent FROM c JOIN t ON t.root = c.root AND t.id = c.anc)"""


def _trees(v):
    return graph.galaxy(v.edges_distinct, v.parts, v.parts.filter("id % 20 = 0").select(F.col("id").alias("root")))


@entry("gr3_galaxies", f"{_TREES} SELECT m.root, m.id, m.depth, t.parent FROM m LEFT JOIN t ON t.root = m.root AND t.id = m.id")
def _(v):
    return _trees(v).select("root", "id", "depth", "parent")


@entry("ag31_subtree_sizes", f"{_TREES} SELECT m.root, m.id, count(c.id) AS below FROM m LEFT JOIN c ON c.root = m.root AND c.anc = m.id GROUP BY m.root, m.id")
def _(v):
    return graph.intervals(_trees(v)).select("root", "id", "below")


@entry("gr6_focus_of_roots", f"{_TREES}, p AS (SELECT root, min(id) AS pick FROM m WHERE depth = 1 GROUP BY root) SELECT p.root, pick, c.id, 'below' AS role FROM p JOIN c ON c.root = p.root AND c.anc = p.pick UNION ALL SELECT p.root, pick, c.anc, 'above' FROM p JOIN c ON c.root = p.root AND c.id = p.pick WHERE c.anc <> p.root UNION ALL SELECT d.root, d.pick, c.id, 'below' FROM (SELECT root, max(id) AS pick FROM m WHERE depth = 2 GROUP BY root) d JOIN c ON c.root = d.root AND c.anc = d.pick UNION ALL SELECT d.root, d.pick, c.anc, 'above' FROM (SELECT root, max(id) AS pick FROM m WHERE depth = 2 GROUP BY root) d JOIN c ON c.root = d.root AND c.id = d.pick WHERE c.anc <> d.root")
def _(v):
    tree = cut(_trees(v))
    first, second = (tree.filter(F.col("depth") == d).groupBy("root").agg(f("id").alias("pick")) for d, f in ((1, F.min), (2, F.max)))
    return galaxy.focus(tree, first.unionByName(second))


@entry("tk2_families_board", f"{_FAM}, b AS (SELECT anc, CAST(q.dl30 + dl30_desc AS BIGINT) AS fam_dl30 FROM f JOIN fx_parts q ON q.id = anc WHERE members >= 10 ORDER BY fam_dl30 DESC, anc LIMIT 300), o AS (SELECT * FROM b WHERE anc NOT IN (SELECT id FROM p WHERE id IN (SELECT anc FROM b) AND anc IN (SELECT anc FROM b))) SELECT 'families' AS board, CAST(row_number() OVER (ORDER BY fam_dl30 DESC, anc) AS INTEGER) AS rank, anc AS id, CAST(fam_dl30 AS DOUBLE) AS value FROM o ORDER BY fam_dl30 DESC, anc LIMIT 100")
def _(v):
    pairs, stats = _families(v)
    best = graph.outermost(graph.family_totals(stats.filter("members >= 10"), v.parts), pairs)
    return ranks.board(best.select(F.col("anc").alias("id"), "fam_dl30"), "families", "fam_dl30")


_SIZES = "x AS (SELECT strftime(created, '%Y-%m') AS month, CASE WHEN dst % 50 > 0 THEN dst % 97 END AS size, CAST(weight * (src % 3) AS BIGINT) AS weight FROM fx_uses), h AS (SELECT month, size, sum(weight) AS w FROM x WHERE size IS NOT NULL AND weight > 0 GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY month ORDER BY size) AS upto, sum(w) OVER (PARTITION BY month) AS total FROM h)"


@entry("rp8_typical_size", f"WITH {_SIZES} SELECT month, min(size) FILTER (upto >= 0.25 * total) AS low, min(size) FILTER (upto >= 0.5 * total) AS typical, min(size) FILTER (upto >= 0.75 * total) AS high, round(sum(size * w) / sum(w), 6) AS mean FROM c GROUP BY month")
def _(v):
    sized = v.uses.select(F.date_format("created", "yyyy-MM").alias("month"), F.when(F.col("dst") % 50 > 0, F.col("dst") % 97).alias("size"), (F.col("weight") * (F.col("src") % 3)).alias("weight"))
    out = report.weighted_quantiles(sized, ["month"], "size", "weight", {"low": 0.25, "typical": 0.5, "high": 0.75})
    return out.withColumn("mean", r6("mean"))


@entry("wn2_rank_within_null_group", f"WITH n AS (SELECT id, likes // 8 AS v, CASE WHEN {NUMBER} % 3 > 0 THEN CAST({NUMBER} % 2 AS VARCHAR) END AS g FROM fx_series WHERE day = {LAST}) SELECT id, CASE WHEN v % 5 > 0 THEN CAST(rank() OVER (PARTITION BY g ORDER BY CASE WHEN v % 5 > 0 THEN v END DESC NULLS LAST) AS INTEGER) END AS r FROM n")
def _(v):
    n = v.series.filter(F.col("day") == v.last()).select("id", F.expr("likes div 8").alias("v"), F.when(F.expr(f"{NUMBER} % 3 > 0"), F.expr(f"CAST({NUMBER} % 2 AS STRING)")).alias("g"))
    return ranks.rank_within(n.withColumn("v", F.when(F.col("v") % 5 > 0, F.col("v"))), "g", "v", "r").select("id", "r")


@entry("wn4_spark_arrays", f"SELECT id, string_agg(CAST(CAST(round(d * 1000, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY day) AS spark FROM ({_spark_sql('dl_all', True).replace('WITH g AS', 'WITH g AS', 1)}) GROUP BY id")
def _(v):
    points = F.transform("spark", lambda x: F.round(x * 1000).cast("long").cast("string"))
    return series.sparks(v.gappy, v.last(), "dl_all").select("id", F.array_join(points, ",").alias("spark"))


@_same_sql(("st5_closure_by_changes", "gr2_closure"))
def _(v):
    """Edges of which some are still to come and some go: what the changes make of the paths kept."""
    now = cut(v.edges_distinct)
    gone = now.filter("id % 11 = 0").select("id", (F.col("id") + 1).alias("parent")).join(now, ["id", "parent"], "left_anti")
    before = cut(now.filter("id % 7 > 0").unionByName(gone))
    kept = cut(graph.paths(before))
    delta = now.filter("id % 7 = 0").withColumn("sign", F.lit(1)).unionByName(gone.withColumn("sign", F.lit(-1)))
    changes = cut(graph.path_changes(kept, now, delta))
    pairs = kept.filter("id <> anc").select("id", "anc").distinct()
    turned = graph.changed_pairs(kept, changes)
    return pairs.join(turned.filter("change < 0"), ["id", "anc"], "left_anti").unionByName(turned.filter("change > 0").select("id", "anc"))


_RECORD = f"""t AS (SELECT author, round(sum(gain), 4) AS d FROM y GROUP BY 1 HAVING round(sum(gain), 4) > 0),
 wk AS (SELECT author, CAST(date_trunc('week', day) AS DATE) AS week, round(sum(gain), 6) AS v FROM y GROUP BY 1, 2), z AS (SELECT author, arg_min(week, (-v, week)) AS best_week FROM wk WHERE week > DATE '1997-12-31' AND week < DATE '1998-12-28' GROUP BY 1),
 mo AS (SELECT author, string_agg(m || ':' || v, ',' ORDER BY m) AS months FROM (SELECT author, strftime(day, '%Y-%m') AS m, CAST(CAST(round(sum(gain), 0) AS BIGINT) AS VARCHAR) AS v FROM y GROUP BY 1, 2) GROUP BY 1),
 tp AS (SELECT author, string_agg(id || ':' || CAST(CAST(round(v, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS top FROM k WHERE rank <= 5 GROUP BY 1),
 q AS (SELECT author, CASE WHEN {NUMBER} % 6 > 0 THEN 'tag' || ({NUMBER} % 6) END AS tag, sum(gain) AS v FROM y GROUP BY ALL),
 mx AS (SELECT *, sum(v) OVER (PARTITION BY author) AS total FROM q), kk AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY v DESC, tag) AS rank FROM mx WHERE tag IS NOT NULL AND v > 0), tt AS (SELECT *, sum(v) OVER (PARTITION BY author) AS best FROM kk WHERE rank <= 5),
 mi AS (SELECT author, string_agg(tag || ':' || CAST(CAST(round(1000 * round(v / best, 6), 0) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS mix FROM tt WHERE best >= 0.3 * total GROUP BY 1),
 n AS (SELECT id, arg_max(likes, day) FILTER (day = DATE '1998-12-31' AND likes IS NOT NULL) AS now, arg_max(likes, day) FILTER (day BETWEEN DATE '1997-12-21' AND DATE '1997-12-31') AS b, min(day) > DATE '1997-12-31' AS new FROM g GROUP BY id),
 li AS (SELECT split_part(id, '/', 1) AS author, CAST(greatest(0, sum(coalesce(now, 0)) - sum(coalesce(b, 0))) AS BIGINT) AS likes_gained, count(*) FILTER (new) AS models_new FROM n GROUP BY 1),
 en AS (SELECT id, split_part(id, '/', 1) AS author, {NUMBER} AS num, dl30 FROM g WHERE day = (SELECT max(day) FROM g WHERE day <= DATE '1998-12-31')),
 ri AS (SELECT a.author, count(DISTINCT c.id) AS built, CAST(sum(c.dl30) AS BIGINT) AS built_dl30, arg_max(c.id, (c.dl30, c.id)) AS biggest FROM en c JOIN en a ON a.num = c.num // 2 AND a.num <> c.num WHERE a.author <> c.author GROUP BY a.author)"""


@entry("mt15_year_record", f"WITH {_GAPPY}, {_YEAR}, {_REPOS}, {_RECORD} SELECT t.author, d AS downloads, round(31536000 / d, 2) AS every_seconds, round(d / 525600.0, 6) AS per_minute, CAST(rank() OVER (ORDER BY d DESC) AS INTEGER) AS rank, k.id AS top_id, round(k.v / d, 6) AS top_share, best_week, round(100.0 * rank() OVER (ORDER BY d DESC) / count(*) OVER (), 2) AS top_percent, months, top, mix, likes_gained, models_new, coalesce(built, 0) AS built, coalesce(built_dl30, 0) AS built_dl30, biggest FROM t LEFT JOIN k ON k.author = t.author AND k.rank = 1 LEFT JOIN z ON z.author = t.author LEFT JOIN mo ON mo.author = t.author LEFT JOIN tp ON tp.author = t.author LEFT JOIN mi ON mi.author = t.author LEFT JOIN li ON li.author = t.author LEFT JOIN ri ON ri.author = t.author")
def _(v):
    s, start, last = v.gappy, "1997-12-31", "1998-12-31"
    tag = F.expr(f"CASE WHEN {NUMBER} % 6 > 0 THEN concat('tag', CAST({NUMBER} % 6 AS STRING)) END")
    end = s.filter(F.col("day") <= last).agg(F.max("day").alias("_last"))
    now = cut(s.join(F.broadcast(end), F.col("day") == F.col("_last")).join(v.authors, "id").select("id", "author", F.expr(NUMBER).alias("num"), "dl30"))
    edges = now.select("id", F.expr("num div 2").alias("up"), "num").join(now.select(F.col("id").alias("parent"), F.col("num").alias("up")), "up").filter("num <> up").select("id", "parent")
    likes = rollups.likes_gained(s, v.authors, F.lit(start), F.lit(last))
    return rollups.year_record(rollups.year_gaps(s, v.authors, 1998), likes, v.authors.select("id", tag.alias("tag")), graph.ripple(edges, now), start, last)


_KIN = f"ids AS (SELECT DISTINCT id, {NUMBER} AS num FROM fx_series), e AS (SELECT c.id, a.id AS parent FROM ids c JOIN ids a ON a.num = c.num // 2 AND a.num <> c.num), c AS (SELECT id, parent AS anc FROM e UNION SELECT c.id, e.parent FROM c JOIN e ON e.id = c.anc), b AS (SELECT id, anc FROM c UNION SELECT anc, anc FROM c)"


@entry("jn8_family_members_series", f"WITH RECURSIVE {_KIN} SELECT anc, day, CAST(sum(dl30) AS BIGINT) AS dl30, CAST(sum(dl_all) AS BIGINT) AS dl_all, count(*) AS members FROM fx_series s JOIN b ON b.id = s.id GROUP BY anc, day")
def _(v):
    """The family of every id that has descendants: a member counts in every family above it, however far."""
    ids = cut(v.series.select("id").distinct().withColumn("num", F.expr(NUMBER)))
    edges = ids.select("id", F.expr("num div 2").alias("up"), "num").join(ids.select(F.col("id").alias("parent"), F.col("num").alias("up")), "up").filter("num <> up").select("id", "parent")
    pairs = graph.whole_closure(edges)
    return graph.family_series(pairs, v.series, pairs.select("anc").distinct(), v.tasks("series"))
