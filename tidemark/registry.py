"""All queries of the library over the driver's tables, with their SQL twins.

Each entry is (Spark query of (view, last day as a column), SQL for DuckDB). Names follow the inventory's numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import boards, graph, identity, quality, ranks, report, rollups, search, series
from tidemark.plans.views import tasks, view, with_views
from tidemark.sources import snapshots

_ALL: dict[str, tuple] = {}
SKIP = "day IN (DATE '2001-01-05', DATE '2001-01-06')"
GAPPY = "dayofyear(day) % 17 NOT IN (3, 4)"
NUMBER = "CAST(split_part(id, 'repo', 2) AS INT)"


def entry(name: str, sql: str | None):
    def add(f):
        _ALL[name] = (f, with_views(sql) if sql else None)
        return f

    return add


class Views:
    """The views of one data folder, by short name."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name) -> DataFrame:
        return view(self.spark, self.sf_dir, f"fx_{name}")

    def tasks(self, name: str) -> int:
        """How many tasks the uses or the series are dealt over."""
        return tasks(self.spark, self.sf_dir)[name]

    @property
    def last_day(self):
        """The last day of the series, from the one column that its calendar is made of."""
        view(self.spark, self.sf_dir, "fx_edges")
        return self.spark.sql("SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem").first()[0]

    @property
    def months(self) -> int:
        """How many months the series has, from the same column."""
        view(self.spark, self.sf_dir, "fx_edges")
        return self.spark.sql("SELECT count(DISTINCT date_format(CAST(l_shipdate AS DATE), 'yyyy-MM')) FROM lineitem").first()[0]

    @property
    def gappy(self) -> DataFrame:
        return self.series.filter(F.expr(GAPPY))

    @property
    def ragged(self) -> DataFrame:
        """The gappy series; some ids come in its last days, some have no snapshot for ten days, some lose what they had."""
        from datetime import timedelta

        last = self.last_day
        d = lambda n: f"DATE '{last - timedelta(days=n)}'"
        # The remainder of a number by 5 is that of its last digit; days are compared first.
        fifth = "CAST(right(id, 1) AS INT) % 5"
        s = self.gappy.filter(f"NOT (day < {d(4)} AND {fifth} = 1) AND NOT (day BETWEEN {d(18)} AND {d(6)} AND {fifth} = 2)")
        return s.withColumn("dl_all", F.expr(f"CASE WHEN dayofyear(day) % 11 = 0 AND {fifth} = 3 THEN NULL WHEN day = {d(3)} AND {fifth} = 4 THEN dl_all - 40 ELSE dl_all END"))

    @property
    def skip(self) -> DataFrame:
        return self.series.filter(SKIP).select("day").distinct()

    @property
    def authors(self) -> DataFrame:
        return self.series.select("id").distinct().withColumn("author", S.owner(F.col("id")))

    def last(self, name="series"):
        return F.lit(self.last_day if name == "series" else getattr(self, name).agg(F.max("day")).first()[0])

    @property
    def metrics(self) -> DataFrame:
        return series.metrics(self.series, last=self.last_day)

    @property
    def edges_distinct(self) -> DataFrame:
        return self.edges.filter("id <> parent AND parent > 0").select("id", "parent").distinct()


def r6(c):
    return F.round(c, 6)


LAST = "(SELECT max(day) FROM fx_series)"


@entry("src4_latest_upload", "SELECT day, arg_max(event_id, (ts, event_id)) AS event_id FROM fx_events GROUP BY day")
def _(v):
    return snapshots.latest_upload(v.events, "ts", "event_id")


@entry("src5_resume", "SELECT DISTINCT day FROM fx_events WHERE day NOT IN (SELECT day FROM fx_events WHERE dayofyear(day) % 5 > 0)")
def _(v):
    return snapshots.not_landed(v.events.select("day").distinct(), v.events.filter("dayofyear(day) % 5 > 0"))


@entry("src6_scan_months", "SELECT id, day, dl30, dl_all, likes FROM fx_series WHERE strftime(day, '%Y-%m') IN ('1998-01', '1998-02')")
def _(v):
    return snapshots.in_months(v.series, ["1998-01", "1998-02"])


@entry("src7_snapshot", f"SELECT id, day, dl30, dl_all, likes FROM fx_series WHERE day = {LAST}")
def _(v):
    return snapshots.snapshot(v.series, v.last())


def _folder(v, name):
    """A new folder beside the checkpoints, which driver and executors share."""
    import uuid

    from tidemark.plans.staging import shared_folder

    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


@entry("snk1_series_by_month", "SELECT id, day, dl30, dl_all, likes, strftime(day, '%Y-%m') AS month FROM fx_series")
def _(v):
    path = _folder(v, "series")
    snapshots.write_series(v.series, path, months=v.months)
    return v.spark.read.parquet(path).withColumn("month", F.date_format("day", "yyyy-MM"))


@entry("snk3_replaced_day", f"SELECT id, day, CASE WHEN day = {LAST} THEN dl30 + 1 ELSE dl30 END AS dl30 FROM fx_series WHERE day < {LAST} OR {NUMBER} % 2 = 0")
def _(v):
    path, last = _folder(v, "series"), v.last_day
    snapshots.write_series(v.series, path, files=1, months=v.months)
    again = v.series.filter(F.col("day") == F.lit(last)).filter(f"{NUMBER} % 2 = 0").withColumn("dl30", F.col("dl30") + 1)
    for _ in range(2):  # a second delivery changes nothing
        snapshots.upsert_day(path, _folder(v, "staging"), again, last)
    return v.spark.read.parquet(path).select("id", "day", "dl30")


@entry("src1_read_days", "SELECT id, day, CAST(dl30 AS INTEGER) AS dl30, dl_all, CAST(NULL AS INTEGER) AS likes FROM fx_series WHERE day(day) = 1")
def _(v):
    path = _folder(v, "days")
    raw = v.series.filter("day(day) = 1").select("id", F.col("dl30").alias("downloads"), F.col("dl_all").alias("downloadsAllTime"), F.concat(F.col("day").cast("string"), F.lit(".parquet")).alias("file"))
    raw.repartition("file").write.partitionBy("file").parquet(path)
    return snapshots.counters(snapshots.read_days(v.spark, f"{path}/file=*"))


@entry("src2_like_days", "SELECT id, day, CAST(likes AS INTEGER) AS likes, CAST(dl30 / 7.0 AS REAL) AS trending FROM fx_series WHERE day(day) = 2")
def _(v):
    path = _folder(v, "days")
    raw = v.series.filter("day(day) = 2").select("id", "likes", (F.col("dl30") / 7.0).alias("trendingScore"), F.concat(F.col("day").cast("string"), F.lit(".parquet")).alias("file"))
    raw.repartition("file").write.partitionBy("file").parquet(path)
    return snapshots.like_counters(snapshots.read_days(v.spark, f"{path}/file=*", snapshots.RAW_LIKES))


@entry("src8_entity_metadata", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS author, p_type AS pipeline_tag, CAST(p_size AS BIGINT) AS params, CASE WHEN p_size % 2 = 0 THEN 'merge' END AS base_relation, p_partkey // 2 AS base, CASE WHEN p_size % 3 > 0 THEN p_name END AS license, p_size % 5 = 0 AS is_gguf FROM part")
def _(v):
    view(v.spark, v.sf_dir, "fx_parts")
    base = F.struct(F.when(F.col("p_size") % 2 == 0, "merge").alias("relation"), F.array(F.struct((F.floor(F.col("p_partkey") / 2)).cast("string").alias("id"))).alias("models"))
    tags = F.array_compact(F.array(F.lit("x"), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("license:"), "p_name")), F.when(F.col("p_size") % 5 == 0, "gguf")))
    raw = v.spark.table("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("author"), F.col("p_type").alias("pipeline_tag"), F.lit("2024-01-02T03:04:05").alias("createdAt"), F.struct(F.col("p_size").cast("long").alias("total")).alias("safetensors"), base.alias("baseModels"), tags.alias("tags"))
    return snapshots.entity_metadata(raw).select("id", "author", "pipeline_tag", "params", "base_relation", F.get("base_ids", 0).cast("long").alias("base"), "license", "is_gguf")


@entry("flt1_active", "SELECT id, day FROM fx_series WHERE dl30 >= 10 OR likes >= 1 OR dl_all >= 50")
def _(v):
    return v.series.filter(series.active(F.col("dl30"), F.col("likes"), F.col("dl_all"))).select("id", "day")


_SAMPLED = "d AS (SELECT day, row_number() OVER (ORDER BY day) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT day FROM fx_series)), s AS (SELECT day FROM d WHERE (n - 1) % 7 = 0 OR n = c)"


@entry("flt2_universe", f"WITH {_SAMPLED} SELECT DISTINCT id FROM fx_series WHERE day IN (SELECT day FROM s) AND (dl30 >= 10 OR likes >= 1 OR dl_all >= 50)")
def _(v):
    return series.universe(v.series)


@entry("flt3_liked_universe", f"WITH {_SAMPLED} SELECT DISTINCT id FROM fx_series WHERE day IN (SELECT day FROM s) AND likes >= 1")
def _(v):
    return series.universe(v.series, F.col("likes") >= 1)


@entry("flt4_recent", f"SELECT id, day, dl_all FROM fx_series WHERE day > {LAST} - 40 AND (day = {LAST} OR NOT ({SKIP}))")
def _(v):
    return series.recent(v.series, v.skip).select("id", "day", "dl_all")


@entry("flt5_skip_days", f"SELECT id, day, dl_all FROM fx_series WHERE NOT ({SKIP})")
def _(v):
    return series.without_days(v.series, v.skip).select("id", "day", "dl_all")


_RAGGED = f"""l AS (SELECT max(day) AS last FROM fx_series), r AS (SELECT id, day, dl30,
   CASE WHEN {NUMBER} % 5 = 3 AND dayofyear(day) % 11 = 0 THEN NULL WHEN {NUMBER} % 5 = 4 AND day = last - 3 THEN dl_all - 40 ELSE dl_all END AS dl_all, likes
   FROM fx_series, l WHERE {GAPPY} AND NOT ({NUMBER} % 5 = 1 AND day < last - 4) AND NOT ({NUMBER} % 5 = 2 AND day BETWEEN last - 18 AND last - 6))"""
_PEAK = f"""{_RAGGED}, d7 AS (SELECT id, max(day) AS d7 FROM r, l WHERE day BETWEEN last - 17 AND last - 7 GROUP BY id),
 wk AS (SELECT r.id, day, dl_all - lag(dl_all) OVER (PARTITION BY r.id ORDER BY day) AS raw FROM r CROSS JOIN l LEFT JOIN d7 ON d7.id = r.id WHERE day >= last - 17 AND (d7 IS NULL OR day >= d7)),
 st AS (SELECT id, CASE WHEN raw < 0 THEN 0 ELSE raw END AS step FROM wk),
 pk AS (SELECT id, CASE WHEN sum(step) > 0 THEN max(step) / sum(step) END AS peak_share, CAST(count(step) AS INTEGER) AS steps FROM st GROUP BY id)"""


@entry("flt6_steady", f"WITH {_PEAK} SELECT id, round(peak_share, 6) AS peak_share, steps FROM pk WHERE peak_share IS NULL OR steps < 5 OR peak_share <= 0.6")
def _(v):
    return series.steady(series.peak_share(v.ragged, v.last()), 0.6, 5).withColumn("peak_share", r6("peak_share"))


@entry("flt7_null_before_start", "SELECT id, day, CASE WHEN day < DATE '1997-01-01' THEN NULL ELSE dl_all END AS dl_all FROM fx_series")
def _(v):
    return v.series.select("id", "day", F.when(F.col("day") >= "1997-01-01", F.col("dl_all")).alias("dl_all"))


@entry("flt9_notable", f"WITH r AS (SELECT id, likes, rank() OVER (ORDER BY dl30 DESC) AS rk FROM fx_series WHERE day = {LAST}) SELECT id FROM r WHERE rk <= 20 OR likes >= 200")
def _(v):
    now = ranks.global_rank(v.series.filter(F.col("day") == v.last()), "dl30", "rank_dl30")
    return boards.notable(now, "datasets", {"rank_dl30": 20, "likes": 200}).select("id")


@entry("flt9_notable_models", "WITH r AS (SELECT id, rank() OVER (ORDER BY dl30 DESC) AS rk, dl30 % 130 AS likes, CASE WHEN id % 5 = 0 THEN id % 31 END AS fam FROM fx_parts) SELECT id FROM r WHERE rk <= 10000 AND id % 2 = 0 OR likes >= 100 OR fam >= 20")
def _(v):
    parts = v.parts.withColumn("likes", F.col("dl30") % 130).withColumn("fam_members", F.when(F.col("id") % 5 == 0, F.col("id") % 31))
    ranked = ranks.global_rank(parts, "dl30", "rank_dl30").withColumn("rank_dl30", F.when(F.col("id") % 2 == 0, F.col("rank_dl30")))
    return boards.notable(ranked, "models").select("id")


_IDS = "ids AS (SELECT DISTINCT id FROM fx_series)"
_ASK = "ask AS (SELECT id AS asked FROM ids WHERE length(id) % 2 = 0 UNION ALL SELECT upper(id) FROM ids WHERE length(id) % 2 = 1 UNION ALL SELECT 'old-' || id FROM ids)"


@entry("flt10_lookup", f"WITH {_IDS}, {_ASK}, c AS (SELECT asked, id, 0 AS p FROM ask JOIN ids ON asked = id UNION ALL SELECT asked, id, 1 FROM ask JOIN ids ON lower(asked) = lower(id) UNION ALL SELECT 'old-' || id, id, 2 FROM ids) SELECT asked, arg_min(id, (p, id)) AS id FROM c GROUP BY asked")
def _(v):
    ids = v.series.select("id").distinct()
    ask = ids.filter("length(id) % 2 = 0").select(F.col("id").alias("asked")).unionByName(ids.filter("length(id) % 2 = 1").select(F.upper("id").alias("asked"))).unionByName(ids.select(F.concat(F.lit("old-"), "id").alias("asked")))
    return identity.lookup(ask, ids, ids.select(F.concat(F.lit("old-"), "id").alias("old"), F.col("id").alias("new")))


@entry("flt12_keep_last", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM fx_events) WHERE n = 1")
def _(v):
    return snapshots.keep_last(v.events, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@entry("jn1_semi_universe", "SELECT event_id FROM fx_events WHERE user_id IN (SELECT user_id FROM fx_events WHERE event_type = 'purchase')")
def _(v):
    return v.events.join(v.events.filter("event_type = 'purchase'").select("user_id"), "user_id", "left_semi").select("event_id")


@entry("jn2_gone", "SELECT DISTINCT user_id FROM fx_events a WHERE day < (SELECT max(day) FROM fx_events) - 1 AND NOT EXISTS (SELECT 1 FROM fx_events b WHERE b.user_id = a.user_id AND b.day >= (SELECT max(day) FROM fx_events) - 1)")
def _(v):
    late = F.col("day") >= F.date_sub(v.last("events"), 1)
    return v.events.filter(~late).join(v.events.filter(late), "user_id", "left_anti").select("user_id").distinct()


def _as_of_sql(b):
    return f"SELECT id, max(day) AS day_{b}, arg_max(dl_all, day) AS dl_all_{b}, arg_max(likes, day) AS likes_{b} FROM g WHERE day BETWEEN {LAST} - {b + 10} AND {LAST} - {b} GROUP BY id"


_GAPPY = f"g AS (SELECT * FROM fx_series WHERE {GAPPY})"


@entry("jn5_as_of", f"WITH {_GAPPY}, a AS ({_as_of_sql(7)}), b AS ({_as_of_sql(28)}), i AS (SELECT DISTINCT id FROM g) SELECT i.id, day_7, dl_all_7, likes_7, day_28, dl_all_28, likes_28 FROM i LEFT JOIN a ON a.id = i.id LEFT JOIN b ON b.id = i.id")
def _(v):
    return series.as_of(v.gappy, [7, 28], v.last())


_REN = "rn AS (SELECT id AS old, 'new-' || id AS new, DATE '1998-06-01' + CAST(length(id) AS INTEGER) AS came FROM (SELECT DISTINCT id FROM fx_series) WHERE CAST(split_part(id, 'repo', 2) AS BIGINT) % 13 = 0)"


def _renames(v):
    ids = v.series.select("id").distinct().filter("CAST(split_part(id, 'repo', 2) AS BIGINT) % 13 = 0")
    return ids.select(F.col("id").alias("old"), F.concat(F.lit("new-"), "id").alias("new"), F.date_add(F.lit("1998-06-01").cast("date"), F.length("id")).alias("came"))


@entry("jn6_before_rename", f"WITH {_REN} SELECT s.id, s.day, s.dl_all FROM fx_series s LEFT JOIN rn ON rn.old = s.id WHERE came IS NULL OR day < came")
def _(v):
    return identity.before_rename(v.series, _renames(v)).select("id", "day", "dl_all")


@entry("jn7_add_renamed", "SELECT user_id AS id, event_type FROM fx_events UNION SELECT user_id + 1000000, event_type FROM fx_events WHERE user_id % 5 = 0")
def _(v):
    e = v.events.select(F.col("user_id").alias("id"), "event_type")
    return identity.with_renamed(e, "id", e.filter("id % 5 = 0").select(F.col("id").alias("new"), (F.col("id") + 1000000).alias("old")).distinct()).distinct()


_PREV = "prev AS (SELECT id, dl_all FROM fx_series WHERE day = DATE '1999-06-01'), cur AS (SELECT CASE WHEN CAST(split_part(id, 'repo', 2) AS BIGINT) % 13 = 0 THEN 'moved/' || split_part(id, '/', 2) ELSE id END AS id, dl_all FROM fx_series WHERE day = DATE '1999-06-02')"
_CAND = f"{_PREV}, gone AS (SELECT * FROM prev WHERE dl_all >= 1000 AND id NOT IN (SELECT id FROM cur)), came AS (SELECT * FROM cur WHERE dl_all >= 1000 AND id NOT IN (SELECT id FROM prev)), cand AS (SELECT g.id AS old, c.id AS new FROM gone g JOIN came c ON (split_part(g.id, '/', 2) = split_part(c.id, '/', 2) OR split_part(g.id, '/', 1) = split_part(c.id, '/', 1)) AND abs(c.dl_all - g.dl_all) <= 0.01 * g.dl_all)"


def _two_days(v):
    a, b = (v.series.filter(F.col("day") == d).select("id", "dl_all") for d in ("1999-06-01", "1999-06-02"))
    moved = F.expr("CASE WHEN CAST(split_part(id, 'repo', 2) AS BIGINT) % 13 = 0 THEN 'moved/' || split_part(id, '/', 2) ELSE id END")
    return a, b.withColumn("id", moved)


@entry("jn10_rename_candidates", f"WITH {_CAND} SELECT DISTINCT old, new FROM cand")
def _(v):
    return identity.rename_candidates(*_two_days(v))


@entry("dq18_find_renames", f"WITH {_CAND}, a AS (SELECT *, count(*) OVER (PARTITION BY old) AS c FROM cand), b AS (SELECT old, new, count(*) OVER (PARTITION BY new) AS c FROM a WHERE c = 1) SELECT old, new FROM b WHERE c = 1")
def _(v):
    return identity.find_renames(*_two_days(v))


#: Every 13th repo moves on a day of its own, so that each pair of neighbouring days may hold renames.
_MOVING = "CASE WHEN CAST(split_part(id, 'repo', 2) AS BIGINT) % 13 = 0 AND day >= DATE '1999-01-01' + CAST(CAST(split_part(id, 'repo', 2) AS BIGINT) % 400 AS INTEGER) THEN concat('moved/', split_part(id, '/', 2)) ELSE id END"
_DAYS_CAND = f"s AS (SELECT {_MOVING} AS id, day, dl_all FROM fx_series), d AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT day FROM s)), t AS (SELECT s.*, n FROM s JOIN d ON s.day = d.day), gone AS (SELECT * FROM t WHERE dl_all >= 1000 AND NOT EXISTS (SELECT 1 FROM t u WHERE u.id = t.id AND u.n = t.n + 1)), came AS (SELECT * FROM t WHERE dl_all >= 990 AND NOT EXISTS (SELECT 1 FROM t u WHERE u.id = t.id AND u.n = t.n - 1)), cand AS (SELECT DISTINCT c.day, g.id AS old, c.id AS new FROM gone g JOIN came c ON c.n = g.n + 1 AND (split_part(g.id, '/', 2) = split_part(c.id, '/', 2) OR split_part(g.id, '/', 1) = split_part(c.id, '/', 1)) AND abs(c.dl_all - g.dl_all) <= 0.01 * g.dl_all)"


@entry("jn10_rename_candidates_every_day", f"WITH {_DAYS_CAND} SELECT day, old, new FROM cand")
def _(v):
    return identity.rename_candidates_by_day(v.series.withColumn("id", F.expr(_MOVING)))


@entry("dq18_find_renames_every_day", f"WITH {_DAYS_CAND}, a AS (SELECT *, count(*) OVER (PARTITION BY day, old) AS c FROM cand), b AS (SELECT day, old, new, count(*) OVER (PARTITION BY day, new) AS c FROM a WHERE c = 1) SELECT day, old, new FROM b WHERE c = 1")
def _(v):
    return identity.find_renames_by_day(v.series.withColumn("id", F.expr(_MOVING)))


@entry("dq19_resolve_renames", "WITH RECURSIVE e AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS old, CAST(user_id // 2 AS BIGINT) AS new FROM fx_events WHERE user_id > 1), c AS (SELECT old, new FROM e UNION ALL SELECT c.old, e.new FROM c JOIN e ON e.old = c.new) SELECT old, min(new) AS new FROM c GROUP BY old")
def _(v):
    return identity.resolve(v.events.filter("user_id > 1").select(F.col("user_id").alias("old"), F.expr("user_id div 2").alias("new")))


@entry("dq20_stitched", f"WITH {_REN}, s AS (SELECT id, day, dl30, dl_all FROM fx_series UNION ALL SELECT new, day, NULL, dl_all + 1 FROM fx_series JOIN rn ON old = id WHERE day >= came), k AS (SELECT coalesce(new, id) AS cid, CASE WHEN new IS NULL THEN 0 ELSE 1 END AS p, s.* FROM s LEFT JOIN rn ON old = id) SELECT cid AS id, day, arg_min(dl30, p) AS dl30, arg_min(dl_all, p) AS dl_all FROM k GROUP BY cid, day")
def _(v):
    rn = _renames(v)
    new = v.series.join(rn.withColumnRenamed("old", "id"), "id").filter("day >= came").select(F.col("new").alias("id"), "day", F.lit(None).cast("long").alias("dl30"), (F.col("dl_all") + 1).alias("dl_all"))
    return identity.stitched(v.series.select("id", "day", "dl30", "dl_all").unionByName(new), rn, ["dl30", "dl_all"])


@entry("ag1_first_seen", "SELECT user_id AS id, min(day) AS first_seen FROM fx_events GROUP BY user_id")
def _(v):
    return series.first_seen(v.events.withColumnRenamed("user_id", "id"))


@entry("ag2_null_sum", "SELECT event_type, sum(CASE WHEN event_type = 'click' THEN NULL ELSE event_id END) AS total FROM fx_events GROUP BY event_type")
def _(v):
    return rollups.sum_known(v.events.withColumn("known", F.when(F.col("event_type") != "click", F.col("event_id"))), "event_type", "known")


_CLOSURE = """WITH RECURSIVE e AS (SELECT DISTINCT id, parent FROM fx_edges WHERE id <> parent AND parent > 0),
 c AS (SELECT id, parent AS anc, 1 AS n FROM e UNION SELECT c.id, e.parent, n + 1 FROM c JOIN e ON e.id = c.anc WHERE n < 7),
 p AS (SELECT DISTINCT id, anc FROM c WHERE id <> anc)"""
_FAM = f"{_CLOSURE}, f AS (SELECT anc, count(*) AS members, coalesce(sum(dl30), 0) AS dl30_desc, coalesce(sum(dl30 * 7 + q.id % 13), 0) AS dl_all_desc, coalesce(sum(dl30 // 4), 0) AS dl_7d_desc, count(*) FILTER (base_relation = 'quantized') AS n_quantized, count(*) FILTER (base_relation = 'finetune') AS n_finetune, count(*) FILTER (base_relation = 'adapter') AS n_adapter, count(*) FILTER (base_relation = 'merge') AS n_merge FROM p JOIN fx_parts q ON q.id = p.id GROUP BY anc)"


def _entities(v):
    return v.parts.withColumn("dl_all", F.col("dl30") * 7 + F.col("id") % 13).withColumn("dl_7d", F.expr("dl30 div 4"))


def _families(v):
    pairs = graph.closure(v.edges_distinct)
    return pairs, graph.family_stats(pairs, _entities(v))


@entry("gr1_edges", "SELECT DISTINCT id, parent FROM fx_edges WHERE id <> parent")
def _(v):
    return graph.edges_of(v.edges.groupBy("id").agg(F.collect_list("parent").alias("base_ids")))


@entry("gr2_closure", f"{_CLOSURE} SELECT id, anc FROM p")
def _(v):
    return graph.closure(v.edges_distinct)


@entry("ag5_family_stats", f"{_FAM} SELECT anc, members, CAST(dl30_desc AS BIGINT) AS dl30_desc, CAST(dl_all_desc AS BIGINT) AS dl_all_desc, CAST(dl_7d_desc AS BIGINT) AS dl_7d_desc, n_quantized, n_finetune, n_adapter, n_merge FROM f")
def _(v):
    return _families(v)[1]


@entry("ag6_family_totals", f"{_FAM} SELECT anc, members, CAST(q.dl30 + dl30_desc AS BIGINT) AS fam_dl30, CAST(dl30 * 7 + q.id % 13 + dl_all_desc AS BIGINT) AS fam_dl_all, CAST(dl30 // 4 + dl_7d_desc AS BIGINT) AS fam_dl_7d, round(1 - q.dl30 / (q.dl30 + dl30_desc), 6) AS derived_share, round(n_merge / members, 6) AS mix_merge, round(n_quantized / members, 6) AS mix_quantized FROM f JOIN fx_parts q ON q.id = anc")
def _(v):
    return graph.family_totals(_families(v)[1], _entities(v)).select("anc", "members", "fam_dl30", "fam_dl_all", "fam_dl_7d", "derived_share", "mix_merge", "mix_quantized")


@entry("tk6_outermost_families", f"{_FAM}, t AS (SELECT anc, CAST(q.dl30 + dl30_desc AS BIGINT) AS fam_dl30 FROM f JOIN fx_parts q ON q.id = anc ORDER BY fam_dl30 DESC, anc LIMIT 300) SELECT * FROM t WHERE anc NOT IN (SELECT id FROM p WHERE id IN (SELECT anc FROM t) AND anc IN (SELECT anc FROM t))")
def _(v):
    pairs, stats = _families(v)
    return graph.outermost(graph.family_totals(stats, v.parts), pairs)


@entry("tk7_galaxies", f"{_FAM} SELECT anc, members FROM f WHERE members >= 50 AND anc NOT IN (SELECT id FROM e) ORDER BY members DESC, anc LIMIT 20")
def _(v):
    return graph.galaxies(_families(v)[1], v.edges_distinct).select("anc", "members")


@entry("tk8_children", "SELECT parent, id, rank FROM (SELECT e.parent, e.id, row_number() OVER (PARTITION BY e.parent ORDER BY dl30 DESC, e.id) AS rank FROM (SELECT DISTINCT id, parent FROM fx_edges WHERE id <> parent AND parent > 0) e JOIN fx_parts p ON p.id = e.id) WHERE rank <= 1")
def _(v):
    return graph.children(v.edges_distinct, v.parts, 1).select("parent", "id", "rank")


@entry("gr4_lineage", "WITH RECURSIVE b AS (SELECT id, max(parent) AS base FROM fx_edges WHERE id <> parent AND parent > 0 GROUP BY id), l AS (SELECT id, 1 AS hop, base FROM b UNION ALL SELECT l.id, hop + 1, b.base FROM l JOIN b ON b.id = l.base WHERE hop < 8) SELECT id, hop, base FROM l")
def _(v):
    return graph.lineage(v.edges_distinct.groupBy("id").agg(F.max("parent").alias("base")))


@entry("gr3_galaxy", "WITH RECURSIVE e AS (SELECT DISTINCT id, parent FROM fx_edges WHERE id <> parent AND parent > 0), g AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS depth UNION SELECT e.id, depth + 1 FROM g JOIN e ON e.parent = g.id WHERE depth < 8), m AS (SELECT id, min(depth) AS depth FROM g GROUP BY id) SELECT CAST(1 AS BIGINT) AS root, id, depth FROM m")
def _(v):
    return graph.galaxy(v.edges_distinct, v.parts, v.spark.range(1, 2).select(F.col("id").alias("root"))).select("root", "id", "depth")


_TREE = """WITH RECURSIVE e AS (SELECT DISTINCT id, parent FROM fx_edges WHERE id <> parent AND parent > 0),
 t AS (SELECT r AS root, r AS id, 0 AS depth FROM range(1, 4) x(r) UNION SELECT t.root, e.id, t.depth + 1 FROM t JOIN e ON e.parent = t.id WHERE t.depth < 8),
 n AS (SELECT root, id, min(depth) AS depth FROM t GROUP BY ALL)"""


@entry("ag30_generations", f"{_TREE} SELECT root, CAST(least(depth, 4) AS INTEGER) AS generation, count(*) AS n, count(*) FILTER (base_relation = 'quantized') AS n_quantized, count(*) FILTER (base_relation = 'finetune') AS n_finetune, count(*) FILTER (base_relation = 'adapter') AS n_adapter, count(*) FILTER (base_relation = 'merge') AS n_merge FROM n LEFT JOIN fx_parts p ON p.id = n.id WHERE depth > 0 GROUP BY 1, 2")
def _(v):
    nodes = graph.galaxy(v.edges_distinct, v.parts, v.spark.range(1, 4).select(F.col("id").alias("root")))
    return graph.generations(nodes, v.parts)


@entry("ag25_ripple", "WITH e AS (SELECT DISTINCT id, parent FROM fx_edges WHERE id <> parent AND parent > 0) SELECT a.author, count(DISTINCT c.id) AS built, CAST(sum(c.dl30) AS BIGINT) AS dl30, arg_max(c.id, (c.dl30, c.id)) AS biggest FROM e JOIN fx_parts c ON c.id = e.id JOIN fx_parts a ON a.id = e.parent WHERE a.author <> c.author GROUP BY a.author")
def _(v):
    return graph.ripple(v.edges_distinct, v.parts)


@entry("ag3_family_series", "WITH b AS (SELECT DISTINCT id, split_part(id, '/', 1) AS anc FROM fx_series) SELECT anc, day, CAST(sum(dl30) AS BIGINT) AS dl30, CAST(sum(dl_all) AS BIGINT) AS dl_all, count(*) AS members FROM fx_series s JOIN b ON b.id = s.id GROUP BY anc, day")
def _(v):
    pairs = v.authors.withColumnRenamed("author", "anc")
    return graph.family_series(pairs, v.series, pairs.select("anc").distinct())


@entry("ag4_author_series", f"WITH a AS (SELECT *, split_part(id, '/', 1) AS author FROM fx_series), b AS (SELECT author FROM a WHERE day = {LAST} GROUP BY author HAVING sum(coalesce(dl_all, dl30)) >= 5000) SELECT author, day, CAST(sum(dl30) AS BIGINT) AS dl30, CAST(sum(dl_all) AS BIGINT) AS dl_all, CAST(sum(likes) AS BIGINT) AS likes, count(*) AS models FROM a WHERE author IN (SELECT author FROM b) GROUP BY author, day")
def _(v):
    return rollups.author_series(v.series, v.authors, 5000)


@entry("ag8_peak_share", f"WITH {_PEAK} SELECT id, round(peak_share, 6) AS peak_share, steps FROM pk")
def _(v):
    return series.peak_share(v.ragged, v.last()).withColumn("peak_share", r6("peak_share"))


_PAIRS = "c AS (SELECT * FROM r WHERE dl_all IS NOT NULL), d AS (SELECT day, row_number() OVER (ORDER BY day) AS n, lag(day) OVER (ORDER BY day) AS pday FROM (SELECT DISTINCT day FROM c)), s AS (SELECT c.id, c.day, pday, dl_all, n, lag(dl_all) OVER w AS p, lag(dl30) OVER w AS p30, lag(n) OVER w AS pn FROM c JOIN d ON d.day = c.day WINDOW w AS (PARTITION BY id ORDER BY c.day))"
_HUB = f"WITH {_RAGGED}, {_PAIRS}, i AS (SELECT day, pday, CASE WHEN {NUMBER} % 4 = 0 THEN 'other' ELSE split_part(id, '/', 1) END AS tag, round_even(sum(greatest(dl_all - p, 0)) / (day - pday), 0) AS v FROM s WHERE pn = n - 1 GROUP BY ALL HAVING true) SELECT CAST(unnest(generate_series(pday + 1, day, INTERVAL 1 DAY)) AS DATE) AS day, tag, CAST(v AS BIGINT) AS dl FROM i"


@entry("ag9_hub_increment", _HUB.replace("GROUP BY ALL HAVING true", f"GROUP BY day, pday, CASE WHEN {NUMBER} % 4 = 0 THEN 'other' ELSE split_part(id, '/', 1) END"))
def _(v):
    return series.hub_increment(v.ragged, v.authors.withColumnRenamed("author", "tag").filter(f"{NUMBER} % 4 <> 0"))


@entry("ag10_signals", f"WITH {_RAGGED}, {_PAIRS} SELECT day, round(CASE WHEN count(*) FILTER (p30 >= 50) >= 10 THEN count(*) FILTER (p30 >= 50 AND dl_all = p) / count(*) FILTER (p30 >= 50) END, 6) AS frozen, round(avg(CASE WHEN dl_all < p THEN 1 ELSE 0 END), 6) AS back FROM s WHERE pn = n - 1 GROUP BY day")
def _(v):
    return quality.signals(v.ragged, 50, 10).select("day", r6("frozen").alias("frozen"), r6("back").alias("back"))


@entry("ag11_shortfall", "SELECT CAST(sum(greatest(0, a.dl_all - b.dl_all)) AS BIGINT) AS shortfall FROM (SELECT * FROM fx_series WHERE day = DATE '1999-06-02') a JOIN (SELECT * FROM fx_series WHERE day = DATE '1999-05-01') b ON a.id = b.id")
def _(v):
    return quality.shortfall(v.series.filter("day = DATE '1999-06-02'"), v.series.filter("day = DATE '1999-05-01'"))


@entry("ag13_use_counts", "SELECT dst, count(*) FILTER (src_kind = 'model') AS n_models, count(*) FILTER (src_kind = 'space') AS n_spaces FROM fx_uses GROUP BY dst")
def _(v):
    return rollups.use_counts(v.uses)


@entry("ag14_uses_each", "SELECT src, count(*) AS n_uses FROM fx_uses GROUP BY src")
def _(v):
    return rollups.uses_each(v.uses)


@entry("ag15_new_users", "SELECT dst, CAST(date_trunc('month', created) AS DATE) AS month, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY dst ORDER BY date_trunc('month', created)) AS BIGINT) AS total FROM fx_uses GROUP BY dst, date_trunc('month', created)")
def _(v):
    return rollups.new_users(v.uses, v.tasks("uses"))


@entry("gr9_top_users", "SELECT dst, src, rank FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS rank FROM fx_uses) WHERE rank <= 5")
def _(v):
    return rollups.top_users(v.uses, 5).select("dst", "src", "rank")


@entry("jn11_users_with_meta", "SELECT u.src, u.dst, p.author, p.tag FROM fx_uses u LEFT JOIN fx_parts p ON p.id = u.dst")
def _(v):
    return rollups.users_with_meta(v.uses, v.parts)


@entry("ag16_created_per_day", "SELECT day, coalesce(event_type, 'other') AS tag, count(*) AS n FROM fx_events GROUP BY ALL")
def _(v):
    return rollups.per_day(v.events, "event_type")


@entry("ag17_new_by_week", "WITH l AS (SELECT max(day) AS last FROM fx_events), b AS (SELECT event_type FROM fx_events, l WHERE day > last - 365 GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 2) SELECT CAST(date_trunc('week', day) AS DATE) AS week, CASE WHEN event_type IN (SELECT event_type FROM b) THEN event_type ELSE 'other' END AS event_type, count(*) AS n FROM fx_events GROUP BY ALL")
def _(v):
    return rollups.new_by_week(v.events, "event_type", 2)


@entry("ag18_hub_chart", "WITH h AS (SELECT day, CASE WHEN pipeline_tag = '1-URGENT' THEN 'other' ELSE pipeline_tag END AS pipeline_tag, dl FROM fx_hub), l AS (SELECT max(day) AS last FROM fx_hub), b AS (SELECT pipeline_tag FROM h, l WHERE day >= last - 90 AND pipeline_tag <> 'other' GROUP BY pipeline_tag ORDER BY sum(dl) DESC, pipeline_tag LIMIT 3) SELECT day, CASE WHEN pipeline_tag IN (SELECT pipeline_tag FROM b) THEN pipeline_tag ELSE 'other' END AS pipeline_tag, CAST(sum(dl) AS BIGINT) AS dl FROM h GROUP BY ALL")
def _(v):
    return rollups.hub_chart(v.hub.withColumn("pipeline_tag", F.when(F.col("pipeline_tag") == "1-URGENT", "other").otherwise(F.col("pipeline_tag"))), 3)


@entry("ag20_authors_having", "SELECT author, CAST(sum(dl30) AS BIGINT) AS dl30 FROM fx_parts GROUP BY author HAVING sum(dl30) >= 50000")
def _(v):
    return rollups.having(v.parts.groupBy("author").agg(F.sum("dl30").alias("dl30")), "dl30", 50000)


_YEAR = "s AS (SELECT id, day, dl_all, lag(dl_all) OVER w AS p, lag(day) OVER w AS pd FROM g WHERE day BETWEEN DATE '1997-12-21' AND DATE '1998-12-31' WINDOW w AS (PARTITION BY id ORDER BY day)), x AS (SELECT id, unnest(generate_series(pd + 1, day, INTERVAL 1 DAY)) AS u, greatest(0, dl_all - p) / (day - pd) AS gain FROM s WHERE p IS NOT NULL AND day > DATE '1997-12-31'), y AS (SELECT split_part(id, '/', 1) AS author, id, CAST(u AS DATE) AS day, gain FROM x WHERE u > DATE '1997-12-31')"


def _gains(v):
    return rollups.summed_gaps(rollups.year_gaps(v.gappy, v.authors, 1998))


@entry("ag22_year_gains", f"WITH {_GAPPY}, {_YEAR} SELECT author, day, round(sum(gain), 4) AS gain FROM y GROUP BY ALL")
def _(v):
    return rollups.by_days(_gains(v)[1])


_REPOS = "r AS (SELECT author, id, round(sum(gain), 6) AS v FROM y GROUP BY 1, 2), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY author ORDER BY v DESC, id) AS INTEGER) AS rank FROM r WHERE v > 0)"


@entry("mt15_year_summary", f"WITH {_GAPPY}, {_YEAR}, {_REPOS}, t AS (SELECT author, round(sum(gain), 4) AS d FROM y GROUP BY 1 HAVING round(sum(gain), 4) > 0), w AS (SELECT author, CAST(date_trunc('week', day) AS DATE) AS week, round(sum(gain), 6) AS v FROM y GROUP BY 1, 2), z AS (SELECT author, arg_min(week, (-v, week)) AS best_week FROM w WHERE week > DATE '1997-12-31' AND week < DATE '1998-12-28' GROUP BY 1) SELECT t.author, d AS downloads, round(31536000 / d, 2) AS every_seconds, round(d / 525600.0, 6) AS per_minute, CAST(rank() OVER (ORDER BY d DESC) AS INTEGER) AS rank, k.id AS top_id, round(k.v / d, 6) AS top_share, best_week FROM t LEFT JOIN k ON k.author = t.author AND k.rank = 1 LEFT JOIN z ON z.author = t.author")
def _(v):
    return rollups.year_summary(*_gains(v), "1997-12-31", "1998-12-31")


@entry("mt15_top_repos", f"WITH {_GAPPY}, {_YEAR}, {_REPOS} SELECT author, rank, id, v AS downloads FROM k WHERE rank <= 5")
def _(v):
    return rollups.top_repos(_gains(v)[0])


@entry("mt15_months", f"WITH {_GAPPY}, {_YEAR} SELECT author, CAST(date_trunc('month', day) AS DATE) AS month, round(sum(gain), 4) AS downloads FROM y GROUP BY 1, 2")
def _(v):
    return rollups.period_months(_gains(v)[1])


@entry("ag24_likes_gained", f"WITH {_RAGGED}, n AS (SELECT id, arg_max(likes, day) FILTER (day = last) AS now, arg_max(likes, day) FILTER (day BETWEEN last - 375 AND last - 365) AS b, min(day) > any_value(last) - 365 AS new FROM r, l GROUP BY id) SELECT split_part(id, '/', 1) AS author, CAST(greatest(0, sum(coalesce(now, 0)) - sum(coalesce(b, 0))) AS BIGINT) AS likes, count(*) FILTER (new) AS models_new FROM n GROUP BY 1")
def _(v):
    return rollups.likes_gained(v.ragged, v.authors, F.date_sub(v.last(), 365), v.last())


@entry("ag27_task_mix", "WITH q AS (SELECT author, CASE WHEN tag NOT LIKE 'ECONOMY%' THEN tag END AS tag, dl30 FROM fx_parts), m AS (SELECT author, tag, CAST(sum(dl30) AS BIGINT) AS v FROM q GROUP BY ALL), o AS (SELECT *, sum(v) OVER (PARTITION BY author) AS total FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY v DESC, tag) AS rank FROM o WHERE tag IS NOT NULL AND v > 0), t AS (SELECT *, sum(v) OVER (PARTITION BY author) AS top FROM k WHERE rank <= 5) SELECT author, tag, rank, v, round(CASE WHEN top >= 0.3 * total THEN v / top END, 6) AS share FROM t")
def _(v):
    return rollups.task_mix(v.parts.withColumnRenamed("dl30", "v").withColumn("tag", F.when(~F.col("tag").like("ECONOMY%"), F.col("tag"))))


@entry("jn13_change_between", f"WITH {_RAGGED}, n AS (SELECT id, arg_max(dl_all, day) FILTER (day BETWEEN DATE '1998-01-22' AND DATE '1998-02-01' AND dl_all IS NOT NULL) AS a, arg_max(dl_all, day) FILTER (day BETWEEN DATE '1998-07-22' AND DATE '1998-08-01' AND dl_all IS NOT NULL) AS b FROM r GROUP BY id) SELECT split_part(id, '/', 1) AS author, CAST(sum(greatest(0, b - a)) AS BIGINT) AS gain FROM n WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def _(v):
    return rollups.change_between(v.ragged, v.authors, "1998-02-01", "1998-08-01")


_SUPPLIERS = "sp AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'Brand#' || CAST(s_suppkey % 60 AS VARCHAR) ELSE s_name END AS author, CAST(s_suppkey AS BIGINT) AS dl30 FROM supplier)"


def _suppliers(v):
    view(v.spark, v.sf_dir, "fx_parts")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 60).cast("string"))).otherwise(F.col("s_name"))
    return v.spark.table("supplier").select(name.alias("author"), F.col("s_suppkey").cast("long").alias("dl30"))


@entry("ag21_author_index", f"WITH {_SUPPLIERS}, a AS (SELECT author, count(*) AS m, 0 AS s, sum(dl30) AS d FROM fx_parts GROUP BY 1 UNION ALL SELECT author, 0, count(*), sum(dl30) FROM sp GROUP BY 1) SELECT author, CAST(sum(m) AS BIGINT) AS n_models, CAST(sum(s) AS BIGINT) AS n_spaces, CAST(sum(d) AS BIGINT) AS dl30 FROM a GROUP BY 1")
def _(v):
    return rollups.author_index({"models": v.parts, "spaces": _suppliers(v)})


@entry("flt11_resolve_author", f"WITH {_SUPPLIERS}, k AS (SELECT DISTINCT 0 AS o, author FROM fx_parts UNION SELECT DISTINCT 1, author FROM sp), q AS (SELECT DISTINCT upper(author) AS asked FROM k UNION SELECT DISTINCT author FROM k) SELECT asked, arg_min(author, (o, CAST(author <> asked AS INT), author)) AS author FROM q JOIN k ON lower(author) = lower(asked) GROUP BY 1")
def _(v):
    known = v.parts.select("author").unionByName(_suppliers(v).select("author"))
    asked = known.select(F.upper("author").alias("asked")).unionByName(known.withColumnRenamed("author", "asked")).distinct()
    return rollups.resolve_author(asked, [v.parts, _suppliers(v)])


@entry("so2_widening_union", f"WITH {_SUPPLIERS} SELECT author, dl30, tag, NULL AS kind FROM fx_parts UNION ALL SELECT author, dl30, NULL, 'space' FROM sp")
def _(v):
    return v.parts.select("author", "dl30", "tag").unionByName(_suppliers(v).withColumn("kind", F.lit("space")), allowMissingColumns=True)


@entry("ag33_health", "WITH k AS (SELECT 'series' AS kind, max(day) AS last FROM fx_series UNION ALL SELECT 'hub', max(day) FROM fx_hub) SELECT kind, last, CAST((SELECT max(last) FROM k) - last AS INTEGER) AS behind FROM k")
def _(v):
    return rollups.health({"series": v.series, "hub": v.hub})


@entry("ag34_coverage", "SELECT count(DISTINCT day) AS days, min(day) AS first, max(day) AS last, count(DISTINCT id) AS ids FROM fx_series")
def _(v):
    return rollups.coverage(v.series)


_NOW = f"n AS (SELECT * FROM fx_series WHERE day = {LAST})"


@entry("wn1_global_rank", "SELECT id, day, CAST(rank() OVER (ORDER BY dl30 DESC) AS INTEGER) AS rank FROM fx_series")
def _(v):
    return ranks.global_rank(v.series, "dl30", "rank").select("id", "day", "rank")


@entry("wn2_rank_within", "SELECT id, CAST(rank() OVER (PARTITION BY tag ORDER BY dl30 DESC) AS INTEGER) AS rank_task FROM fx_parts")
def _(v):
    return ranks.rank_within(v.parts, "tag", "dl30", "rank_task").select("id", "rank_task")


_STEPS = "st AS (SELECT id, day, CASE WHEN dl_all - lag(dl_all) OVER w < 0 THEN 0 ELSE dl_all - lag(dl_all) OVER w END AS step FROM fx_series WINDOW w AS (PARTITION BY id ORDER BY day))"


@entry("wn3_steps", f"WITH {_STEPS} SELECT id, day, step FROM st")
def _(v):
    return series.steps(v.series).select("id", "day", "step")


def _spark_sql(value, gap):
    return f"WITH {_GAPPY}, s AS (SELECT id, day, CASE WHEN {value} - lag({value}) OVER w < 0 THEN 0 ELSE {value} - lag({value}) OVER w END AS gain, greatest(day - lag(day) OVER w, 1) AS gap FROM g WHERE day >= {LAST} - 29 WINDOW w AS (PARTITION BY id ORDER BY day)) SELECT id, day, round(CAST(gain AS DOUBLE){' / gap' if gap else ''}, 6) AS d FROM s WHERE gain IS NOT NULL"


@entry("wn4_spark_points", _spark_sql("dl_all", True))
def _(v):
    return series.spark_points(v.gappy, v.last(), "dl_all").withColumn("d", r6("d"))


@entry("wn5_like_spark_points", _spark_sql("likes", False))
def _(v):
    return series.spark_points(v.gappy, v.last(), "likes", by_gap=False).withColumn("d", r6("d"))


_TOT = "t AS (SELECT day, CAST(sum(dl) AS DOUBLE) AS tot FROM fx_hub GROUP BY day), m AS (SELECT day, tot, CASE WHEN count(*) OVER w >= 5 THEN median(tot) OVER w END AS med FROM t WINDOW w AS (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)), q AS (SELECT day, tot, med, CASE WHEN med > 0 THEN tot / med ELSE 1.0 END AS ratio FROM m)"


@entry("dq3_ratio_to_median", f"WITH {_TOT} SELECT day, tot, med AS median, round(ratio, 6) AS ratio FROM q")
def _(v):
    return quality.totals(v.hub).withColumn("ratio", r6("ratio"))


@entry("dq4_stall_runs", f"WITH {_TOT}, s AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS k FROM q WHERE ratio < 0.3) SELECT min(day) AS start, max(day) AS \"end\", count(*) AS days FROM s GROUP BY k")
def _(v):
    return quality.stall_runs(quality.totals(v.hub))


@entry("wn16_weekday_factor", f"WITH {_TOT} SELECT CAST(isodow(day) AS INTEGER) AS weekday, round(median(ratio), 6) AS factor FROM (SELECT day, CASE WHEN med > 0 THEN tot / med END AS ratio FROM q) GROUP BY 1")
def _(v):
    return quality.weekday_factor(quality.totals(v.hub)).withColumn("factor", r6("factor"))


@entry("dq7_measurements", f"WITH {_GAPPY}, c AS (SELECT DISTINCT day FROM fx_series), s AS (SELECT DISTINCT day FROM g) SELECT c.day, coalesce((SELECT min(s.day) FROM s WHERE s.day >= c.day AND s.day < DATE '1998-11-01'), (SELECT max(day) FROM s WHERE day < DATE '1998-11-01')) AS snap FROM c")
def _(v):
    return quality.measurements(v.series.select("day").distinct(), v.gappy.filter("day < DATE '1998-11-01'").select("day").distinct())


_RUNS = f"{_TOT}, s AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS k FROM q WHERE ratio < 0.5), r AS (SELECT min(day) AS start, max(day) AS fin FROM s GROUP BY k), x AS (SELECT *, max(fin) OVER (ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM r), y AS (SELECT *, sum(CASE WHEN start <= e + 2 THEN 0 ELSE 1 END) OVER (ORDER BY start, fin) AS k FROM x), wins AS (SELECT min(start) AS start, max(fin) AS fin FROM y GROUP BY k)"


def _wins(v):
    return quality.merge_windows(quality.stall_runs(quality.totals(v.hub), 0.5).drop("days"))


@entry("dq9_merge_windows", f"WITH {_RUNS} SELECT start, fin AS \"end\" FROM wins")
def _(v):
    return _wins(v)


@entry("dq10_smooth", f"WITH {_RUNS}, a AS (SELECT h.*, start, fin FROM fx_hub h LEFT JOIN wins ON day BETWEEN start AND fin), b AS (SELECT start, fin, pipeline_tag, sum(dl) AS t FROM a WHERE start IS NOT NULL GROUP BY ALL) SELECT day, pipeline_tag, dl FROM a WHERE start IS NULL UNION ALL SELECT CAST(unnest(generate_series(start, fin, INTERVAL 1 DAY)) AS DATE), pipeline_tag, CAST(round_even(t / (fin - start + 1), 0) AS BIGINT) FROM b")
def _(v):
    return quality.smooth(v.hub, _wins(v))


@entry("dq14_skip_days", f"WITH {_RUNS} SELECT DISTINCT CAST(unnest(generate_series(start, fin - 1, INTERVAL 1 DAY)) AS DATE) AS day FROM wins WHERE start < fin")
def _(v):
    return quality.skip_days(_wins(v))


@entry("dq15_short_days", "WITH t AS (SELECT day, min(ts) AS taken_at FROM fx_events WHERE value > 30 AND event_id % 29 = 0 GROUP BY day), l AS (SELECT day, (epoch(date_trunc('second', taken_at)) - epoch(date_trunc('second', lag(taken_at) OVER (ORDER BY taken_at)))) / 3600 AS hours FROM t) SELECT day, round(hours, 6) AS hours FROM l WHERE hours < 18")
def _(v):
    return quality.short_days(v.events.filter("value > 30 AND event_id % 29 = 0").groupBy("day").agg(F.min(F.col("ts").cast("timestamp")).alias("taken_at")))


@entry("dq16_repair_calendar", "WITH h AS (SELECT * FROM fx_hub WHERE dayofyear(day) % 17 NOT IN (3, 4)), d AS (SELECT day, coalesce(day - lag(day) OVER (ORDER BY day), 1) AS n FROM (SELECT DISTINCT day FROM h)) SELECT CAST(unnest(generate_series(h.day - CAST(n - 1 AS INTEGER), h.day, INTERVAL 1 DAY)) AS DATE) AS day, pipeline_tag, CAST(round_even(dl / n, 0) AS BIGINT) AS dl FROM h JOIN d ON d.day = h.day")
def _(v):
    return quality.repair_calendar(v.hub.filter(F.expr(GAPPY)))


@entry("wn8_trailing_mean", "SELECT id, day, round(avg(dl30) OVER (PARTITION BY id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS smooth FROM fx_series")
def _(v):
    return series.smooth(v.series, "dl30").select("id", "day", r6("smooth").alias("smooth"))


@entry("wn12_month_ends", "WITH m AS (SELECT id, strftime(day, '%Y-%m') AS month, arg_max(dl30, day) AS v FROM fx_series GROUP BY 1, 2), c AS (SELECT *, v - lag(v) OVER w AS change, max(v) OVER w AS best, row_number() OVER (PARTITION BY id ORDER BY month DESC) AS k FROM m WINDOW w AS (PARTITION BY id ORDER BY month)) SELECT id, month, v, change, best FROM c WHERE k <= 13")
def _(v):
    return series.month_ends(v.series, "dl30")


@entry("wn13_daily_points", f"WITH {_GAPPY}, a AS (SELECT id, day, dl_all, row_number() OVER (PARTITION BY id ORDER BY day DESC) AS k FROM g), b AS (SELECT id, day, greatest(dl_all - lag(dl_all) OVER (PARTITION BY id ORDER BY day), dl_all - dl_all) AS step, lag(dl_all) OVER (PARTITION BY id ORDER BY day) AS p FROM a WHERE k <= 63), c AS (SELECT id, day, step, avg(step) OVER (PARTITION BY id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean7, row_number() OVER (PARTITION BY id ORDER BY day) AS n FROM b WHERE p IS NOT NULL) SELECT id, day, step, round(mean7, 6) AS mean7 FROM c WHERE n > 6")
def _(v):
    return series.daily_points(v.gappy, "dl_all").withColumn("mean7", r6("mean7"))


@entry("wn14_card_points", "WITH a AS (SELECT id, day, dl_all, row_number() OVER (PARTITION BY id ORDER BY day DESC) - 1 AS k FROM fx_series) SELECT id, day, dl_all AS v, dl_all - lag(dl_all) OVER (PARTITION BY id ORDER BY day) AS gained FROM a WHERE k % 7 = 0 AND k < 182")
def _(v):
    return series.card_points(v.series, "dl_all")


@entry("wn15_position", "WITH t AS (SELECT author, sum(dl30) AS v FROM fx_parts GROUP BY author) SELECT author, CAST(rank() OVER (ORDER BY v DESC) AS INTEGER) AS place, round(100.0 * rank() OVER (ORDER BY v DESC) / count(*) OVER (), 6) AS top_percent FROM t")
def _(v):
    return ranks.position(v.parts.groupBy("author").agg(F.sum("dl30").alias("v")), "author", "v").select("author", "place", "top_percent")


@entry("mt16_standing", "WITH t AS (SELECT id, dl30 AS v FROM fx_parts), p AS (SELECT id, rank() OVER (ORDER BY v DESC) AS place, round(100.0 * rank() OVER (ORDER BY v DESC) / count(*) OVER (), 6) AS top_percent FROM t) SELECT id, CASE WHEN place <= 10 THEN 'top 10' WHEN place <= 100 THEN 'top 100' WHEN place <= 1000 THEN 'top 1000' ELSE 'top ' || CAST(CAST(ceil(top_percent) AS BIGINT) AS VARCHAR) || ' %' END AS tier FROM p")
def _(v):
    return ranks.standing(ranks.position(v.parts.withColumnRenamed("dl30", "v"), "id", "v")).select("id", "tier")


@entry("sc22_links", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'dataset' WHEN 1 THEN 'space' WHEN 2 THEN 'model' ELSE '' END AS kind, CASE WHEN s_suppkey % 4 < 3 THEN 'org' || s_nationkey || '/repo' || s_suppkey ELSE '' END AS rid FROM supplier")
def _(v):
    view(v.spark, v.sf_dir, "fx_parts")
    t = v.spark.table("supplier")
    rid = F.concat(F.lit("org"), F.col("s_nationkey").cast("string"), F.lit("/repo"), F.col("s_suppkey").cast("string"))
    k = F.col("s_suppkey") % 4
    text = F.when(k == 0, F.concat(F.lit("https://hub.example/datasets/"), rid)).when(k == 1, F.concat(F.lit("https://hub.example/spaces/"), rid)).when(k == 2, rid).otherwise("no link at all")
    kind, found = S.link(text)
    return t.select("s_suppkey", kind.alias("kind"), found.alias("rid"))


@entry("sc21_card_items", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN [p_brand] WHEN p_size % 3 = 1 THEN list_sort([p_brand, p_name]) ELSE [] END AS items FROM part")
def _(v):
    view(v.spark, v.sf_dir, "fx_parts")
    k = F.col("p_size") % 3
    card = F.when(k == 0, F.to_json(F.struct(F.col("p_brand").alias("datasets")))).when(k == 1, F.to_json(F.struct(F.array("p_brand", F.concat(F.lit(" "), "p_name"), F.lit(""), "p_brand").alias("datasets")))).otherwise("{not json")
    return v.spark.table("part").select("p_partkey", F.array_sort(S.card_items(card, "datasets")).alias("items"))


@entry("tk1_top", f"SELECT id, dl30 FROM fx_series WHERE day = {LAST} ORDER BY dl30 DESC, id LIMIT 100")
def _(v):
    return ranks.top(v.series.filter(F.col("day") == v.last()), "dl30", 100).select("id", "dl30")


@entry("tk9_top_of_author", "SELECT author, id, rank FROM (SELECT author, id, row_number() OVER (PARTITION BY author ORDER BY dl30 DESC, id) AS rank FROM fx_parts) WHERE rank <= 3")
def _(v):
    return ranks.top_each(v.parts, "author", "dl30", 3).select("author", "id", "rank")


@entry("tk13_chunks", "SELECT id, (row_number() OVER (ORDER BY dl30 DESC, id) - 1) // 100 AS chunk FROM fx_parts")
def _(v):
    return ranks.chunks(v.parts, "dl30", 100)


def _mt():
    refs = ", ".join(f"a{b} AS (SELECT id, max(day) AS day_{b}, arg_max(coalesce(CAST(dl_all AS VARCHAR), ''), day) AS t_{b}, arg_max(likes, day) AS likes_{b} FROM u WHERE day BETWEEN {LAST} - {b + 10} AND {LAST} - {b} GROUP BY id)" for b in (7, 14, 28, 31))
    joins = " ".join(f"LEFT JOIN a{b} ON a{b}.id = n.id" for b in (7, 14, 28, 31))
    total = ", ".join(f"TRY_CAST(t_{b} AS BIGINT) AS dl_all_{b}" for b in (7, 14, 28, 31))
    return f"""{_PEAK}, u AS (SELECT r.* FROM r, l WHERE day >= last - 40), {refs}, fs AS (SELECT id, min(day) AS first_seen FROM r GROUP BY id),
 h AS (SELECT n.id, first_seen, dl30, dl_all, likes, day_7, likes_7, day_14, day_28, {total}, first_seen > {LAST} - 7 AS new, {LAST} - day_7 AS s7, day_7 - day_14 AS s14, day_7 - day_28 AS s28, peak_share, steps
   FROM u n {joins} LEFT JOIN fs ON fs.id = n.id LEFT JOIN pk ON pk.id = n.id WHERE n.day = {LAST}),
 k AS (SELECT * REPLACE (CASE WHEN dl_all_31 IS NOT NULL AND dl_all = dl_all_31 THEN 0 ELSE dl30 END AS dl30), CASE WHEN s7 > 0 AND dl_all IS NOT NULL THEN greatest(dl_all - dl_all_7, 0) * 7 / s7 END AS r7,
   CASE WHEN s28 > 0 AND dl_all_28 IS NOT NULL AND dl_all_7 IS NOT NULL THEN greatest(dl_all_7 - dl_all_28, 0) * 7 / s28 END AS dl_base7d FROM h),
 mm AS (SELECT id, split_part(id, '/', 1) AS author, first_seen, dl30, dl_all, likes,
   CAST(round_even(CASE WHEN dl_all_7 IS NOT NULL THEN least(r7, dl30) WHEN new THEN least(dl_all, dl30) END, 0) AS BIGINT) AS dl_7d,
   CAST(CASE WHEN s14 > 0 AND dl_all_7 IS NOT NULL AND dl_all_14 IS NOT NULL THEN round_even(greatest(dl_all_7 - dl_all_14, 0) * 7 / s14, 0) END AS BIGINT) AS dl_prev7d, dl_base7d,
   CAST(round_even(CASE WHEN likes_7 IS NOT NULL THEN (likes - likes_7) * 7 / s7 WHEN new THEN likes END, 0) AS BIGINT) AS likes_7d, peak_share, steps FROM k)"""


@entry("mt6_entity_metrics", f"WITH {_mt()} SELECT id, author, first_seen, CAST(dl30 AS BIGINT) AS dl30, dl_all, likes, dl_7d, dl_prev7d, round(dl_base7d, 6) AS dl_base7d, likes_7d, round(CASE WHEN dl_base7d >= 100 THEN dl_7d / dl_base7d - 1 END, 6) AS growth_7d, round(peak_share, 6) AS peak_share, steps FROM mm")
def _(v):
    m = series.metrics(v.ragged, last=v.last_day)
    return m.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


@entry("ag7_author_totals", f"WITH {_mt()} SELECT author, CAST(sum(dl30) AS BIGINT) AS dl30, CAST(sum(dl_7d) AS BIGINT) AS dl_7d, count(*) AS models, round(CASE WHEN sum(dl_base7d) >= 1000 THEN sum(dl_7d) / sum(dl_base7d) - 1 END, 6) AS growth FROM mm GROUP BY author")
def _(v):
    return rollups.author_totals(series.metrics(v.ragged, last=v.last_day))


def _board_sql(name, by, rows, kind="id"):
    return f"(SELECT '{name}' AS board, CAST(row_number() OVER (ORDER BY {by} DESC, {kind}) AS INTEGER) AS rank, {kind} AS id, round(CAST({by} AS DOUBLE), 6) AS value FROM {rows} WHERE {by} IS NOT NULL ORDER BY {by} DESC, {kind} LIMIT 20)"


_CALM = "(peak_share IS NULL OR peak_share <= 0.6)"
_BOARDS = [
    _board_sql("gainers_7d", "dl_7d", "mm"),
    _board_sql("dl30", "dl30", "mm"),
    _board_sql("dl_all", "dl_all", "mm"),
    _board_sql("growth_7d", "growth_7d", f"(SELECT id, dl_7d / dl_base7d - 1 AS growth_7d FROM mm WHERE dl_base7d >= 1000 AND dl30 >= 10000 AND {_CALM})"),
    _board_sql("breakouts", "dl_7d", f"(SELECT id, dl_7d FROM mm WHERE first_seen >= {LAST} - 30 AND (peak_share IS NULL OR steps < 3 OR peak_share <= 0.8))"),
    _board_sql("likes_7d", "likes_7d", "(SELECT * FROM mm WHERE dl30 >= 1000)"),
    _board_sql("authors_dl30", "dl30", "au", "author"),
    _board_sql("authors_7d", "dl_7d", "au", "author"),
]


@entry("tk2_model_boards", f"WITH {_mt()}, au AS (SELECT author, sum(dl30) AS dl30, sum(dl_7d) AS dl_7d FROM mm WHERE author IS NOT NULL GROUP BY author) " + " UNION ALL ".join(_BOARDS))
def _(v):
    return ranks.model_boards(series.metrics(v.ragged, last=v.last_day), v.last(), 20)


_ENTITY = f"""WITH {_mt()}, meta AS (SELECT id, CASE WHEN {NUMBER} % 6 > 0 THEN 'tag' || ({NUMBER} % 6) END AS pipeline_tag FROM mm WHERE {NUMBER} % 7 > 0),
 pr AS (SELECT b.id AS anc, a.* FROM mm a JOIN mm b ON b.author = a.author AND b.id < a.id AND {NUMBER.replace('id', 'b.id')} % 10 = 0),
 fm AS (SELECT anc, count(*) AS members, sum(dl30) AS dl30, sum(dl_all) AS dl_all, sum(dl_7d) AS dl_7d FROM pr GROUP BY anc),
 us AS (SELECT dst, count(*) FILTER (src_kind = 'model') AS n_models, count(*) FILTER (src_kind = 'space') AS n_spaces FROM fx_uses GROUP BY dst),
 e AS (SELECT mm.id, pipeline_tag, mm.dl30, mm.dl_7d, coalesce(fm.members, 0) AS fam_members, mm.dl30 + coalesce(fm.dl30, 0) AS fam_dl30, mm.dl_all + coalesce(fm.dl_all, 0) AS fam_dl_all, mm.dl_7d + coalesce(fm.dl_7d, 0) AS fam_dl_7d, coalesce(n_models, 0) AS n_models, coalesce(n_spaces, 0) AS n_spaces
   FROM mm LEFT JOIN meta ON meta.id = mm.id LEFT JOIN fm ON fm.anc = mm.id LEFT JOIN us ON us.dst = {NUMBER.replace('id', 'mm.id')})
 SELECT id, pipeline_tag, CAST(fam_members AS BIGINT) AS fam_members, CAST(fam_dl30 AS BIGINT) AS fam_dl30, CAST(fam_dl_all AS BIGINT) AS fam_dl_all, CAST(fam_dl_7d AS BIGINT) AS fam_dl_7d, n_models, n_spaces,
 CAST(CASE WHEN dl30 IS NOT NULL THEN rank() OVER (PARTITION BY pipeline_tag ORDER BY dl30 DESC NULLS LAST) END AS INTEGER) AS rank_task, CAST(CASE WHEN dl30 IS NOT NULL THEN rank() OVER (ORDER BY dl30 DESC NULLS LAST) END AS INTEGER) AS rank_dl30, CAST(CASE WHEN dl_7d IS NOT NULL THEN rank() OVER (ORDER BY dl_7d DESC NULLS LAST) END AS INTEGER) AS rank_7d FROM e"""


@entry("jn4_entity_table", _ENTITY)
def _(v):
    number = lambda c: F.expr(NUMBER.replace("id", c))
    m = series.metrics(v.ragged, last=v.last_day)
    ids = v.series.select("id").distinct()
    meta = ids.filter(number("id") % 7 > 0).select("id", F.when(number("id") % 6 > 0, F.concat(F.lit("tag"), (number("id") % 6).cast("string"))).alias("pipeline_tag"))
    bases = m.filter(number("id") % 10 == 0).select(F.col("id").alias("anc"), "author")
    pairs = m.join(bases, "author").filter("anc < id")
    fam = pairs.groupBy(F.col("anc").alias("id")).agg(F.count("*").alias("members"), *[F.sum(c).alias(c) for c in ("dl30", "dl_all", "dl_7d")])
    uses = rollups.use_counts(v.uses).join(ids.withColumn("dst", number("id")), "dst").select("id", "n_models", "n_spaces")
    out = series.entity_table(m, meta, fam, uses)
    return out.select("id", "pipeline_tag", "fam_members", "fam_dl30", "fam_dl_all", "fam_dl_7d", "n_models", "n_spaces", "rank_task", "rank_dl30", "rank_7d")


def _liked_sql(b):
    return f"CAST(round_even(CASE WHEN a{b}.likes_{b} IS NOT NULL THEN greatest(likes - a{b}.likes_{b}, 0) * {b} / ({LAST} - a{b}.day_{b}) WHEN first_seen > {LAST} - {b} THEN likes END, 0) AS BIGINT) AS likes_{b}d"


_SPACE_REFS = ", ".join(f"a{b} AS (SELECT id, max(day) AS day_{b}, arg_max(likes, day) AS likes_{b} FROM r WHERE day BETWEEN {LAST} - {b + 10} AND {LAST} - {b} GROUP BY id)" for b in (7, 30))


@entry("mt7_space_metrics", f"WITH {_RAGGED}, {_SPACE_REFS}, fs AS (SELECT id, min(day) AS first_seen FROM r GROUP BY id) SELECT r.id, r.likes, {_liked_sql(7)}, {_liked_sql(30)} FROM r LEFT JOIN a7 ON a7.id = r.id LEFT JOIN a30 ON a30.id = r.id LEFT JOIN fs ON fs.id = r.id WHERE r.day = {LAST}")
def _(v):
    return series.space_metrics(v.ragged, v.last_day)


_DAILY = "s AS (SELECT id, day, greatest(dl_all - lag(dl_all) OVER w, 0) AS gain, lag(day) OVER w AS pd FROM g WINDOW w AS (PARTITION BY id ORDER BY day)), dd AS (SELECT id, CAST(unnest(generate_series(pd + 1, day, INTERVAL 1 DAY)) AS DATE) AS day, gain / (day - pd) AS v FROM s WHERE pd IS NOT NULL)"


@entry("mt8_daily_values", f"WITH {_GAPPY}, {_DAILY} SELECT id, day, round(v, 6) AS v FROM dd")
def _(v):
    return series.by_day(v.gappy, "dl_all").withColumn("v", r6("v"))


@entry("mt10_weekly", f"WITH {_GAPPY}, {_DAILY}, w AS (SELECT id, CAST(date_trunc('week', day) AS DATE) AS week, sum(v) AS v, max(day) AS d FROM dd GROUP BY 1, 2) SELECT id, week, round(v, 4) AS v, week = max(week) OVER (PARTITION BY id) AND max(d) OVER (PARTITION BY id) - week < 6 AS partial FROM w")
def _(v):
    return series.weekly(series.by_day(v.gappy, "dl_all"), "v").withColumn("v", F.round("v", 4))


@entry("mt11_milestones", "WITH mk AS (SELECT CAST(power(10, unnest(range(3, 10))) AS BIGINT) AS mark), f AS (SELECT id, arg_min(dl_all, day) AS v0, arg_max(dl_all, day) AS total FROM fx_series GROUP BY id), g AS (SELECT f.id, v0, total, mark, (SELECT min(day) FROM fx_series s WHERE s.id = f.id AND dl_all >= mark) AS day FROM f, mk), b AS (SELECT *, v0 >= mark AS before, lag(day) OVER (PARTITION BY id ORDER BY mark) AS lower, max(CASE WHEN v0 >= mark THEN mark END) OVER (PARTITION BY id) AS tb FROM g) SELECT id, mark, CASE WHEN NOT before THEN day END AS day, before FROM b WHERE (day IS NOT NULL OR lower IS NOT NULL OR mark = 1000 OR mark / 10 <= total * 10) AND (NOT before OR mark = tb)")
def _(v):
    return series.milestones(v.series)


@entry("mt12_compare", "SELECT day, max(CASE WHEN pipeline_tag = '1-URGENT' THEN dl END) AS \"1-URGENT\", max(CASE WHEN pipeline_tag = '5-LOW' THEN dl END) AS \"5-LOW\" FROM fx_hub WHERE pipeline_tag IN ('1-URGENT', '5-LOW') GROUP BY day")
def _(v):
    return series.compare(v.hub.withColumnRenamed("pipeline_tag", "id"), ["1-URGENT", "5-LOW"], "dl")


@entry("mt14_full_months", "WITH l AS (SELECT CAST(date_trunc('month', max(day)) - INTERVAL 1 MONTH AS DATE) AS m FROM fx_hub), a AS (SELECT CAST(unnest(generate_series(m - INTERVAL 11 MONTH, m, INTERVAL 1 MONTH)) AS DATE) AS month FROM l), i AS (SELECT DISTINCT pipeline_tag AS id FROM fx_hub), s AS (SELECT pipeline_tag AS id, CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(dl) AS BIGINT) AS v FROM fx_hub GROUP BY 1, 2) SELECT i.id, a.month, coalesce(v, 0) AS v FROM i CROSS JOIN a LEFT JOIN s ON s.id = i.id AND s.month = a.month")
def _(v):
    return series.full_months(v.hub.withColumnRenamed("pipeline_tag", "id"), "dl", 12)


@entry("mt17_range", f"SELECT id, day, dl30 FROM fx_series WHERE day >= {LAST} - 91")
def _(v):
    return series.in_range(v.series, 91, v.last()).select("id", "day", "dl30")


_INDEX = "ix AS (SELECT p_brand || '/' || p_name AS id, CASE WHEN p_partkey % 9 > 0 THEN CAST(round(p_retailprice) AS BIGINT) END AS pop, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS title FROM part)"
#: Every 20th part asks: for its name, its owner and type, the first letters of its owner, or nothing.
_ASKS = "SELECT p_partkey AS qid, CASE p_partkey // 20 % 4 WHEN 0 THEN p_name WHEN 1 THEN ' ' || upper(p_brand) || '  ' || p_type WHEN 2 THEN substr(p_brand, 1, 7) ELSE ' ' END AS q FROM part WHERE p_partkey % 20 = 0"
_WORDS = "wq AS (SELECT qid, list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda w: w <> '') AS ws FROM qs), aq AS (SELECT qid, ws, array_to_string(ws, ' ') AS q FROM wq WHERE len(ws) > 0)"


def _asks(v):
    view(v.spark, v.sf_dir, "fx_parts")
    return v.spark.sql(_ASKS.replace("p_partkey // 20", "p_partkey div 20"))


def _parts_index(v):
    view(v.spark, v.sf_dir, "fx_parts")
    return v.spark.sql(_INDEX.removeprefix("ix AS (").removesuffix(")"))


_RANKED = """c AS (SELECT qid, q, ws, id, pop, lower(id) AS lid, lower(title) AS lt FROM ix, aq WHERE len(list_filter(ws, lambda w: NOT (contains(lower(id), w) OR coalesce(contains(lower(title), w), false)))) = 0),
 b AS (SELECT *, coalesce(pop >= 0.05 * max(pop) OVER (PARTITION BY qid), false) AS enough, split_part(lid, '/', 2) AS nm, split_part(lid, '/', 1) AS ow FROM c),
 k AS (SELECT *, lid = q AS k1, list_contains(ws, ow) AS k2, (nm = q OR coalesce(lt = q, false)) AND enough AS k3,
   NOT list_contains(ws, ow) AND (len(list_filter(ws, lambda w: NOT (contains(nm, w) OR coalesce(contains(lt, w), false)))) = 0 OR (starts_with(ow, ws[1]) AND enough)) AS k4 FROM b)"""
_ORDER = "CAST(k1 AS INT) DESC, CAST(k2 AS INT) DESC, CAST(k3 AS INT) DESC, CAST(k4 AS INT) DESC, pop DESC NULLS LAST, id"


@entry("se1_search", f"WITH {_INDEX}, qs AS ({_ASKS}), {_WORDS}, {_RANKED}, r AS (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY {_ORDER}) AS INTEGER) AS rank FROM k) SELECT qid, rank, id FROM r WHERE rank <= 20")
def _(v):
    return search.ranked(_asks(v), _parts_index(v), 20)


@entry("se2_search_authors", f"WITH ix AS (SELECT author, CAST(sum(dl30) AS BIGINT) AS pop FROM fx_parts GROUP BY author), qs AS (SELECT p_partkey AS qid, substr(p_brand, 1, 5 + p_partkey // 20 % 4) AS q FROM part WHERE p_partkey % 20 = 0), {_WORDS}, r AS (SELECT qid, author, CAST(row_number() OVER (PARTITION BY qid ORDER BY CAST(lower(author) = q AS INT) DESC, CAST(starts_with(lower(author), q) AS INT) DESC, pop DESC, author) AS INTEGER) AS rank FROM ix, aq WHERE len(list_filter(ws, lambda w: NOT contains(lower(author), w))) = 0) SELECT qid, rank, author FROM r WHERE rank <= 8")
def _(v):
    ix = v.parts.groupBy("author").agg(F.sum("dl30").alias("pop"))
    q = v.spark.sql("SELECT p_partkey AS qid, substr(p_brand, 1, cast(5 + p_partkey div 20 % 4 AS INT)) AS q FROM part WHERE p_partkey % 20 = 0")
    return search.authors(q, ix, 8)


@entry("rp1_monthly_totals", f"WITH {_GAPPY}, t AS (SELECT day, sum(dl_all) AS t FROM g GROUP BY day), m AS (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS m FROM t), b AS (SELECT m, max(day) AS bd, arg_max(t, day) AS bt FROM t JOIN m ON day <= m GROUP BY m), a AS (SELECT m, min(day) AS ad, arg_min(t, day) AS att FROM t JOIN m ON day >= m GROUP BY m), v AS (SELECT b.m, bt + (att - bt) * CASE WHEN ad > bd THEN (b.m - bd) / (ad - bd) ELSE 0.0 END AS v FROM b JOIN a ON a.m = b.m), l AS (SELECT m, round(lead(v) OVER (ORDER BY m) - v, 6) AS total FROM v) SELECT m AS month, total FROM l WHERE total IS NOT NULL")
def _(v):
    return report.monthly_totals(v.gappy)


@entry("rp2_month_estimate", "WITH t AS (SELECT day, sum(dl30) AS d FROM fx_series GROUP BY day), m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, arg_max(d, day) AS d FROM t GROUP BY 1) SELECT month, round(d * day(last_day(month)) / 30, 6) AS estimate FROM m")
def _(v):
    return report.month_estimate(v.series)


@entry("rp3_yearly_rate", "WITH r AS (SELECT pipeline_tag, CAST(year(day) AS INTEGER) AS year, sum(dl) / count(DISTINCT day) AS rate FROM fx_hub GROUP BY 1, 2) SELECT pipeline_tag, year, round(rate, 6) AS rate, round(rate / lag(rate) OVER (PARTITION BY pipeline_tag ORDER BY year), 6) AS ratio FROM r")
def _(v):
    return report.yearly_rate(v.hub)


@entry("rp4_shares", "SELECT tag, author, CAST(sum(dl30) AS BIGINT) AS v, round(sum(dl30) / sum(sum(dl30)) OVER (PARTITION BY tag), 6) AS share FROM fx_parts GROUP BY tag, author")
def _(v):
    return report.shares(v.parts, "tag", "author", "dl30")


@entry("rp7_concentration", "WITH r AS (SELECT dl30, row_number() OVER (ORDER BY dl30 DESC, id) AS k, rank() OVER (ORDER BY dl30 DESC) AS rk, count(*) OVER () AS n, sum(dl30) OVER () AS s FROM fx_parts) SELECT round(sum(dl30) FILTER (k <= 10) / max(s), 6) AS top_10, round(sum(dl30) FILTER (k <= 100) / max(s), 6) AS top_100, round(sum(dl30) FILTER (k <= 1000) / max(s), 6) AS top_1000, round(sum(dl30) FILTER (rk <= ceil(n / 100)) / max(s), 6) AS top_percent FROM r")
def _(v):
    return report.concentration(v.parts, "dl30")


@entry("rp8_bands", "SELECT CASE WHEN dl30 < 1000 THEN '< 1000' WHEN dl30 < 1500 THEN '< 1500' ELSE '>= 1500' END AS band, count(*) AS n, CAST(sum(dl30) AS BIGINT) AS dl30 FROM fx_parts GROUP BY 1")
def _(v):
    return v.parts.groupBy(report.bands(F.col("dl30"), [1000, 1500]).alias("band")).agg(F.count("*").alias("n"), F.sum("dl30").alias("dl30"))


@entry("rp9_cohort_share", "SELECT CAST(year(created) AS INTEGER) AS cohort, CAST(sum(weight) AS BIGINT) AS dl30, round(sum(weight) / (SELECT sum(weight) FROM fx_uses), 6) AS share FROM fx_uses GROUP BY 1")
def _(v):
    return report.cohort_share(v.uses.withColumnRenamed("weight", "dl30"), F.year("created"))


@entry("rp9_cohorts", "WITH f AS (SELECT user_id, CAST(min(day) AS DATE) AS f FROM fx_events GROUP BY user_id) SELECT CAST(date_trunc('week', f) AS DATE) AS cohort, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM fx_events e JOIN f ON f.user_id = e.user_id GROUP BY 1")
def _(v):
    f = v.events.groupBy("user_id").agg(S.week(F.min("day")).alias("cohort"))
    return v.events.join(f, "user_id").groupBy("cohort").agg(F.count("*").alias("n")).withColumn("share", r6(F.col("n") / F.sum("n").over(W.partitionBy())))


@entry("rp10_launch_curve", "WITH f AS (SELECT id, min(day) AS fs FROM fx_series GROUP BY id), s AS (SELECT s.id, dl_all - coalesce(lag(dl_all) OVER (PARTITION BY s.id ORDER BY day), 0) AS g, (day - fs) // 7 AS week FROM fx_series s JOIN f ON f.id = s.id), a AS (SELECT id, week, sum(g) AS g FROM s WHERE week < 26 GROUP BY ALL), b AS (SELECT *, sum(g) OVER (PARTITION BY id) AS t FROM a) SELECT CAST(week AS BIGINT) AS week, round(avg(g / t), 6) AS share, count(*) AS n FROM b WHERE t >= 100 GROUP BY week")
def _(v):
    return report.launch_curve(v.series, series.first_seen(v.series), 100)


@entry("rp11_spearman", f"WITH {_NOW}, a AS (SELECT rank() OVER (ORDER BY dl30 DESC) + (count(*) OVER (PARTITION BY dl30) - 1) / 2 AS ra, rank() OVER (ORDER BY likes DESC) + (count(*) OVER (PARTITION BY likes) - 1) / 2 AS rb FROM n) SELECT round(corr(ra, rb), 6) AS rho FROM a")
def _(v):
    return report.spearman(v.series.filter(F.col("day") == v.last()), "dl30", "likes")


@entry("rp12_rank_by_month", "WITH m AS (SELECT CAST(date_trunc('month', day) AS DATE) AS month, pipeline_tag, CAST(sum(dl) AS BIGINT) AS v FROM fx_hub GROUP BY 1, 2) SELECT *, CAST(rank() OVER (PARTITION BY month ORDER BY v DESC) AS INTEGER) AS rank FROM m")
def _(v):
    return report.rank_by_month(v.hub, "pipeline_tag", "dl")


@entry("rp13_creators", "WITH q AS (SELECT DISTINCT CAST(date_trunc('quarter', created) AS DATE) AS quarter, src_kind, src % 997 AS src FROM fx_uses), f AS (SELECT src_kind, src, min(quarter) AS first FROM q GROUP BY 1, 2) SELECT quarter, q.src_kind, count(*) AS creators, round(count(*) FILTER (quarter = first) / count(*), 6) AS share_new FROM q JOIN f ON f.src_kind = q.src_kind AND f.src = q.src GROUP BY 1, 2")
def _(v):
    return rollups.creators(v.uses.withColumn("src", F.col("src") % 997))


@entry("rp14_share_of_authors", "WITH u AS (SELECT CAST(year(created) AS INTEGER) AS year, src % 211 AS author, dst FROM fx_uses) SELECT u.year, p.tag, count(DISTINCT u.author) AS n, round(count(DISTINCT u.author) / max(t.c), 6) AS share FROM u JOIN fx_parts p ON p.id = dst JOIN (SELECT year, count(DISTINCT author) AS c FROM u GROUP BY year) t ON t.year = u.year GROUP BY 1, 2")
def _(v):
    return rollups.citing_authors(v.uses.withColumn("author", F.col("src") % 211), v.parts)


@entry("rp16_volume_bands", f"SELECT count(*) FILTER (dl30 < 10) AS under_10, count(*) FILTER (dl30 < 100) AS under_100, count(*) FILTER (dl30 > 1000000) AS over_1m FROM fx_series WHERE day = {LAST}")
def _(v):
    return report.volume_bands(v.series.filter(F.col("day") == v.last()))


_SIDES = " UNION ALL ".join(f"(SELECT '{side}' AS side, CAST(row_number() OVER (ORDER BY ratio {way}, id) AS INTEGER) AS rank, id, likes, dl30, ratio FROM (SELECT *, round(likes / dl30, 6) AS ratio FROM n WHERE dl30 > 0 AND likes > 0) ORDER BY ratio {way}, id LIMIT 20)" for side, way in (("liked", "DESC"), ("used", "ASC")))


@entry("rp17_outliers", f"WITH {_NOW} {_SIDES}")
def _(v):
    return boards.outliers(v.series.filter(F.col("day") == v.last()), 20)


@entry("src8_dataset_metadata", "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 3 > 0 THEN p_type END AS pipeline_tag, CASE WHEN p_size % 2 = 0 THEN 'n<1K' END AS size, NULL AS modality, CAST(length(repeat(p_name || ' ', 60)) AS BIGINT) > 300 AS was_longer, least(300, length(repeat(p_name || ' ', 60))) AS n, CAST(TIMESTAMP '2024-05-06 07:08:09' + to_days(CAST(p_size AS INTEGER)) AS TIMESTAMP) AS last_modified, round(p_retailprice / 7, 6) AS trending, CAST(NULL AS VARCHAR) AS gated FROM part")
def _(v):
    view(v.spark, v.sf_dir, "fx_parts")
    tags = F.array_compact(F.array(F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("task_categories:"), "p_type")), F.when(F.col("p_size") % 2 == 0, "size_categories:n<1K"), F.lit("other")))
    text = F.repeat(F.concat("p_name", F.lit(" ")), F.lit(60))
    raw = v.spark.table("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("author"), F.lit("2024-01-02T03:04:05").alias("createdAt"), tags.alias("tags"), text.alias("description"), F.date_format(F.expr("timestamp_ntz'2024-05-06 07:08:09' + make_dt_interval(p_size)"), "yyyy-MM-dd'T'HH:mm:ss").alias("lastModified"), (F.col("p_retailprice") / 7).alias("trendingScore"))
    m = snapshots.dataset_metadata(raw).join(raw.select("id", F.length("description").alias("l")), "id")
    return m.select("id", "pipeline_tag", "size", "modality", (F.col("l") > 300).alias("was_longer"), F.length("description").alias("n"), "last_modified", r6("trending").alias("trending"), "gated")


@entry("src8_space_metadata", "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 3 = 0 THEN p_name END AS title, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'x' END AS emoji, CAST(p_size AS BIGINT) AS likes, TIMESTAMP '2024-01-02 03:04:05' AS created_at, CAST(NULL AS TIMESTAMP) AS last_modified, CAST(p_size * 0.5 AS DOUBLE) AS trending FROM part")
def _(v):
    view(v.spark, v.sf_dir, "fx_parts")
    card = F.when(F.col("p_size") % 3 == 0, F.to_json(F.struct(F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "x").alias("emoji")))).when(F.col("p_size") % 3 == 1, "{broken")
    raw = v.spark.table("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("author"), F.lit("sdk").alias("sdk"), F.lit("2024-01-02T03:04:05").alias("createdAt"), F.col("p_size").alias("likes"), (F.col("p_size") * 0.5).alias("trendingScore"), card.alias("cardData"))
    return snapshots.space_metadata(raw).select("id", "title", "emoji", "likes", "created_at", "last_modified", "trending")


def queries() -> dict:
    return {k: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}


from tidemark import registry_boards, registry_quality, registry_state  # noqa: E402, F401  (add their entries)
