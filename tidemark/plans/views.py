"""The driver's tables seen as counter histories; the text is SQL for Spark and DuckDB alike, but for the uses and the series, which Spark builds by USES and SERIES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.staging import tasks_for

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "fx_series": """
WITH cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem),
 g AS (SELECT s_suppkey, s_nationkey, day FROM supplier CROSS JOIN cal),
 f AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, CAST(sum(l_quantity) AS BIGINT) AS q,
       CAST(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS BIGINT) AS r
       FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)),
 d AS (SELECT g.*, coalesce(q,0) AS q, coalesce(r,0) AS r FROM g LEFT JOIN f ON g.s_suppkey=f.l_suppkey AND g.day=f.day)
SELECT concat('org', CAST(s_nationkey AS VARCHAR(10)), '/repo', CAST(s_suppkey AS VARCHAR(10))) AS id, day,
 CAST(sum(q) OVER (PARTITION BY s_suppkey ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS dl30,
 CAST(sum(q) OVER (PARTITION BY s_suppkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS dl_all,
 CAST(sum(r) OVER (PARTITION BY s_suppkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS likes
FROM d""",
    "fx_hub": "SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS pipeline_tag, count(*) AS dl FROM orders GROUP BY CAST(o_orderdate AS DATE), o_orderpriority",
    "fx_edges": """
SELECT p_partkey AS id, CAST(floor(p_partkey/2.0) AS BIGINT) AS parent,
 CASE p_size % 4 WHEN 0 THEN 'quantized' WHEN 1 THEN 'finetune' WHEN 2 THEN 'adapter' ELSE 'merge' END AS base_relation
FROM part WHERE p_partkey > 0
UNION ALL
SELECT p_partkey, CAST(floor(p_partkey/3.0) AS BIGINT),
 CASE p_size % 4 WHEN 0 THEN 'quantized' WHEN 1 THEN 'finetune' WHEN 2 THEN 'adapter' ELSE 'merge' END
FROM part WHERE p_partkey > 0 AND p_partkey % 11 = 0 AND floor(p_partkey/3.0) <> floor(p_partkey/2.0)""",
    "fx_uses": """
SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'space' ELSE 'model' END AS src_kind, o_orderkey AS src,
 'dataset' AS dst_kind, l_partkey AS dst, CAST(o_orderdate AS DATE) AS created, CAST(round(o_totalprice) AS BIGINT) AS weight
FROM orders JOIN lineitem ON o_orderkey=l_orderkey""",
    "fx_events": "SELECT event_id, ts, CAST(ts AS DATE) AS day, user_id, event_type, value FROM events",
    "fx_parts": """
SELECT p_partkey AS id, p_brand AS author, p_type AS tag, CAST(round(p_retailprice) AS BIGINT) AS dl30,
 CASE p_size % 4 WHEN 0 THEN 'quantized' WHEN 1 THEN 'finetune' WHEN 2 THEN 'adapter' ELSE 'merge' END AS base_relation FROM part""",
}


#: fx_uses as Spark runs it: lines meet their orders in tasks of a bounded number of lines, whatever the number of shuffle partitions.
#: The rows of one source lie in one task, so that they are made distinct there and what follows by src shuffles nothing again.
USES = """
WITH o AS (SELECT /*+ REPARTITION(o_orderkey) */ o_orderkey, o_orderdate, o_totalprice FROM orders),
 l AS (SELECT /*+ REPARTITION(l_orderkey) */ l_orderkey, l_partkey FROM lineitem)
SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN 'space' ELSE 'model' END AS src_kind, o_orderkey AS src,
 'dataset' AS dst_kind, l_partkey AS dst, CAST(o_orderdate AS DATE) AS created, CAST(round(o_totalprice) AS BIGINT) AS weight
FROM o JOIN l ON o_orderkey = l_orderkey
"""

#: fx_series as Spark runs it: the same rows without a grid that is joined and sorted. What a supplier sells on a day of the calendar
#: moves its sums on that day and, for dl30, back 30 days on. The sums run over these moves alone, and each holds until the next one:
#: a move becomes as many rows as there are days until then. Rows lie by id, in
#: tasks of a bounded number of rows, so that what follows by id shuffles nothing again.
SERIES = """
WITH cal AS (SELECT day, row_number() OVER (ORDER BY day) AS n FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)),
 ids AS (SELECT s_suppkey, concat('org', CAST(s_nationkey AS VARCHAR(10)), '/repo', CAST(s_suppkey AS VARCHAR(10))) AS id FROM supplier),
 l AS (SELECT /*+ BROADCAST(cal) */ l_suppkey, n, l_quantity AS q, CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END AS r FROM lineitem JOIN cal ON CAST(l_shipdate AS DATE) = day),
 a AS (SELECT /*+ REPARTITION(id) */ * FROM (SELECT id, n, q, r FROM l JOIN ids ON l_suppkey = s_suppkey UNION ALL SELECT id, 1, NULL, 0 FROM ids)),
 f AS (SELECT id, n, coalesce(CAST(sum(q) AS BIGINT), 0L) AS q, CAST(sum(r) AS BIGINT) AS r FROM a GROUP BY id, n),
 m AS (SELECT id, stack(2, n, q, q, r, n + 30, -q, 0L, 0L) AS (n, q30, q, r) FROM f),
 t AS (SELECT id, n, sum(q30) OVER w AS dl30, sum(q) OVER w AS dl_all, sum(r) OVER w AS likes, lead(n) OVER w AS until FROM m WHERE n <= (SELECT count(*) FROM cal) WINDOW w AS (PARTITION BY id ORDER BY n)),
 d AS (SELECT id, explode(sequence(n, coalesce(until, CAST((SELECT count(*) FROM cal) AS INT) + 1) - 1)) AS n, dl30, dl_all, likes FROM t WHERE until IS NULL OR until > n)
SELECT /*+ BROADCAST(cal) */ id, day, dl30, dl_all, likes FROM d JOIN cal ON d.n = cal.n
"""

#: Lines, and rows of the series, that one task holds.
LINES_A_TASK, ROWS_A_TASK = 1 << 18, 1 << 20

_OPEN: dict[str, str] = {}
_TASKS: dict[str, dict[str, int]] = {}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables of a folder, which are opened once for it."""
    session = f"{spark.sparkContext.applicationId}/{id(spark)}"
    if _OPEN.get(session) != sf_dir or not all(spark.catalog.tableExists(t) for t in TABLES[:1]):
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        _OPEN[session] = sf_dir
        _TASKS.pop(session, None)
    if name in ("fx_series", "fx_uses"):
        text, n = SERIES if name == "fx_series" else USES, tasks(spark, sf_dir)[name[3:]]
        return spark.sql(text.replace("REPARTITION(", f"REPARTITION({n}, "))
    return spark.sql(VIEWS[name])


def tasks(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """How many tasks the uses and the series of a folder are dealt over, from the sizes of its tables, which are counted once."""
    session = f"{spark.sparkContext.applicationId}/{id(spark)}"
    if _OPEN.get(session) != sf_dir:
        view(spark, sf_dir, "fx_edges")
    if session not in _TASKS:
        lines, days = spark.sql("SELECT count(*), coalesce(datediff(max(l_shipdate), min(l_shipdate)) + 1, 1) FROM lineitem").first()
        _TASKS[session] = {"uses": tasks_for(spark, lines, LINES_A_TASK), "series": tasks_for(spark, spark.table("supplier").count() * days, ROWS_A_TASK)}
    return _TASKS[session]


def with_views(sql: str) -> str:
    """A query with the views it names in front."""
    used = [f"{k} AS ({v})" for k, v in VIEWS.items() if k in sql]
    return ("WITH RECURSIVE " + ", ".join(used) + (", " + sql.strip()[len("WITH RECURSIVE") :] if sql.strip().upper().startswith("WITH RECURSIVE") else (", " + sql.strip()[4:] if sql.strip().upper().startswith("WITH") else " " + sql))) if used else sql
