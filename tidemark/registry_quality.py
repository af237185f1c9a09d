"""Queries on windows, verdicts and low days, with SQL twins that go the same rounds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import quality, verdicts, windows
from tidemark.registry import _GAPPY, _PAIRS, GAPPY, NUMBER, entry

ROUNDS_SQL = windows.ROUNDS

_GAPPY_HUB = """h AS (SELECT * FROM fx_hub WHERE dayofyear(day) % 17 NOT IN (3, 4)), hd AS (SELECT day, coalesce(day - lag(day) OVER (ORDER BY day), 1) AS n FROM (SELECT DISTINCT day FROM h)),
 hub AS (SELECT pipeline_tag AS series, CAST(unnest(generate_series(h.day - CAST(n - 1 AS INTEGER), h.day, INTERVAL 1 DAY)) AS DATE) AS day, pipeline_tag, CAST(round_even(dl / n, 0) AS BIGINT) AS dl FROM h JOIN hd ON hd.day = h.day),
 snaps AS (SELECT DISTINCT day FROM h)"""
_FROZEN = f"{_GAPPY}, r AS (SELECT * FROM g), {_PAIRS}, frozen AS (SELECT day, CASE WHEN count(*) FILTER (p30 >= 100) >= 10 THEN count(*) FILTER (p30 >= 100 AND dl_all = p) / count(*) FILTER (p30 >= 100) END AS share FROM s WHERE pn = n - 1 AND day - pday = 1 GROUP BY day)"


def facts_sql(x: str, hub: str, frozen: str = "false") -> str:
    """CTEs f{x}: the facts of each day of a hub; `frozen`: a condition on q."""
    return f"""
t{x} AS (SELECT series, day, CAST(sum(dl) AS DOUBLE) AS tot FROM {hub} GROUP BY series, day),
m{x} AS (SELECT *, CASE WHEN count(*) OVER w >= 5 THEN median(tot) OVER w END AS med, row_number() OVER o - 1 AS k, count(*) OVER p AS n, max(day) OVER p AS last FROM t{x}
  WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), o AS (PARTITION BY series ORDER BY day), p AS (PARTITION BY series)),
q{x} AS MATERIALIZED (SELECT *, CASE WHEN med > 0 THEN tot / med ELSE 1.0 END AS ratio, (SELECT min(day) FROM snaps WHERE snaps.day >= m{x}.day) AS closes, (SELECT max(day) FROM snaps WHERE snaps.day < m{x}.day) AS opened FROM m{x}),
f{x} AS MATERIALIZED (SELECT *, coalesce(closes, (SELECT max(day) FROM snaps), day) AS block, ratio < 0.3 OR {frozen} AS stalled,
  CASE WHEN lead(ratio, 3) OVER o > 1.3 AND lead(ratio, 4) OVER o > 1.3 THEN 4 WHEN lead(ratio, 3) OVER o > 1.3 THEN 3 WHEN lead(ratio, 2) OVER o > 1.3 THEN 2 ELSE 1 END AS reach,
  CASE WHEN lag(ratio) OVER o > 1.5 AND lag(ratio, 2) OVER o > 1.5 THEN 2 WHEN lag(ratio) OVER o > 1.5 THEN 1 ELSE 0 END AS early FROM q{x} WINDOW o AS (PARTITION BY series ORDER BY day))"""


def windows_sql(x: str, hub: str, settled: str) -> str:
    """CTEs up to w{x}: the windows of a hub, days of which are settled already."""
    frozen = f"coalesce((SELECT max(share) FROM frozen WHERE frozen.day = q{x}.day AND NOT EXISTS (SELECT 1 FROM {settled} z WHERE z.series = q{x}.series AND z.day = q{x}.day)) >= 0.9, false)"
    return f"""{facts_sql(x, hub, frozen)},
i{x} AS (SELECT series, k, reach, k - row_number() OVER (PARTITION BY series ORDER BY k) AS g FROM f{x} WHERE stalled),
r{x} AS (SELECT series, min(k) AS first, max(k) AS final, arg_max(reach, k) AS reach, row_number() OVER (PARTITION BY series ORDER BY min(k)) AS j FROM i{x} GROUP BY series, g),
l{x} AS (SELECT series, CAST(0 AS BIGINT) AS j, CAST(-1 AS BIGINT) AS until, CAST(NULL AS BIGINT) AS a FROM r{x} WHERE j = 1 UNION ALL
  SELECT r.series, r.j, CASE WHEN until + 1 > r.final THEN until ELSE r.final + r.reach END, CASE WHEN until + 1 <= r.final THEN f.k - f.early END FROM l{x} l JOIN r{x} r ON r.series = l.series AND r.j = l.j + 1 LEFT JOIN f{x} f ON f.series = r.series AND f.k = greatest(r.first, l.until + 1)),
b{x} AS (SELECT series, block, last, min(k) AS lo, max(k) AS hi, max(n) AS n, count(*) AS w, avg(ratio) AS ratio, min(day) AS d0, max(day) AS d1, arg_min(opened, k) FILTER (opened IS NOT NULL) AS opened, arg_max(closes, k) FILTER (closes IS NOT NULL) AS closes FROM f{x} GROUP BY series, block, last),
c{x} AS (SELECT *, lag(w) OVER o AS pw, lag(ratio) OVER o AS pr, lag(d0) OVER o AS pd, lag(opened) OVER o AS po, lead(w) OVER o AS nw, lead(ratio) OVER o AS nr, lead(d1) OVER o AS nd, lead(closes) OVER o AS nc FROM b{x} WINDOW o AS (PARTITION BY series ORDER BY lo)),
d{x} AS (SELECT *, pr > 1.3 AND 2 * (ratio * w + pr * pw) / (w + pw) BETWEEN 1.6 AND 2.4 AS before, hi + 1 < n - 1 AND nr > 1.3 AND 2 * (ratio * w + nr * nw) / (w + nw) BETWEEN 1.6 AND 2.4 AS behind FROM c{x} WHERE ratio >= 0.3 AND ratio < 0.7 AND greatest(lo, 1) <= least(hi, n - 3)),
u{x} AS (SELECT l.series, s.day AS a, e.day AS b, s.opened, e.closes, e.last FROM l{x} l JOIN f{x} s ON s.series = l.series AND s.k = l.a JOIN f{x} e ON e.series = l.series AND e.k = l.until WHERE e.k < e.n - 1
  UNION ALL SELECT series, pd, d1, po, closes, last FROM d{x} WHERE before UNION ALL SELECT series, d0, nd, opened, nc, last FROM d{x} WHERE behind AND before IS NOT TRUE),
v{x} AS (SELECT series, least(a, opened + 1) AS a, greatest(b, closes) AS b FROM u{x} WHERE greatest(b, closes) < last),
y{x} AS (SELECT *, max(b) OVER (PARTITION BY series ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM v{x}),
z{x} AS (SELECT *, sum(CASE WHEN a <= e + 2 THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY a, b) AS g FROM y{x}),
w{x} AS (SELECT series, min(a) AS a, max(b) AS b FROM z{x} GROUP BY series, g)"""


def rounds_sql(n: int) -> str:
    """CTEs of n rounds over hub, snaps and frozen; `wins` and `settled_hub` are what they lead to."""
    out = ["settled0 AS (SELECT series, day FROM hub WHERE false)", "hub0 AS MATERIALIZED (SELECT * FROM hub)"]
    for k in range(n):
        x, hub, settled = f"_{k}", f"hub{k}", f"settled{k}"
        out += [
            windows_sql(x, hub, settled),
            f"in{k} AS (SELECT DISTINCT w.series, a, b, h.day FROM w{x} w JOIN {hub} h ON h.series = w.series AND h.day BETWEEN a AND b)",
            f"but{k} AS (SELECT * FROM (SELECT *, max(day) OVER (PARTITION BY series, a, b) AS fin FROM in{k}) WHERE day < fin)",
            f"new{k} AS (SELECT DISTINCT series, a, b FROM but{k} x WHERE NOT EXISTS (SELECT 1 FROM {settled} z WHERE z.series = x.series AND z.day = x.day))",
            f"days{k} AS MATERIALIZED (SELECT i.*, count(*) OVER (PARTITION BY series, a, b) AS n FROM in{k} i SEMI JOIN new{k} x ON x.series = i.series AND x.a = i.a AND x.b = i.b)",
            f"settled{k + 1} AS (SELECT * FROM {settled} UNION SELECT x.series, x.day FROM but{k} x SEMI JOIN new{k} y ON y.series = x.series AND y.a = x.a AND y.b = x.b)",
            f"tot{k} AS (SELECT d.series, a, b, n, pipeline_tag, sum(dl) AS t FROM days{k} d JOIN {hub} h ON h.series = d.series AND h.day = d.day GROUP BY ALL)",
            f"hub{k + 1} AS MATERIALIZED (SELECT * FROM {hub} h WHERE NOT EXISTS (SELECT 1 FROM days{k} d WHERE d.series = h.series AND d.day = h.day) UNION ALL SELECT d.series, d.day, pipeline_tag, CAST(round_even(t / d.n, 0) AS BIGINT) FROM days{k} d JOIN tot{k} t ON t.series = d.series AND t.a = d.a AND t.b = d.b)",
        ]
    union = " UNION ALL ".join(f"SELECT series, a, b FROM new{k}" for k in range(n))
    return ", ".join([*out, f"wins AS ({union})"])


def _gappy_hub(v):
    """(hub with its missing days filled in, days with a snapshot), by tag."""
    hub = v.hub.filter(F.expr(GAPPY))
    by_tag = quality.repair_calendar(hub).withColumn("series", F.col("pipeline_tag"))
    return by_tag.select("series", "day", "pipeline_tag", "dl"), hub.select(F.col("pipeline_tag").alias("series")).distinct().crossJoin(hub.select("day").distinct())


def _frozen(v, series):
    # Supplier counters rarely move on a day, so the bound is that of data sets. A share counts between neighbouring days only.
    near = v.gappy.select("day").distinct().withColumn("_p", F.lag("day").over(W.orderBy("day"))).filter(F.datediff("day", "_p") == 1).select("day")
    return quality.signals(v.gappy, 100, 10).join(near, "day").select("day", F.col("frozen").alias("share")).crossJoin(series)


def _settled(v):
    hub, snaps = _gappy_hub(v)
    return windows.settle(hub, _frozen(v, hub.select("series").distinct()), 0.9, snaps)


@entry("dq5_windows", f"WITH RECURSIVE {_GAPPY_HUB}, {_FROZEN}, settled0 AS (SELECT series, day FROM hub WHERE false), {windows_sql('_0', 'hub', 'settled0')} SELECT series, a AS start, b AS \"end\" FROM w_0")
def _(v):
    hub, snaps = _gappy_hub(v)
    return windows.find(hub, _frozen(v, hub.select("series").distinct()), 0.9, snaps)


@entry("dq5_settled_windows", f"WITH RECURSIVE {_GAPPY_HUB}, {_FROZEN}, {rounds_sql(ROUNDS_SQL)} SELECT series, a AS start, b AS \"end\" FROM wins")
def _(v):
    return _settled(v)[0]


@entry("dq11_settled_hub", f"WITH RECURSIVE {_GAPPY_HUB}, {_FROZEN}, {rounds_sql(ROUNDS_SQL)} SELECT * FROM hub{ROUNDS_SQL}")
def _(v):
    return _settled(v)[1]


def _short(v):
    return quality.short_days(v.events.filter("value > 30 AND event_id % 29 = 0").groupBy("day").agg(F.min(F.col("ts").cast("timestamp")).alias("taken_at")))


_SHORT = "st AS (SELECT day, min(ts) AS taken_at FROM fx_events WHERE value > 30 AND event_id % 29 = 0 GROUP BY day), sl AS (SELECT day, (epoch(date_trunc('second', taken_at)) - epoch(date_trunc('second', lag(taken_at) OVER (ORDER BY taken_at)))) / 3600 AS hours FROM st), short AS (SELECT DISTINCT day FROM sl WHERE hours < 18)"
_LOW = f"""WITH RECURSIVE {_GAPPY_HUB}, {_SHORT}, {facts_sql("", "hub")},
 o AS (SELECT *, count(*) OVER (PARTITION BY series, block) AS c FROM f),
 wf AS (SELECT series, isodow(day) AS wd, median(CASE WHEN med > 0 THEN tot / med END) AS factor FROM o WHERE c = 1 GROUP BY 1, 2),
 x AS (SELECT f.*, med * factor AS exp, EXISTS (SELECT 1 FROM short WHERE short.day = f.day) AS is_short FROM f LEFT JOIN wf ON wf.series = f.series AND wf.wd = isodow(f.day)),
 y AS (SELECT *, sum(CASE WHEN exp IS NOT NULL THEN tot END) OVER (PARTITION BY series, block) AS bt, sum(exp) OVER (PARTITION BY series, block) AS be FROM x),
 z AS (SELECT *, k - row_number() OVER o AS gk, day - CAST(row_number() OVER o AS INTEGER) AS gd FROM y WHERE exp IS NOT NULL AND be > 0 AND bt < 0.7 * be AND k < n - 2 WINDOW o AS (PARTITION BY series ORDER BY day)),
 r AS (SELECT series, gk, gd, min(k) AS k0, max(k) AS k1, sum(exp - tot) AS lost FROM z GROUP BY series, gk, gd HAVING NOT bool_or(is_short)),
 a AS (SELECT r.*, coalesce((SELECT sum(greatest(0, y.tot - y.exp)) FROM y WHERE y.series = r.series AND y.exp IS NOT NULL AND (y.k BETWEEN r.k0 - 3 AND r.k0 - 1 OR y.k BETWEEN r.k1 + 1 AND r.k1 + 3)), 0) AS back FROM r)
 SELECT z.series, z.day, round(CASE WHEN exp > 0 THEN tot / exp END, 6) AS r FROM z JOIN a ON a.series = z.series AND a.gk = z.gk AND a.gd = z.gd WHERE back < 0.5 * lost"""


@entry("dq13_low_days", _LOW)
def _(v):
    hub, snaps = _gappy_hub(v)
    facts = windows.day_facts(hub, hub.select("series", "day", F.lit(None).cast("double").alias("share")).limit(0), 1.0, snaps)
    short = _short(v).select("day").crossJoin(hub.select("series").distinct())
    return windows.low_days(facts, windows.weekday_factor(facts), short)


def _rolled(v):
    """Four series of a year with a rollback that recovers, a lasting correction, and a partial snapshot, each on days of its own."""
    s = v.series.filter("year(day) = 1997").withColumn("series", F.expr(f"CAST({NUMBER} % 4 AS STRING)"))
    d = F.dayofyear("day") + F.expr(f"{NUMBER} % 4")
    s = s.filter(~((d == 40) & (F.expr(NUMBER) % 3 > 0)))
    drop = F.when(d.between(100, 104), F.lit(300)).when(d >= 200, F.lit(200)).otherwise(F.lit(0))
    return s.withColumn("dl_all", F.greatest(F.lit(0), F.col("dl_all") - drop)).select("series", "id", "day", "dl_all")


_ROLLED = f"""c AS (SELECT *, {NUMBER} AS num, CAST({NUMBER} % 4 AS VARCHAR) AS series, dayofyear(day) + {NUMBER} % 4 AS d FROM fx_series WHERE year(day) = 1997),
 s AS (SELECT series, id, day, greatest(0, dl_all - CASE WHEN d BETWEEN 100 AND 104 THEN 300 WHEN d >= 200 THEN 200 ELSE 0 END) AS dl_all FROM c WHERE NOT (d = 40 AND num % 3 > 0)),
 z AS (SELECT series, day, count(*) AS n, row_number() OVER (PARTITION BY series ORDER BY day) AS j FROM s WHERE dl_all IS NOT NULL GROUP BY series, day),
 e AS (SELECT series, j, day, n AS kept, true AS is_whole FROM z WHERE j = 1 UNION ALL SELECT z.series, z.j, z.day, CASE WHEN z.n < 0.5 * kept THEN kept ELSE z.n END, z.n >= 0.5 * kept FROM e JOIN z ON z.series = e.series AND z.j = e.j + 1),
 h AS MATERIALIZED (SELECT series, day, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS p FROM e WHERE is_whole),
 r AS MATERIALIZED (SELECT s.series, id, p, dl_all FROM s JOIN h ON h.series = s.series AND h.day = s.day WHERE dl_all IS NOT NULL),
 b AS MATERIALIZED (SELECT h.series, h.p, coalesce(avg(CASE WHEN x.dl_all < y.dl_all THEN 1 ELSE 0 END) FILTER (y.id IS NOT NULL), 0) AS back FROM h JOIN r x ON x.series = h.series AND x.p = h.p LEFT JOIN r y ON y.series = x.series AND y.id = x.id AND y.p = x.p - 1 GROUP BY h.series, h.p),
 g AS MATERIALIZED (SELECT b.series, b.p AS since, x.p, sum(greatest(0, y.dl_all - x.dl_all)) AS missing FROM b JOIN r y ON y.series = b.series AND y.p = b.p - 1 JOIN r x ON x.series = y.series AND x.id = y.id AND x.p BETWEEN b.p AND b.p + 8 WHERE back > 0.05 GROUP BY ALL),
 v AS (SELECT series, p, CAST(-1 AS BIGINT) AS since, CAST(0 AS DOUBLE) AS first, 'first' AS verdict, CAST(NULL AS BIGINT) AS base FROM h WHERE p = 0 UNION ALL
  SELECT v.series, b.p, CASE WHEN v.since < 0 AND back > 0.05 THEN b.p WHEN v.since < 0 OR coalesce(o.missing, 0) <= 0.1 * first OR b.p - v.since >= 8 THEN -1 ELSE v.since END,
   CASE WHEN v.since < 0 THEN coalesce(n.missing, 0) ELSE first END,
   CASE WHEN v.since < 0 AND back <= 0.05 THEN 'use' WHEN v.since < 0 THEN 'hold' WHEN coalesce(o.missing, 0) <= 0.1 * first THEN 'use' WHEN b.p - v.since >= 8 THEN 'release' ELSE 'hold' END,
   CASE WHEN v.since < 0 AND back <= 0.05 THEN b.p - 1 WHEN v.since >= 0 AND coalesce(o.missing, 0) <= 0.1 * first THEN v.since - 1 WHEN v.since >= 0 AND b.p - v.since >= 8 THEN b.p - 1 END
  FROM v JOIN b ON b.series = v.series AND b.p = v.p + 1 LEFT JOIN g o ON o.series = b.series AND o.since = v.since AND o.p = b.p LEFT JOIN g n ON n.series = b.series AND n.since = b.p AND n.p = b.p),
 x AS (SELECT v.series, v.p, CASE WHEN l.p IS NULL THEN v.verdict ELSE 'release' END AS verdict, CASE WHEN l.p IS NULL THEN v.base ELSE v.p - 1 END AS base FROM v LEFT JOIN v l ON l.series = v.series AND l.verdict = 'release' AND v.p BETWEEN l.p - 8 AND l.p),
 verdicts AS (SELECT x.series, h.day, verdict, k.day AS base FROM x JOIN h ON h.series = x.series AND h.p = x.p LEFT JOIN h k ON k.series = x.series AND k.p = x.base UNION ALL SELECT series, day, 'partial', NULL FROM e WHERE NOT is_whole)"""


@entry("dq2_usable_snapshots", f"WITH RECURSIVE {_ROLLED} SELECT series, day, verdict, base FROM verdicts")
def _(v):
    return verdicts.usable_by_series(_rolled(v))


@entry("dq1_measured", f"WITH RECURSIVE {_ROLLED}, i AS (SELECT a.series, u.base, u.day, split_part(a.id, '/', 1) AS pipeline_tag, sum(greatest(0, a.dl_all - f.dl_all)) AS t FROM verdicts u JOIN s a ON a.series = u.series AND a.day = u.day JOIN s f ON f.series = a.series AND f.id = a.id AND f.day = u.base GROUP BY ALL) SELECT series, CAST(unnest(generate_series(base + 1, day, INTERVAL 1 DAY)) AS DATE) AS day, pipeline_tag, CAST(round_even(t / (day - base), 0) AS BIGINT) AS dl FROM i")
def _(v):
    s = _rolled(v)
    return quality.measured_by_series(s, v.authors.withColumnRenamed("author", "pipeline_tag"), verdicts.usable_by_series(s))
