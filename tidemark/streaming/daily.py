"""The daily run: new snapshot files become all that follows from them, published together.

Two streams, each until its input is read. The first takes a landing folder file by file: a day's rows, the rings of its ids (see
`rings`) and the day's facts, joins of that snapshot with the one before and with those that open falls are measured from. The
second takes facts through the keyed state of `settling`, and publishes verdicts, windows, skip days and the hub, and of the last
day entity metrics, ranks, boards, and author and family series of the months touched. Each batch is one commit of a `Store`, so readers see a day
with all that belongs to it or not at all. A batch that is repeated after a failure finds its mark and leaves the store as it is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import graph, ranks, rings, rollups, series, verdicts, windows
from tidemark.operators.quality import BIG, LEAST_BIG
from tidemark.sources.snapshots import RAW, counters
from tidemark.streaming import settling
from tidemark.streaming.incremental import file_day
from tidemark.streaming.store import Change, Store

FACTS = "series string, day date, at long, body string"
#: One row a landed day: what the next day's facts start from.
DAYS = "series string, day date, n long, whole boolean, back double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def usable_input(today: DataFrame | None, before: DataFrame | None, least: float = 0.5) -> DataFrame | None:
    """Today's input, or the one before where today's is missing or has under half of its rows."""
    if today is None or before is None:
        return before if today is None else today
    return before if today.count() < least * before.count() else today


def pair_facts(rows: DataFrame, pairs: DataFrame, tags: DataFrame, big: int = BIG, least: int = LEAST_BIG) -> DataFrame:
    """(series, day, base, back, frozen, missing, gains) for pairs(series, day, base) of days of rows(series, id, day, dl30, dl_all).

    Over ids counted on both days: the share of counters that fell; of those big on the base day, the share that stood still (null
    under `least` of them); what all are short of the base; and gains by tag, losses as 0. One join by id; the sums of a tag are
    added up before they are gathered.
    """
    counted = rows.filter("dl_all IS NOT NULL").select("series", "id", "day", "dl_all", "dl30")
    base = counted.select("series", "id", F.col("day").alias("base"), F.col("dl_all").alias("b"), F.col("dl30").alias("b30"))
    both = counted.join(F.broadcast(pairs), ["series", "day"]).join(base, ["series", "base", "id"]).join(tags.select("id", "pipeline_tag"), "id", "left")
    more, is_big = F.col("dl_all") - F.col("b"), F.col("b30") >= big
    sums = {"_n": F.count("*"), "_fell": F.count_if(more < 0), "_big": F.count_if(is_big), "_still": F.count_if(is_big & (more == 0)), "_short": F.sum(F.greatest(F.lit(0), -more)), "_gain": F.sum(F.greatest(F.lit(0), more))}
    by_tag = both.groupBy("series", "day", "base", F.coalesce("pipeline_tag", F.lit("other")).alias("pipeline_tag")).agg(*[x.alias(k) for k, x in sums.items()])
    gains = F.map_from_entries(F.collect_list(F.struct("pipeline_tag", "_gain")))
    frozen = F.when(F.sum("_big") >= least, F.sum("_still") / F.sum("_big"))
    return by_tag.groupBy("series", "day", "base").agg((F.sum("_fell") / F.sum("_n")).alias("back"), frozen.alias("frozen"), F.sum("_short").cast("double").alias("missing"), gains.alias("gains"))


class Daily:
    """tags(id, pipeline_tag), authors(id, author), edges(id, parent) or None: the metadata of the day. family: members that a family with a series has at least. big, least: what counts as a big counter, and how many it takes."""

    def __init__(self, spark: SparkSession, folder: str, tags: DataFrame, authors: DataFrame, edges: DataFrame | None = None, least_author: int = 1000, least_frozen: float = 0.25, big: int = BIG, least: int = LEAST_BIG, family: int = 3):
        self.spark, self.folder, self.store = spark, folder, Store(spark, f"{folder}/store")
        self.tags, self.authors, self.edges = tags, authors, edges
        self.least_author, self.least_frozen, self.big, self.least, self.family = least_author, least_frozen, big, least, family

    def run(self, landing: str, kind: str = "models", files: int = 1) -> None:
        """Takes in what has landed, `files` days a commit, and publishes it. What comes of it does not depend on `files`."""
        stream = self.spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).parquet(landing)
        days = counters(stream.withColumn("day", file_day()))
        land = days.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.folder}/landing-{kind}")
        land.foreachBatch(lambda batch, k: self.land(batch, k, kind)).start().awaitTermination()
        self.settle()

    def settle(self) -> None:
        conf, name = self.spark.conf, "spark.sql.streaming.stateStore.providerClass"
        before = conf.get(name)
        conf.set(name, STATE_STORE)
        try:
            facts = self.spark.readStream.schema(FACTS).parquet(f"{self.folder}/facts")
            out = settling.settled(facts, self.least_frozen).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.folder}/settling")
            out.foreachBatch(self.publish).start().awaitTermination()
        finally:
            conf.set(name, before)

    # ---- landing

    def land(self, batch: DataFrame, k: int, kind: str) -> None:
        """One landed file: its day's rows, its rings and the facts that it changes."""
        mark, now = f"landing-{kind}", self.store.reader()
        batch = batch.withColumn("series", F.lit(kind)).persist()
        days = sorted(r.day for r in batch.select("day").distinct().collect())
        if now.marks.get(mark, -1) < k and days:
            change = self.store.begin()
            change.put("series", batch.withColumn("_key", F.concat_ws("~", "series", "day")), "_key")
            self._rings(change, now, batch, days, kind)
            known = self._known(now, kind) | {r.day: (r.n, None) for r in batch.filter("dl_all IS NOT NULL").groupBy("day").agg(F.count("*").alias("n")).collect()}
            self._facts(change, kind, known, *self._affected(known, days), k)
            # The months that the next publishing has to recompute.
            change.marks[f"months-{kind}"] = sorted({*now.marks.get(f"months-{kind}", []), *(f"{d:%Y-%m}" for d in days)})
            change.marks[mark] = k
            change.commit()
        batch.unpersist()

    def _known(self, now, kind: str) -> dict:
        """{day: (rows, share that fell)}: one row a day."""
        return {r.day: (r.n, r.back) for r in now.read("days").filter(F.col("series") == kind).collect()} if now.has("days") else {}

    @staticmethod
    def _affected(known: dict, days: list) -> tuple[list, list]:
        """Days whose facts may change with these, and all whole days: those behind a day, as far as an episode lasts."""
        whole = []
        for d in sorted(known):
            if not whole or known[d][0] >= verdicts.PARTIAL * known[whole[-1]][0]:
                whole.append(d)
        out = set()
        for d in days:
            behind = [x for x in sorted(known) if x >= d]
            last = [x for x in whole if x >= d][: verdicts.MOST_HELD + 2]
            out |= {x for x in behind if not last or x <= last[-1]}
        return sorted(out), whole

    def _facts(self, change: Change, kind: str, known: dict, changed: list, whole: list, k: int) -> None:
        """Facts of days against the whole day before, then against those that falls of the last days are measured from, where there are any."""
        place = {d: p for p, d in enumerate(whole)}
        todo = [d for d in changed if place.get(d)]
        near = [(kind, d, whole[place[d] - 1]) for d in todo]
        pairs = self._pairs(change, near)
        back = {d: b for d, (_, b) in known.items()} | {r.day: r.back for r in pairs}
        far = []
        for d in todo:
            p = place[d]
            far += [(kind, d, whole[q - 1]) for q in range(max(1, p - verdicts.MOST_HELD), p) if (back.get(whole[q]) or 0.0) > verdicts.BACK]
        pairs += self._pairs(change, far)
        bodies = {d: {"n": known[d][0], "pairs": {}} for d in changed}
        for r in pairs:
            bodies[r.day]["pairs"][r.base.isoformat()] = {"back": r.back, "frozen": r.frozen, "missing": r.missing, "gains": dict(r.gains)}
        fresh = self.spark.createDataFrame([(kind, d, known[d][0], d in place, back.get(d)) for d in changed], DAYS)
        change.put("days", fresh.withColumn("_key", F.concat_ws("~", "series", "day")), "_key")
        # A repeated batch tells them again, which changes nothing.
        rows = self.spark.createDataFrame([(kind, d, k, json.dumps(b)) for d, b in bodies.items()], FACTS)
        rows.coalesce(1).write.mode("append").parquet(f"{self.folder}/facts")

    def _pairs(self, change: Change, pairs: list) -> list:
        if not pairs:
            return []
        wanted = sorted({f"{s}~{d}" for s, *ds in pairs for d in ds})
        rows = change.reader().read("series", wanted)
        return pair_facts(rows, self.spark.createDataFrame(pairs, "series string, day date, base date"), self.tags, self.big, self.least).collect()

    def _rings(self, change: Change, now, batch: DataFrame, days: list, kind: str) -> None:
        key = f"rings-{kind}"
        landed = [k.split("~")[1] for k in now.keys("series") if k.startswith(f"{kind}~")]
        last = max([*landed, *map(str, days)])
        new = rings.rings_of(batch.drop("series"), last)
        if now.has(key):
            new = rings.merge(now.read(key), new, last, [d for d in days if str(d) in landed])
        change.put(key, new)

    # ---- publishing

    def publish(self, batch: DataFrame, k: int) -> None:
        """What the state has told, and of the last day what follows from it."""
        now = self.store.reader()
        if now.marks.get("settling", -1) >= k:
            return
        batch.persist()
        change = self.store.begin()
        floors = batch.filter("kind = 'floor'").select("series", F.col("day").alias("floor"))
        told = batch.filter("kind IN ('verdict', 'window')").select("series", "kind", "day", "at", "verdict", "base", F.monotonically_increasing_id().alias("n"))
        if now.has("told"):
            old = now.read("told").join(F.broadcast(floors.withColumn("again", F.lit(True))), "series", "left")
            told = old.filter("again IS NULL OR at <= floor").select(told.columns).unionByName(told)
        change.put("told", told)
        for name, columns in (("hub", ["series", "day", "pipeline_tag", "dl"]), ("skip", ["series", "day"])):
            new = batch.filter(F.col("kind") == name).select(columns).distinct()
            if now.has(name):
                # The open days of a series are told as they stand: what was told of them before goes.
                since = batch.filter("kind = 'hub'").groupBy("series").agg(F.min("day").alias("since"))
                kept = now.read(name).join(F.broadcast(since), "series", "left").filter("since IS NULL OR day < since").select(columns)
                new = kept.unionByName(new.join(kept, ["series", "day"], "left_anti"))
            change.put(name, new)
        change.marks["settling"] = k
        for kind in sorted(r.series for r in floors.distinct().collect()):
            self._derived(change, now, kind, batch.filter((F.col("kind") == "skip") & (F.col("series") == kind)).select("day"))
        change.commit()
        batch.unpersist()

    def _derived(self, change: Change, now, kind: str, skip: DataFrame) -> None:
        """Of the last day metrics, ranks and boards; of the months of days that have landed since, author and family series."""
        last = max(k for k in now.keys("series") if k.startswith(f"{kind}~")).split("~")[1]
        table = rings.metrics(now.read(f"rings-{kind}"), last, skip).join(self.tags.select("id", "pipeline_tag"), "id", "left")
        table = ranks.rank_within(ranks.global_rank(table, "dl30", "rank_dl30"), "pipeline_tag", "dl30", "rank_task")
        change.put(f"entities-{kind}", table)
        for column in ("dl30", "dl_all", "dl_7d", "likes"):
            change.put(f"board-{kind}-{column}", ranks.top(table, column, 100))
        months = now.marks.get(f"months-{kind}", [])
        pairs = roots = None
        if self.edges is not None and months:
            pairs = graph.closure(self.edges)
            roots = pairs.groupBy("anc").agg(F.count("*").alias("members")).filter(F.col("members") >= self.family).select("anc")
            pairs = pairs.join(roots, "anc", "left_semi")
        for month in months:
            rows = now.read("series", [k for k in now.keys("series") if k.startswith(f"{kind}~{month}")]).drop("series", "_key")
            change.put(f"authors-{kind}", rollups.author_series(rows, self.authors, self.least_author).withColumn("month", F.lit(month)), "month")
            if pairs is not None:
                change.put(f"families-{kind}", graph.family_series(pairs, rows, roots).withColumn("month", F.lit(month)), "month")
        change.marks[f"months-{kind}"] = []

    # ---- reading

    def verdicts(self, reader=None) -> DataFrame:
        """(series, day, verdict, base): the last that was told of each day."""
        told = (reader or self.store.reader()).read("told").filter("kind = 'verdict'")
        return told.groupBy("series", "day").agg(F.max_by(F.struct("verdict", "base"), F.struct("at", "n")).alias("v")).select("series", "day", "v.*")

    def windows(self, reader=None) -> DataFrame:
        return (reader or self.store.reader()).read("told").filter("kind = 'window'").select("series", F.col("day").alias("start"), F.col("base").alias("end"))

    def low_days(self, short: DataFrame, reader=None) -> DataFrame:
        """(series, day, r): low days of the hub as it stands; short(series, day)."""
        reader = reader or self.store.reader()
        snaps = reader.read("days").filter("whole").select("series", "day")
        facts = windows.day_facts(reader.read("hub"), snaps.select("series", "day", F.lit(None).cast("double").alias("share")).limit(0), 1.0, snaps)
        return windows.low_days(facts, windows.weekday_factor(facts), short)
