"""The daily run: in how many runs days come, days that come again, runs that die; the state's bounds; rings; publishing."""

import json
import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import rings, series, verdicts
from tidemark.streaming import daily, settling
from tidemark.streaming.store import Conflict, Store

D = date(2025, 1, 25)
IDS = [f"a{i}/r{i}" for i in range(6)]


def day(k):
    return D + timedelta(k)


def land(folder, k, values, delivery=""):
    folder.mkdir(exist_ok=True)
    pd.DataFrame({"id": IDS[: len(values)], "downloads": 50, "downloadsAllTime": values, "likes": k}).to_parquet(folder / f"{day(k)}{delivery}.parquet")


def history(n=14, seed=3):
    """Totals by day: a stall made up later, a rollback that recovers, a partial snapshot, a missing day."""
    r, total, out = random.Random(seed), [1000 * (i + 1) for i in range(6)], {}
    for k in range(n):
        rate = {5: 0, 6: 3}.get(k, 1)
        total = [t + int(rate * (100 + r.randrange(9))) for t in total]
        if k != 3:
            out[k] = [t - 700 for t in total] if k in (9, 10) else total[:2] if k == 12 else total
    return out


def make(spark, folder, families=False):
    tags = spark.createDataFrame([(i, "t" if k % 2 else "u") for k, i in enumerate(IDS)], "id string, pipeline_tag string")
    authors = spark.createDataFrame([(i, i.split("/")[0]) for i in IDS], "id string, author string")
    edges = spark.createDataFrame([(IDS[k], IDS[0]) for k in (1, 2, 3)], "id string, parent string")
    return daily.Daily(spark, str(folder), tags, authors, edges if families else None, least_author=1, big=10, least=3)


def tables(run):
    r = run.store.reader()
    skip = lambda df: sorted(str(sorted(x.asDict().items())) for x in df.collect())
    return {"verdicts": skip(run.verdicts(r)), "windows": skip(run.windows(r).distinct())} | {t: skip(r.read(t)) for t in sorted(r.tables) if t != "told"}


@pytest.fixture(scope="module")
def slow(spark, tmp_path_factory):
    """A history taken in day by day."""
    base = tmp_path_factory.mktemp("slow")
    run = make(spark, base / "out", families=True)
    for k, v in history().items():
        land(base / "in", k, v)
        if k in (0, 1, 6, 9, 13):
            run.run(str(base / "in"), files=1 if k < 2 else 3)
    return base, run


def test_days_one_by_one_equal_all_at_once(spark, tmp_path, slow):
    for k, v in reversed(history().items()):  # file order need not be day order
        land(tmp_path / "in", k, v)
    fast = make(spark, tmp_path / "out", families=True)
    fast.run(str(tmp_path / "in"), files=20)
    want, got = tables(slow[1]), tables(fast)
    assert got == want
    said = {(r.day - D).days: r.verdict for r in fast.verdicts().collect()}
    assert said == {k: {0: "first", 9: "hold", 10: "hold", 12: "partial"}.get(k, "use") for k in history()}
    assert sorted(((r.start - D).days, (r.end - D).days) for r in fast.windows().distinct().collect()) == [(5, 6), (9, 11)]


def test_the_state_agrees_with_the_batch_operators(spark, slow):
    """Verdicts as `verdicts.usable_by_series` has them, metrics as `series.metrics` has them, with the skip days of the run."""
    r = slow[1].store.reader()
    rows = r.read("series")
    assert sorted(map(tuple, slow[1].verdicts(r).collect())) == sorted(map(tuple, verdicts.usable_by_series(rows).collect()))
    want = series.metrics(rows, r.read("skip"))
    assert sorted(map(str, r.read("entities-models").select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_day_that_comes_again_counts(spark, tmp_path, slow):
    """The rolled-back days come again, sound: all is as if they had come so at first."""
    base, run = slow
    sound = {k: [v + 700 for v in history()[k]] for k in (9, 10)}
    for k, v in sound.items():
        land(base / "in", k, v, ".2")
    run.run(str(base / "in"), files=2)
    for k, v in (history() | sound).items():
        land(tmp_path / "in", k, v)
    fresh = make(spark, tmp_path / "out", families=True)
    fresh.run(str(tmp_path / "in"), files=20)
    assert tables(run) == tables(fresh)
    assert {r.verdict for r in fresh.verdicts().filter(F.col("day").isin(day(9), day(10))).collect()} == {"use"}


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    run = make(spark, tmp_path / "out")
    for k in range(3):
        land(tmp_path / "in", k, history()[k])
    run.run(str(tmp_path / "in"), files=9)
    before, reader = tables(run), run.store.reader()
    for k in (4, 5):
        land(tmp_path / "in", k, history()[k])
    put = daily.Change.put

    def dies(self, name, df, by=None):
        if name in ("days", "hub"):
            raise OSError("lost")
        put(self, name, df, by)

    monkeypatch.setattr(daily.Change, "put", dies)
    with pytest.raises(Exception, match="lost"):
        run.run(str(tmp_path / "in"), files=9)
    assert tables(run) == before
    monkeypatch.undo()
    run.run(str(tmp_path / "in"), files=9)
    again = make(spark, tmp_path / "again")
    again.run(str(tmp_path / "in"), files=9)
    assert tables(run) == tables(again) != before
    # A reader stays with its version until that is expired; folders of the run that died go with it.
    assert reader.read("series").count() == 18
    assert run.store.expire(1) and len(run.store.versions()) == 1
    assert tables(run) == tables(again)


def test_of_two_writers_one_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    a, b = store.begin(), store.begin()
    a.put("t", spark.range(3), None)
    b.put("t", spark.range(4), None)
    assert a.commit() == 1
    with pytest.raises(Conflict):
        b.commit()
    assert store.read("t").count() == 3
    c = store.begin()
    c.put("p", spark.range(6).withColumn("k", F.col("id") % 3), "k")
    c.commit()
    d = store.begin()
    d.put("p", spark.range(100, 101).withColumn("k", F.lit(1).cast("long")), "k")
    d.drop("p", [2])
    d.commit()
    assert sorted(r.id for r in store.read("p").collect()) == [0, 3, 100]
    assert sorted(r.id for r in store.reader(2).read("p").collect()) == list(range(6))
    assert [r.id for r in store.reader().read("p", [1]).collect()] == [100]


def facts_of(n, seed):
    """Facts of n days of one series, as `daily` makes them."""
    r, out, days = random.Random(seed), {}, []
    for k in range(n):
        if r.random() < 0.1:
            continue
        d = day(k).isoformat()
        pairs = {}
        for base in days[-10:]:
            fall = r.random() < 0.03
            gap = (date.fromisoformat(d) - date.fromisoformat(base)).days
            level = 1000 * gap * r.choice([1, 1, 1, 1, 1, 0.04, 0.5, 1.6, 2])
            pairs[base] = {"back": 0.2 if fall else 0.01, "frozen": r.choice([0.0, 0.1, 0.1, 0.1, 0.9]), "missing": r.choice([10.0, 500.0, 5000.0]), "gains": {"t": int(level), "u": int(level / 7)}}
        out[d] = {"n": r.choice([100, 100, 100, 100, 40]) if k else 100, "pairs": pairs}
        days.append(d)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_what_the_state_forgets_decides_nothing(seed):
    """A state that keeps some weeks tells the same as one that keeps all days, in whatever batches these come."""
    facts = facts_of(260, seed)
    whole = settling.fold(settling.start(), facts, sorted(facts), 0.25, 10_000)
    state, told, hub, skip = {"floor": "", "base": settling.start(), "facts": {}}, [], {}, set()
    days, r = sorted(facts), random.Random(seed)
    while days:
        n = r.choice([1, 1, 1, 2, 7, 60])
        some, days = days[:n], days[n:]
        floor = state["floor"]
        state, now, late = settling.advance(json.loads(json.dumps(state)), {d: facts[d] for d in some}, 0.25)
        told = [x for x in told if x["at"] <= floor] + [x for x in now["log"] if x["kind"] in ("verdict", "window")]
        new = {x["day"]: x["tags"] for x in now["log"] if x["kind"] == "hub"} | now["hub"]
        since = min(new, default="")
        hub = {d: v for d, v in hub.items() if d < since} | new
        assert not late and len(state["facts"]) < 80
    assert told == [x for x in whole["log"] if x["kind"] in ("verdict", "window")]
    assert hub == whole["hub"] and any(x["kind"] == "window" for x in told)


def test_rings_grow_day_by_day(spark):
    r = random.Random(2)
    rows = [(f"o/{i}", day(k), r.randrange(100), 1000 * i + 40 * k + r.randrange(30), r.randrange(9)) for i in range(9) for k in range(80) if r.random() < 0.8 and k >= 9 * i and not (i == 4 and k > 70)]
    s = spark.createDataFrame(rows, "id string, day date, dl30 long, dl_all long, likes long")
    skip = spark.createDataFrame([(day(72),), (day(78),)], "day date")
    kept = rings.rings_of(s.filter(F.col("day") <= day(76)), day(76))
    for k in (77, 78, 79):
        kept = rings.merge(kept, rings.rings_of(s.filter(F.col("day") == day(k)), day(k)), day(k))
    kept.cache()
    assert kept.select(F.max(F.size("ring"))).first()[0] <= rings.KEPT + 1
    for out in (None, skip):
        want = series.metrics(s, out)
        assert sorted(map(str, rings.metrics(kept, day(79), out).collect())) == sorted(map(str, want.collect()))
    again = spark.createDataFrame([("o/0", day(75), 1, 5, 0)], s.schema)
    ring = {r.id: {x.day: x.dl_all for x in r.ring} for r in rings.merge(kept, rings.rings_of(again, day(75)), day(79), [day(75)]).collect()}
    assert ring["o/0"][day(75)] == 5 and not any(day(75) in x for i, x in ring.items() if i != "o/0")


def test_fallback_to_the_input_before(spark):
    ten, four, six = spark.range(10), spark.range(4), spark.range(6)
    assert daily.usable_input(four, ten) is ten and daily.usable_input(six, ten) is six and daily.usable_input(None, ten) is ten and daily.usable_input(four, None) is four
