"""Ranks, quantiles, bands and trees: no task holds a group."""

import random

from pyspark.sql import functions as F

from tidemark.operators import galaxy, graph, identity, ranks, report
from tidemark.plans.staging import running_by

R = random.Random(8)


def test_running_sums_of_many_groups_and_one_large(spark):
    rows = [("hot" if k % 3 else R.choice(["a", "b", None]), k, R.randrange(5)) for k in range(3000)]
    got = running_by(spark.createDataFrame(rows, "g string, k long, s long").repartition(7), ["g"], "k", "s").collect()
    sums = {}
    for g, k, s in sorted(rows, key=lambda r: r[1]):
        sums[g, k] = sums.get(("", g), 0)
        sums["", g] = sums[g, k] + s
    assert len(got) == 3000 and all(r.before == sums[r.g, r.k] for r in got)


def test_ranks_within_a_hot_group_and_ties(spark):
    rows = [(k, None if k % 3 else R.choice("ab"), R.choice([None, 0, 0, 0, R.randrange(50)])) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    got = {r.id: r.r for r in ranks.rank_within(df, "g", "v", "r").collect()}
    for k, g, v in rows:
        assert got[k] == (None if v is None else 1 + sum(x[1] == g and x[2] is not None and x[2] > v for x in rows))
    # Nothing is sorted by group: the plan's windows go by range.
    plan = ranks.rank_within(df, "g", "v", "r")._jdf.queryExecution().executedPlan().toString()
    assert "rank(" not in plan
    average = {r.id: r.r for r in ranks.global_rank(df, "v", "r", average=True).collect()}
    values = sorted((x[2] for x in rows if x[2] is not None), reverse=True)
    places = {v: [p + 1 for p, x in enumerate(values) if x == v] for v in set(values)}
    assert all(average[k] == (None if v is None else sum(places[v]) / len(places[v])) for k, _, v in rows)


def test_weighted_quantiles(spark):
    rows = [(R.choice(["x", "x", "x", None, "y"]), R.choice([None, R.randrange(20)]), R.choice([0, None, 1, 5, 40])) for _ in range(800)] + [("zero", 3, 0), ("one", 7, 2)]
    got = {r.g: r for r in report.weighted_quantiles(spark.createDataFrame(rows, "g string, v long, w long"), ["g"], "v", "w", {"low": 0.1, "mid": 0.5, "all": 1.0}).collect()}
    assert set(got) == {"x", "y", None, "one"}
    for g, r in got.items():
        each = sorted(v for a, v, w in rows if a == g and v is not None for _ in range(w or 0))
        pick = lambda q: next(v for k, v in enumerate(each) if k + 1 >= q * len(each))
        assert (r.low, r.mid, r["all"]) == (pick(0.1), pick(0.5), each[-1]) and abs(r["mean"] - sum(each) / len(each)) < 1e-9


def test_renames_of_one_owner_meet_in_bands(spark):
    """One owner renames thousands: the same candidates as all pairs have, while no key of the join holds more than a few."""
    counts = [int(1000 * 1.012**k) + R.randrange(3) for k in range(1200)]
    prev = [(f"own/a{k}", c) for k, c in enumerate(counts)] + [("x/same", 5000), ("own/under", 999), ("own/stays", 10)]
    cur = [(f"own/b{k}", c + c // 200) for k, c in enumerate(counts)] + [("y/Same", 5040), ("own/over", 1008), ("own/stays", 10), ("own/far", 10**15)]
    gone, came = (spark.createDataFrame(x, "id string, dl_all long") for x in (prev, cur))
    got = sorted(map(tuple, identity.rename_candidates(gone, came).collect()))
    alike = lambda a, b: a.split("/")[0] == b.split("/")[0] or a.split("/")[1].lower() == b.split("/")[1].lower()
    kept = {i for i, _ in prev} & {i for i, _ in cur}
    want = sorted((a, b) for a, c in prev for b, d in cur if c >= 1000 and d >= 990 and alike(a, b) and abs(d - c) <= 0.01 * c and not {a, b} & kept)
    assert got == want and len(want) > 1200


def test_trees_by_intervals(spark):
    edges = [(k, R.randrange(max(1, k // 3))) for k in range(1, 300)] + [(k, R.randrange(k)) for k in range(20, 300, 7)]
    edges = sorted({(a, b) for a, b in edges if a != b})
    sizes = spark.createDataFrame([(k, R.randrange(9)) for k in range(300)], "id long, dl30 long")
    nodes = graph.galaxy(spark.createDataFrame(edges, "id long, parent long"), sizes, spark.createDataFrame([(0,), (3,), (299,)], "root long"))
    up = {(r.root, r.id): r.parent for r in nodes.collect()}
    below = dict.fromkeys(up, 0)
    above = {}
    for root, x in up:
        line, y = [], up[root, x]
        while y is not None:
            below[root, y] += 1
            line.append(y)
            y = up[root, y]
        above[root, x] = line
    got = {(r.root, r.id): r for r in graph.intervals(nodes).collect()}
    assert {k: r.below for k, r in got.items()} == below
    for root in (0, 3, 299):
        assert sorted(r.pre for k, r in got.items() if k[0] == root) == list(range(sum(k[0] == root for k in up)))
    picks = [(root, x) for root, x in up if x % 11 == 0]
    found = sorted(map(tuple, galaxy.focus(nodes, spark.createDataFrame(picks, "root long, pick long")).collect()))
    want = [(r, p, x, "below") for r, p in picks for q, x in up if q == r and p in above[r, x]] + [(r, p, x, "above") for r, p in picks for x in above[r, p] if x != r]
    assert found == sorted(want)


def test_a_galaxy_ends_at_its_cap(spark):
    edges = spark.range(1, 200).select(F.col("id"), F.floor((F.col("id") - 1) / 3).cast("long").alias("parent"))
    sizes = spark.range(200).select("id", (F.col("id") % 7).alias("dl30"))
    roots = spark.createDataFrame([(0,), (50,)], "root long")
    whole = [r for r in graph.galaxy(edges, sizes, roots).collect()]
    got = graph.galaxy(edges, sizes, roots, cap=20).collect()
    for root in (0, 50):
        best = sorted((r.depth, -r.dl30, r.id) for r in whole if r.root == root)[:20]
        assert sorted((r.depth, -r.dl30, r.id) for r in got if r.root == root) == best


def test_a_closure_follows_edits(spark):
    """After random edits, cycles and diamonds among them, counts of paths and pairs are those from scratch."""
    edges = {(R.randrange(40), R.randrange(40)) for _ in range(55)}
    edges = {e for e in edges if e[0] != e[1]}
    df = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    kept = graph.paths(df(edges, "id long, parent long"))
    for _ in range(2):
        gone = set(R.sample(sorted(edges), 5))
        come = {e for e in ((R.randrange(40), R.randrange(40)) for _ in range(6)) if e[0] != e[1]} - edges
        now = (edges - gone) | come
        changes = graph.path_changes(kept, df(now, "id long, parent long"), df([(*e, 1) for e in come] + [(*e, -1) for e in gone], "id long, parent long, sign int"))
        turned = {(r.id, r.anc): r.change for r in graph.changed_pairs(kept, changes).collect()}
        pairs = [{tuple(r) for r in graph.closure(df(e, "id long, parent long")).select("id", "anc").collect()} for e in (edges, now)]
        assert turned == {p: 1 for p in pairs[1] - pairs[0]} | {p: -1 for p in pairs[0] - pairs[1]} and turned
        after = sorted(map(tuple, graph.with_changes(kept, changes).collect()))
        kept, edges = graph.paths(df(now, "id long, parent long")), now
        assert after == sorted(map(tuple, kept.collect()))
