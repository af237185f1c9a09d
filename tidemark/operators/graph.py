"""Lineage: edges parent to child, closures, families, galaxies and lineages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.staging import cut, dealt

HOPS, LEVELS, CAP = 7, 8, 50_000
RELATIONS = ("quantized", "finetune", "adapter", "merge")


def edges_of(entities: DataFrame) -> DataFrame:
    """(id, parent) from a list column; no self loops, no nulls."""
    return entities.select("id", F.explode("base_ids").alias("parent")).filter("parent IS NOT NULL AND parent <> id").distinct()


def closure(edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """Distinct (id, anc) over up to `hops` edges; no id is its own ancestor. Each round is cut, and an empty one ends it."""
    step = cut(edges.filter("id <> parent").select("id", F.col("parent").alias("anc")).distinct())
    known, front = step, step
    for _ in range(hops - 1):
        up = front.join(step.select(F.col("id").alias("anc"), F.col("anc").alias("next")), "anc").select("id", F.col("next").alias("anc")).filter("id <> anc").distinct()
        front = cut(up.join(known, ["id", "anc"], "left_anti"))
        if front.isEmpty():
            break
        known = cut(known.unionByName(front))
    return known


def whole_closure(edges: DataFrame) -> DataFrame:
    """Distinct (id, anc) over any number of edges; no id is its own ancestor. Each round doubles the paths: the longest of those known go on by all of them."""
    known, longest = cut(edges.filter("id <> parent").select("id", F.col("parent").alias("anc")).distinct().withColumn("hops", F.lit(1))), 1
    while True:
        up = known.select(F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("hops").alias("more"))
        on = known.filter(F.col("hops") == longest).join(up, "anc").filter("id <> next").groupBy("id", F.col("next").alias("anc")).agg((F.min("more") + longest).alias("hops"))
        new = cut(on.join(known, ["id", "anc"], "left_anti"))
        if new.isEmpty():
            return known.select("id", "anc")
        known, longest = cut(known.unionByName(new)), 2 * longest


SUMS = ("dl30", "dl_all", "dl_7d")


def paths(edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """(id, anc, hops, n): how many ways of so many hops lead from id to anc; the pairs of unlike ids are the closure."""
    level = cut(edges.groupBy("id", F.col("parent").alias("anc")).agg(F.count("*").alias("n")))
    out = level.withColumn("hops", F.lit(1))
    for k in range(2, hops + 1):
        step = level.select("id", F.col("anc").alias("_mid"), "n").join(edges.select(F.col("id").alias("_mid"), F.col("parent").alias("anc")), "_mid")
        level = cut(step.groupBy("id", "anc").agg(F.sum("n").alias("n")))
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("hops", F.lit(k)))
    return out.select("id", "anc", "hops", "n")


def path_changes(old: DataFrame, edges: DataFrame, delta: DataFrame, hops: int = HOPS) -> DataFrame:
    """(id, anc, hops, n): by how much the numbers of paths `old` change when delta(id, parent, sign) has led to `edges`.

    A longer path changes by its first part, or keeps that and changes by its last edge. Both joins begin with what has changed, so
    the work goes with the change and not with the graph. Counts, unlike pairs, can be taken away again: a pair is lost when its
    last path is.
    """
    edge = edges.select(F.col("id").alias("_mid"), F.col("parent").alias("anc"))
    moved = delta.select(F.col("id").alias("_mid"), F.col("parent").alias("anc"), "sign")
    level = cut(delta.groupBy("id", F.col("parent").alias("anc")).agg(F.sum("sign").cast("long").alias("n")).filter("n <> 0"))
    out = level.withColumn("hops", F.lit(1))
    for k in range(2, hops + 1):
        by_first = level.select("id", F.col("anc").alias("_mid"), "n").join(edge, "_mid").select("id", "anc", "n")
        by_last = old.filter(F.col("hops") == k - 1).select("id", F.col("anc").alias("_mid"), "n").join(moved, "_mid").select("id", "anc", (F.col("n") * F.col("sign")).alias("n"))
        level = cut(by_first.unionByName(by_last).groupBy("id", "anc").agg(F.sum("n").alias("n")).filter("n <> 0"))
        out = out.unionByName(level.withColumn("hops", F.lit(k)))
    return out.select("id", "anc", "hops", "n")


def changed_pairs(old: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, anc, change): pairs that the changes of paths gain (1) or lose (-1); only pairs that changed are looked up."""
    of = old.join(changes.select("id", "anc").distinct(), ["id", "anc"], "left_semi").groupBy("id", "anc").agg(F.sum("n").alias("_old"))
    new = changes.groupBy("id", "anc").agg(F.sum("n").alias("_more")).join(of, ["id", "anc"], "left").withColumn("_old", F.coalesce("_old", F.lit(0)))
    change = (F.col("_old") + F.col("_more") > 0).cast("int") - (F.col("_old") > 0).cast("int")
    return new.filter("id <> anc").select("id", "anc", change.alias("change")).filter("change <> 0")


def with_changes(old: DataFrame, changes: DataFrame) -> DataFrame:
    """The numbers of paths after changes."""
    return old.unionByName(changes).groupBy("id", "anc", "hops").agg(F.sum("n").alias("n")).filter("n <> 0")


def family_stats(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Per ancestor: members, sums of what entities have of SUMS (0 where nothing is known) and members by relation."""
    m = pairs.join(entities, "id")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_desc") for c in SUMS if c in entities.columns]
    counts = [F.count_if(F.col("base_relation") == r).alias(f"n_{r}") for r in RELATIONS]
    return m.groupBy("anc").agg(F.count("*").alias("members"), *sums, *counts)


def family_totals(stats: DataFrame, entities: DataFrame) -> DataFrame:
    """Families with the root itself: sums, the share of downloads that derivatives have, and the share of each relation among members."""
    sums = [c for c in SUMS if c in entities.columns]
    e = entities.select(F.col("id").alias("anc"), *sums).join(stats, "anc")
    e = e.withColumns({f"fam_{c}": F.col(c) + F.coalesce(f"{c}_desc", F.lit(0)) for c in sums})
    mix = {f"mix_{r}": F.round(F.col(f"n_{r}") / F.col("members"), 6) for r in RELATIONS}
    return e.withColumns({"derived_share": F.round(F.when(F.col("fam_dl30") > 0, 1 - F.col("dl30") / F.col("fam_dl30")), 6)} | mix)


#: Ids of a family, about, that are summed together before the rest, and the number of a day that is not known, long before all dates.
MEMBERS, NO_DAY = 1000, -1_000_000_000


def family_series(pairs: DataFrame, series: DataFrame, roots: DataFrame, tasks: int | None = None) -> DataFrame:
    """Series of each family with its root: sums keep null when nothing is known. `tasks` is how many tasks families are dealt over.

    Each row moves the sums of its id up on its day and down on the next one; moves that cancel are gone before an id goes, once a
    year with its moves as arrays, to a part of one family, where ids that share families meet. They are summed there for all their
    families, then those sums by family. Sums of moves hold until a family's next one, on the days that have members. The family an
    id goes to is its smallest of more than MEMBERS, in a part together with its largest of at most so many, or else that one.
    """
    both = pairs.select("id", "anc").unionByName(roots.select(F.col("anc").alias("id"), "anc")).distinct()
    sized = both.join(both.groupBy("anc").agg(F.count("*").alias("size")), "anc").withColumn("s", F.struct("size", "anc"))
    small, large = F.max(F.when(F.col("size") <= MEMBERS, F.col("s"))), F.min(F.when(F.col("size") > MEMBERS, F.col("s")))
    homes = sized.groupBy("id").agg(small.alias("small"), large.alias("large"), F.collect_list("anc").alias("above"))
    parts = F.ceil(F.coalesce("large.size", F.lit(1)) / MEMBERS)
    homes = homes.select("id", F.coalesce("large.anc", "small.anc").alias("anc"), F.pmod(F.xxhash64(F.coalesce("small.anc", "id")), parts).alias("part"), "above")
    sums = ["members", "known30", "dl30", "known_all", "dl_all"]
    of = [F.lit(1), F.col("dl30").isNotNull(), F.coalesce("dl30", F.lit(0)), F.col("dl_all").isNotNull(), F.coalesce("dl_all", F.lit(0))]
    rows = series.select("id", F.coalesce(F.unix_date("day"), F.lit(NO_DAY)).alias("day"), *[c.cast("long").alias(n) for c, n in zip(of, sums)])
    turns = F.array(F.struct("day", *sums), F.struct((F.col("day") + 1).alias("day"), *[(-F.col(c)).alias(c) for c in sums]))
    moves = rows.select("id", F.inline(turns)).groupBy("id", "day").agg(*[F.sum(c).alias(c) for c in sums]).filter(" OR ".join(f"{c} <> 0" for c in sums))
    lists = moves.groupBy("id", F.floor(F.col("day") / 366).alias("year")).agg(F.collect_list(F.struct("day", *sums)).alias("m"))
    lists = lists.select("id", "year", *[F.col(f"m.{c}").alias(c) for c in ("day", *sums)])
    sent = dealt(lists.join(homes, "id").drop("id"), tasks, "anc", "part", "year")
    sent = sent.select(F.col("anc").alias("home"), "part", "year", F.explode("above").alias("anc"), "day", *sums)
    each = sent.select("home", "part", "year", "anc", F.inline(F.arrays_zip("day", *sums))).groupBy("home", "part", "year", "anc", "day").agg(*[F.sum(c).alias(c) for c in sums])
    each = dealt(each, tasks, "anc").groupBy("anc", "day").agg(*[F.sum(c).alias(c) for c in sums])
    w = W.partitionBy("anc").orderBy("day")
    held = each.select("anc", "day", F.lead("day").over(w).alias("until"), *[F.sum(c).over(w).alias(c) for c in sums]).filter("members > 0")
    days = held.select("anc", F.explode(F.sequence("day", F.col("until") - 1)).alias("day"), *sums)
    date = F.when(F.col("day") != NO_DAY, F.date_from_unix_date("day")).alias("day")
    return days.select("anc", date, F.when(F.col("known30") > 0, F.col("dl30")).alias("dl30"), F.when(F.col("known_all") > 0, F.col("dl_all")).alias("dl_all"), "members")


def outermost(families: DataFrame, pairs: DataFrame, n: int = 300) -> DataFrame:
    """Biggest families that lie in no other one of the biggest."""
    best = families.orderBy(F.col("fam_dl30").desc_nulls_last(), "anc").limit(n).select("anc", "fam_dl30")
    inner = pairs.join(F.broadcast(best.select(F.col("anc").alias("id"))), "id", "left_semi").join(F.broadcast(best.select("anc")), "anc", "left_semi")
    return best.join(inner.select(F.col("id").alias("anc")).distinct(), "anc", "left_anti")


def galaxies(families: DataFrame, edges: DataFrame, least: int = 50, n: int = 20) -> DataFrame:
    """Families of enough members whose root has no base of its own."""
    roots = families.filter(F.col("members") >= least).join(edges.select(F.col("id").alias("anc")).distinct(), "anc", "left_anti")
    return roots.orderBy(F.col("members").desc(), "anc").limit(n)


def children(edges: DataFrame, entities: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("parent").orderBy(F.col("dl30").desc_nulls_last(), "id")
    return edges.join(entities, "id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def galaxy(edges: DataFrame, entities: DataFrame, roots: DataFrame, levels: int = LEVELS, cap: int = CAP) -> DataFrame:
    """(root, id, parent, depth): each node once a root, at its shallowest level, under the parent with most downloads then the smallest id.

    The cap is the feature: the shallowest levels first, the biggest nodes within the last of them.
    """
    sizes = cut(entities.select("id", F.coalesce("dl30", F.lit(0)).alias("dl30")))
    front = cut(roots.select("root", F.col("root").alias("id"), F.lit(None).cast(dict(edges.dtypes)["parent"]).alias("parent"), F.lit(0).alias("depth")))
    seen = front
    by_parent = cut(edges.select("id", "parent").filter("id <> parent"))
    for depth in range(1, levels + 1):
        up = front.select("root", F.col("id").alias("parent")).join(by_parent, "parent")
        up = up.join(sizes.select(F.col("id").alias("parent"), F.col("dl30").alias("_p")), "parent", "left").join(seen.select("root", "id"), ["root", "id"], "left_anti")
        w = W.partitionBy("root", "id").orderBy(F.col("_p").desc_nulls_last(), "parent")
        front = cut(up.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("root", "id", "parent", F.lit(depth).alias("depth")))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
        # A root whose nodes reach the cap needs no deeper level.
        front = front.join(seen.groupBy("root").count().filter(F.col("count") >= cap), "root", "left_anti")
    w = W.partitionBy("root").orderBy("depth", F.col("dl30").desc(), "id")
    return seen.join(sizes, "id", "left").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap).drop("_n")


def generations(nodes: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(root, generation, n) of a galaxy's nodes below the root, the fourth and later together; with entities(id, base_relation) also their numbers by relation."""
    below = nodes.filter("depth > 0")
    counts = []
    if entities is not None:
        below = below.join(entities.select("id", "base_relation"), "id", "left")
        counts = [F.count_if(F.col("base_relation") == r).alias(f"n_{r}") for r in RELATIONS]
    return below.groupBy("root", F.least("depth", F.lit(4)).alias("generation")).agg(F.count("*").alias("n"), *counts)


def lineage(first_base: DataFrame, hops: int = LEVELS) -> DataFrame:
    """(id, hop, base): the first base of the first base …, up to 8 hops, ending at a repeat."""
    rows = cut(first_base.select("id", F.lit(1).alias("hop"), "base", F.array("id", "base").alias("_path")).filter("id <> base"))
    out = rows
    for hop in range(2, hops + 1):
        rows = rows.select("id", F.col("base").alias("k"), "_path").join(first_base.select(F.col("id").alias("k"), "base"), "k").filter(~F.array_contains("_path", F.col("base")))
        rows = cut(rows.select("id", F.lit(hop).alias("hop"), "base", F.concat("_path", F.array("base")).alias("_path")))
        if rows.isEmpty():
            break
        out = out.unionByName(rows)
    return out.select("id", "hop", "base")


def intervals(nodes: DataFrame) -> DataFrame:
    """nodes(root, id, parent, depth) of kept trees with `below`, the number of nodes below each, and `pre`, its preorder number.

    The nodes below x are those with pre_x < pre <= pre_x + below_x: a range, where a closure would hold a pair for each. Sizes go
    up and numbers go down level by level, a join each; brothers are numbered in the order of their ids.
    """
    nodes = cut(nodes.select("root", "id", "parent", "depth"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sized = None
    for depth in range(deepest, -1, -1):
        level = nodes.filter(F.col("depth") == depth)
        if sized is None:
            level = level.withColumn("below", F.lit(0).cast("long"))
        else:
            up = under.groupBy("root", F.col("parent").alias("id")).agg(F.sum(F.col("below") + 1).alias("below"))
            level = level.join(up, ["root", "id"], "left").withColumn("below", F.coalesce("below", F.lit(0)))
        under = cut(level)
        sized = under if sized is None else sized.unionByName(under)
    sized = cut(sized)
    brothers = W.partitionBy("root", "parent").orderBy("id")
    first = F.coalesce(F.sum(F.col("below") + 1).over(brothers.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + 1
    placed = sized.filter("depth > 0").withColumn("_first", first)
    front = sized.filter("depth = 0").withColumn("pre", F.lit(0).cast("long"))
    out = front
    for depth in range(1, deepest + 1):
        up = front.select("root", F.col("id").alias("parent"), F.col("pre").alias("_up"))
        front = cut(placed.filter(F.col("depth") == depth).join(up, ["root", "parent"]).withColumn("pre", F.col("_up") + F.col("_first")).select(out.columns))
        out = out.unionByName(front)
    return out


def ripple(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """What others built on an author's entities: children once, their downloads once a link, the biggest."""
    e = entities.select("id", "author", "dl30")
    j = edges.join(e, "id").join(e.select(F.col("id").alias("parent"), F.col("author").alias("of")), "parent").filter("author <> of")
    return j.groupBy(F.col("of").alias("author")).agg(F.countDistinct("id").alias("built"), F.sum("dl30").alias("dl30"), F.max(F.struct("dl30", "id"))["id"].alias("biggest"))
