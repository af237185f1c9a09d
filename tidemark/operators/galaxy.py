"""Questions about one kept galaxy tree, nodes(root, id, parent, depth)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.graph import intervals
from tidemark.plans.staging import cut


def focus(nodes: DataFrame, picks: DataFrame) -> DataFrame:
    """(root, pick, id, role): the nodes below each of picks(root, pick) and its ancestors, the root left out of these.

    Both are ranges of preorder numbers: those below a pick begin behind it, an ancestor's range holds the pick.
    """
    tree = cut(intervals(nodes))
    span = F.struct("pre", (F.col("pre") + F.col("below")).alias("last"))
    at = tree.select("root", F.col("id").alias("pick"), span.alias("p")).join(picks, ["root", "pick"])
    both = at.join(tree.select("root", "id", "depth", span.alias("x")), "root")
    below = both.filter((F.col("x.pre") > F.col("p.pre")) & (F.col("x.pre") <= F.col("p.last"))).select("root", "pick", "id", F.lit("below").alias("role"))
    above = both.filter((F.col("x.pre") < F.col("p.pre")) & (F.col("x.last") >= F.col("p.pre")) & (F.col("depth") > 0))
    return below.unionByName(above.select("root", "pick", "id", F.lit("above").alias("role")))


def builders(nodes: DataFrame, entities: DataFrame, n: int = 6) -> DataFrame:
    """(root, author, n, dl30, rank): who else built most in a galaxy, by downloads then name. entities(id, author, dl30)."""
    own = entities.select(F.col("id").alias("root"), F.col("author").alias("_own"))
    j = nodes.filter("depth > 0").select("root", "id").join(entities.select("id", "author", "dl30"), "id").join(own, "root").filter("author <> _own")
    g = j.groupBy("root", "author").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl30"), F.lit(0)).alias("dl30"))
    w = W.partitionBy("root").orderBy(F.col("dl30").desc(), "author")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def found(nodes: DataFrame, entities: DataFrame, text: str, n: int = 8) -> DataFrame:
    """(root, id, rank): nodes but the root whose name holds the text, biggest first; nothing for less than two characters."""
    q = text.strip().lower()
    named = nodes.filter("depth > 0").select("root", "id").join(entities.select("id", "name", "dl30"), "id")
    hit = named.filter(F.contains(F.lower("name"), F.lit(q)) & F.lit(len(q) >= 2))
    w = W.partitionBy("root").orderBy(F.coalesce("dl30", F.lit(0)).desc(), "id")
    return hit.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("root", "id", "rank")
