"""Who uses what: references of cards, papers that models cite, and what others make of an owner's datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.scalars import owner
from tidemark.plans.staging import dealt

#: Fixed value: the form of a paper's number.
PAPER = r"^\d{4}\.\d{4,5}$"


def uses(model_refs: DataFrame, models: DataFrame, space_refs: DataFrame, spaces: DataFrame) -> DataFrame:
    """References with their source's creation day and weight.

    refs(src, dst_kind, dst) and tables(src, created, weight). A model that the table does not know is left out; a Space stays,
    with nulls.
    """
    m = model_refs.join(models, "src").withColumn("src_kind", F.lit("model"))
    s = space_refs.join(spaces, "src", "left").withColumn("src_kind", F.lit("space"))
    return m.unionByName(s).select("src_kind", "src", "dst_kind", "dst", F.to_date("created").alias("created"), F.col("weight").cast("long").alias("weight"))


def paper_refs(entities: DataFrame) -> DataFrame:
    """Distinct (id, paper) from the arxiv: tags of entities(id, tags) that hold a well-formed number."""
    tags = entities.select("id", F.explode("tags").alias("tag")).filter(F.startswith("tag", F.lit("arxiv:")))
    return tags.select("id", F.trim(F.substring("tag", 7, 1000)).alias("paper")).filter(F.col("paper").rlike(PAPER)).distinct()


def paper_models(refs: DataFrame, models: DataFrame, n: int = 5) -> DataFrame:
    """Per paper: models that cite it, their downloads, and the n most downloaded as (dl30, id) structs, best first."""
    m = refs.join(models.select("id", "dl30", "dl_all"), "id")
    totals = m.groupBy("paper").agg(F.count("*").alias("models"), F.sum("dl30").alias("dl30"), F.sum("dl_all").alias("dl_all"))
    w = W.partitionBy("paper").orderBy(F.col("dl30").desc_nulls_last(), "id")
    best = m.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    best = best.groupBy("paper").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "id", "dl30"))), lambda t: F.struct(t["id"].alias("id"), F.coalesce(t["dl30"], F.lit(0)).alias("dl30"))).alias("top"))
    return totals.join(best, "paper", "left")


def used_by(uses: DataFrame, datasets: DataFrame, models: DataFrame, spaces: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per owner of datasets: models of others that list any of them (each once), their downloads, the biggest; Spaces of others.

    Models and Spaces go through the joins together; `tasks` is how many tasks the uses are dealt over.
    """
    d = datasets.select(F.col("id").alias("dst"), F.col("author").alias("of"))
    u = dealt(uses.filter("dst_kind = 'dataset' AND src_kind IN ('model', 'space')").select("src_kind", "src", "dst"), tasks, "dst").join(d, "dst")
    of_kind = lambda df, kind, dl30: df.select(F.lit(kind).alias("src_kind"), F.col("id").alias("src"), "author", dl30.alias("dl30"))
    known = of_kind(models, "model", F.col("dl30")).unionByName(of_kind(spaces, "space", F.lit(None).cast("long")))
    is_model = F.col("src_kind") == "model"
    u = dealt(u, tasks, "src", "src_kind").join(dealt(known, tasks, "src", "src_kind"), ["src", "src_kind"], "left")
    u = u.filter(F.when(is_model, F.col("author")).otherwise(F.coalesce("author", owner(F.col("src").cast("string")))) != F.col("of"))
    once = u.groupBy("of", "src_kind", "src").agg(F.min("dst").alias("dataset"), F.first("dl30", ignorenulls=True).alias("dl30"))
    best = F.min(F.when(is_model, F.struct((-F.coalesce("dl30", F.lit(-1))).alias("k"), "src", "dataset")))
    m = once.groupBy("of").agg(F.count_if(is_model).alias("models"), F.coalesce(F.sum("dl30"), F.lit(0)).alias("dl30"), F.count_if(~is_model).alias("spaces"), best.alias("b"))
    return m.select(F.col("of").alias("author"), "models", "dl30", "spaces", F.col("b.src").alias("top_id"), F.col("b.dataset").alias("top_dataset"))


def author_repos(datasets: DataFrame, spaces: DataFrame) -> DataFrame:
    """Per author: datasets and their downloads, Spaces and their likes; 0 where there is none of a kind."""
    d = datasets.groupBy("author").agg(F.count("*").alias("datasets"), F.sum("dl30").alias("datasets_dl30"))
    s = spaces.groupBy("author").agg(F.count("*").alias("spaces"), F.sum("likes").alias("spaces_likes"))
    return d.join(s, "author", "full_outer").fillna(0, ["datasets", "datasets_dl30", "spaces", "spaces_likes"])
