"""Column expressions used by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest and most frequent forms of repository links.
LINK = r"^(?:https?://[^/]+/)?(?:(datasets|spaces)/)?([^/\s?#]+/[^/\s?#]+)"


def owner(rid: Column) -> Column:
    """What stands before the first slash; the whole id where there is none."""
    return F.element_at(F.split(rid, "/"), 1)


def name(rid: Column) -> Column:
    return F.element_at(F.split(rid, "/"), -1)


def part(text: Column, k: int) -> Column:
    """k-th part between slashes; '' where there is none."""
    return F.split_part(text, F.lit("/"), F.lit(k))


def clip(x: Column) -> Column:
    """Negative to 0; null stays null."""
    return F.when(x < 0, F.lit(0)).otherwise(x)


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def week(day: Column) -> Column:
    """Monday of the day's week."""
    return F.date_trunc("week", day).cast("date")


def tag_value(tags: Column, prefix: str) -> Column:
    """What follows the prefix in the first tag that has it."""
    return F.regexp_replace(F.get(F.filter(tags, lambda t: t.startswith(prefix)), 0), "^" + prefix, "")


def json_field(text: Column, path: str) -> Column:
    return F.get_json_object(text, path)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def link(text: Column) -> tuple[Column, Column]:
    """(kind, id) of a link or id; empty strings where it is neither."""
    kind = F.regexp_extract(text, LINK, 1)
    rid = F.regexp_extract(text, LINK, 2)
    return F.when(rid == "", "").when(kind == "datasets", "dataset").when(kind == "spaces", "space").otherwise("model"), rid


def card_items(card: Column, field: str) -> Column:
    """Distinct, trimmed, non-blank string items of a JSON field that is a string or a list; [] for anything else."""
    found = F.get_json_object(card, f"$.{field}")
    typed = F.schema_of_variant(F.try_variant_get(F.try_parse_json(card), f"$.{field}", "variant"))
    one = F.when(typed == "STRING", F.array(found))
    items = F.from_json(F.when(F.startswith(typed, F.lit("ARRAY")), found), "array<variant>")
    strings = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    return F.array_distinct(F.filter(F.transform(F.coalesce(one, strings, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != ""))
