"""Tag maps: predicates, rule tables, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tag values that a rule False accepts.
FALSE_VALUES = ("0", "false", "no")
#: Keys that make a closed way a line and not an area, and keys of features that cut areas.
LINEAR_KEYS = ("highway", "railway", "waterway", "barrier", "power", "aerialway")
HIDDEN_KEYS = ("geometry", "id", "action", "visible")

Rule = dict[str, "bool | str | list[str]"]


def tag_map(pairs: DataFrame, key: str) -> DataFrame:
    """(key, tags) from (key, k, v) rows; empty keys and null values are dropped."""
    kept = pairs.where("k <> '' AND v IS NOT NULL")
    return kept.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("k", "v")))).alias("tags"))


def matches(tags: Column, rule: Rule) -> Column:
    """All keys of a rule hold: True any non-empty value, False a false value, text equality, list membership."""

    def one(k: str, want) -> Column:
        value = F.try_element_at(tags, F.lit(k))
        if want is True:
            hit = value != ""
        elif want is False:
            hit = F.lower(value).isin(*FALSE_VALUES)
        elif isinstance(want, str):
            hit = value == want
        else:
            hit = value.isin(*want)
        return F.coalesce(hit, F.lit(False))

    return reduce(lambda a, b: a & b, [one(k, w) for k, w in rule.items()])


def matches_any(tags: Column, rule: Rule) -> Column:
    """Some key of a rule holds (layer fetch semantics)."""
    return reduce(lambda a, b: a | b, [matches(tags, {k: w}) for k, w in rule.items()])


def first_match(tags: Column, rules: list[Rule]) -> Column:
    """Position of the first rule that holds, or null; empty rules are dropped, none left is an error."""
    rules = [r for r in rules if r]
    if not rules:
        raise ValueError("no rule left")
    return F.coalesce(*[F.when(matches(tags, r), F.lit(i)) for i, r in enumerate(rules)])


def expand_rules(rules: list[Rule]) -> list[Rule]:
    """One-key rules, distinct, in order."""
    seen: dict[str, Rule] = {}
    for rule in rules:
        for k, want in rule.items():
            seen.setdefault(f"{k}={sorted(want) if isinstance(want, list) else want!r}", {k: want})
    return list(seen.values())


def canonical_tag(rule: Rule) -> tuple[str, str] | None:
    """The first key with its text or first list value; none for a boolean."""
    for k, want in rule.items():
        if isinstance(want, bool):
            return None
        return (k, want if isinstance(want, str) else want[0])
    return None


def resolved_tags(tags: Column, precise: Column, use_precise: bool) -> Column:
    return F.when(F.lit(use_precise) & (F.size(precise) > 0), precise).otherwise(tags)


def scrub(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: ~k.isin(*HIDDEN_KEYS) & v.isNotNull())


def output_tags(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: k != "type")


def is_area(first: Column, last: Column, size: Column, tags: Column) -> Column:
    """A closed way of four references or more: area=no is false, area=yes true, otherwise no linear key."""
    area = F.try_element_at(tags, F.lit("area"))
    linear = F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, LINEAR_KEYS)))
    return (size >= 4) & (first == last) & F.when(area == "no", False).when(area == "yes", True).otherwise(~linear)


def is_splitter(tags: Column, exclude: Rule | None = None) -> Column:
    cut = F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, LINEAR_KEYS))) | matches(tags, {"natural": "tree_row"})
    return cut & ~matches(tags, exclude) if exclude else cut


def canonical_json(tags: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(tags))))


def lookup_radius(pairs: DataFrame, key: str, table: dict[tuple[str, str], int]) -> DataFrame:
    """(key, radius): the largest radius of a feature's tag pairs in a lookup table; features without one are left out."""
    spark = pairs.sparkSession
    rows = F.broadcast(spark.createDataFrame([(k, v, r) for (k, v), r in table.items()], "k string, v string, radius long"))
    return pairs.join(rows, ["k", "v"]).groupBy(key).agg(F.max("radius").alias("radius")).where("radius > 0")


def category_of(pairs: DataFrame, key: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(key, category) by the first rule (k, v, category) that any tag meets."""
    spark = pairs.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule_no long, k string, v string, category string"))
    return pairs.join(table, ["k", "v"]).groupBy(key).agg(F.min_by("category", "rule_no").alias("category"))


def common_tags(pairs: DataFrame, members: DataFrame, group: str, key: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """(group, k, v): tags that all members of a group share with one value, without the dropped keys."""
    sizes = members.groupBy(group).agg(F.count_distinct(key).alias("size"))
    shared = members.join(pairs, key).groupBy(group, "k").agg(F.count_distinct(key).alias("n"), F.min("v").alias("v"), F.max("v").alias("hi"))
    return shared.join(sizes, group).where((F.col("n") == F.col("size")) & (F.col("v") == F.col("hi")) & ~F.col("k").isin(*drop, "")).select(group, "k", "v")


def merge_key(tags: Column, rule: Rule, collapse: bool) -> Column:
    """Sorted key=value pairs of the rule's keys; list values become the first one when collapsing."""
    parts = []
    for k in sorted(rule):
        want = rule[k]
        value = F.lit(want[0]) if collapse and isinstance(want, list) else F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
        parts.append(F.concat(F.lit(f"{k}="), value))
    return F.concat_ws(";", *parts)
