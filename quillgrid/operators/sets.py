"""Set operations: unions, bags, name selections and array sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merged(*streams: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def bag_overlap(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """INTERSECT ALL of the keys."""
    return a.select(*key).intersectAll(b.select(*key))


def bag_only(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """EXCEPT ALL of the keys."""
    return a.select(*key).exceptAll(b.select(*key))


def active_set(catalog: DataFrame, seed: DataFrame, enable: DataFrame, disable: DataFrame, custom: DataFrame) -> DataFrame:
    """(seed and enabled names) without disabled ones, and custom ones; formatters never join. All but catalog: name."""
    named = seed.select("name").union(enable.select("name")).distinct()
    usable = named.join(catalog.where("shape = 'formatter'").select("name"), "name", "left_anti")
    return usable.join(disable.select("name"), "name", "left_anti").union(custom.select("name")).distinct()


def member_set(members: DataFrame, mode: str, enable: DataFrame, disable: DataFrame) -> DataFrame:
    """Members (name, default_on) of a family: all but the disabled, only the enabled, or the defaults changed by both."""
    start = {"enable-all": members, "disable-all": members.limit(0), "default": members.where("default_on")}[mode].select("name")
    if mode == "disable-all":
        return members.join(enable.select("name"), "name", "left_semi").select("name")
    if mode == "enable-all":
        return start.join(disable.select("name"), "name", "left_anti")
    more = members.join(enable.select("name"), "name", "left_semi").select("name")
    return start.union(more).distinct().join(disable.select("name"), "name", "left_anti")


def append_unique(a: Column, b: Column) -> Column:
    """Union of arrays in order of first sight."""
    return F.array_distinct(F.concat(a, b))


def ordered_distinct(a: Column) -> Column:
    return F.array_distinct(a)


def array_union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def contains(a: Column, x: Column) -> Column:
    return F.array_contains(a, x)


def right_biased(a: Column, b: Column) -> Column:
    """Union of maps; of a key that both have the right one's value stays."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def same_keys(a: Column, b: Column) -> Column:
    return F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))


def selected(analyzers: DataFrame, wanted: list[str]) -> DataFrame:
    """Analyzers of the wanted names; unknown names are an error that lists all of them, sorted."""
    known = {r["name"] for r in analyzers.where(F.col("name").isin(*wanted)).select("name").collect()} if wanted else set()
    missing = sorted(set(wanted) - known)
    if missing:
        raise ValueError(f"unknown analyzers: {', '.join(missing)}")
    return analyzers.where(F.col("name").isin(*wanted))


def symbols(index: DataFrame, package: str, name: str, prefix: bool = False) -> DataFrame:
    """Symbols (package, name, ...) of a module index by exact name or by prefix."""
    hit = F.startswith("name", F.lit(name)) if prefix else F.col("name") == name
    return index.where((F.col("package") == package) & hit)
