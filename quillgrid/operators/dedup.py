"""Keeping one row of a group, always by an explicit order."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import numbered


def first_of(df: DataFrame, keys: tuple[str, ...], order: tuple[str | Column, ...]) -> DataFrame:
    """The first row of each group by ``order``.

    An aggregate instead of a window: it combines before the shuffle, so a group with many rows isn't sorted in one
    task. The whole row rides along in the minimum of a struct that begins with the order.
    """
    rest = [c for c in df.columns if c not in keys]
    ranks = [F.col(c) if isinstance(c, str) else c for c in order]
    best = F.min_by(F.struct(*rest), F.struct(*[r.alias(f"k{i}") for i, r in enumerate(ranks)])) if rest else F.count("*")
    out = df.groupBy(*keys).agg(best.alias("best_"))
    return out.select(*[c if c in keys else F.col(f"best_.{c}").alias(c) for c in df.columns])


def first_seen(df: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """For each value of ``key`` where it is seen first."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def package_preference(packages: DataFrame) -> DataFrame:
    """Of the packages (id, path, for_test, files) of one path the preferred: no test variant, fewer files, smaller id."""
    is_test = F.coalesce(F.col("for_test"), F.lit("")) != ""
    return first_of(packages, ("path",), (is_test, F.size("files"), "id"))


def numbered_names(df: DataFrame, name: str = "name", order: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """Each row's unique name: the nth repetition of a name gets #NN, two digits at least; a taken name is passed over.

    A row that is itself named like a repetition can take one's number, so the names of such a family (equal but for
    numbers at the end) are given out one after another; all others by their number alone, however often they repeat.
    """
    stem = F.regexp_replace(name, r"(#\d+)+$", "")
    rows = df.withColumn("stem_", stem)
    odd = rows.where(F.col(name) != F.col("stem_")).select(*by, "stem_").distinct()
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in (*by, "stem_")])
    plain = numbered(rows.join(odd, same(rows, odd), "left_anti"), (*by, name), (order,), "n_")
    again = F.format_string("%s#%02d", F.col(name), F.col("n_") - 1)
    told = plain.withColumn("unique_name", F.when((F.col("n_") == 1) & (F.col(name) != ""), F.col(name)).otherwise(again)).drop("n_", "stem_")

    def fold(family: pd.DataFrame) -> pd.DataFrame:
        family = family.sort_values(order, kind="stable")
        return family.drop(columns=["stem_"]).assign(unique_name=unique_names(family[name].tolist()))

    schema = told.schema
    families = rows.join(odd, same(rows, odd), "left_semi").groupBy(*by, "stem_").applyInPandas(fold, schema)
    return told.unionByName(families)


def unique_names(names: list[str]) -> list[str]:
    """In order of appearance: of what a name is offered, itself first (an empty one isn't), then with its numbers, the first that is free."""
    spent: Counter = Counter()  # of each name, how many offers are used up; a name that was given out has one at least

    def offers(name: str) -> Iterator[str]:
        while True:
            k, spent[name] = spent[name], spent[name] + 1
            yield f"{name}#{k:02d}" if k or not name else name

    def is_free(offer: str, name: str) -> bool:
        if offer != name:
            return not spent[offer]
        head, mark, digits = name.rpartition("#")  # a name that looks like a number of another one is free if that number wasn't reached
        number = bool(mark) and re.fullmatch(r"\d{2}|[1-9]\d{2,}", digits) is not None and (digits != "00" or not head)
        return not number or int(digits) >= spent[head]

    return [next(o for o in offers(n) if is_free(o, n)) for n in names]
