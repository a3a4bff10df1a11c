"""Comparing two sets of findings as bags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc
from . import running

KEY = ("file", "line", "linter", "stem")


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("stem", fc.message_stem())


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``nth`` among those of the same key."""
    return running.numbered(keyed(rows), KEY, order or ("column", "message"), "nth")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """min(n, m) rows of each key; the second side's rows survive."""
    return numbered(b).join(numbered(a).select(*KEY, "nth"), [*KEY, "nth"], "left_semi").drop("nth")


def only(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of the first side without a partner."""
    return numbered(a).join(numbered(b).select(*KEY, "nth"), [*KEY, "nth"], "left_anti").drop("nth")


def per_linter(a: DataFrame, b: DataFrame) -> DataFrame:
    """For every linter of either side: counts, pairs, and what is left on each side; one aggregation by key."""
    side = lambda df, x, y: keyed(df).select(*KEY, F.lit(x).alias("a"), F.lit(y).alias("b"))
    keys = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(*KEY).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    both = F.least("a", "b")
    return keys.groupBy("linter").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(both).alias("overlap"), F.sum(F.col("a") - both).alias("only_a"), F.sum(F.col("b") - both).alias("only_b"))


def report(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("A", "B"), most: int = 20) -> str:
    """Markdown: totals, a table by linter, and the first one-sided findings of each side."""
    stats = per_linter(a, b).orderBy("linter").collect()
    total = [sum(r[c] for r in stats) for c in ("n_a", "n_b", "overlap", "only_a", "only_b")]
    out = ["# Comparison", "", f"- {names[0]}: {total[0]}", f"- {names[1]}: {total[1]}", f"- both: {total[2]}", f"- only {names[0]}: {total[3]}", f"- only {names[1]}: {total[4]}", ""]
    out += [f"| linter | {names[0]} | {names[1]} | both | only {names[0]} | only {names[1]} |", "|-|-|-|-|-|-|"]
    out += [f"| {r['linter']} | {r['n_a']} | {r['n_b']} | {r['overlap']} | {r['only_a']} | {r['only_b']} |" for r in stats]
    for name, rows in ((names[0], only(a, b)), (names[1], only(b, a))):
        out += ["", f"## Only {name}", ""]
        out += [f"- {r['file']}:{r['line']} {r['linter']}: {r['message']}" for r in rows.orderBy("file", "line", "linter", "message").limit(most).collect()]
    return "\n".join(out) + "\n"


def detailed(a: DataFrame, b: DataFrame) -> DataFrame:
    """All one-sided findings of both sides, to be written in comparison order."""
    side = lambda df, name: df.select(F.lit(name).alias("side"), "file", "line", "column", "linter", "message")
    return side(only(a, b), "a").unionByName(side(only(b, a), "b")).orderBy("side", "file", "line", "linter", "message")
