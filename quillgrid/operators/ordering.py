"""Sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANONICAL = ("file", "line", "column", "linter", "message")


def canonical_sort(findings: DataFrame, *tie: str) -> DataFrame:
    """By file, line, column, linter and message, in byte order; ``tie`` makes the order of equal ones stable."""
    return findings.orderBy(*CANONICAL, *tie)


def comparison_sort(rows: DataFrame, *tie: str) -> DataFrame:
    return rows.orderBy("file", "line", "linter", "message", *tie)


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows: each task keeps n, so no full sort."""
    return df.orderBy(*order).limit(n)


def top_per_bucket(df: DataFrame, bucket: str, value: str, n: int, *tie: str) -> DataFrame:
    """The n largest of each bucket; Spark filters by rank in each task before the shuffle."""
    w = Window.partitionBy(bucket).orderBy(F.col(value).desc(), *tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def closest_names(wanted: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """For each unknown name the known one of the least edit distance up to ``most``, then by name.

    Names meet by length, which differs by ``most`` at most, so this is an equi join and no name is compared with all.
    """
    lengths = F.sequence(F.greatest(F.char_length("name") - most, F.lit(0)), F.char_length("name") + most)
    near = wanted.select("name", F.explode(lengths).alias("length_"))
    pairs = near.join(known.select(F.col("name").alias("suggestion"), F.char_length("name").alias("length_")), "length_")
    d = pairs.withColumn("distance", F.levenshtein("name", "suggestion", most)).where("distance >= 0")
    return d.groupBy("name").agg(F.min(F.struct("distance", "suggestion")).alias("best")).select("name", F.col("best.suggestion").alias("suggestion"), F.col("best.distance").alias("distance"))


def ordered_entries(m):
    """Column: a map's entries by key."""
    return F.array_sort(F.map_entries(m))
