"""Many runs to one verdict: supersede, drop, deduplicate, sort, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import first_of
from .joins import superseded_runs

FIVE = ("file", "line", "column", "linter", "message")


def collect(runs: DataFrame, results: DataFrame, ignored: tuple[str, ...] = (), only_in_last: tuple[str, ...] = ("unused",)) -> tuple[DataFrame, DataFrame]:
    """(findings, verdict) of runs (RUN schema) and their results (run_id, ordinal and a finding's columns).

    What a superseded run says about unused code is dropped, and counted before duplicates go; of equal findings the
    first run's stays.
    """
    gone = superseded_runs(runs).withColumn("superseded", F.lit(True))
    marked = results.join(gone, "run_id", "left").withColumn("superseded", F.coalesce("superseded", F.lit(False)) & F.col("linter").isin(*only_in_last))
    kept = first_of(marked.where("not superseded"), FIVE, ("run_id", "ordinal")).drop("superseded")
    told = kept.select("linter", F.lit(False).alias("gone")).unionByName(marked.where("superseded").select("linter", F.lit(True).alias("gone")))
    skip = F.col("linter").isin(*ignored) if ignored else F.lit(False)
    counts = told.agg(F.count_if(~F.col("gone")).alias("findings"), F.count_if(~F.col("gone") & ~skip).alias("enforced"), F.count_if(~F.col("gone") & skip).alias("ignored"), F.count_if("gone").alias("superseded"))
    return kept, counts
