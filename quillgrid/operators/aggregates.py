"""Counts, summaries, medians and digests of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..schema import SEVERITIES
from .running import numbered, running


def by_severity(findings: DataFrame) -> DataFrame:
    """Three rows always; an empty severity counts as error."""
    word = F.when(F.coalesce("severity", F.lit("")) == "", "error").otherwise(F.col("severity"))
    counts = findings.agg(*[F.count_if(word == s).alias(s) for s in SEVERITIES])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES])).alias("x")).select("x.severity", "x.n")


def by_linter(findings: DataFrame) -> DataFrame:
    return findings.groupBy("linter").agg(F.count("*").alias("n"))


def verdict(findings: DataFrame, ignored: tuple[str, ...], superseded: int | Column = 0) -> DataFrame:
    """One row: all findings, those that count, those that don't, and the dropped ones of superseded runs."""
    skip = F.col("linter").isin(*ignored) if ignored else F.lit(False)
    gone = F.lit(superseded) if isinstance(superseded, int) else superseded
    return findings.agg(F.count("*").alias("findings"), F.count_if(~skip).alias("enforced"), F.count_if(skip).alias("ignored")).withColumn("superseded", gone.cast("long"))


def grouped_by_file(findings: DataFrame, seq: str = "seq") -> DataFrame:
    """Each file's findings in their own order, as an array."""
    rest = [c for c in findings.columns if c not in ("file", seq)]
    return findings.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(seq, *rest))).alias("findings"))


def p95(values: Column) -> Column:
    """Of a sorted array: the element at floor(95 n / 100), the last at most."""
    n = F.size(values)
    return F.when(n > 0, F.get(values, F.least(F.floor(n * 95 / 100), n - 1).cast("int"))).otherwise(0)


def int_median(values: Column) -> Column:
    """Of a sorted array: the middle, or the two middles' mean rounded down; 0 for none."""
    n = F.size(values)
    mid = (n / 2).cast("int")
    low, high = F.get(values, mid - 1), F.get(values, mid)
    return F.when(n == 0, 0).when(n % 2 == 1, high).otherwise(low + ((high - low) / 2).cast("long"))


def mean_p95(observations: DataFrame, bucket: str = "bucket", value: str = "v") -> DataFrame:
    """Count, mean rounded towards zero, and p95.

    p95 needs one exact rank: a distribution of counts by value gives it with partial aggregation, where a list of all
    values of a bucket would not fit a task.
    """
    counts = observations.groupBy(bucket, value).agg(F.count("*").alias("c"))
    totals = counts.groupBy(bucket).agg(F.sum("c").alias("n"), F.sum(F.col(value) * F.col("c")).alias("s"))
    upto = running(counts, (bucket,), (value,), F.col("c"), "upto").join(totals.select(F.col(bucket).alias("b_"), "n"), F.col(bucket).eqNullSafe(F.col("b_"))).drop("b_")
    rank = F.least(F.floor(F.col("n") * 95 / 100), F.col("n") - 1)
    tail = upto.where(F.col("upto") > rank).groupBy(bucket).agg(F.min(value).alias("p95"))
    named = totals.select(F.col(bucket).alias("b_"), "n", (F.col("s") / F.col("n")).cast("long").alias("mean"))
    return tail.join(named, F.col(bucket).eqNullSafe(F.col("b_"))).select(bucket, "n", "mean", "p95")


def scenario(observations: DataFrame, by: str, wall: str, rss: str) -> DataFrame:
    """Wall time mean, p95, max, min and memory mean, max of each scenario."""
    base = observations.groupBy(by).agg(F.count("*").alias("n"), F.floor(F.sum(wall) / F.count("*")).alias("mean_wall"), F.max(wall).alias("max_wall"), F.min(wall).alias("min_wall"), F.floor(F.sum(rss) / F.count("*")).alias("mean_rss"), F.max(rss).alias("max_rss"))
    tail = mean_p95(observations, by, wall).select(by, F.col("p95").alias("p95_wall"))
    return base.join(tail, by)


WINDOW = 128
LEAST_SAMPLES = 10
#: Observations of one task's part of a bucket.
SPAN = 1 << 16


def sliding_median(observations: DataFrame, fallback: int, window: int = WINDOW, least: int = LEAST_SAMPLES) -> DataFrame:
    """After each observation the integer median of the bucket's last ``window`` non-zero ones; the fallback below ``least``."""
    placed = numbered(observations.where("v <> 0"), ("bucket",), ("seq",), "n_").withColumn("n_", F.col("n_") - 1)
    # spans of a bucket, each with the end of the one before, so that a large bucket isn't one task's
    span = (F.col("n_") / SPAN).cast("long")
    spans = F.when(F.pmod("n_", F.lit(SPAN)) >= SPAN - window + 1, F.array(span, span + 1)).otherwise(F.array(span))
    spread = placed.select("*", span.alias("own_"), F.explode(spans).alias("span_"))
    w = Window.partitionBy("bucket", "span_").orderBy("n_").rowsBetween(-(window - 1), 0)
    held = spread.withColumn("held", F.array_sort(F.collect_list("v").over(w))).where("own_ = span_")
    return held.select("seq", "bucket", "v", F.when(F.size("held") < least, F.lit(fallback)).otherwise(int_median(F.col("held"))).cast("long").alias("estimate"))


def cascade(packages: Column, bytes_each: Column, budget: int) -> Column:
    total = packages * bytes_each
    return F.struct(total.alias("projected"), ((total > budget) & F.lit(budget > 0)).alias("exceeds"))


def peak_in_flight(events: DataFrame, by: str, at: str = "at", delta: str = "delta") -> DataFrame:
    """Most that was in flight at once, from +1 and -1 events; ends come before starts of the same moment."""
    return running(events, (by,), (at, delta), F.col(delta), "running").groupBy(by).agg(F.greatest(F.max("running"), F.lit(0)).alias("peak"))


def scheduler_stats(events: DataFrame) -> DataFrame:
    """Acquired, blocked, waited, and released = pins - live, from an event log (kind, wait)."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return events.agg(n("acquire").alias("acquired"), n("block").alias("blocked"), F.coalesce(F.sum("wait"), F.lit(0)).alias("waited"), n("pin").alias("pins"), (n("pin") - n("live")).alias("released"))


def cache_counters(events: DataFrame) -> DataFrame:
    """Hits, misses, stores and errors by tier."""
    n = lambda kind: F.count_if(F.col("outcome") == kind).alias(kind + ("es" if kind == "miss" else "s"))
    return events.groupBy("tier").agg(n("hit"), n("miss"), n("store"), n("error"))


def set_digest(df: DataFrame, by: tuple[str, ...], *parts: str) -> DataFrame:
    """One digest for each group's rows whatever their order.

    Rows are digested first; then those of a group whose digests begin alike, and then these 256 digests, so that what
    is gathered in one place is a 256th of a group, 64 characters a row.
    """
    rows = df.select(*by, fc.digest(*parts).alias("row_")).withColumn("shard_", F.substring("row_", 1, 2))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    shards = rows.groupBy(*by, "shard_").agg(joined("row_").alias("part_"), F.count("*").alias("n"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("shard_", "part_"))), lambda x: x["part_"])
    return shards.groupBy(*by).agg(F.sha2(F.array_join(in_order, ""), 256).alias("digest"), F.sum("n").alias("n"))


def reference_sets(references: DataFrame) -> DataFrame:
    """(decl, key): the digest of each declaration's set of references (decl, ref; ref null for none)."""
    return references.groupBy("decl").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("ref")), "\u0000"), 256).alias("key"))


def equivalence_classes(references: DataFrame) -> DataFrame:
    """(class, n): declarations with the same set of references are one class, named by its first; members are told by reference_sets."""
    return reference_sets(references).groupBy("key").agg(F.min("decl").alias("class"), F.count("*").alias("n")).select("class", "n")


def inverted_index(edges: DataFrame) -> DataFrame:
    """Importers of each node, sorted."""
    return edges.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("importers"))


def disk_use(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))
