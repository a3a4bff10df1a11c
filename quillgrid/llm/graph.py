"""Connected components of a large edge list, without ever holding a component in one place."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def release(df: DataFrame) -> DataFrame:
    """Lets go of the shuffle files and checkpoints of finished steps: Spark deletes them once the driver's garbage is collected."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def merge_join(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the corpus: sorted and merged, so nothing is gathered on the driver.

    The sides meet on a changed key, so that both are shuffled for the join even where one is partitioned by the key
    already: only then can adaptive execution split the partitions of hot keys.
    """
    kind = a.schema[on].dataType.typeName()
    key = F.col(on).bitwiseXOR(F.lit(0x5BD1E995)) if kind == "long" else F.concat(F.col(on), F.lit(b"\0"))
    right = b.withColumn("k_", key).drop(on)
    return a.withColumn("k_", key).join(right.hint("merge"), "k_", how).drop("k_")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): the label is the smallest node of its component.

    Each round, every label hooks onto its smallest neighbour, if that is smaller; the hooks are trees, whose depth is
    halved by jumping until all point at their roots; then the edges are contracted. It ends when no edge joins two
    labels. Hot nodes are aggregated before they are shuffled, and joins on hot roots can be split.
    """
    left = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    labels = None
    while not left.isEmpty():
        root = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")).checkpoint()
        while True:
            further = merge_join(root, root.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p"), (F.col("q") < F.col("p")).alias("moved")).checkpoint()
            root = further.select("a", "p")
            if further.where("moved").isEmpty():
                break
        to = lambda df, c: merge_join(df, root.select(F.col("a").alias(c), F.col("p").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023,E731
        labels = root.select(F.col("a").alias("node"), F.col("p").alias("label")) if labels is None else to(labels, "label").checkpoint()
        left = to(to(left, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
        release(left)
    return labels if labels is not None else left.select(F.col("a").alias("node"), F.col("b").alias("label"))


def relabelled(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, label) after further links (a, b): only the labels that the links join are looked at."""
    if labels is None:
        return components(links)
    of = lambda df, c: merge_join(df, labels.select(F.col("node").alias(c), F.col("label").alias("to")), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    joined = components(of(of(links, "a"), "b"))
    moved = merge_join(labels, joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    # nodes that had no label yet
    fresh = merge_join(joined, labels.select("node"), "node", "left_anti").select("node", "label")
    return release(moved.union(fresh).checkpoint())
