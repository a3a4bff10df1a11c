"""Row numbers and running sums over groups that may be too large for one task.

Rows are dealt to tasks by ranges of group and order; each task numbers, or sums, its own part of a group, and the parts
before it are added from one row for each part. Ranges come from a sample, so the dealt rows are written to the
checkpoint folder once: a lost task reads the same rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ready


def running(df: DataFrame, by: tuple[str, ...], order: tuple[str | Column, ...], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the group up to this one."""
    ready(df.sparkSession)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.withColumn("v_", value).repartitionByRange(*[F.col(c) for c in by], *keys).withColumn("p_", F.spark_partition_id()).checkpoint()
    own = dealt.withColumn("own_", F.sum("v_").over(Window.partitionBy("p_", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)))
    parts = dealt.groupBy("p_", *by).agg(F.sum("v_").alias("part_"))
    w = Window.partitionBy(*by).orderBy("p_")  # as many rows as there are partitions, at most
    before = parts.select(F.col("p_").alias("p2_"), *[F.col(c).alias(f"{c}_2_") for c in by], (F.sum("part_").over(w) - F.col("part_")).alias("before_"))
    on = F.col("p_") == F.col("p2_")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}_2_"))
    return own.join(before, on).select(*df.columns, (F.col("own_") + F.col("before_")).alias(name))


def numbered(df: DataFrame, by: tuple[str, ...], order: tuple[str | Column, ...], name: str) -> DataFrame:
    """``df`` with each row's number in its group, from 1."""
    return running(df, by, order, F.lit(1).cast("long"), name)
