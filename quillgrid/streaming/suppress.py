"""Findings as a stream: the batch predicates, and the first finding of each line across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.suppress import Config, dropped
from ..schema import struct

REQUEST = "requestId int, arguments array<string>, cancel boolean, sandboxDir string"


def suppressed(stream: DataFrame, config: Config, late: str | None = None, at: str = "ts") -> DataFrame:
    """Findings that no predicate drops, once for each (file, line).

    Without ``late`` the state lasts as long as the query, which is right for one run (availableNow); with it, an event
    time column bounds the state: a line may be told again after so long.
    """
    kept = stream.where(~F.coalesce(dropped(config), F.lit(False)))
    if not config.once_per_line:
        return kept
    if late is None:
        return kept.dropDuplicates(["file", "line"])
    return kept.withWatermark(at, late).dropDuplicatesWithinWatermark(["file", "line"])


def run_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what there is now and ends; its state goes with its checkpoint."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def requests(lines: DataFrame) -> DataFrame:
    """Worker requests from JSON lines (value)."""
    return lines.select(F.from_json("value", struct(REQUEST)).alias("r")).select("r.*")


def answers(req: DataFrame, work) -> DataFrame:
    """One response for each request: cancels are acknowledged, sandboxed ones refused, others worked on by a Column of theirs."""
    refused = F.coalesce(F.col("sandboxDir"), F.lit("")) != ""
    cancelled = F.coalesce("cancel", F.lit(False))
    return req.select(
        F.coalesce("requestId", F.lit(0)).alias("requestId"),
        F.when(cancelled, 0).when(refused, 1).otherwise(0).alias("exitCode"),
        F.when(cancelled, "").when(refused, "sandboxed requests are not supported").otherwise(work(F.col("arguments"))).alias("output"),
        cancelled.alias("wasCancelled"),
    )


def serve(spark: SparkSession, folder: str, out: str, checkpoint: str, work) -> StreamingQuery:
    """Answers the requests in a folder's text files, in the order in which they arrive."""
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(folder)

    def answer(batch: DataFrame, _: int) -> None:
        answers(requests(batch), work).write.mode("append").json(out)

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def per_hour(stream: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Findings by linter and hour, finished once the watermark has passed."""
    return stream.withWatermark(at, late).groupBy(F.window(at, "1 hour"), "linter").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "linter", "n")
