"""Corpora: tables of files and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table as files: file, package, text."""
    file = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(file.alias("file"), F.concat("source", F.lit("/"), "lang").alias("package"), "text")


def folder(spark: SparkSession, path: str, pattern: str = "*", go_only: bool = False) -> DataFrame:
    """Files below a folder, as text: file, package (its folder), text."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    rows = found.select(F.col("path").alias("file"), F.regexp_replace("path", "/[^/]*$", "").alias("package"), F.decode("content", "UTF-8").alias("text"))
    return rows.where(paths.go_files(F.col("file"))) if go_only else rows


def folders(files: DataFrame) -> DataFrame:
    return files.select(F.regexp_extract("file", "^(.*)/", 1).alias("folder")).distinct()


def lines(files: DataFrame) -> DataFrame:
    """file, package, line (from 1), content; a final line end makes no further line."""
    cut = files.select("file", "package", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"), F.size(F.split("text", "\n", -1)).alias("n"))
    return cut.where((F.col("content") != "") | (F.col("pos") < F.col("n") - 1)).select("file", "package", (F.col("pos") + 1).alias("line"), "content")


def package_files(packages: DataFrame) -> DataFrame:
    return packages.select("id", F.explode("files").alias("file"))


def dependency_edges(packages: DataFrame) -> DataFrame:
    """Edges from packages with a map from import path to id; a missing import has an empty id."""
    return packages.select(F.col("id").alias("src"), F.explode(F.map_entries("deps")).alias("e")).select("src", F.col("e.key").alias("import_path"), F.col("e.value").alias("dst"))


def roots(packages: DataFrame) -> DataFrame:
    return packages.where("is_root")


def synthetic_packages(spark: SparkSession, leaves: int, mids: int, tops: int, fan_out: int = 3) -> DataFrame:
    """A leaf, mid and root graph as edges (src, dst): each mid depends on ``fan_out`` leaves, each root on all mids."""
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    low = spark.range(mids).select("id", upto(min(fan_out, leaves))).select(F.concat(F.lit("mid"), "id").alias("src"), F.concat(F.lit("leaf"), ((F.col("id") + F.col("k")) % leaves).cast("string")).alias("dst"))
    top = spark.range(tops).select("id", upto(mids))
    return low.union(top.select(F.concat(F.lit("root"), "id"), F.concat(F.lit("mid"), "k"))).distinct()
