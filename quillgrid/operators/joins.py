"""Joins between findings, packages, runs and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def owned(findings: DataFrame, file_packages: DataFrame) -> DataFrame:
    """Findings with their file's package; "" for none. ``file_packages``: file, package."""
    return findings.join(file_packages.select("file", "package"), "file", "left").withColumn("package", F.coalesce("package", F.lit("")))


def cache_hits(packages: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return packages.join(cache.select(key).distinct(), key, "left_semi")


def cache_misses(packages: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """A package whose key can't be computed (null) counts as a miss."""
    return packages.join(cache.select(key).distinct(), key, "left_anti")


def superseded_runs(runs: DataFrame) -> DataFrame:
    """Runs (run_id, package, go_files, compiles) of which another run of the package compiled a strict superset of files.

    The join is on the package and one of the run's files, so it doesn't compare all runs of a package with each other;
    a run without files is compared with its package's largest compiling run.
    """
    yes = F.coalesce(F.col("compiles"), F.lit(True))
    sets = runs.select("run_id", "package", F.array_distinct("go_files").alias("files"), F.size("go_files").alias("n"), yes.alias("ok"))
    small = sets.where("size(files) > 0").withColumn("file", F.array_min("files"))
    big = sets.where("ok").select("package", F.explode("files").alias("file"), F.col("files").alias("of"), F.col("n").alias("m"))
    hit = small.join(big, ["package", "file"]).where((F.col("m") > F.col("n")) & (F.size(F.array_except("files", "of")) == 0)).select("run_id").distinct()
    most = sets.where("ok").groupBy("package").agg(F.max("n").alias("m"))
    empty = sets.where("size(files) = 0").join(most, "package").where("m > n").select("run_id")
    return hit.union(empty)


def strict_superset(a: str, b: str):
    """Column: array ``a`` holds all of ``b`` and is longer."""
    return (F.size(F.array_except(F.col(b), F.col(a))) == 0) & (F.size(F.col(a)) > F.size(F.col(b)))


def without_test_superseded(packages: DataFrame) -> DataFrame:
    """Packages but those with an in-package test variant (for_test = path); external test packages supersede nothing."""
    variants = packages.where("for_test = path").select(F.col("path").alias("p")).distinct()
    plain = F.coalesce(F.col("for_test"), F.lit("")) == ""
    return packages.where(~plain).unionByName(packages.where(plain).join(variants, F.col("path") == F.col("p"), "left_anti"))


def resolved_aliases(direct: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, file) of direct entries and of aliases (source, target) that no direct entry overrides."""
    via = aliases.join(direct.select(F.col("path").alias("target"), "file"), "target").select(F.col("source").alias("path"), "file")
    return direct.select("path", "file").unionByName(via.join(direct.select("path"), "path", "left_anti"))


def resolved_paths(findings: DataFrame, package_dirs: DataFrame) -> DataFrame:
    """Canonical paths (<package>/<base>) -> paths in the package's folder; an unknown package's stays."""
    package = F.regexp_replace("file", "/[^/]*$", "")
    base = F.element_at(F.split("file", "/"), -1)
    joined = findings.withColumn("package_", package).join(package_dirs.select(F.col("package").alias("package_"), "dir"), "package_", "left")
    return joined.withColumn("file", F.when(F.col("dir").isNull(), F.col("file")).otherwise(F.concat("dir", F.lit("/"), base))).select(*findings.columns)


def unused_objects(objects: DataFrame) -> DataFrame:
    """Objects (file, line, name, used, is_type_param) never used at the same place under the same name."""
    used = objects.where("used").select("file", "line", "name").distinct()
    return objects.where("not used and not is_type_param").join(used, ["file", "line", "name"], "left_anti")


def dependency_overrides(closure: DataFrame, cache: DataFrame) -> DataFrame:
    """Every dependency of a closure (root, node, key) with what the cache has for its key."""
    return closure.join(cache.select("key", "facts"), "key", "left")


def routed_facts(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(src, package, facts): a dependency gives its own facts, an embedded one all that it was given (kind 'embed')."""
    own = edges.where("kind = 'dep'").join(facts.select(F.col("package").alias("dst"), "facts"), "dst").select("src", F.col("dst").alias("package"), "facts")
    given = own.select(F.col("src").alias("dst"), "package", "facts")
    embedded = edges.where("kind = 'embed'").join(given, "dst").select("src", "package", "facts")
    return own.unionByName(embedded).distinct()


def with_overlay(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Files (path, text) with staged content instead of their own; a staged null removes the file, a new path adds one."""
    o = overlay.select("path", F.col("text").alias("staged"), F.lit(True).alias("has"))
    joined = base.join(o, "path", "full").where("has is null or staged is not null")
    return joined.select("path", F.when(F.col("has"), F.col("staged")).otherwise(F.col("text")).alias("text"))
