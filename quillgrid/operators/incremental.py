"""Skipping unchanged work: content-addressed keys, caches as tables, invalidation and eviction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fc
from .aggregates import set_digest
from .graph import paths, ready

ZERO = "0" * 64
KEEP_DAYS = 30


def source_digests(files: DataFrame) -> DataFrame:
    """(package, source): digest of a package's files (package, file, text)."""
    rows = files.select("package", "file", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return set_digest(rows, ("package",), "file", "hash").select("package", F.col("digest").alias("source"))


def closure_digests(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(package, deps): digest over the digests of everything that a package depends on, itself left out."""
    below = paths(edges).where("root <> node").select(F.col("root").alias("package"), F.col("node").alias("dep"))
    rows = below.join(sources.select(F.col("package").alias("dep"), "source"), "dep", "left")
    broken = rows.where("source is null").select("package").distinct()
    found = set_digest(rows.where("source is not null"), ("package",), "dep", "source").select("package", F.col("digest").alias("deps"))
    return sources.select("package").join(found, "package", "left").join(broken.withColumn("broken", F.lit(True)), "package", "left").select("package", F.when(~F.coalesce("broken", F.lit(False)), F.coalesce("deps", F.lit(ZERO))).alias("deps"))


def result_keys(sources: DataFrame, deps: DataFrame, analyzers: str, filter_: str, tool: str, env: str, version: str = "1") -> DataFrame:
    """(package, key): null where a dependency is unknown."""
    both = sources.join(deps, "package")
    key = fc.digest(F.lit(version), F.lit("result"), F.col("package"), F.col("source"), F.col("deps"), F.lit(analyzers), F.lit(filter_), F.lit(tool), F.lit(env))
    return both.select("package", F.when(F.col("deps").isNotNull(), key).alias("key"))


def analyzer_key(analyzer: Column, package: Column, input_: Column, facts: Column, types: Column, version: Column, salt: Column, tool: Column) -> Column:
    return fc.digest(analyzer, package, input_, facts, types, version, salt, tool)


def scoped_input(scope: Column, local: Column, reachable: Column) -> Column:
    """Rules that read no more than syntax are keyed by the package alone."""
    return F.when(scope == "syntax", local).otherwise(reachable)


def scoped_types(scope: Column, all_deps: Column) -> Column:
    return F.when(scope == "syntax", F.lit("syntax-only")).otherwise(all_deps)


def fact_digests(deps: DataFrame, facts: DataFrame) -> DataFrame:
    """Digest of each package's dependencies' facts (dep, hash); a dependency without facts counts as zeros."""
    rows = deps.join(facts.select("dep", "hash"), "dep", "left").withColumn("hash", F.coalesce("hash", F.lit(ZERO)))
    return set_digest(rows, ("package",), "dep", "hash").select("package", F.col("digest").alias("facts"))


def split_cached(keys: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits and misses of (package, key)."""
    have = cache.select("key").distinct()
    return keys.join(have, "key", "left_semi"), keys.join(have, "key", "left_anti")


def entries(keys: DataFrame, findings: DataFrame) -> DataFrame:
    """Cache entries of analysed packages: one for each key, with an empty array where nothing was found."""
    rows = findings.groupBy("package").agg(F.array_sort(F.collect_list(F.struct("file", "line", "column", "linter", "message", "severity"))).alias("findings"))
    none = F.array().cast(rows.schema["findings"].dataType)
    return keys.where("key is not null").join(rows, "package", "left").select("key", "package", F.coalesce("findings", none).alias("findings"))


def publish(cache_path: str, new: DataFrame) -> None:
    """Appends entries that the cache lacks; the first writer of a key wins. Partitioned by the key's first two digits.

    Two writers at once may both append a key: each batch carries when it was written and by whom, and reading takes the
    first, so that all readers see the same one.
    """
    import time
    import uuid

    spark = new.sparkSession
    try:
        have = spark.read.parquet(cache_path).select("key")
        new = new.join(have, "key", "left_anti")
    except Exception as e:  # no such table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    batch = new.dropDuplicates(["key"]).withColumns({"shard": F.substring("key", 1, 2), "written": F.lit(time.time_ns()), "writer": F.lit(uuid.uuid4().hex)})
    batch.write.mode("append").partitionBy("shard").parquet(cache_path)


def settled(cache: DataFrame) -> DataFrame:
    """Of each key the entry that was written first."""
    from .dedup import first_of

    return first_of(cache, ("shard", "key"), ("written", "writer")).drop("written", "writer")


def lookup(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries for the keys; the shard column prunes partitions at run time."""
    wanted = keys.select("key", F.substring("key", 1, 2).alias("shard")).distinct()
    return settled(cache.join(wanted, ["shard", "key"], "left_semi"))


def intact(bodies: DataFrame) -> DataFrame:
    """Remote entries (body, output_id) whose body has the digest that they claim."""
    return bodies.where(F.sha2(F.col("body").cast("binary"), 256) == F.col("output_id"))


def aged_out(cache: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Entries (key, mtime, size) older than so many days; exactly so old stays."""
    return cache.where(F.col("mtime") < now - F.make_dt_interval(F.lit(days)))


def over_budget(cache: DataFrame, budget: int, buckets: int = 512) -> DataFrame:
    """Entries to evict, oldest first, until the rest is below the budget.

    The running total over all entries would sort them in one task; instead sizes are summed by time bucket, and only
    the bucket in which the budget runs out is sorted.
    """
    timed = cache.withColumn("t_", F.unix_micros(F.col("mtime").cast("timestamp")))
    lo, hi = timed.agg(F.min("t_"), F.max("t_")).first()
    if lo is None:
        return cache.limit(0)
    width = (hi - lo) // buckets + 1
    placed = timed.withColumn("b_", F.floor((F.col("t_") - lo) / width).cast("int"))
    sums = sorted(((r["b_"], r["s"]) for r in placed.groupBy("b_").agg(F.sum("size").alias("s")).collect()), reverse=True)
    total, edge = 0, -1
    for b, s in sums:
        if total + s >= budget:
            edge = b
            break
        total += s
    if edge < 0:
        return cache.limit(0)
    w = Window.partitionBy("b_").orderBy(F.col("t_").desc(), "key")
    part = placed.where(F.col("b_") == edge).withColumn("run_", F.sum("size").over(w) + total).where(F.col("run_") >= budget)
    return placed.where(F.col("b_") < edge).select(*cache.columns).unionByName(part.select(*cache.columns))


def least_recent(accesses: DataFrame, capacity: int) -> DataFrame:
    """Keys that an LRU cache of a size drops after a whole log (key, at, size)."""
    last = accesses.groupBy("key").agg(F.max("at").alias("mtime"), F.max_by("size", "at").alias("size"))
    return over_budget(last, capacity + 1)


def invalidated(results: DataFrame, stale: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (package, ...) that a set of stale packages leaves valid, and those to recompute."""
    s = stale.select(F.col("node").alias("package"))
    return results.join(s, "package", "left_anti"), results.join(s, "package", "left_semi")


def unaffected(dependents: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Early cut-off: dependents (package) whose facts' digest (package, facts) is as before."""
    same = before.join(after, ["package", "facts"]).select("package")
    return dependents.join(same, "package", "left_semi")


def workspace_digest(files: DataFrame, tags: tuple[str, ...] = (), env: dict[str, str] | None = None) -> str:
    """Of all files' paths and contents (file, text), build tags and environment."""
    import hashlib

    rows = files.select(F.lit(1).alias("all"), "file", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    # files are digested by shard first, so that no task gathers all of them
    sharded = set_digest(rows.withColumn("shard", F.substring(F.sha2("file", 256), 1, 3)), ("shard",), "file", "hash")
    found = sharded.orderBy("shard").collect()  # of 4096 shards at most
    parts = [f"{r['shard']}={r['digest']}" for r in found] + sorted(tags) + [f"{k}={v}" for k, v in sorted((env or {}).items())]
    return hashlib.sha256("".join(f"{len(x)}:{x}" for x in parts).encode()).hexdigest()


def metrics(counters: DataFrame, severities: DataFrame) -> str:
    """Cache counters by tier and findings by severity as JSON."""
    import json

    tiers = {r["tier"]: {k: r[k] for k in ("hits", "misses", "stores", "errors")} for r in counters.collect()}
    return json.dumps({"cache": tiers, "findings": {r["severity"]: r["n"] for r in severities.collect()}}, sort_keys=True)


def analyzer_set_digest(analyzers: DataFrame) -> DataFrame:
    """One row: the digest of all enabled analyzers (name, version, scope, salt), in whatever order they are listed."""
    return set_digest(analyzers, (), "name", "version", "scope", "salt").select("digest", "n")


def reachable_keys(edges: DataFrame, local: DataFrame) -> DataFrame:
    """(package, key): a package's own key (package, source) with the keys of all that it reaches."""
    return local.join(closure_digests(edges, local), "package").select("package", F.when(F.col("deps").isNotNull(), fc.digest("package", "source", "deps")).alias("key"))


def decoded(cache: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """Entries (key, version, body as JSON text) that can be used, and one row: errors, the number of those that can't be read.

    An entry of another version is purged without an error; one whose body is no JSON list is an error and then a miss.
    """
    parsed = cache.where(F.col("version") == version).withColumn("findings", F.try_parse_json("body"))
    is_list = F.coalesce(F.schema_of_variant("findings").startswith("ARRAY"), F.lit(False))
    return parsed.where(is_list), parsed.agg(F.count_if(~is_list).alias("errors"))


def cleaned(cache: DataFrame, tier: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What is left of a cache (key, tier, size) after cleaning it, or one tier of it; and one row: the bytes and files that go."""
    from .aggregates import disk_use

    gone = F.lit(True) if tier is None else F.col("tier") == tier
    return cache.where(~gone), disk_use(cache.where(gone))


def analysed(files: DataFrame, edges: DataFrame, analyse: Callable[[DataFrame], DataFrame], cache_path: str, analyzers: str, filter_: str = "", tool: str = "", env: str = "") -> DataFrame:
    """Findings of all packages, of which only those are analysed whose key the cache lacks; what is new is published.

    ``analyse`` gives findings (with package) for files (package, file, text). A package whose key can't be computed is
    analysed each time and never cached.
    """
    src = source_digests(files)
    keys = result_keys(src, closure_digests(edges, src), analyzers, filter_, tool, env)
    spark = files.sparkSession
    try:
        cache = settled(spark.read.parquet(cache_path))
    except Exception as e:  # no such table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = None
    missing = keys if cache is None else keys.join(cache.select("key"), "key", "left_anti")
    ready(spark)
    missing = missing.select("package", "key").checkpoint()
    fresh = analyse(files.join(missing.select("package"), "package", "left_semi")).checkpoint()
    if not missing.isEmpty():
        publish(cache_path, entries(missing, fresh))
    if cache is None:
        return fresh
    known = cache.join(keys, ["key", "package"], "left_semi").select("package", F.explode("findings").alias("f")).select("package", "f.*")
    return known.unionByName(fresh, allowMissingColumns=True)
