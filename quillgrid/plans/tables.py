"""How the engine's tables are bound to the given ones, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..sources.corpus import documents, lines, table

WORDS = ("license", "licensed")
RUN_FILES = 16


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def corpus_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(documents(spark, d))


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Text rules over the documents' lines."""
    return rules.findings(corpus_lines(spark, d), rules.long_lines(), rules.repeated_tokens(), rules.nonascii_lines(), rules.keyword_lines(WORDS))


def log(spark: SparkSession, d: str) -> DataFrame:
    """The event table as an ordered log of findings: seq, linter, file, line, v."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("linter"), F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit(".txt")).alias("file"), F.hour("ts").alias("line"), F.col("event_id").cast("string").alias("message"), F.floor(F.col("value") * 100).alias("v"), "ts")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs: package = customer, files = distinct parts modulo RUN_FILES; every seventh doesn't compile."""
    files = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_set((F.col("l_partkey") % RUN_FILES).cast("string")).alias("go_files"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").cast("string").alias("package"), (F.col("o_orderkey") % 7 != 0).alias("compiles"))
    return o.join(files, "run_id")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a graph: each turn depends on the one before it."""
    t = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    name = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit("/"), n.cast("string"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"))
    return t.join(before, ["conv_id", "turn"]).select(name(F.col("turn")).alias("src"), name(F.col("turn") - 1).alias("dst"))


DOCS = "docs AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file, source || '/' || lang AS package, text FROM documents)"
LINES = f"""{DOCS}, cut AS (SELECT file, package, string_split(text, chr(10)) AS l FROM docs),
lines AS (SELECT file, package, line, content FROM (SELECT file, package, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS line, unnest(l) AS content, len(l) AS n FROM cut) WHERE content <> '' OR line < n),
worded AS (SELECT *, string_split(content, ' ') AS w FROM lines)"""
REPEATS = "len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1] AND w[i] <> ''))"
ODD = "length(regexp_replace(content, '[\\x00-\\x7F]', '', 'g'))"
WORD = "(?i)(^|[^A-Za-z0-9_])(license|licensed)($|[^A-Za-z0-9_])"
FINDINGS = f"""{LINES}, findings AS (
SELECT 'lll' AS linter, 'line is ' || length(content) || ' characters' AS message, 'error' AS severity, file, package, line, 0 AS "column" FROM lines WHERE length(content) > 120
UNION ALL SELECT 'dupword', 'repeated words: ' || {REPEATS}, 'warning', file, package, line, 0 FROM worded WHERE {REPEATS} > 0
UNION ALL SELECT 'asciicheck', {ODD} || ' characters beyond ASCII', 'info', file, package, line, 0 FROM lines WHERE {ODD} > 0
UNION ALL SELECT 'godox', 'line contains ' || upper(regexp_extract(content, '{WORD}', 2)), 'warning', file, package, line, 0 FROM lines WHERE regexp_matches(content, '{WORD}'))"""
LOG = "log AS (SELECT event_id AS seq, event_type AS linter, 'user/' || user_id || '.txt' AS file, CAST(hour(ts) AS INTEGER) AS line, CAST(event_id AS VARCHAR) AS message, CAST(floor(value * 100) AS BIGINT) AS v, ts FROM events)"
RUNS = f"""runs AS (SELECT o_orderkey AS run_id, CAST(o_custkey AS VARCHAR) AS package, o_orderkey % 7 <> 0 AS compiles, files AS go_files FROM orders
JOIN (SELECT l_orderkey, list(DISTINCT CAST(l_partkey % {RUN_FILES} AS VARCHAR)) AS files FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
TURNS = """t AS (SELECT DISTINCT conv_id, turn FROM conversations),
turns AS (SELECT a.conv_id || '/' || a.turn AS src, a.conv_id || '/' || (a.turn - 1) AS dst FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)"""
