"""Readers of report and metadata files, all with fixed schemas."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..schema import struct

LOCATION = "physicalLocation struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>"
SARIF = f"""runs array<struct<
  results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<{LOCATION.replace(" ", ":", 1)}>>>>,
  properties:struct<unit:struct<package:string,mode:string,goFiles:array<string>,compiles:boolean>>>>"""
PLUGIN = "file string, line int, column int, severity string, message string, code string, related array<struct<file:string,line:int,column:int,message:string>>"
EXTERNAL_A = "Issues array<struct<FromLinter:string,Text:string,Severity:string,Pos:struct<Filename:string,Line:int,Column:int>>>"
EXTERNAL_B = "issues array<struct<linter:string,message:string,severity:string,pos:struct<filename:string,line:int,column:int>>>"


def sarif(spark: SparkSession, paths: list[str], unit_key: str = "unit") -> tuple[DataFrame, DataFrame]:
    """(runs, results): of each result the first location; run identity from its first run with a package; no ``compiles`` means true."""
    schema = SARIF.replace("struct<unit:", f"struct<{unit_key}:")
    raw = spark.read.schema(struct(schema)).option("multiLine", True).json(paths).withColumn("path", F.input_file_name())
    order = {p: i for i, p in enumerate(paths)}
    at = F.create_map(*[F.lit(x) for p, i in order.items() for x in (str(PurePosixPath(p).name), i)])[F.element_at(F.split("path", "/"), -1)]
    raw = raw.withColumn("run_id", at.cast("long"))
    unit = F.get(F.filter("runs", lambda r: F.coalesce(r["properties"][unit_key]["package"], F.lit("")) != ""), 0)["properties"][unit_key]
    runs = raw.select("run_id", unit["package"].alias("package"), unit["mode"].alias("mode"), unit["goFiles"].alias("go_files"), F.coalesce(unit["compiles"], F.lit(True)).alias("compiles"))
    results = raw.select("run_id", F.explode("runs").alias("run")).select("run_id", F.posexplode("run.results").alias("ordinal", "r"))
    where = F.get("r.locations", 0)["physicalLocation"]
    flat = results.select("run_id", "ordinal", F.col("r.ruleId").alias("linter"), F.col("r.message.text").alias("message"), F.col("r.level").alias("severity"), where["artifactLocation"]["uri"].alias("file"), where["region"]["startLine"].alias("line"), where["region"]["startColumn"].alias("column"))
    return runs, flat


def plugin_findings(raw: DataFrame, linter: str, root: str = "") -> DataFrame:
    """Findings of a plugin's JSON lines (column value). A line without file, positive line or message fails the whole read."""
    parsed = raw.where(F.trim("value") != "").select("value", F.from_json("value", struct(PLUGIN)).alias("p"))
    bad = F.col("p.file").isNull() | (F.col("p.file") == "") | ~F.coalesce(F.col("p.line") > 0, F.lit(False)) | F.coalesce(F.col("p.message") == "", F.lit(True))
    checked = parsed.select(F.when(bad, F.raise_error(F.concat(F.lit("finding without file, line or message: "), "value")).cast(struct(PLUGIN))).otherwise(F.col("p")).alias("p"))
    path = F.when(F.startswith("p.file", F.lit("/")) | F.lit(not root), F.col("p.file")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("p.file", r"^\./", "")))
    return checked.select(F.lit(linter).alias("linter"), F.regexp_replace("p.message", r"[ \t\r\n]+$", "").alias("message"), fc.severity_of(F.coalesce("p.severity", F.lit(""))).alias("severity"), path.alias("file"), F.col("p.line").alias("line"), F.coalesce("p.column", F.lit(0)).alias("column"), F.col("p.related").alias("related"))


def external_a(spark: SparkSession, path: str) -> DataFrame:
    i = spark.read.schema(struct(EXTERNAL_A)).option("multiLine", True).json(path).select(F.explode("Issues").alias("i"))
    return i.select(F.replace(F.col("i.Pos.Filename"), F.lit("\\"), F.lit("/")).alias("file"), F.col("i.Pos.Line").alias("line"), F.coalesce("i.Pos.Column", F.lit(0)).alias("column"), F.col("i.FromLinter").alias("linter"), F.col("i.Text").alias("message"))


def external_b(spark: SparkSession, path: str) -> DataFrame:
    i = spark.read.schema(struct(EXTERNAL_B)).option("multiLine", True).json(path).select(F.explode("issues").alias("i"))
    return i.select(F.replace(F.col("i.pos.filename"), F.lit("\\"), F.lit("/")).alias("file"), F.col("i.pos.line").alias("line"), F.coalesce("i.pos.column", F.lit(0)).alias("column"), F.col("i.linter").alias("linter"), F.col("i.message").alias("message"))


def import_config(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(direct, aliases) of ``packagefile a=b`` and ``importmap old=new`` lines (column value); another verb is an error."""
    text = raw.select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    verb, rest = F.split("v", " ", 2)[0], F.trim(F.split("v", " ", 2)[1])
    known = F.when(~verb.isin("packagefile", "importmap"), F.raise_error(F.concat(F.lit("unknown directive: "), "v")).cast("string")).otherwise(verb)
    rows = text.select(known.alias("verb"), F.split(rest, "=", 2)[0].alias("a"), F.split(rest, "=", 2)[1].alias("b"))
    return rows.where("verb = 'packagefile'").select(F.col("a").alias("path"), F.col("b").alias("file")), rows.where("verb = 'importmap'").select(F.col("a").alias("source"), F.col("b").alias("target"))


def facts(table: DataFrame, version: int) -> DataFrame:
    """Facts (package, analyzer, object, fact_type, value, version) of the wanted format."""
    return table.where(F.col("version") == version)


def dependency_facts(facts: DataFrame, direct: DataFrame) -> DataFrame:
    """Facts of the declared direct dependencies (package)."""
    return facts.join(direct.select("package").distinct(), "package", "left_semi")


@dataclass
class UnitConfig:
    package: str
    go_files: list[str]
    goos: str = ""
    goarch: str = ""
    tags: list[str] = field(default_factory=list)
    mode: str = "full"
    enable_only: list[str] = field(default_factory=list)
    facts: dict[str, str] = field(default_factory=dict)
    out: dict[str, str] = field(default_factory=dict)


def unit_config(text: str) -> UnitConfig:
    """One action's configuration: schema 1, no unknown fields, known modes."""
    top = json.loads(text)
    known = {"schema": int, "package": dict, "deps": dict, "module": dict, "analysis": dict, "out": dict}
    if extra := set(top) - set(known):
        raise ValueError(f"unknown fields: {', '.join(sorted(extra))}")
    if top.get("schema") != 1:
        raise ValueError("schema must be 1")
    p, a = top.get("package", {}), top.get("analysis", {})
    if extra := set(p) - {"path", "go_files", "goos", "goarch", "tags", "cgo", "go_version", "test_filter"}:
        raise ValueError(f"unknown fields: {', '.join(sorted(extra))}")
    if not p.get("path"):
        raise ValueError("package.path is missing")
    mode = a.get("mode") or "full"
    if mode not in ("full", "facts_only", "module"):
        raise ValueError(f"unknown mode: {mode}")
    if p.get("test_filter", "") not in ("", "only", "exclude"):
        raise ValueError(f"unknown test_filter: {p['test_filter']}")
    return UnitConfig(p["path"], p.get("go_files", []), p.get("goos", ""), p.get("goarch", ""), p.get("tags", []), mode, a.get("enable_only", []), top.get("deps", {}).get("facts", {}), top.get("out", {}))


def params(args: list[str]) -> list[str]:
    """Arguments with each @file replaced by its lines that aren't empty."""
    out: list[str] = []
    for a in args:
        if a.startswith("@"):
            with open(a[1:], encoding="utf-8") as f:
                out += [x.rstrip("\n") for x in f if x.strip()]
        else:
            out.append(a)
    return out


def remote_entries(spark: SparkSession, folder: str) -> DataFrame:
    """(key, body, output_id) of a remote cache in any store: files named by the digest of what they hold, and of each key a file ``<key>.id`` that names one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    ids = named.where(F.endswith("name", F.lit(".id"))).select(F.regexp_replace("name", r"\.id$", "").alias("key"), F.trim(F.col("content").cast("string")).alias("output_id"))
    bodies = named.where(~F.endswith("name", F.lit(".id"))).select(F.col("name").alias("output_id"), F.col("content").alias("body"))
    return ids.join(bodies, "output_id").select("key", "body", "output_id")
