"""The rule catalogue: which names exist, which are on, and what runs them."""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as fc
from . import go_rules, rules

#: Names whose rule needs only text, lines, sets, counts or syntax, and has a form here. Two more line rules, trailing-space and sentence-end, are this engine's own and chosen by hand.
NATIVE = tuple(sorted({*rules.TEXT_RULES, *rules.TABLE_RULES, *go_rules.GO_RULES, *go_rules.MODULE_RULES, "typecheck"} - {"trailing-space", "sentence-end"}))
#: The names of all rules but the text and table rules; those that no rule above has need types, and nothing here runs them.
NAMES = tuple(
    "asasalint bodyclose canonicalheader containedctx contextcheck copyloopvar cyclop decorder depguard dogsled durationcheck embeddedstructfieldcheck errcheck errchkjson errname errorlint exhaustive exhaustruct exptostd fatcontext forcetypeassert funcorder funlen ginkgolinter gocheckcompilerdirectives gochecknoglobals gochecknoinits gochecksumtype gocognit gocritic gocyclo godoclint gomoddirectives gomodguard goprintffuncname gosec gosmopolitan govet grouper iface importas inamedparam ineffassign interfacebloat intrange iotamixing ireturn loggercheck maintidx makezero mirror misspell mnd modernize musttag nakedret nestif nilerr nilnesserr nilnil nlreturn noctx noinlineerr nolintlint nonamedreturns nosprintfhostport paralleltest perfsprint prealloc predeclared promlinter protogetter reassign recvcheck revive rowserrcheck sloglint spancheck sqlclosecheck staticcheck tagalign tagliatelle testableexamples testifylint testpackage thelper tparallel tracecheck typecheck unconvert unparam unqueryvet unused usestdlibvars usetesting varnamelen wastedassign wrapcheck wsl wsl_v5 zerologlint".split()
)
UNWIRED = tuple(n for n in NAMES if n not in NATIVE)
FORMATTERS = ("gci", "gofmt", "gofumpt", "goimports", "golines", "swaggo")
STANDARD = ("errcheck", "govet", "ineffassign", "staticcheck", "typecheck", "unused")
ALIASES = {"gosimple": "staticcheck", "stylecheck": "staticcheck"}


@dataclass(frozen=True)
class Descriptor:
    """What a rule's cache key needs to know of it."""

    name: str
    version: str = "1"
    scope: str = "syntax"
    facts: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)


def catalog(spark: SparkSession) -> DataFrame:
    """(name, shape, standard)."""
    rows = [(n, "native", n in STANDARD) for n in NATIVE] + [(n, "unwired", n in STANDARD) for n in UNWIRED] + [(n, "formatter", False) for n in FORMATTERS]
    return spark.createDataFrame(sorted(rows), "name string, shape string, standard boolean")


def resolve(known: DataFrame, default: str, enable: list[str], disable: list[str]) -> DataFrame:
    """(name, shape, status): enabled, disabled, or no-analyzer for enabled names that nothing runs."""
    on = [ALIASES.get(n, n) for n in enable]
    off = [ALIASES.get(n, n) for n in disable]
    seed: Column = {"standard": F.col("standard"), "all": F.lit(True), "none": F.lit(False), "fast": F.col("shape") == "native"}[default]
    active = (seed | F.col("name").isin(*on)) & ~F.col("name").isin(*off) & (F.col("shape") != "formatter")
    return known.select("name", "shape", F.when(~active, "disabled").when(F.col("shape") == "unwired", "no-analyzer").otherwise("enabled").alias("status"))


def unknown_names(known: DataFrame, names: list[str]) -> list[str]:
    have = {r["name"] for r in known.select("name").collect()} | set(ALIASES)
    return sorted(set(names) - have)


def plan(resolved: DataFrame, custom: dict[str, list[str]], settings: dict[str, dict] | None = None) -> tuple[list[rules.Rule | rules.TableRule], list[str], list[str]]:
    """Rules to run (see rules.run), plugins to start, and warnings about enabled names that nothing runs or whose settings don't fit."""
    known = rules.TEXT_RULES | rules.TABLE_RULES
    native, warnings, syntax, reads = [], [], {}, False
    for n, status in sorted((r["name"], r["status"]) for r in resolved.collect()):
        if status == "no-analyzer":
            warnings.append(f"{n}: no analyzer")
        elif status == "enabled" and n == "typecheck":
            reads = True  # comes with reading the files
        elif status == "enabled" and n not in known:
            given = (settings or {}).get(n, {})
            fit = set(given) <= set(inspect.signature((go_rules.GO_RULES | go_rules.MODULE_RULES)[n]).parameters)
            if fit:
                syntax[n] = given
            else:
                warnings.append(f"{n}: unknown settings: {', '.join(sorted(given))}")
        elif status == "enabled":
            try:
                native.append(known[n](**(settings or {}).get(n, {})))
            except (KeyError, TypeError) as e:
                warnings.append(f"{n}: {'no rule' if isinstance(e, KeyError) else e}")
    if syntax or reads:
        native.append(rules.TableRule("syntax", lambda lines, files: go_rules.findings(files, syntax)))
    return native, sorted(custom), warnings


def listing(resolved: DataFrame) -> DataFrame:
    return resolved.select("name", (F.col("status") != "disabled").alias("enabled"), (F.col("shape") == "formatter").alias("formatter")).orderBy("name")


#: Rules that need the toolchain that a hermetic run doesn't have: none here reads more than its files.
TOOLCHAIN: tuple[str, ...] = ()


def select_roots(resolved: DataFrame, mode: str = "full", producers: tuple[str, ...] = (), hermetic: bool = True) -> tuple[list[str], list[str]]:
    """(names to run, names left out) of the enabled ones for one package.

    Rules of module scope never run for a package; in module mode nothing else does. A hermetic run leaves out what needs
    the toolchain; facts_only keeps the producers of facts.
    """
    enabled = sorted(r["name"] for r in resolved.where("status = 'enabled'").collect())
    module = set(go_rules.MODULE_RULES)
    keep = {
        "module": lambda n: n in module,
        "full": lambda n: n not in module,
        "facts_only": lambda n: n not in module and n in producers,
    }[mode]
    roots = [n for n in enabled if keep(n) and not (hermetic and n in TOOLCHAIN)]
    return roots, [n for n in enabled if n not in roots]


def families(spark: SparkSession) -> DataFrame:
    """(family, member) of the names that stand for many checks, as far as the members are listed here."""
    return spark.createDataFrame([("govet", m) for m in fc.GOVET_MEMBERS], "family string, member string")
