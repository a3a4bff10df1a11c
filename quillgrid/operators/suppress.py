"""Suppression of findings: rules, targets, generated files and line ranges.

Predicates are Columns, folded into one filter; only what needs another table is a join. Range suppression is an anti
join on the file with the interval as residual condition, never a nested loop.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..functions import paths


@dataclass(frozen=True)
class ExcludeRule:
    linters: tuple[str, ...] = ()
    path: str = ""
    path_except: str = ""
    text: str = ""
    source: str = ""


#: The four named rule lists.
PRESETS: dict[str, tuple[ExcludeRule, ...]] = {
    "comments": (
        ExcludeRule(("staticcheck",), text=r"(ST1000|ST1020|ST1021|ST1022)"),
        ExcludeRule(("revive",), text=r"exported (.+) should have comment( \(or a comment on this block\))? or be unexported"),
        ExcludeRule(("revive",), text=r'package comment should be of the form "(.+)..."'),
        ExcludeRule(("revive",), text=r'comment on exported (.+) should be of the form "(.+)..."'),
        ExcludeRule(("revive",), text=r"should have a package comment"),
    ),
    "std-error-handling": (
        ExcludeRule(("errcheck",), text=r"(?i)Error return value of .((os\.)?std(out|err)\..*|.*Close|.*Flush|os\.Remove(All)?|.*print(f|ln)?|os\.(Un)?Setenv). is not checked"),
    ),
    "common-false-positives": (
        ExcludeRule(("gosec",), text=r"G103: Use of unsafe calls should be audited"),
        ExcludeRule(("gosec",), text=r"G204: Subprocess launched with variable"),
        ExcludeRule(("gosec",), text=r"G304: Potential file inclusion via variable"),
    ),
    "legacy": (
        ExcludeRule(("govet",), text=r"(possible misuse of unsafe.Pointer|should have signature)"),
        ExcludeRule(("staticcheck",), text=r"SA4011"),
        ExcludeRule(("gosec",), text=r"G104"),
        ExcludeRule(("gosec",), text=r"(G301|G302|G307): Expect (directory permissions to be 0750|file permissions to be 0600) or less"),
    ),
}


@dataclass(frozen=True)
class Config:
    targets: list[tuple[str, bool]] | None = None
    paths: tuple[str, ...] = ()
    paths_except: tuple[str, ...] = ()
    generated: str = "strict"  # strict, lax or disable
    rules: tuple[ExcludeRule, ...] = ()
    presets: tuple[str, ...] = ()
    keep_style_checks: bool = False
    base: str = ""
    once_per_line: bool = True

    def digest(self) -> str:
        """Of all that decides what is dropped, with the order of linters in a rule left out, and the base path."""
        import hashlib

        rules = [[sorted(r.linters), r.path, r.path_except, r.text, r.source] for r in self.all_rules()]
        parts = ["targets", self.targets, "paths", self.paths, "except", self.paths_except, "generated", self.generated, "rules", rules, "style", self.keep_style_checks, "once", self.once_per_line]
        return hashlib.sha256("".join(f"{len(str(x))}:{x}" for x in parts).encode()).hexdigest()

    def all_rules(self) -> tuple[ExcludeRule, ...]:
        return self.rules + tuple(r for p in self.presets for r in PRESETS[p])


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def validate(rule: ExcludeRule, least: int = 2) -> list[str]:
    """What is wrong with a rule: bad patterns, both path conditions, or too few conditions."""
    import re

    wrong = []
    for name in ("path", "path_except", "text", "source"):
        try:
            re.compile(getattr(rule, name))
        except re.error as e:
            wrong.append(f"{name}: {e}")
    if rule.path and rule.path_except:
        wrong.append("path and path-except exclude each other")
    if sum(bool(x) for x in (rule.linters, rule.path or rule.path_except, rule.text, rule.source)) < least:
        wrong.append(f"at least {least} conditions are needed")
    return wrong


def rule_hits(r: ExcludeRule, linter: Column, path: Column, message: Column) -> Column:
    """All conditions of a rule; an empty rule never fires, nor does one with a source condition."""
    if r.source or not (r.linters or r.path or r.path_except or r.text):
        return F.lit(False)
    out = F.lit(True)
    if r.linters:
        out = linter.isin(*r.linters) | fc.family(linter).isin(*r.linters)
    if r.path:
        out = out & path.rlike(r.path)
    if r.path_except:
        out = out & ~path.rlike(r.path_except)
    if r.text:
        out = out & message.rlike(r.text)
    return out


def generated_files(files: DataFrame, mode: str) -> DataFrame:
    """Files (of file, text) that a marker says are generated."""
    named = files.where(~F.col("file").rlike(r"(^|/)go\.mod$"))
    return named.where(fc.strict_generated("text") if mode == "strict" else fc.lax_generated("text")).select("file").distinct()


def file_dropped(c: Config, path: Column) -> Column:
    """Target scope, paths and paths-except."""
    out = ~paths.in_targets(path, c.targets) | any_of(path.rlike(p) for p in c.paths)
    return out | ~any_of(path.rlike(p) for p in c.paths_except) if c.paths_except else out


def dropped(c: Config) -> Column:
    """All that can be told from a finding's own row."""
    path = fc.relative_path(c.base) if c.base else F.col("file")
    out = file_dropped(c, path) | fc.version_skew() | any_of(rule_hits(r, F.col("linter"), path, F.col("message")) for r in c.all_rules())
    return out if c.keep_style_checks else out | F.col("linter").isin(*fc.DEFAULT_DISABLED)


def in_ranges(findings: DataFrame, ranges: DataFrame) -> DataFrame:
    """Findings that no range of their file suppresses; a range without linters is for all."""
    r = ranges.select(F.col("file").alias("r_file"), "from_line", "to_line", F.col("linters").alias("r_linters"))
    covers = (F.col("file") == F.col("r_file")) & F.col("line").between(F.col("from_line"), F.col("to_line"))
    named = (F.size("r_linters") == 0) | F.exists("r_linters", lambda x: (F.lower(F.col("linter")) == x) | (F.lower(fc.family()) == x))
    return findings.join(r, covers & named, "left_anti")


def expanded_ranges(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ranges, and for each that ends on the line above a node in the node's column, one to the node's end."""
    n = nodes.select(F.col("file").alias("n_file"), "start_line", "end_line", F.col("col").alias("n_col"))
    hit = (F.col("file") == F.col("n_file")) & (F.col("start_line") - 1 == F.col("to_line")) & (F.col("col") == F.col("n_col"))
    longer = ranges.join(n, hit).select("file", "from_line", F.greatest("to_line", "end_line").alias("to_line"), "col", "linters")
    return ranges.select("file", "from_line", "to_line", "col", "linters").unionByName(longer)


def directive_ranges(lines: DataFrame) -> DataFrame:
    """One-line ranges of directives in a line table; malformed directives suppress nothing."""
    comment = F.regexp_extract("content", r"(//[\s\S]*|/\*[\s\S]*\*/)$", 1)
    found = lines.select("file", F.col("line").alias("from_line"), F.col("line").alias("to_line"), (F.length("content") - F.length(comment) + 1).alias("col"), fc.directive(comment).alias("d"))
    return found.where("d is not null and not d.malformed").select("file", "from_line", "to_line", "col", F.col("d.linters").alias("linters"))


def apply(findings: DataFrame, c: Config, ranges: DataFrame | None = None, files: DataFrame | None = None, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The whole chain: what any step drops is gone; then, if asked for, the first finding of each line stays."""
    out = findings.where(~F.coalesce(dropped(c), F.lit(False)))
    if ranges is not None:
        out = in_ranges(out, ranges)
    if files is not None and c.generated != "disable":
        out = out.join(generated_files(files, c.generated), "file", "left_anti")
    return once_per_line(out, order) if c.once_per_line else out


def once_per_line(findings: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The first finding of each (file, line)."""
    from .dedup import first_of

    return first_of(findings, ("file", "line"), order)


def excluded_packages(files: DataFrame, c: Config) -> DataFrame:
    """Packages (of package, file) all of whose files are dropped."""
    gone = file_dropped(c, F.col("file"))
    return files.groupBy("package").agg(F.every(gone).alias("gone")).where("gone").select("package")


def excluded_by_globs(files: DataFrame, folders: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """Packages one of whose folders matches, or all of whose files do."""
    folder = F.regexp_replace("file", "/[^/]*$", "")
    in_folder, by_name = any_of(paths.glob_match(folder, p) for p in folders), any_of(paths.glob_match(F.col("file"), p) for p in names)
    return files.groupBy("package").agg((F.some(in_folder) | F.every(by_name)).alias("gone")).where("gone").select("package")


def prune_roots(packages: DataFrame, excluded: DataFrame) -> DataFrame:
    return packages.join(excluded, "package", "left_anti")


def is_intermediate_variant(for_test: str = "for_test", path: str = "path") -> Column:
    """A package rebuilt for another package's test."""
    t, p = F.col(for_test), F.col(path)
    return (F.coalesce(t, F.lit("")) != "") & (t != p) & (t != F.regexp_replace(p, "_test$", ""))


def without_intermediate_variants(packages: DataFrame) -> DataFrame:
    """Packages (path, for_test) but those rebuilt only for another package's test."""
    return packages.where(~is_intermediate_variant())


def hermetic(linters: DataFrame, toolchain: tuple[str, ...]) -> DataFrame:
    return linters.where(~F.col("linter").isin(*toolchain))


def possible_members(values: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The values that may be members, told by a bloom filter of the members: none is missed, about 1 in 100 others stays."""
    bits, hashes = bloom_size(members.select(key).distinct().count())
    return values.where(may_hold(bloom(members, key, bits, hashes), F.col(key), bits, hashes))


#: Share of strangers that a bloom filter lets pass.
BLOOM_ERROR = 0.01
#: Bits of a filter at most (8 MB): a larger set lets more strangers pass, but never misses a member.
BLOOM_BITS = 1 << 26


def bloom_size(n: int, error: float = BLOOM_ERROR) -> tuple[int, int]:
    """Bits and hash functions for n members."""
    import math

    bits = min(BLOOM_BITS, max(64, math.ceil(-max(1, n) * math.log(error) / math.log(2) ** 2)))
    return bits, max(1, round(bits / max(1, n) * math.log(2)))


def bloom_places(value: Column, bits: int, hashes: int) -> Column:
    """The bits of a value: two hashes, combined."""
    a, b = (F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(1 << 40)) for seed in (1, 2))
    return F.array(*[F.pmod(a + F.lit(k) * b, F.lit(bits)) for k in range(hashes)])


def bloom(members: DataFrame, key: str, bits: int, hashes: int) -> bytes:
    """The filter's bits, set where the members lie: a word of 32 bits is one row on its way to the driver."""
    places = members.select(F.explode(bloom_places(F.col(key), bits, hashes)).alias("p")).distinct()
    words = places.groupBy((F.col("p") / 32).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(32)).cast("int"))).alias("v"))
    import numpy as np

    out = np.zeros(-(-bits // 32), "<u4")
    for r in words.toLocalIterator():
        out[r["w"]] = r["v"]
    return out.tobytes()


def may_hold(filter_: bytes, value: Column, bits: int, hashes: int) -> Column:
    """Whether all bits of a value are set."""
    held = F.lit(bytearray(filter_))

    def is_set(p: Column) -> Column:
        byte = F.conv(F.hex(F.substr(held, (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, F.pmod(p, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return F.forall(bloom_places(value, bits, hashes), is_set)


#: Rules of a table at most.
RULE_TABLE = 10_000


def without_rule_hits(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules kept as a table (RULE schema) instead of configuration: the findings that none of them hits.

    Patterns have no key to join by, so each finding is held against each rule: a table of more than RULE_TABLE rules is
    an error, and a smaller one is sent to all tasks.
    """
    r = rules.where("coalesce(source, '') = ''")
    if (n := r.limit(RULE_TABLE + 1).count()) > RULE_TABLE:
        raise ValueError(f"more than {RULE_TABLE} rules: {n}")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    conditions = [
        (F.size("linters") == 0) | F.array_contains("linters", F.col("linter")) | F.array_contains("linters", fc.family()),
        ~given("path") | F.expr("file rlike path"),
        ~given("path_except") | ~F.expr("file rlike path_except"),
        ~given("text") | F.expr("message rlike text"),
        (F.size("linters") > 0) | given("path") | given("path_except") | given("text"),
    ]
    return findings.join(F.broadcast(r.select("linters", "path", "path_except", "text")), reduce(lambda a, b: a & b, conditions), "left_anti")


def numbered(findings: DataFrame, *order: str) -> DataFrame:
    """``seq`` by an order within each file, for tables that have none."""
    return findings.withColumn("seq", F.row_number().over(Window.partitionBy("file").orderBy(*order)).cast("long"))
