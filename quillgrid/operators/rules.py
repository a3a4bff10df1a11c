"""Text rules: each is a set of Column expressions over a line table (file, package, line, content) that gives findings.

A rule scans the lines once; :func:`findings` unions several rules over the same scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as fc

LONG_LINE = 120
KEYWORDS = ("TODO", "BUG", "FIXME")
BIDI = "[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]"


@dataclass(frozen=True)
class Rule:
    """A named predicate and message over lines."""

    name: str
    where: Column
    message: Column
    column: Column = field(default_factory=lambda: F.lit(0))
    severity: str = "error"


def long_lines(limit: int = LONG_LINE, tab_width: int = 1) -> Rule:
    n = fc.expanded_length("content", tab_width)
    return Rule("lll", n > limit, F.concat(F.lit("line is "), n.cast("string"), F.lit(" characters")))


def keyword_lines(words: tuple[str, ...] = KEYWORDS) -> Rule:
    pattern = f"(?i)(^|[^A-Za-z0-9_])({'|'.join(words)})($|[^A-Za-z0-9_])"  # plain classes: word boundaries differ between engines
    found = F.upper(F.regexp_extract("content", pattern, 2))
    return Rule("godox", F.col("content").rlike(pattern), F.concat(F.lit("line contains "), found), severity="warning")


def repeated_tokens() -> Rule:
    n = fc.repeated_neighbours("content")
    return Rule("dupword", n > 0, F.concat(F.lit("repeated words: "), n.cast("string")), severity="warning")


def nonascii_lines() -> Rule:
    n = F.regexp_count(F.col("content"), F.lit(r"[^\x00-\x7F]"))
    return Rule("asciicheck", n > 0, F.concat(n.cast("string"), F.lit(" characters beyond ASCII")), severity="info")


def bidi_lines() -> Rule:
    return Rule("bidichk", F.col("content").rlike(BIDI), F.lit("bidirectional control character"))


#: What is forbidden where nothing else is configured: printing.
FORBIDDEN = (r"\\b(fmt\\.)?[Pp]rint(f|ln)?\\(",)


def forbidden(patterns: tuple[str, ...] = FORBIDDEN) -> Rule:
    pattern = "|".join(f"(?:{p})" for p in patterns)
    return Rule("forbidigo", F.col("content").rlike(pattern), F.concat(F.lit("use of "), F.regexp_extract("content", pattern, 0), F.lit(" is forbidden")))


def trailing_space() -> Rule:
    return Rule("trailing-space", F.col("content").rlike(r"[ \t]+$"), F.lit("trailing white space"), severity="info")


def sentence_end() -> Rule:
    return Rule("sentence-end", ~F.col("content").rlike(r"[.!?:]\s*$") & (F.trim("content") != ""), F.lit("line doesn't end a sentence"), severity="info")


def findings(lines: DataFrame, *rules: Rule) -> DataFrame:
    """Findings of all rules in one pass over the lines: each row makes an array of its hits, which is exploded."""
    hit = lambda r: F.when(r.where, F.struct(F.lit(r.name).alias("linter"), r.message.alias("message"), F.lit(r.severity).alias("severity"), r.column.cast("int").alias("column")))
    hits = F.filter(F.array(*[hit(r) for r in rules]), lambda x: x.isNotNull())
    return lines.select("file", "package", "line", F.explode(hits).alias("hit")).select("hit.linter", "hit.message", "hit.severity", "file", "package", "line", "hit.column")


def header_missing(files: DataFrame, pattern: str) -> DataFrame:
    """One finding for each file whose text doesn't begin with the header."""
    return files.where(~F.col("text").rlike(f"^(?:{pattern})")).select(F.lit("goheader").alias("linter"), F.lit("missing header").alias("message"), F.lit("error").alias("severity"), "file", "package", F.lit(1).alias("line"), F.lit(0).alias("column"))


def repeated_literals(lines: DataFrame, least_length: int = 3, least_count: int = 3) -> DataFrame:
    """Line texts that occur often: content, number, and the first place."""
    first = F.min(F.struct("file", "line"))
    long = lines.where(F.char_length("content") >= least_length)
    return long.groupBy("content").agg(F.count("*").alias("n"), first.alias("first")).where(F.col("n") >= least_count).select("content", "n", F.col("first.file").alias("file"), F.col("first.line").alias("line"))


def repeated_blocks(lines: DataFrame, window: int) -> DataFrame:
    """Runs of ``window`` equal lines in several places: key, number, and the first place (shingles of lines, grouped by their digest instead of in pairs)."""
    from pyspark.sql import Window

    w = Window.partitionBy("file").orderBy("line").rowsBetween(0, window - 1)
    blocks = lines.select("file", "line", F.collect_list("content").over(w).alias("block")).where(F.size("block") == window)
    keyed = blocks.select("file", "line", F.sha2(F.to_json("block"), 256).alias("key"))
    first = F.min(F.struct("file", "line"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1").select("key", "n", "first.file", "first.line")


@dataclass(frozen=True)
class TableRule:
    """A named rule over whole tables: a function of lines and files that gives findings."""

    name: str
    run: Callable[[DataFrame, DataFrame], DataFrame]


PLACE = ("linter", "message", "severity", "file", "package", "line", "column")


def literal_findings(lines: DataFrame, least_length: int = 3, least_count: int = 3) -> DataFrame:
    """One finding for each repeated line text, where it stands first."""
    found = repeated_literals(lines, least_length, least_count).join(lines.select("file", "line", "package"), ["file", "line"])
    return found.select(F.lit("goconst").alias("linter"), F.concat(F.lit("text has "), F.col("n").cast("string"), F.lit(" occurrences")).alias("message"), F.lit("warning").alias("severity"), "file", "package", "line", F.lit(0).alias("column"))


def block_findings(lines: DataFrame, window: int) -> DataFrame:
    """One finding for each repeated block, where it stands first."""
    found = repeated_blocks(lines, window).join(lines.select("file", "line", "package"), ["file", "line"])
    return found.select(F.lit("dupl").alias("linter"), F.concat(F.lit(f"{window} lines stand in "), F.col("n").cast("string"), F.lit(" places")).alias("message"), F.lit("warning").alias("severity"), "file", "package", "line", F.lit(0).alias("column"))


def run(planned: list[Rule | TableRule], lines: DataFrame, files: DataFrame) -> tuple[DataFrame | None, list[str]]:
    """Findings of all rules, and a warning for each that can't be built: one failing rule doesn't stop the others."""
    out, warnings, plain = [], [], []
    for r in planned:
        try:
            if isinstance(r, Rule):
                findings(lines, r).schema  # noqa: B018  resolves its columns
                plain.append(r)
            else:
                out.append(r.run(lines, files).select(*PLACE))
        except Exception as e:  # whatever a rule raises
            warnings.append(f"{r.name}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    if plain:
        out.insert(0, findings(lines, *plain).select(*PLACE))
    return (reduce(DataFrame.unionByName, out) if out else None), warnings


#: Rules over whole tables; their settings are keyword arguments.
TABLE_RULES: dict[str, Callable[..., TableRule]] = {
    "goheader": lambda pattern: TableRule("goheader", lambda lines, files: header_missing(files, pattern)),
    "goconst": lambda **k: TableRule("goconst", lambda lines, files: literal_findings(lines, **k)),
    "dupl": lambda window=15: TableRule("dupl", lambda lines, files: block_findings(lines, window)),
}

#: name -> constructor with defaults, for the registry.
TEXT_RULES: dict[str, Callable[..., Rule]] = {
    "lll": long_lines,
    "godox": keyword_lines,
    "dupword": repeated_tokens,
    "asciicheck": nonascii_lines,
    "bidichk": bidi_lines,
    "trailing-space": trailing_space,
    "sentence-end": sentence_end,
    "forbidigo": forbidden,
}
