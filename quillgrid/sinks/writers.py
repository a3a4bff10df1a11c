"""Report formats. Each makes a table (part, name, seq, value): the pieces of the report in that order, to be written one after another.

Rows are rendered by Column expressions, and no format runs anything while it is built: what depends on all rows (their
number, column widths) is an aggregate in the same plan. :func:`write` and :func:`render` join a report on the driver,
for reports that fit it; :func:`write_parts` writes one of any size as ordered part files. Findings need ``seq`` for
their order, from 1; ``source_lines`` and ``fixes`` are optional.

The texts of SARIF, Checkstyle, Code Climate, JUnit and TeamCity are fixed by these formats.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as fc

TOOL = "quillgrid"
#: Findings whose order one task looks at.
SPAN = 1 << 16
SARIF_SCHEMA = "https://schemastore.azurewebsites.net/schemas/json/sarif-2.1.0-rtm.6.json"


def full(findings: DataFrame) -> DataFrame:
    """With the optional columns, empty where they are missing."""
    out = findings
    if "source_lines" not in out.columns:
        out = out.withColumn("source_lines", F.array().cast("array<string>"))
    return out.withColumn("severity", F.coalesce("severity", F.lit(""))).withColumn("source_lines", F.coalesce("source_lines", F.array().cast("array<string>")))


def parts(rows: DataFrame, value: Column, head: str | Column = "", tail: str | Column = "", between: str = "") -> DataFrame:
    """Head, rows, tail; ``between`` goes before every row but that with seq 1. Head and tail may use ``n``, the number of rows."""
    name = F.col("name") if "name" in rows.columns else F.lit("")
    body = rows.select(F.lit(1).alias("part"), name.alias("name"), F.col("seq").cast("long").alias("seq"), value.alias("value"))
    if between:
        body = body.withColumn("value", F.concat(F.when(F.col("seq") == 1, F.lit("")).otherwise(F.lit(between)), "value"))
    counted = isinstance(head, Column) or isinstance(tail, Column)
    ends = rows.agg(F.count("*").alias("n")) if counted else rows.sparkSession.range(1)
    edge = lambda k, v: F.struct(F.lit(k).alias("part"), F.lit("").alias("name"), F.lit(0).cast("long").alias("seq"), (v if isinstance(v, Column) else F.lit(v)).alias("value"))
    return body.unionByName(ends.select(F.inline(F.array(edge(0, head), edge(2, tail)))))


def text(findings: DataFrame) -> DataFrame:
    """Position, message and linter; then the source lines, and a caret under the column if there is just one."""
    f = full(findings)
    line = F.concat(fc.position(), F.lit(": "), "message", F.lit(" ("), "linter", F.lit(")\n"))
    source = F.array_join(F.transform("source_lines", lambda x: F.concat(x, F.lit("\n"))), "")
    before = F.substring(F.get("source_lines", 0), F.lit(1), F.col("column") - 1)
    caret = F.concat(F.regexp_replace(before, "[^\t]", " "), F.lit("^\n"))
    return parts(f, F.concat(line, source, F.when((F.size("source_lines") == 1) & (F.col("column") > 0), caret).otherwise("")))


def tab(findings: DataFrame) -> DataFrame:
    """Aligned columns; a message of several lines ends a block of common widths."""
    f = full(findings).withColumn("pos", fc.position())
    # a block is named by the number of such messages before it; they are summed by spans of the order, then over the spans
    ends = F.when(F.instr("message", "\n") > 0, 1).otherwise(0)
    placed = f.withColumn("span_", F.floor(F.col("seq") / SPAN)).withColumn("ends_", ends)
    spans = placed.groupBy("span_").agg(F.sum("ends_").alias("in_"))
    before = spans.select(F.col("span_").alias("span2_"), (F.sum("in_").over(Window.orderBy("span_")) - F.col("in_")).alias("before_"))  # a row for each SPAN findings
    own = F.sum("ends_").over(Window.partitionBy("span_").orderBy("seq")) - F.col("ends_")
    blocks = placed.withColumn("own_", own).join(before, F.col("span_") == F.col("span2_")).withColumn("block", F.col("own_") + F.col("before_"))
    widths = blocks.groupBy("block").agg(*[F.max(F.char_length(c)).alias(f"w_{c}") for c in ("pos", "linter")])
    sized = blocks.join(widths, "block")
    pad = lambda c: F.rpad(c, F.col(f"w_{c}") + 2, " ")
    return parts(sized, F.concat(pad("pos"), pad("linter"), "message", F.lit("\n")))


def json_object(*fields: tuple[str, Column, Column | None]) -> Column:
    """An object of rendered fields; one whose condition fails is left out."""
    piece = lambda k, v: F.concat(F.lit(f'"{k}":'), v)
    return F.concat(F.lit("{"), F.concat_ws(",", *[piece(k, v) if c is None else F.when(c, piece(k, v)) for k, v, c in fields]), F.lit("}"))


def strings(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, fc.json_string), ","), F.lit("]"))


def number(c: Column | str) -> Column:
    return fc.col(c).cast("string")


def json(findings: DataFrame) -> DataFrame:
    f = full(findings)
    pos = json_object(("filename", fc.json_string("file"), None), ("line", number("line"), None), ("column", number("column"), F.col("column") != 0))
    obj = json_object(
        ("linter", fc.json_string("linter"), None), ("message", fc.json_string("message"), None), ("severity", fc.json_string("severity"), F.col("severity") != ""), ("pos", pos, None),
        ("source_lines", strings(F.col("source_lines")), F.size("source_lines") > 0),
    )
    return parts(f, obj, '{"issues":[', "]}\n", ",")


#: Characters of HTML text and attributes that are written as references, the ampersand first.
HTML_MARKS = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("+", "&#43;"))


def html(findings: DataFrame, tool: str = TOOL) -> DataFrame:
    """A page with one row for each finding; an empty severity counts as error."""
    f = full(findings)
    esc = lambda c: reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), F.lit(kv[1])), HTML_MARKS, fc.col(c))
    severity = F.when(F.col("severity") == "", "error").otherwise(F.col("severity"))
    cells = [(fc.position(), "where"), (F.col("linter"), "rule"), (severity, "severity"), (F.trim("message"), "message"), (F.array_join("source_lines", "\n"), "source")]
    row = F.concat(F.lit('<tr data-severity="'), esc(severity), F.lit('">'), *[F.concat(F.lit(f'<td class="{k}">'), esc(c), F.lit("</td>")) for c, k in cells], F.lit("</tr>\n"))
    n = F.col("n")
    told = F.concat(n.cast("string"), F.when(n == 1, " finding").otherwise(" findings"))
    style = "td { vertical-align: top; padding: 0 1em 0 0 } td.source { font-family: monospace; white-space: pre-wrap } tr[data-severity=error] td.severity { font-weight: bold }"
    head = F.concat(F.lit(f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{tool}: findings</title><style>{style}</style></head>\n<body><p id="total">'), told, F.lit("</p>\n"), F.when(n > 0, "<table><tbody>\n").otherwise(""))
    return parts(f, row, head, F.concat(F.when(n > 0, "</tbody></table>\n").otherwise(""), F.lit("</body></html>\n")))


def by_file(f: DataFrame, head: Column, item: Column, tail: str) -> DataFrame:
    """A block for each file, files in byte order, items in their own order."""
    items = f.select("file", F.struct("seq", item.alias("v")).alias("x"))
    grouped = items.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]), "").alias("items"), F.count("*").alias("n"))
    return grouped.select(F.col("file").alias("name"), F.lit(0).alias("seq"), F.concat(head, "items", F.lit(tail)).alias("value"))


def checkstyle(findings: DataFrame) -> DataFrame:
    f = full(findings)
    x = fc.xml_escaped
    error = F.concat(F.lit('    <error column="'), number("column"), F.lit('" line="'), number("line"), F.lit('" message="'), x("message"), F.lit('" severity="'), x(fc.sanitised("severity", ("ignore", "info", "warning", "error"), "error")), F.lit('" source="'), x("linter"), F.lit('"></error>\n'))
    blocks = by_file(f, F.concat(F.lit('  <file name="'), x("file"), F.lit('">\n')), error, "  </file>\n")
    top = '<?xml version="1.0" encoding="UTF-8"?>\n<checkstyle version="5.0">'
    return parts(blocks, F.col("value"), F.concat(F.lit(top), F.when(F.col("n") > 0, "\n").otherwise("")), "</checkstyle>\n")


def junit(findings: DataFrame, extended: bool = False) -> DataFrame:
    f = full(findings)
    x, pos = fc.xml_escaped, fc.position()
    content = F.concat("severity", F.lit(": "), "message", F.lit("\nCategory: "), "linter", F.lit("\nFile: "), "file", F.lit("\nLine: "), number("line"), F.lit("\nDetails: "), F.array_join("source_lines", "\n"))
    more = F.concat(F.lit(' file="'), x("file"), F.lit('" line="'), number("line"), F.lit('"')) if extended else F.lit("")
    case = F.concat(F.lit('    <testcase name="'), x("linter"), F.lit('" classname="'), x(pos), F.lit('"'), more, F.lit('>\n      <failure message="'), x(F.concat(pos, F.lit(": "), "message")), F.lit('" type="'), x("severity"), F.lit('"><![CDATA['), F.replace(content, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]></failure>\n    </testcase>\n"))
    head = F.concat(F.lit('  <testsuite name="'), x("file"), F.lit('" tests="'), number("n"), F.lit('" errors="0" failures="'), number("n"), F.lit('">\n'))
    return parts(by_file(f, head, case, "  </testsuite>\n"), F.col("value"), F.concat(F.lit("<testsuites>"), F.when(F.col("n") > 0, "\n").otherwise("")), "</testsuites>")


def teamcity_rows(findings: DataFrame) -> DataFrame:
    """(seq, kind, value): a type line where a linter comes first, and a line for each finding."""
    f = full(findings)
    small, large = (lambda c: fc.teamcity_escaped(c, 255)), (lambda c: fc.teamcity_escaped(c, 4000))
    first = f.groupBy("linter").agg(F.min("seq").alias("seq"))
    kinds = first.select("seq", F.lit(0).alias("kind"), F.concat(F.lit("##teamcity[inspectionType id='"), small("linter"), F.lit("' name='"), small("linter"), F.lit("' description='"), large("linter"), F.lit("' category='Golangci-lint reports']\n")).alias("value"))
    severity = fc.sanitised(F.upper("severity"), ("INFO", "ERROR", "WARNING", "WEAK WARNING"), "ERROR")
    rows = f.select("seq", F.lit(1).alias("kind"), F.concat(F.lit("##teamcity[inspection typeId='"), small("linter"), F.lit("' message='"), large("message"), F.lit("' file='"), large("file"), F.lit("' line='"), number("line"), F.lit("' SEVERITY='"), severity, F.lit("']\n")).alias("value"))
    return kinds.unionByName(rows)


def teamcity(findings: DataFrame) -> DataFrame:
    return parts(teamcity_rows(findings).withColumn("seq", F.col("seq") * 2 + F.col("kind")), F.col("value"))


def code_climate(findings: DataFrame) -> DataFrame:
    f = full(findings)
    where = F.concat(F.lit('{"path":'), fc.json_string("file"), F.lit(',"lines":{"begin":'), number("line"), F.lit("}}"))
    obj = json_object(
        ("description", fc.json_string(fc.description()), None), ("check_name", fc.json_string("linter"), None), ("severity", fc.json_string(fc.sanitised("severity", ("info", "minor", "major", "critical", "blocker"), "critical")), None),
        ("fingerprint", fc.json_string(fc.fingerprint()), None), ("location", where, None),
    )
    return parts(f, obj, "[", "]\n", ",")


def message(c: Column | str) -> Column:
    return F.concat(F.lit('{"text":'), fc.json_string(c), F.lit("}"))


def sarif_fixes(fixes: Column) -> Column:
    """Replacements grouped by file in order of first sight; fixes without edits are left out."""

    def replacement(e: Column) -> Column:
        at = lambda p, c: F.greatest(e[p]["column"], F.lit(1)).cast("string") if c == "column" else e[p]["line"].cast("string")
        region = F.concat(F.lit('{"deletedRegion":{"startLine":'), at("start", "line"), F.lit(',"startColumn":'), at("start", "column"), F.when(e["end"]["line"] != 0, F.concat(F.lit(',"endLine":'), at("end", "line"))).otherwise(""), F.lit(',"endColumn":'), at("end", "column"), F.lit("}"))
        return F.concat(region, F.when(e["new_text"] != "", F.concat(F.lit(',"insertedContent":'), message(e["new_text"]))).otherwise(""), F.lit("}"))

    def one(fix: Column) -> Column:
        files = F.array_distinct(F.transform(fix["edits"], lambda e: e["start"]["file"]))
        change = lambda name: F.concat(F.lit('{"artifactLocation":{"uri":'), fc.json_string(name), F.lit(',"index":0},"replacements":['), F.array_join(F.transform(F.filter(fix["edits"], lambda e: e["start"]["file"] == name), replacement), ","), F.lit("]}"))
        told = F.when(F.coalesce(fix["message"], F.lit("")) != "", F.concat(F.lit('"description":'), message(fix["message"]), F.lit(","))).otherwise("")
        return F.concat(F.lit("{"), told, F.lit('"artifactChanges":['), F.array_join(F.transform(files, change), ","), F.lit("]}"))

    return F.transform(F.filter(fixes, lambda x: F.size(x["edits"]) > 0), one)


def sarif(findings: DataFrame, tool: str = TOOL, properties: str = "") -> DataFrame:
    """``properties``: the run's property bag as JSON text."""
    f = full(findings)
    where = F.concat(F.lit('[{"physicalLocation":{"artifactLocation":{"uri":'), fc.json_string("file"), F.lit(',"index":0},"region":{"startLine":'), number("line"), F.lit(',"startColumn":'), number(F.greatest("column", F.lit(1))), F.lit("}}}]"))
    fields = [("ruleId", fc.json_string("linter"), None), ("level", fc.json_string(fc.sanitised("severity", ("none", "note", "warning", "error"), "error")), None), ("message", message("message"), None), ("locations", where, None)]
    if "fixes" in f.columns:
        rendered = sarif_fixes(F.col("fixes"))
        fields.append(("fixes", F.concat(F.lit("["), F.array_join(rendered, ","), F.lit("]")), F.coalesce(F.size(rendered) > 0, F.lit(False))))
    bag = f',"properties":{properties}' if properties else ""
    return parts(f, json_object(*fields), f'{{"version":"2.1.0","$schema":"{SARIF_SCHEMA}","runs":[{{"tool":{{"driver":{{"name":"{tool}"}}}},"results":[', f"]{bag}}}]}}\n", ",")


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "text": text, "tab": tab, "json": json, "html": html, "checkstyle": checkstyle, "code-climate": code_climate, "junit-xml": junit, "teamcity": teamcity, "sarif": sarif,
}


def printer(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in FORMATS:
        raise ValueError(f"unknown format: {name}")
    return FORMATS[name]


def render(findings: DataFrame, name: str, **options) -> str:
    """A whole report as text, for reports that fit the driver."""
    pieces = printer(name)(findings, **options).orderBy("part", "name", "seq")
    return "".join(r["value"] for r in pieces.toLocalIterator())


def sequenced(findings: DataFrame) -> DataFrame:
    """Findings with ``seq`` in canonical order, numbered range by range."""
    from ..operators.ordering import CANONICAL
    from ..operators.running import numbered

    return numbered(findings.drop("seq"), (), CANONICAL, "seq")


def write(findings: DataFrame, outputs: dict[str, str], top: str | None = None) -> None:
    """A report for each format -> path, in canonical order; with ``top`` paths must lie inside it. Without outputs, text is printed."""
    import os
    import sys
    import tempfile

    from ..functions.paths import confined

    ordered = sequenced(findings).cache()
    try:
        for name, path in (outputs or {"text": "stdout"}).items():
            pieces = (r["value"] for r in printer(name)(ordered).orderBy("part", "name", "seq").toLocalIterator())
            if path in ("stdout", "stderr"):
                getattr(sys, path).writelines(pieces)
            else:
                target = confined(path, top) if top else path
                fd, part = tempfile.mkstemp(dir=os.path.dirname(target) or ".")
                with os.fdopen(fd, "w", encoding="utf-8") as f:
                    f.writelines(pieces)  # partition by partition
                os.replace(part, target)
    finally:
        ordered.unpersist()


def write_parts(findings: DataFrame, name: str, folder: str, **options) -> None:
    """A report as part files in a folder of any store, in their names' order; each piece ends its line, so that one after another they are the report."""
    pieces = printer(name)(sequenced(findings), **options).where("value <> ''").orderBy("part", "name", "seq")
    pieces.select(F.regexp_replace("value", "\n$", "").alias("value")).write.text(folder)


def verdict_lines(verdict: DataFrame) -> str:
    r = verdict.first()
    return "".join(f"{k}={v}\n" for k, v in [("schema", 1), *((k, r[k]) for k in ("findings", "enforced", "ignored", "superseded"))])


def quiet(lines: DataFrame) -> DataFrame:
    """A log without third-party noise."""
    return lines.where(~fc.is_noise("value"))


def write_facts(facts: DataFrame, path: str, version: int) -> None:
    """Facts (package, analyzer, object, fact_type, value) with their format's version, a folder for each package."""
    facts.withColumn("version", F.lit(version)).repartition("package").sortWithinPartitions("package", "analyzer", "object").write.mode("append").partitionBy("package").parquet(path)
