"""Report formats, byte by byte, and streams."""

import json
import xml.dom.minidom

import pytest

from quillgrid.operators.suppress import Config, ExcludeRule
from quillgrid.sinks import writers
from quillgrid.streaming import suppress as streams

DDL = "seq long, linter string, message string, severity string, file string, line int, column int, source_lines array<string>"
ROWS = [
    (1, "errcheck", "value of `f` <is> not & checked", "error", "a/a b.go", 10, 5, ["\tf.Close()"]),
    (2, "lll", "first\nsecond", "warning", "a/a b.go", 25, 0, []),
    (3, "errcheck", "it's [x]|", "", "b.go", 7, 2, None),
]


@pytest.fixture(scope="module")
def found(spark):
    return spark.createDataFrame(ROWS, DDL)


def test_text(found):
    assert writers.render(found, "text") == "a/a b.go:10:5: value of `f` <is> not & checked (errcheck)\n\tf.Close()\n\t   ^\na/a b.go:25: first\nsecond (lll)\nb.go:7:2: it's [x]| (errcheck)\n"


def test_tab(found):
    assert writers.render(found, "tab") == "a/a b.go:10:5  errcheck  value of `f` <is> not & checked\na/a b.go:25    lll       first\nsecond\nb.go:7:2  errcheck  it's [x]|\n"


def test_json(found):
    text = writers.render(found, "json")
    assert "\\u003cis\\u003e not \\u0026" in text and text.endswith("]}\n")
    issues = json.loads(text)["issues"]
    assert issues[0] == {"linter": "errcheck", "message": ROWS[0][2], "severity": "error", "pos": {"filename": "a/a b.go", "line": 10, "column": 5}, "source_lines": ["\tf.Close()"]}
    assert "column" not in issues[1]["pos"] and "severity" not in issues[2]


def test_xml(found):
    text = writers.render(found, "checkstyle")
    assert '<error column="0" line="25" message="first&#xA;second" severity="warning" source="lll"></error>' in text
    assert [f.getAttribute("name") for f in xml.dom.minidom.parseString(text).getElementsByTagName("file")] == ["a/a b.go", "b.go"]
    text = writers.render(found, "junit-xml")
    suites = xml.dom.minidom.parseString(text).getElementsByTagName("testsuite")
    assert [(s.getAttribute("tests"), s.getAttribute("failures")) for s in suites] == [("2", "2"), ("1", "1")]
    assert "<![CDATA[error: value of `f` <is> not & checked\nCategory: errcheck" in text


def test_teamcity(found):
    lines = writers.render(found, "teamcity").splitlines()
    assert len(lines) == 5 and lines[0].startswith("##teamcity[inspectionType id='errcheck'") and lines[2].startswith("##teamcity[inspectionType id='lll'")
    assert lines[4] == "##teamcity[inspection typeId='errcheck' message='it|'s |[x|]||' file='b.go' line='7' SEVERITY='ERROR']"


def test_code_climate_and_sarif(found):
    climate = json.loads(writers.render(found, "code-climate"))
    assert [x["severity"] for x in climate] == ["critical"] * 3 and all(len(x["fingerprint"]) == 32 for x in climate)
    run = json.loads(writers.render(found, "sarif", properties='{"unit":{"package":"p"}}'))["runs"][0]
    assert [r["level"] for r in run["results"]] == ["error", "warning", "error"] and run["properties"]["unit"]["package"] == "p"
    assert run["results"][1]["locations"][0]["physicalLocation"]["region"] == {"startLine": 25, "startColumn": 1}


def test_fixes(spark):
    ddl = DDL + ", fixes array<struct<message:string,edits:array<struct<start:struct<file:string,line:int,column:int>,end:struct<file:string,line:int,column:int>,new_text:string>>>>"
    edit = lambda f, new: ((f, 1, 0), (f, 2, 3), new)
    rows = [(1, "l", "m", "error", "a", 1, 0, [], [("say", [edit("b", "x"), edit("a", ""), edit("b", "y")]), ("none", [])])]
    fixes = json.loads(writers.render(spark.createDataFrame(rows, ddl), "sarif"))["runs"][0]["results"][0]["fixes"]
    assert len(fixes) == 1 and [c["artifactLocation"]["uri"] for c in fixes[0]["artifactChanges"]] == ["b", "a"]
    assert fixes[0]["artifactChanges"][0]["replacements"][0] == {"deletedRegion": {"startLine": 1, "startColumn": 1, "endLine": 2, "endColumn": 3}, "insertedContent": {"text": "x"}}


def test_empty_reports(spark):
    none = spark.createDataFrame([], DDL)
    assert writers.render(none, "text") == "" and json.loads(writers.render(none, "json")) == {"issues": []}
    assert writers.render(none, "junit-xml") == "<testsuites></testsuites>" and writers.render(none, "checkstyle").endswith('<checkstyle version="5.0"></checkstyle>\n')
    assert '<p id="total">0 findings</p>' in writers.render(none, "html") and "<table>" not in writers.render(none, "html") and json.loads(writers.render(none, "code-climate")) == []
    with pytest.raises(ValueError):
        writers.printer("nope")


def test_html(spark, found):
    text = writers.render(found, "html")
    assert '<td class="message">value of `f` &lt;is&gt; not &amp; checked</td>' in text and "it&#39;s" in text and "3 findings</p>" in text
    assert text.count('<tr data-severity="error">') == 2 and text.count("<tr ") == 3 and '<td class="severity">error</td>' in text  # an empty severity too
    one = spark.createDataFrame([(1, "l", " m+ ", "info", "f", 1, 0, ["<x>"])], DDL)
    text = writers.render(one, "html")
    assert '<p id="total">1 finding</p>' in text and '<tr data-severity="info"><td class="where">f:1</td><td class="rule">l</td><td class="severity">info</td><td class="message">m&#43;</td><td class="source">&lt;x&gt;</td></tr>' in text


def test_reports_in_parts(spark, found, tmp_path):
    many = spark.createDataFrame([(9, f"l{i % 7}", f"m{i}", "error", f"f{i % 13}", i, 0, []) for i in range(500)], DDL).repartition(6)
    for name, df in (("text", many), ("tab", many), ("junit-xml", many), ("json", many), ("sarif", many), ("html", found)):
        writers.write_parts(df, name, str(tmp_path / name))
        files = sorted(x for x in (tmp_path / name).iterdir() if x.name.startswith("part-"))
        whole = "".join(x.read_text() for x in files)
        want = writers.render(writers.sequenced(df), name)
        assert (json.loads(whole) == json.loads(want)) if name in ("json", "sarif") else whole.rstrip("\n") == want.rstrip("\n")


def test_building_a_report_runs_nothing(spark, found):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    for name in writers.FORMATS:
        writers.printer(name)(found)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_order_of_input_does_not_matter(spark, found):
    again = spark.createDataFrame(ROWS[::-1], DDL).repartition(3)
    for name in writers.FORMATS:
        assert writers.render(found, name) == writers.render(again, name)


def test_files(found, tmp_path):
    writers.write(found, {"text": "out.txt", "json": "out.json"}, str(tmp_path))
    assert (tmp_path / "out.txt").read_text().startswith("a/a b.go:10:5") and json.loads((tmp_path / "out.json").read_text())["issues"]
    with pytest.raises(ValueError):
        writers.write(found, {"text": "../x"}, str(tmp_path))


def test_streamed_suppression(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    ddl = "linter string, message string, severity string, file string, line int, column int"
    config = Config(rules=(ExcludeRule(linters=("lll",)),), generated="disable")

    def add(*rows):
        spark.createDataFrame(list(rows), ddl).coalesce(1).write.mode("append").json(src)
        q = streams.run_once(streams.suppressed(spark.readStream.schema(ddl).json(src), config), out, cp)
        q.awaitTermination()
        assert q.exception() is None

    add(("a", "m", "error", "f", 1, 0), ("lll", "m", "error", "f", 2, 0), ("a", "m", "error", "f", 3, 0))
    add(("b", "m", "error", "f", 1, 0), ("b", "m", "error", "g", 1, 0))
    assert sorted((r["file"], r["line"]) for r in spark.read.parquet(out).collect()) == [("f", 1), ("f", 3), ("g", 1)]


def test_worker(spark, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1").write_text('{"requestId": 1, "arguments": ["a", "b"]}\n{"requestId": 2, "cancel": true}\n{"requestId": 3, "sandboxDir": "/x"}\n')
    q = streams.serve(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda a: F.array_join(a, " "))
    q.awaitTermination()
    got = {r["requestId"]: (r["exitCode"], r["output"], r["wasCancelled"]) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {1: (0, "a b", False), 2: (0, "", True), 3: (1, "sandboxed requests are not supported", False)}
