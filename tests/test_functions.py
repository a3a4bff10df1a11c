"""Column functions and patterns on literal rows."""

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.functions import columns as fc
from quillgrid.functions import diff, paths
from quillgrid.sources import config


def values(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ddl}").orderBy("i").select(column).collect()]


def test_positions(spark):
    assert values(spark, [("a.go", 3, 0), ("", 1, 2), (None, 1, 0), ("a b", 7, 9)], "file string, line int, column int", fc.position()) == ["a.go:3", "-:1:2", "-:1", "a b:7:9"]


def test_message_stem(spark):
    rows = [("errcheck", "  Errcheck: Value Is not checked!. "), ("x", ": A"), ("x", "é" * 60), ("x", "")]
    assert values(spark, rows, "linter string, message string", fc.message_stem())[:2] == ["value is not checked", "a"]
    assert values(spark, rows, "linter string, message string", F.octet_length(fc.message_stem()))[2:] == [80, 0]


def test_human_bytes(spark):
    assert values(spark, [(0,), (1023,), (1024,), (30976,), (1536 * 1024,), (5 * 1024**3,)], "n long", fc.human_bytes("n")) == ["0 B", "1023 B", "1.0K", "30.2K", "1.5M", "5.0G"]


def test_human_bytes_beyond_longs(spark):
    rows = [(str(8999999**2 * 899999),), (str(2**60),), (None,), (str(2**70),)]
    n = F.col("n").cast("decimal(38,0)")
    assert values(spark, rows, "n string", fc.human_bytes(n)) == ["63.2E", "1.0E", None, "1024.0E"]
    assert values(spark, rows, "n string", fc.human_bytes(n, "KMGTP")) == ["64748.1P", "1024.0P", None, "1048576.0P"]


def test_order_sizes_of_large_keys(spark, tmp_path):
    """Keys of sixty copies of a table; and sizes from 2^60 on, which the SQL gives in P."""
    from quillgrid.plans.catalog import ORACLES, QUERIES

    rows = [(8999999, 899999), (2999999, 299999), (2**20, 2**20), (1024, 1), (0, 5), (7, None)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = {r["o_orderkey"]: r["size"] for r in QUERIES["human_bytes"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet' WHERE o_orderkey < 8999999")  # beyond, the SQL's longs overflow
    assert got.pop(8999999) == "64748.1P" and got == dict(con.sql(ORACLES["human_bytes"]).fetchall())


def test_directives(spark):
    rows = [("//nolint",), ("// nolint:a, B // why",), ("/* nolint:all */",), ("//nolint:",), ("//nolintlint",), ("//nolint:a,,b",), ("text",), ("//nolint foo",)]
    d = values(spark, rows, "c string", fc.directive("c"))
    assert [x and (x["malformed"], x["linters"]) for x in d] == [(False, []), (False, ["a", "b"]), (False, []), (True, []), None, (True, []), None, (True, [])]


def test_teamcity_escape(spark):
    assert values(spark, [("a'b|[c]\n",), ("ab'",), ("ab'x",)], "s string", fc.teamcity_escaped("s", 255)) == ["a|'b|||[c|]|n", "ab|'", "ab|'x"]
    assert values(spark, [("ab'x",), ("abcd",)], "s string", fc.teamcity_escaped("s", 3)) == ["ab", "abc"]


def test_error_parts(spark):
    got = values(spark, [("a.go:3:4: bad",), ("a.go:3: bad",), ("a.go",)], "s string", fc.error_parts("s"))
    assert [tuple(x) for x in got] == [("a.go", 3, 4, "bad"), ("a.go", 3, None, "bad"), ("a.go", None, None, "")]


def test_framing_is_unambiguous(spark):
    a, b = values(spark, [("ab", "c"), ("a", "bc")], "x string, y string", fc.digest("x", "y"))
    assert a != b


def test_import_visibility(spark):
    rows = [("a/b", "a/internal/x"), ("a", "a/internal"), ("c", "a/internal/x"), ("ab", "a/internal/x"), ("c", "a/x")]
    assert values(spark, rows, "f string, t string", fc.import_visible("f", "t")) == [True, True, False, False, True]


def test_globs(spark):
    rows = [("a/b.go",), ("b.go",), ("a/x/c.go",), ("a/x/y/c.go",)]
    m = lambda p: values(spark, rows, "p string", paths.glob_match(F.col("p"), p))
    assert m("b.*") == [True, True, False, False]
    assert m("a/*.go") == [True, False, False, False]
    assert m("a/**/c.go") == [False, False, True, True]
    assert m("**/[bc].go") == [True, True, True, True]
    assert m("a/**") == [True, False, True, True]


def test_targets(spark):
    assert paths.targets(["./..."]) is None and paths.targets(["./a/...", "b"]) == [("a", True), ("b", False)]
    got = values(spark, [("a/x/f",), ("b/f",), ("b/c/f",), ("f",)], "p string", paths.in_targets(F.col("p"), [("a", True), ("b", False)]))
    assert got == [True, True, False, False]


def test_last_rule_decides(spark):
    got = values(spark, [("a/b",), ("a/c",), ("d",)], "p string", paths.last_match(F.col("p"), ["-a", "+a/c"]))
    assert got == [False, True, True]


def test_tag_expressions():
    assert paths.tag_expression("linux && !(cgo || arm)", {"linux"})
    assert not paths.tag_expression("linux && cgo", {"linux"})
    with pytest.raises(ValueError):
        paths.tag_expression("linux &&", {"linux"})
    assert not paths.file_suffix_fits("x_windows.go", "linux", "amd64", frozenset(["linux", "windows"]), frozenset(["amd64"]))
    assert paths.file_suffix_fits("linux.go", "windows", "amd64", frozenset(["linux", "windows"]), frozenset(["amd64"]))


def test_confined(tmp_path):
    assert paths.confined("a/b", str(tmp_path)).endswith("a/b")
    with pytest.raises(ValueError):
        paths.confined("../b", str(tmp_path))


@settings(max_examples=60, deadline=None)
@given(st.text("ab\n", max_size=30), st.text("ab\n", max_size=30))
def test_diffs_round_trip(a, b):
    for edits in (diff.line_edits(a, b), diff.text_edits(a, b)):
        assert diff.apply_edits(a, edits) == b
        assert diff.apply_edits(a, diff.whole_lines(a, edits)) == b
    if (not a or a.endswith("\n")) and (not b or b.endswith("\n")):
        assert diff.apply_unified(a, diff.unified("f", a, b)) == b


@settings(max_examples=80, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_runs_are_longest(a, b):
    runs = diff.common_runs(a, b)
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert sum(n for _, _, n in runs) == table[-1][-1] and all(a[i : i + n] == b[j : j + n] for i, j, n in runs)
    assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(runs, runs[1:]))


def test_unified_texts():
    assert diff.unified("f", "a\nb\nc\n", "a\nx\nc\n", 1) == "--- f\n+++ f\n@@ -1,3 +1,3 @@\n a\n-b\n+x\n c\n"
    assert diff.unified("f", "", "a\n") == "--- f\n+++ f\n@@ -0,0 +1 @@\n+a\n" and diff.unified("f", "a\n", "a\n") == ""
    a = [f"{i}\n" for i in range(20)]
    far, near = diff.unified("f", "".join(a), "".join(a[:2] + a[3:15] + a[16:])), diff.unified("f", "".join(a), "".join(a[:2] + a[3:8] + a[9:]))
    assert far.count("@@ -") == 2 and near.count("@@ -") == 1


def test_merging_edits():
    merge = diff.merged_edits
    assert merge([(0, 1, "x")], [(0, 1, "x"), (2, 3, "y")]) == [(0, 1, "x"), (2, 3, "y")]
    assert merge([(1, 1, "x")], [(1, 1, "y")]) == [(1, 1, "x"), (1, 1, "y")]  # two insertions at one point
    assert merge([(2, 2, "x")], [(2, 4, "y")]) == [(2, 2, "x"), (2, 4, "y")] and merge([(2, 4, "y")], [(2, 2, "x")]) == [(2, 2, "x"), (2, 4, "y")]
    assert merge([(0, 2, "")], [(1, 2, "")]) == [(0, 1, ""), (1, 2, "")]  # partly before: split, then equal
    assert merge([(0, 4, "")], [(2, 2, "y")]) == [(0, 2, ""), (2, 2, "y"), (2, 4, "")]
    assert merge([(0, 2, "x")], [(1, 3, "y")]) is None and merge([(0, 2, "x")], [(0, 2, "y")]) is None and merge([(0, 1, "x")], [(0, 2, "x")]) is None
    assert diff.fixed("abc", [[(0, 1, "x")], [(0, 1, "y")], [(2, 3, "z")]]) == ("xbz", 1)
    assert diff.fixed("abc", [[(1, 1, "x")], [(1, 1, "y")], [(0, 3, "")], [(0, 0, "z")]]) == ("zxy", 0)
    with pytest.raises(ValueError):
        diff.apply_edits("ab", [(0, 2, ""), (1, 2, "")])
    assert diff.position_of("a\né😀x", 8) == (2, 7, 3)


def test_configuration(tmp_path):
    assert config.duration("1h2m3.5s") == 3723.5 and config.duration("-1ms") == -0.001
    with pytest.raises(ValueError):
        config.duration("1x")
    assert config.merge({"a": [1], "b": True, "c": 3, "d": {"x": 1}}, {"a": [1, 2], "b": False, "c": 0, "d": {"y": 2}}) == {"a": [1, 2], "b": True, "c": 3, "d": {"x": 1, "y": 2}}
    assert config.canonical({"b": {}, "a": {"c": "", "d": 1}}) == '{"a":{"d":1}}'
    new, warnings = config.migrated({"run": {"skip-dirs": ["x"]}})
    assert new["linters"]["exclusions"]["paths"] == ["x"] and len(warnings) == 1
    (tmp_path / ".golangci.json").write_text('{"run": {}}')
    (tmp_path / "a").mkdir()
    assert config.load(config.discover(str(tmp_path / "a"))) == {"run": {}}
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "x.toml")) if (tmp_path / "x.toml").write_text("") == 0 else None


def test_names_and_imports(spark):
    assert values(spark, [("fooBarIDs",), ("HTTPServer",), ("plain",)], "n string", fc.snake_case("n")) == ["foo_bar_ids", "http_server", "plain"]
    assert values(spark, [('x\nimport "C"\n',), ('import "Cx"',)], "t string", fc.imports_c("t")) == [True, False]
    assert values(spark, [(0, 4)], "line int, column int", F.struct(*fc.from_editor())) == [(1, 5)]
