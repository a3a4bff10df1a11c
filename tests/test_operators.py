"""Operators on literal rows: the cases that the driver's tables don't have."""

import json

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import aggregates, collect, compare, dedup, go_rules, graph, incremental, joins, registry, rules, sets, suppress
from quillgrid.sources import corpus, plugins, readers

FINDING = "seq long, linter string, message string, severity string, file string, line int, column int"


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def ids(df, *columns):
    return sorted(tuple(r) if len(columns) > 1 else r[0] for r in df.select(*columns).collect())


def test_lines_have_no_empty_tail(spark):
    files = frame(spark, "file string, package string, text string", ("a", "p", "x\n\ny\n"), ("b", "p", ""), ("c", "p", None), ("d", "p", "\n"))
    assert ids(corpus.lines(files), "file", "line", "content") == [("a", 1, "x"), ("a", 2, ""), ("a", 3, "y"), ("d", 1, "")]


def test_rules_on_marks(spark):
    lines = frame(spark, "file string, package string, line int, content string", ("f", "p", 1, "a ‮b"), ("f", "p", 2, "// TODO: x"), ("f", "p", 3, "\tx" * 70), ("f", "p", 4, "end  "))
    got = rules.findings(lines, rules.bidi_lines(), rules.keyword_lines(), rules.long_lines(tab_width=4), rules.trailing_space())
    assert ids(got, "line", "linter") == [(1, "bidichk"), (2, "godox"), (3, "lll"), (4, "trailing-space")]


def test_rule_conditions(spark):
    f = frame(spark, FINDING, (1, "SA1", "m", "error", "a/x.go", 1, 0), (2, "printf", "n", "error", "b/x_test.go", 2, 0), (3, "lll", "m", "", "c.go", 3, 0))
    kept = lambda *r: ids(suppress.apply(f, suppress.Config(rules=r, once_per_line=False, generated="disable")), "seq")
    R = suppress.ExcludeRule
    assert kept(R()) == [1, 2, 3]
    assert kept(R(linters=("staticcheck",))) == [2, 3]
    assert kept(R(linters=("govet",), path="_test")) == [1, 3]
    assert kept(R(path_except="_test", text="m")) == [2]
    assert kept(R(text="m", source="s")) == [1, 2, 3]
    assert suppress.validate(R(path="(")) and suppress.validate(R(path="a", path_except="b")) and not suppress.validate(R(path="a", text="b"))


def test_one_failing_rule_is_a_warning(spark):
    lines = frame(spark, "file string, package string, line int, content string", *[(f, "p", i, "some text") for f in "ab" for i in range(1, 4)])
    files = frame(spark, "file string, package string, text string", ("a", "p", "// x"), ("b", "p", "y"))

    def broken(lines, files):
        raise RuntimeError("no way")

    bad = [rules.TableRule("mine", broken), rules.Rule("none", F.col("missing") > 0, F.lit("m"))]
    found, warnings = rules.run([rules.long_lines(5), *bad, rules.TABLE_RULES["goheader"]("//"), rules.TABLE_RULES["goconst"](), rules.TABLE_RULES["dupl"](2)], lines, files)
    assert sorted(w.split(":")[0] for w in warnings) == ["mine", "none"] and "no way" in " ".join(warnings)
    assert ids(found.groupBy("linter").count(), "linter", "count") == [("dupl", 1), ("goconst", 1), ("goheader", 1), ("lll", 6)]
    assert rules.run(bad, lines, files)[0] is None


def test_bloom_membership(spark):
    members = spark.range(3000).selectExpr("concat('m', id) as k")
    others = spark.range(20000).selectExpr("concat('o', id) as k")
    bits, hashes = suppress.bloom_size(3000)
    held = suppress.bloom(members, "k", bits, hashes)
    assert (bits, hashes) == (28756, 7) and len(held) == 4 * -(-bits // 32)
    passed = lambda df: df.where(suppress.may_hold(held, F.col("k"), bits, hashes)).count()
    assert passed(members) == 3000 and 60 < passed(others) < 400  # 1 in 100 is wanted
    assert suppress.possible_members(members.union(others), members.limit(10), "k").join(members.limit(10), "k", "left_semi").count() == 10
    assert suppress.possible_members(members, members.limit(0), "k").count() == 0


def test_presets_name_their_linters(spark):
    f = frame(spark, FINDING, (1, "errcheck", "Error return value of `f.Close` is not checked", "error", "a", 1, 0), (2, "lll", "G104", "error", "a", 2, 0), (3, "gosec", "G104", "error", "a", 3, 0))
    c = suppress.Config(presets=("std-error-handling", "legacy"), once_per_line=False, generated="disable")
    assert ids(suppress.apply(f, c), "seq") == [2]


def test_ranges(spark):
    f = frame(spark, FINDING, *[(i, n, "m", "error", "a", i, 0) for i, n in ((1, "lll"), (2, "printf"), (3, "lll"), (4, "x"))])
    r = frame(spark, "file string, from_line int, to_line int, col int, linters array<string>", ("a", 1, 1, 1, ["other"]), ("a", 2, 2, 1, ["govet"]), ("a", 3, 4, 1, []), ("b", 1, 9, 1, []))
    assert ids(suppress.in_ranges(f, r), "seq") == [1]


def test_generated_files(spark):
    files = frame(spark, "file string, text string", ("a", "// Code generated by x. DO NOT EDIT.\n"), ("b", "// do not edit"), ("go.mod", "// Code generated by x. DO NOT EDIT."))
    assert ids(suppress.generated_files(files, "strict"), "file") == ["a"]
    assert ids(suppress.generated_files(files, "lax"), "file") == ["a", "b"]


def test_directive_ranges(spark):
    lines = frame(spark, "file string, package string, line int, content string", ("a", "p", 4, "x := 1 //nolint:lll // why"), ("a", "p", 5, "y //nolint:"), ("a", "p", 6, "z"))
    assert ids(suppress.directive_ranges(lines), "from_line", "col") == [(4, 8)]


def test_supersession(spark):
    runs = frame(spark, "run_id long, package string, go_files array<string>, compiles boolean", (1, "p", ["a"], True), (2, "p", ["a", "b"], None), (3, "q", ["a"], True), (4, "q", ["a", "b"], False), (5, "r", ["a", "b"], True), (6, "r", ["b", "a"], True), (7, "s", [], True), (8, "s", ["x"], True))
    assert ids(joins.superseded_runs(runs), "run_id") == [1, 7]


def test_collect_counts_before_dedup(spark):
    runs = frame(spark, "run_id long, package string, go_files array<string>, compiles boolean", (1, "p", ["a"], True), (2, "p", ["a", "b"], True))
    results = frame(spark, "run_id long, ordinal int, linter string, message string, severity string, file string, line int, column int", (1, 0, "unused", "u", "error", "a", 1, 0), (1, 1, "unused", "u", "error", "a", 1, 0), (1, 2, "errcheck", "e", "info", "a", 2, 0), (2, 0, "errcheck", "e", "error", "a", 2, 0))
    kept, verdict = collect.collect(runs, results, ("errcheck",))
    assert ids(kept, "run_id", "severity") == [(1, "info")]
    assert tuple(verdict.select("findings", "enforced", "ignored", "superseded").first()) == (1, 0, 1, 2)


def test_bags(spark):
    ddl = "file string, line int, column int, linter string, message string"
    a = frame(spark, ddl, ("f", 1, 0, "errcheck", "errcheck: X."), ("f", 1, 5, "errcheck", "x"), ("g", 2, 0, "revive", "r"))
    b = frame(spark, ddl, ("f", 1, 0, "errcheck", "X"), ("h", 3, 0, "gosec", "s"))
    stats = {r["linter"]: (r["n_a"], r["n_b"], r["overlap"]) for r in compare.per_linter(a, b).collect()}
    assert stats == {"errcheck": (2, 1, 1), "revive": (1, 0, 0), "gosec": (0, 1, 0)}
    assert ids(compare.only(a, b), "file") == ["f", "g"] and ids(compare.paired(a, b), "message") == ["X"]
    text = compare.report(a, b)
    assert "| errcheck | 2 | 1 | 1 | 1 | 0 |" in text and "- h:3 gosec: s" in text


def test_p95_and_medians(spark):
    o = frame(spark, "bucket string, v long", *[("a", i) for i in range(1, 21)], ("b", 7))
    assert {r["bucket"]: (r["n"], r["mean"], r["p95"]) for r in aggregates.mean_p95(o).collect()} == {"a": (20, 10, 20), "b": (1, 7, 7)}
    m = lambda xs: spark.range(1).select(aggregates.int_median(F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<bigint>"))).first()[0]
    assert (m([]), m([5]), m([1, 4]), m([1, 2, 9])) == (0, 5, 2, 2)


def test_sliding_median_needs_samples(spark):
    o = frame(spark, "seq long, bucket string, v long", *[(i, "a", i) for i in range(1, 12)], (12, "a", 0))
    got = {r["seq"]: r["estimate"] for r in aggregates.sliding_median(o, 99).collect()}
    assert got[9] == 99 and got[10] == 5 and got[11] == 6 and 12 not in got


def test_severity_counts_are_filled(spark):
    f = frame(spark, FINDING, (1, "a", "m", "", "f", 1, 0))
    assert ids(aggregates.by_severity(f), "severity", "n") == [("error", 1), ("info", 0), ("warning", 0)]


def test_graphs(spark):
    e = frame(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "x"))
    assert ids(graph.components(e), "node", "component", "size") == [("b", "b", 2), ("c", "b", 2)]
    assert ids(graph.cycle_members(e), "node") == ["b", "c", "x"]
    assert ids(graph.forward_closure(e).where("root = 'a'"), "node") == ["a", "b", "c", "d"]
    assert ids(graph.reverse_closure(e).where("root = 'd'"), "node") == ["a", "b", "c", "d"]
    assert ids(graph.without_cycle_edges(e, frame(spark, "node string", ("c",))), "src", "dst") == [("a", "b"), ("b", "c"), ("c", "d"), ("x", "x")]
    with pytest.raises(ValueError):
        graph.levels(e)
    dag = corpus.synthetic_packages(spark, 3, 2, 1)
    assert {r["node"]: r["level"] for r in graph.levels(dag).collect()} == {"leaf0": 0, "leaf1": 0, "leaf2": 0, "mid0": 1, "mid1": 1, "root0": 2}
    assert ids(graph.updated_graph(e, frame(spark, "src string, dst array<string>", ("a", ["d"]), ("x", None))), "src", "dst") == [("a", "d"), ("b", "c"), ("c", "b"), ("c", "d")]
    seen = graph.run_leaves_first(dag, graph.nodes_of(dag), lambda nodes, done: nodes.withColumn("before", F.lit(0 if done is None else done.count())))
    assert {r["node"]: r["before"] for r in seen.collect()}["root0"] == 5


def broadcasts(spark, work):
    """What work() gives, and how many of its executions broadcast a side of a join."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    every = lambda: (bus.waitUntilEmpty(30_000), store.executionsList())[1]
    last = max((e.executionId() for e in map(every().apply, range(every().size()))), default=-1)
    out, then = work(), every()
    return out, sum("BroadcastExchange" in e.physicalPlanDescription() for e in map(then.apply, range(then.size())) if e.executionId() > last)


def test_walks_send_nothing_through_the_driver(spark):
    """Both sides of a walk's joins grow with the graph, so none is broadcast, however small it is here."""
    requires = frame(spark, "node long, needs array<long>", (1, []), (2, [1]), (3, [2, 9]), (4, [3]), (5, []), (6, [5]), (7, [8]), (8, [7, 6]), (9, [1]))
    bad = frame(spark, "node long", (2,), (6,), (6,))
    got, n = broadcasts(spark, lambda: ids(graph.action_states(requires, bad), "node", "state"))
    assert got == [(1, "done"), (2, "failed"), (3, "skipped"), (4, "skipped"), (5, "done"), (6, "failed"), (7, "skipped"), (8, "skipped"), (9, "done")] and n == 0
    got, n = broadcasts(spark, lambda: ids(graph.fact_producers(requires, bad, frame(spark, "node int", (1,), (2,), (3,), (9,))), "node"))
    assert got == [1, 2] and n == 0
    e = frame(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("x", "c"), ("c", None))
    files = frame(spark, "file string, package string", ("c.go", "c"), ("x.go", "x"))
    got, n = broadcasts(spark, lambda: ids(graph.stale(e, files, frame(spark, "file string", ("c.go",))), "node"))
    assert got == ["a", "b", "c", "x"] and n == 0


def test_edit_makes_dependents_stale(spark):
    dag = corpus.synthetic_packages(spark, 3, 2, 1, fan_out=1)
    files = graph.nodes_of(dag).select(F.concat("node", F.lit(".go")).alias("file"), F.col("node").alias("package"))
    assert ids(graph.stale(dag, files, frame(spark, "file string", ("leaf0.go",))), "node") == ["leaf0", "mid0", "root0"]


def test_keys_change_with_the_closure(spark):
    edges = frame(spark, "src string, dst string", ("a", "b"), ("b", "c"))

    def keys(text):
        files = frame(spark, "package string, file string, text string", ("a", "a.go", "1"), ("b", "b.go", "2"), ("c", "c.go", text))
        s = incremental.source_digests(files)
        return {r["package"]: r["key"] for r in incremental.result_keys(s, incremental.closure_digests(edges, s), "r", "f", "t", "e").collect()}

    one, two = keys("3"), keys("4")
    assert all(one[p] != two[p] for p in "abc") and keys("3") == one
    files = frame(spark, "package string, file string, text string", ("a", "a.go", "1"))
    s = incremental.source_digests(files)
    assert incremental.result_keys(s, incremental.closure_digests(edges, s), "r", "f", "t", "e").first()["key"] is None


def test_cache_first_writer_wins(spark, tmp_path):
    path = str(tmp_path / "cache")
    k = frame(spark, "package string, key string", ("a", "aa1"), ("b", "bb2"), ("c", None))
    f = frame(spark, "package string, " + FINDING, ("a", 1, "lll", "m", "error", "f", 1, 0))
    incremental.publish(path, incremental.entries(k, f))
    incremental.publish(path, incremental.entries(k.limit(1), f))
    cache = incremental.settled(spark.read.parquet(path))
    assert sorted((r["key"], len(r["findings"])) for r in cache.collect()) == [("aa1", 1), ("bb2", 0)]
    hits, misses = incremental.split_cached(k, cache)
    assert ids(hits, "package") == ["a", "b"] and ids(misses, "package") == ["c"]
    assert incremental.lookup(spark.read.parquet(path), k.where("package = 'b'")).count() == 1
    two = [incremental.entries(k.limit(1), f.withColumn("message", F.lit(m))).withColumns({"shard": F.substring("key", 1, 2), "written": F.lit(t), "writer": F.lit("w")}) for m, t in (("late", 2), ("early", 1))]
    race = two[0].unionByName(two[1])  # two writers that didn't see each other
    assert [r["findings"][0]["message"] for r in incremental.settled(race).collect()] == ["early"]


def test_only_what_changed_is_analysed(spark, tmp_path):
    files = [("a", "a/x", "long line here"), ("b", "b/x", "short"), ("c", "c/x", "another long line")]
    edges = frame(spark, "src string, dst string", ("a", "b"))
    seen = []

    def analyse(some):
        seen.append(ids(some, "package"))
        return rules.findings(corpus.lines(some), rules.long_lines(8))

    def run(rows, salt="r"):
        found = incremental.analysed(frame(spark, "package string, file string, text string", *rows), edges, analyse, str(tmp_path / "cache"), salt)
        return ids(found, "package", "message")

    want = [("a", "line is 14 characters"), ("c", "line is 17 characters")]
    assert run(files) == want and run(files) == want and seen == [["a", "b", "c"], []]
    edited = [files[0], ("b", "b/x", "short no more"), files[2]]  # a depends on b
    assert run(edited) == [want[0], ("b", "line is 13 characters"), want[1]] and seen[-1] == ["a", "b"]
    assert run(files) == want and seen[-1] == [] and run(files, "other") == want and seen[-1] == ["a", "b", "c"]


def test_eviction(spark):
    c = frame(spark, "key string, mtime timestamp, size long", *[(str(i), __import__("datetime").datetime(2020, 1, i), 10) for i in range(1, 6)])
    assert ids(incremental.over_budget(c, 30, buckets=2), "key") == ["1", "2", "3"]
    assert ids(incremental.over_budget(c, 1000), "key") == []
    assert ids(incremental.aged_out(c, F.lit("2020-02-01").cast("timestamp")), "key") == ["1"]


def test_names(spark):
    c = registry.catalog(spark)
    assert c.count() == 118 and c.where("shape = 'formatter'").count() == 6
    r = registry.resolve(c, "standard", ["lll", "gosimple"], ["govet"])
    assert {x["name"]: x["status"] for x in r.where("status <> 'disabled'").collect()} == {"lll": "enabled", "errcheck": "no-analyzer", "ineffassign": "no-analyzer", "staticcheck": "no-analyzer", "typecheck": "enabled", "unused": "no-analyzer"}
    native, custom, warnings = registry.plan(r, {"mine": ["prog"]})
    assert [x.name for x in native] == ["lll", "syntax"] and custom == ["mine"] and len(warnings) == 4
    assert registry.unknown_names(c, ["lll", "nope", "gosimple"]) == ["nope"]
    every = registry.resolve(c, "all", [], [])
    native, _, warnings = registry.plan(every, {}, {"goheader": {"pattern": "// "}, "lll": {"limit": 5}, "dupl": {"width": 3}})
    enabled = {x["name"] for x in every.where("status = 'enabled'").collect()}
    syntax = set(go_rules.GO_RULES) | set(go_rules.MODULE_RULES) | {"typecheck"}
    assert {x.name for x in native} - {"syntax"} | {w.split(":")[0] for w in warnings if "no analyzer" not in w} == enabled - syntax  # nothing enabled vanishes
    assert "syntax" in {x.name for x in native} and len(enabled & syntax) > 50
    assert any(w.startswith("dupl: ") for w in warnings) and "goheader" in {x.name for x in native} and any(w.startswith("goheader") for w in registry.plan(every, {})[2])
    with pytest.raises(ValueError, match="nope"):
        sets.selected(c, ["lll", "nope"])
    members = frame(spark, "name string, default_on boolean", ("a", True), ("b", False), ("c", True))
    n = lambda *x: frame(spark, "name string", *[(i,) for i in x])
    assert ids(sets.member_set(members, "default", n("b"), n("c")), "name") == ["a", "b"]
    assert ids(sets.member_set(members, "enable-all", n("b"), n("c")), "name") == ["a", "b"]
    assert ids(sets.member_set(members, "disable-all", n("b"), n("c")), "name") == ["b"]


def test_unique_names(spark):
    names = ["a", "a", "a#01", "a", "a#02", "b#07", "", "", "b#07", "x#1", "x#00", "b"]
    df = frame(spark, "seq long, name string", *enumerate(names)).repartition(4)
    got = {r["seq"]: r["unique_name"] for r in dedup.numbered_names(df).collect()}
    assert [got[i] for i in range(len(names))] == ["a", "a#01", "a#01#01", "a#02", "a#02#01", "b#07", "#00", "#01", "b#07#01", "x#1", "x#00", "b"]
    many = {r["seq"]: r["unique_name"] for r in dedup.numbered_names(spark.range(130).selectExpr("id as seq", "'n' as name").repartition(5)).collect()}
    assert many == {0: "n", **{k: f"n#{k:02d}" for k in range(1, 130)}}
    by = frame(spark, "seq long, parent string, name string", (1, "p", "t"), (2, "q", "t"), (3, "p", "t"), (4, None, "t"), (5, None, "t"))
    assert ids(dedup.numbered_names(by, by=("parent",)), "seq", "unique_name") == [(1, "t"), (2, "t"), (3, "t#01"), (4, "t"), (5, "t#01")]


def test_running_over_parts(spark):
    from quillgrid.operators import running

    rows = [(("hot", None, "x")[0 if i % 3 else i % 2 + 1], i, i % 7 - 3) for i in range(900)]
    df = frame(spark, "k string, o long, v int", *rows).repartition(7)
    got = {(r["k"], r["o"]): (r["s"], r["n"]) for r in running.numbered(running.running(df, ("k",), ("o",), F.col("v"), "s"), ("k",), (F.col("o").desc(),), "n").collect()}
    for k in ("hot", None, "x"):
        mine = sorted((o, v) for x, o, v in rows if x == k)
        for j, (o, _) in enumerate(mine):
            assert got[k, o] == (sum(v for _, v in mine[: j + 1]), len(mine) - j)
    long = frame(spark, "seq long, bucket string, v long", *[(i, "a", i * 37 % 101 + 1) for i in range(700)])
    whole = {r["seq"]: r["estimate"] for r in aggregates.sliding_median(long, 0).collect()}
    old, aggregates.SPAN = aggregates.SPAN, 150
    try:
        assert {r["seq"]: r["estimate"] for r in aggregates.sliding_median(long, 0).collect()} == whole and len(whole) == 700
    finally:
        aggregates.SPAN = old


def test_first_of_keeps_nulls(spark):
    df = frame(spark, "k string, o int, v string", ("a", 2, "x"), ("a", 1, None), (None, 5, "y"))
    assert sorted(map(tuple, dedup.first_of(df, ("k",), ("o",)).collect()), key=str) == [("a", 1, None), (None, 5, "y")]


def test_readers(spark, tmp_path):
    doc = {"runs": [{"results": []}, {"properties": {"unit": {"package": "p", "mode": "full", "goFiles": ["a"]}}, "results": [{"ruleId": "lll", "level": "error", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a"}, "region": {"startLine": 3, "startColumn": 2}}}, {"physicalLocation": {"artifactLocation": {"uri": "b"}, "region": {"startLine": 9, "startColumn": 9}}}]}]}]}
    path = str(tmp_path / "r.sarif")
    open(path, "w").write(json.dumps(doc, indent=1))
    runs, results = readers.sarif(spark, [path])
    r = runs.first()
    assert (r["package"], r["compiles"], r["go_files"]) == ("p", True, ["a"])
    assert ids(results, "linter", "file", "line", "column") == [("lll", "a", 3, 2)]
    for name, body, read in (("a", {"Issues": [{"FromLinter": "l", "Text": "t", "Pos": {"Filename": "x\\y", "Line": 1}}]}, readers.external_a), ("b", {"issues": [{"linter": "l", "message": "t", "pos": {"filename": "x/y", "line": 1}}]}, readers.external_b)):
        (tmp_path / name).write_text(json.dumps(body))
        assert tuple(read(spark, str(tmp_path / name)).first()) == ("x/y", 1, 0, "l", "t")
    raw = frame(spark, "value string", ('{"file":"a.go","line":2,"message":"m \\n","severity":"WARN","extra":1}',), ("",))
    assert tuple(readers.plugin_findings(raw, "p", "/root").select("message", "severity", "file", "line").first()) == ("m", "warning", "/root/a.go", 2)
    with pytest.raises(Exception, match="without file"):
        readers.plugin_findings(frame(spark, "value string", ('{"file":"a.go","line":0,"message":"m"}',)), "p").collect()
    direct, aliases = readers.import_config(frame(spark, "value string", ("# c",), ("packagefile a=b.a",), ("importmap x=a",), ("importmap a=zz",)))
    assert ids(joins.resolved_aliases(direct, aliases), "path", "file") == [("a", "b.a"), ("x", "b.a")]
    with pytest.raises(ValueError):
        readers.unit_config('{"schema": 2}')
    assert readers.unit_config('{"schema": 1, "package": {"path": "p"}}').mode == "full"


def test_plugins(spark):
    assert plugins.chunks(["aa", "b", "cc"], 5) == [["aa", "b"], ["cc"]]
    files = frame(spark, "file string", ("x",), ("y",))
    out = plugins.run(files, ["echo"])
    assert sorted(" ".join(r["value"] for r in out.where("value is not null").collect()).split()) == ["x", "y"]
    assert plugins.outcome(out) == (0, None)
    assert plugins.outcome(plugins.run(files.limit(1), ["sh", "-c", "exit 3"]))[0] == 3


def test_digests_of_configuration_and_workspace(spark):
    R = suppress.ExcludeRule
    one, two = (suppress.Config(rules=(R(linters=x, text="t"),), base=b) for x, b in ((("a", "b"), "/x"), (("b", "a"), "/y")))
    assert one.digest() == two.digest() != suppress.Config().digest()
    files = frame(spark, "file string, text string", ("a", "1"), ("b", None))
    w = incremental.workspace_digest
    assert w(files) == w(files.orderBy(F.desc("file"))) and len({w(files), w(files, ("t",)), w(files, (), {"k": "v"}), w(files.limit(1))}) == 4


def test_metrics_and_symbols(spark):
    events = frame(spark, "tier string, outcome string", ("L0", "hit"), ("L0", "miss"), ("L1", "store"))
    f = frame(spark, FINDING, (1, "a", "m", "info", "f", 1, 0))
    got = json.loads(incremental.metrics(aggregates.cache_counters(events), aggregates.by_severity(f)))
    assert got["cache"]["L0"] == {"hits": 1, "misses": 1, "stores": 0, "errors": 0} and got["findings"]["info"] == 1
    index = frame(spark, "package string, name string", ("p", "Foo"), ("p", "FooBar"), ("q", "Foo"))
    assert sets.symbols(index, "p", "Foo").count() == 1 and sets.symbols(index, "p", "Foo", prefix=True).count() == 2
    ddl = "file string, line int, column int, linter string, message string"
    a, b = frame(spark, ddl, ("f", 1, 0, "x", "m")), frame(spark, ddl, ("g", 1, 0, "x", "m"))
    assert [r["side"] for r in compare.detailed(a, b).collect()] == ["a", "b"]
