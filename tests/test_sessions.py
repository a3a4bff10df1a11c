"""Driver-side parts, readers of folders, codecs and the syntax index on literal values."""

import hashlib
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import codec
from quillgrid.operators import go_rules, incremental, registry
from quillgrid.operators.sessions import ByteGate, CountGate, Expiring, Held, Once, Session
from quillgrid.sinks import writers
from quillgrid.sources import config, host, readers


def in_threads(n, work):
    out = []
    threads = [threading.Thread(target=lambda k=k: out.append(work(k))) for k in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def test_one_computation_for_many():
    once, calls = Once(), []

    def slow():
        calls.append(1)
        time.sleep(0.1)
        return len(calls)

    assert in_threads(8, lambda k: once.get("a", slow)) == [1] * 8 and once.get("a", slow) == 1 and once.get("b", slow) == 2
    with pytest.raises(ZeroDivisionError):
        once.get("c", lambda: 1 / 0)
    assert once.get("c", lambda: 5) == 5


def test_held_while_used(spark):
    made = []
    held = Held(lambda: made.append(1) or spark.range(5))
    with held.hold() as a, held.hold() as b:
        assert a is b and a.is_cached and a.count() == 5
    assert not a.is_cached and held.df is None
    with held.hold():
        assert len(made) == 2


def test_entries_expire():
    now = [0.0]
    cache, made = Expiring(2, 10, lambda: now[0]), []
    get = lambda k: cache.get(k, lambda: made.append(k) or k)
    get("a"), get("b"), get("a"), get("c")
    assert list(cache.entries) == ["a", "c"]
    now[0] = 8
    get("a")
    now[0] = 15
    get("a"), get("c")
    assert made == ["a", "b", "c", "c"]


def test_gates():
    gate, most = CountGate(2, packages=1, patience=5), []

    def work(k):
        with gate.enter("p") as in_time:
            most.append(sum(gate.live.values()))
            time.sleep(0.02)
            return in_time

    assert all(in_threads(6, work)) and max(most) == 2 and not gate.live
    tight = CountGate(1, patience=0.05)
    with tight.enter("a") as first, tight.enter("b") as second:  # waited long enough
        assert first and not second
    budget, seen = ByteGate(100), []

    def use(k):
        with budget.enter(60):
            seen.append(budget.in_flight)
            time.sleep(0.01)

    in_threads(4, use)
    assert max(seen) == 60 and budget.blocked >= 1 and budget.in_flight == 0
    with budget.enter(1000):  # nothing else is in flight
        assert budget.in_flight == 1000


def test_sessions_are_built_again_on_change():
    built = []
    s = Session(lambda *k: built.append(k) or len(built))
    assert [s.get("p", "t", ["b", "a"]), s.get("p", "t", ["a", "b"]), s.get("p", "u", ["a", "b"]), s.get("q", "u", ["a", "b"]), s.get("q", "u", ["a"])] == [1, 1, 2, 3, 4]


def test_host(tmp_path):
    assert host.peak_memory() > 1 << 20 and host.peak_memory("/nowhere") == 0 and host.memory_limit("/nowhere") is None
    (tmp_path / "memory.max").write_text("1024\n")
    assert host.memory_limit(str(tmp_path)) == 1024
    (tmp_path / "memory.max").write_text("max\n")
    assert host.memory_limit(str(tmp_path)) is None


def test_codecs(spark):
    sections = [b"", b"abc", bytes(300)]
    body = codec.sealed(3, sections)
    assert codec.opened(3, body) == sections and codec.opened(3, codec.sealed(3, [])) == []
    for bad in (body[:-1], body + b"x", b"XXXX" + body[4:], b""):
        with pytest.raises(ValueError):
            codec.opened(3, bad)
    with pytest.raises(ValueError):
        codec.opened(4, body)
    row = spark.createDataFrame([("ab", "x" * 300)], "a string, b string").select(codec.sealed_column(9, F.col("a").cast("binary"), F.col("b").cast("binary")).alias("v")).first()
    assert codec.opened(9, bytes(row["v"])) == [b"ab", b"x" * 300]
    rows, ddl = [(1, "a", [1.5]), (None, None, [])], "n int, s string, x array<double>"
    assert codec.decoded(codec.encoded(rows, ddl), ddl) == rows and codec.decoded(codec.encoded([], ddl), ddl) == []
    with pytest.raises(ValueError):
        codec.decoded(codec.encoded(rows, ddl), "n int, t string, x array<double>")


def test_folders(spark, tmp_path):
    body = b"result"
    digest = hashlib.sha256(body).hexdigest()
    for name, data in ((digest, body), ("k1.id", digest.encode()), ("k2.id", b"ab12"), ("ab12", b"other")):
        (tmp_path / name).write_bytes(data)
    remote = readers.remote_entries(spark, str(tmp_path))
    assert sorted((r["key"], bytes(r["body"])) for r in remote.collect()) == [("k1", body), ("k2", b"other")]
    assert [r["key"] for r in incremental.intact(remote).collect()] == ["k1"]  # a body that isn't what its name says is no hit
    (tmp_path / "args").write_text("-x\n\nb c\n")
    assert readers.params(["a", f"@{tmp_path}/args", "d"]) == ["a", "-x", "b c", "d"]
    facts = spark.createDataFrame([("p", "a", "o", "t", "v"), ("q", "a", "o", "t", "w")], "package string, analyzer string, object string, fact_type string, value string")
    writers.write_facts(facts, str(tmp_path / "facts"), 2)
    back = readers.facts(spark.read.parquet(str(tmp_path / "facts")), 2)
    assert sorted((r["package"], r["value"]) for r in back.collect()) == [("p", "v"), ("q", "w")] and readers.facts(spark.read.parquet(str(tmp_path / "facts")), 1).count() == 0


def test_listings_and_roots(spark):
    resolved = registry.resolve(registry.catalog(spark), "none", ["lll", "gomodguard", "funlen", "errcheck"], [])
    listed = {r["name"]: (r["enabled"], r["formatter"]) for r in registry.listing(resolved).collect()}
    assert listed["lll"] == (True, False) and listed["gci"] == (False, True) and list(listed) == sorted(listed)
    assert registry.select_roots(resolved) == (["funlen", "lll"], ["gomodguard"])
    assert registry.select_roots(resolved, "module") == (["gomodguard"], ["funlen", "lll"]) and registry.select_roots(resolved, "facts_only", ("funlen",))[0] == ["funlen"]
    assert registry.families(spark).where("member = 'printf'").first()["family"] == "govet"
    assert config.exclusion_patterns({"linters": {"exclusions": {"paths": ["a"]}}, "formatters": {"exclusions": {"paths": ["b"]}}}) == ["a", "b"] and config.exclusion_patterns({}) == []
    assert config.salt("x", {"a": 1, "b": ""}) == config.salt("x", {"a": 1}) != config.salt("x", {"a": 2})


def test_symbols_and_tests(spark):
    text = 'package p\ntype (\n\tT struct{ a int }\n\tI interface{ M() }\n\tN int\n)\nconst A, B = 1, 2\nfunc (t *T) M() {\n}\nfunc New() *T { return nil }\n'
    test = 'package p\nfunc TestA(t *testing.T) {\n\tt.Run("x y", f)\n\tt.Run("x y", f)\n\tt.Run(name, f)\n}\nfunc Testing() {}\nfunc ExampleT() {}\nfunc BenchmarkB(b *testing.B) {}\n'
    files = spark.createDataFrame([("p/a.go", "p", text), ("p/a_test.go", "p", test), ("p/bad.go", "p", "func {"), ("p/x.txt", "p", "func F() {}")], "file string, package string, text string")
    got = {(r["name"], r["kind"], r["receiver"], r["line"]) for r in go_rules.symbols(files).where("file = 'p/a.go'").collect()}
    assert got == {("T", "struct", "", 3), ("I", "interface", "", 4), ("N", "type", "", 5), ("A", "const", "", 7), ("B", "const", "", 7), ("M", "method", "T", 8), ("New", "func", "", 10)}
    found = sorted((r["name"], r["kind"], r["line"]) for r in go_rules.tests(files).collect())
    assert found == [("BenchmarkB", "benchmark", 9), ("ExampleT", "example", 8), ("TestA", "test", 2), ("TestA/x_y", "subtest", 3), ("TestA/x_y#01", "subtest", 4)]
