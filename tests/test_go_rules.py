"""Syntax rules: for each a text that it finds something in, with the lines, and one that it leaves alone."""

import pytest

from quillgrid.functions import golex
from quillgrid.operators import go_rules, registry, rules

LONG = "\n".join(f"\tx{i} := f({i})" for i in range(70))
BRANCHES = "\n".join(f"\tif a{i} && b{i} {{\n\t\tf({i})\n\t}}" for i in range(20))
DEEP = "\tif a {\n\t\tif b {\n\t\t\tif c {\n\t\t\t\tf()\n\t\t\t} else {\n\t\t\t\tg()\n\t\t\t}\n\t\t} else {\n\t\t\th()\n\t\t}\n\t}"
METHODS = "\n".join(f"\tM{i}(x int)" for i in range(11))

#: rule, settings, text after the package clause (which is line 1), lines of its findings, text without findings
CASES = [
    ("gochecknoinits", {}, "func init() {}\nfunc (t T) init() {}", [2], "func Init() {}"),
    ("gochecknoglobals", {}, "var a, errX = 1, 2\nvar (\n\tb int\n\t_ = 3\n)", [2, 4], "const c = 1\nfunc f() { var x = 1; use(x) }\n//go:embed f\nvar data string"),
    ("testpackage", {"file": "a_test.go"}, "", [1], None),
    ("importas", {"aliases": {"a/b/v1": "bv1"}}, 'import (\n\tx "a/b/v1"\n\t"c"\n)', [3], 'import bv1 "a/b/v1"'),
    ("depguard", {"deny": {"a/b": "old"}}, 'import "a/b/c"\nimport "a/bc"', [2], 'import "a/c"'),
    ("depguard", {"allow": ("fmt",)}, 'import "fmt"\nimport "os"', [3], 'import "fmt"'),
    ("exptostd", {}, 'import "golang.org/x/exp/slices"', [2], 'import "slices"'),
    ("predeclared", {}, "var len = 1\nfunc f(new int) {\n\tcap := 2\n}", [2, 3, 4], "func f(x int) { n := len(x); use(n) }"),
    ("grouper", {"single": ("var",), "grouped": ("const",)}, "var a = 1\nvar b = 2\nconst c = 3", [3, 4], "var (\n\ta = 1\n)\nconst (\n\tc = 3\n)"),
    ("decorder", {}, "func f() {}\nconst c = 1", [3], "type T int\nconst c = 1\nvar v = 2\nfunc f() {}"),
    ("interfacebloat", {}, f"type I interface {{\n{METHODS}\n}}", [2], "type I interface {\n\tM()\n}"),
    ("inamedparam", {}, "type I interface {\n\tM(int, string)\n\tN(a int)\n\tO()\n}", [3], "type I interface{ M(a, b int) }"),
    ("containedctx", {}, "type T struct {\n\tctx context.Context\n\tn int\n}", [3], "type T struct{ n int }"),
    ("embeddedstructfieldcheck", {}, "type T struct {\n\tn int\n\tsync.Mutex\n}\ntype U struct {\n\tMutex\n\tn int\n}", [4, 8], "type T struct {\n\tMutex\n\n\tn int\n}"),
    ("tagliatelle", {}, "type T struct {\n\tA int `json:\"a_b,omitempty\"`\n\tB int `json:\"aB\"`\n}", [3], "type T struct {\n\tA int `json:\"-\"`\n}"),
    ("recvcheck", {}, "func (t *T) F() {}\nfunc (t T) G() {}", [2], "func (t *T) F() {}\nfunc (u U) G() {}"),
    ("funcorder", {}, "func (t *T) b() {}\nfunc (t *T) A() {}", [3], "type T struct{}\nfunc NewT() *T { return nil }\nfunc (t *T) A() {}\nfunc (t *T) b() {}"),
    ("funcorder", {}, "func NewT() *T { return nil }\ntype T struct{}", [2], None),
    ("errname", {}, 'var bad = errors.New("x")\ntype Fault struct{}\nfunc (f Fault) Error() string { return "" }', [2, 4], 'var ErrBad = errors.New("x")\ntype badError struct{}\nfunc (e *badError) Error() string { return "" }'),
    ("funlen", {}, f"func f() {{\n{LONG}\n}}", [2], "func f() {\n\tx()\n}"),
    ("funlen", {"lines": 0}, f"func f() {{\n{LONG}\n}}", [2], None),
    ("gocyclo", {}, f"func f() {{\n{BRANCHES}\n}}", [2], f"func f() {{\n{DEEP}\n}}"),
    ("cyclop", {}, f"func f() {{\n{BRANCHES}\n}}", [2], f"func f() {{\n{DEEP}\n}}"),
    ("gocognit", {}, f"func f() {{\n{BRANCHES}\n}}", [2], f"func f() {{\n{DEEP}\n}}"),
    ("nestif", {}, f"func f() {{\n{DEEP}\n}}", [3], "func f() {\n\tif a {\n\t\tif b {\n\t\t\tg()\n\t\t}\n\t}\n}"),
    ("maintidx", {"under": 60}, f"func f() {{\n{BRANCHES}\n}}", [2], "func f() {\n\tx()\n}"),
    ("nakedret", {}, f"func f() (n int) {{\n{LONG}\n\treturn\n}}", [73], f"func f() {{\n{LONG}\n\treturn\n}}"),
    ("nonamedreturns", {}, "func f() (n int, err error) { return }", [2], "func f() (int, error) { return 1, nil }"),
    ("goprintffuncname", {}, "func say(format string, args ...any) {}", [2], "func sayf(format string, args ...interface{}) {}\nfunc x(a string, args ...any) {}"),
    ("nilnil", {}, "func f() (*T, error) {\n\treturn nil, nil\n}", [3], "func f() (int, error) {\n\treturn 0, nil\n}"),
    ("paralleltest", {"file": "a_test.go"}, "func TestA(t *testing.T) {}\nfunc TestB(t *testing.T) { t.Parallel() }", [2], "func Testing(t *testing.T) {}"),
    ("testableexamples", {"file": "a_test.go"}, "func ExampleF() {\n\tf()\n}", [2], "func ExampleF() {\n\tf()\n\t// Output: 1\n}"),
    ("thelper", {}, "func help(x int, q *testing.T) {\n\tf()\n}", [2, 2, 2], "func help(t *testing.T, x int) {\n\tt.Helper()\n}"),
    ("usetesting", {"file": "a_test.go"}, 'func TestA(t *testing.T) {\n\tos.Setenv("A", "b")\n\tctx := context.Background()\n}', [3, 4], 'func main() { os.Setenv("A", "b") }'),
    ("dogsled", {}, "func f() {\n\t_, _, _, x := g()\n\t_, y := h()\n}", [3], "func f() { a, _, _ := g() }"),
    ("copyloopvar", {}, "func f() {\n\tfor i, x := range xs {\n\t\ti := i\n\t\ty := x\n\t}\n}", [4], "func f() {\n\ti := i\n}"),
    ("intrange", {}, "func f() {\n\tfor i := 0; i < n; i++ {\n\t\tg(i)\n\t}\n}", [3], "func f() {\n\tfor i := 1; i < n; i++ {\n\t}\n\tfor i := 0; i < n; i += 2 {\n\t}\n}"),
    ("noinlineerr", {}, "func f() {\n\tif err := g(); err != nil {\n\t}\n}", [3], "func f() {\n\terr := g()\n\tif err != nil {\n\t}\n}"),
    ("nlreturn", {}, "func f() {\n\tx()\n\treturn\n}", [4], "func f() {\n\tx()\n\n\treturn\n}\nfunc g() {\n\treturn\n}"),
    ("forcetypeassert", {}, "func f() {\n\ts := x.(string)\n}", [3], "func f() {\n\ts, ok := x.(string)\n\tswitch y := x.(type) {\n\t}\n}"),
    ("errorlint", {}, 'func f() {\n\tif err == io.EOF {\n\t}\n\t_ = err.(*T)\n\t_ = fmt.Errorf("x: %v", err)\n}', [3, 5, 6], 'func f() {\n\tif err != nil {\n\t}\n\t_ = fmt.Errorf("x: %w", err)\n}'),
    ("nilerr", {}, "func f() error {\n\tif err != nil {\n\t\treturn nil\n\t}\n}", [4], "func f() error {\n\tif err != nil {\n\t\tlog(err)\n\t\treturn nil\n\t}\n}"),
    ("makezero", {}, "func f() {\n\tx := make([]int, 3)\n\tx = append(x, 1)\n}", [4], "func f() {\n\tx := make([]int, 0)\n\tx = append(x, 1)\n\ty := make([]int, 0, 3)\n\ty = append(y, 1)\n}"),
    ("usestdlibvars", {}, 'func f() {\n\thttp.NewRequest("GET", u, nil)\n\thttp.NewRequestWithContext(ctx, "POST", u, nil)\n}', [3, 4], 'func f() { http.NewRequest(http.MethodGet, "GET", nil) }'),
    ("noctx", {}, "func f() {\n\thttp.Get(u)\n}", [3], "func f() { http.NewRequestWithContext(ctx) }"),
    ("perfsprint", {}, 'func f() {\n\t_ = fmt.Errorf("x")\n\t_ = fmt.Sprintf("%d", n)\n}', [3, 4], 'func f() { _ = fmt.Sprintf("%d-%d", a, b) }'),
    ("nosprintfhostport", {}, 'func f() {\n\t_ = fmt.Sprintf("http://%s:%d/x", h, p)\n}', [3], 'func f() { _ = fmt.Sprintf("http://%s/x", h) }'),
    ("canonicalheader", {}, 'func f() {\n\tr.Header.Get("x-id")\n\tw.Header().Set("content-type", "a")\n}', [3, 4], 'func f() { r.Header.Get("X-Id") }'),
    ("gosmopolitan", {}, 'func f() {\n\tx := "漢"\n\ty := time.Local\n}', [3, 4], 'func f() { x := "é" }'),
    ("reassign", {}, 'import "io"\nfunc f() {\n\tio.EOF = nil\n}', [4], 'import "io"\nfunc f() { x.EOF = nil }'),
    ("misspell", {"words": {"foobaar": "foobar"}}, '// recieve it\n// and Foobaar\nvar x = "teh"', [2, 3, 4], "// receive it"),
    ("godot", {}, "// F does\nfunc F() {}\n// G does.\nfunc G() {}", [2], "// F does:\nfunc F() {}\n//nolint:x\nfunc G() {}"),
    ("godoclint", {}, "// Does things.\nfunc F() {}", [2], "// F does things,\n// many of them.\nfunc F() {}\n// The G is.\nfunc G() {}"),
    ("gocheckcompilerdirectives", {}, "// go:embed x\n//go:nosuch\n//go:build linux", [2, 3], "//go:generate x"),
    ("nolintlint", {"require_specific": True, "require_explanation": True, "allow_no_explanation": ("lll",)}, "var a = 1 //nolint\nvar b = 1 //nolint:\nvar c = 1 //nolint:x\nvar d = 1 //nolint:lll\nvar e = 1 //nolint:x // why", [2, 2, 3, 4], "// nolinted"),
    ("nolintlint", {}, "var a = 1 //nolint:a,,b", [2], "var a = 1 //nolint"),
    ("whitespace", {}, "func f() {\n\n\tx()\n\n}", [2, 6], "func f() {\n\t// text\n\n\tx()\n}\nfunc g() {\n}"),
    ("tracecheck", {}, 'func FooBarIDs() {\n\ttracer.Start(ctx, "foo_bar")\n}', [3], 'func FooBarIDs() {\n\ttracer.Start(ctx, "foo_bar_ids")\n}'),
]


@pytest.mark.parametrize("rule, settings, text, lines, clean", CASES, ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_rule(rule, settings, text, lines, clean):
    settings = dict(settings)
    file = settings.pop("file", "a.go")
    found = list(go_rules.hits(file, f"package p\n{text}\n", {rule: settings}))
    assert sorted(h[3] for h in found) == lines and {h[0] for h in found} == {rule} and {h[2] for h in found} == {"error"}, found
    if clean is not None:
        assert list(go_rules.hits(file, f"package p\n{clean}\n", {rule: settings})) == []


def test_every_rule_has_a_case():
    assert {c[0] for c in CASES} == set(go_rules.GO_RULES)
    assert set(go_rules.GO_RULES) | set(go_rules.MODULE_RULES) <= set(registry.NATIVE)


def test_module_rules():
    mod = "module m\n\ngo 1.22\ntoolchain go1.22.1\n\nrequire (\n\ta.b/c v1.2.0\n\td.e/f v0.1.0 // indirect\n)\nrequire g.h/i v2.0.0\nreplace a.b/c => ../c\nreplace (\n\td.e/f => x.y/z v1.0.0\n)\nretract v1.0.0\nretract v1.1.0 // bad\nexclude a.b/c v1.1.0\n"
    lines = lambda rule, **k: [h[3] for h in go_rules.hits("x/go.mod", mod, {rule: k})]
    assert lines("gomoddirectives") == [11, 13, 15] and lines("gomoddirectives", replace_local=True, replace_allow=("d.e/f",)) == [15]
    assert lines("gomoddirectives", exclude_forbidden=True, toolchain_forbidden=True) == [4, 11, 13, 15, 17]
    assert lines("gomodguard", blocked={"d.e/f": "Use x."}) == [8] and lines("gomodguard", allowed=("a.b",)) == [8, 10]
    assert lines("gomodguard", versions={"a.b/c": "<= 1.2.0", "g.h/i": "< 2.0.0"}) == [7]
    assert lines("lll") == []


def test_texts_that_do_not_scan():
    for text in ("package p\nfunc f() {", "package p\n)", 'package p\nvar x = "abc', "package p\nvar x = `a"):
        found = list(go_rules.hits("a.go", text, {"funlen": {}}))
        assert [h[0] for h in found] == ["typecheck"] and found[0][3] == 2
    assert list(go_rules.hits("a.go", "", {n: {} for n in go_rules.GO_RULES})) == []
    s = golex.read("a.go", "package p\nvar a = []func(int) (x int){nil}\nfunc g[T any](x T) T { return x }\n")
    assert s.package == "p" and [f.name for f in s.functions] == ["g"] and s.declarations[0].names[0].text == "a"


def test_rules_run_on_files(spark):
    files = spark.createDataFrame(
        [("a/x.go", "a", "package a\nfunc init() {}\n"), ("a/y.go", "a", "package a\nfunc {"), ("go.mod", "", "module m\nreplace a => ../b\n"), ("a/z.txt", "a", "func init() {}"), ("a/n.go", "a", None)], "file string, package string, text string"
    )
    found = go_rules.findings(files, {"gochecknoinits": {}, "gomoddirectives": {}, "funlen": {"lines": "many"}})
    got = {(r["linter"], r["file"], r["line"], r["severity"]) for r in found.collect()}
    assert got == {("gochecknoinits", "a/x.go", 2, "error"), ("funlen", "a/x.go", 1, "warning"), ("typecheck", "a/y.go", 2, "error"), ("gomoddirectives", "go.mod", 2, "error")}
    with pytest.raises(ValueError, match="nope"):
        go_rules.findings(files, {"nope": {}})
    resolved = registry.resolve(registry.catalog(spark), "none", ["gochecknoinits", "lll", "funlen", "gomoddirectives"], [])
    native, _, warnings = registry.plan(resolved, {}, {"lll": {"limit": 10}, "funlen": {"rows": 3}})
    assert warnings == ["funlen: unknown settings: rows"]
    lines = spark.createDataFrame([("a/z.txt", "a", 1, "func init() {}")], "file string, package string, line int, content string")
    out, _ = rules.run(native, lines, files)
    assert {(r["linter"], r["file"]) for r in out.collect()} == {("lll", "a/z.txt"), ("gochecknoinits", "a/x.go"), ("typecheck", "a/y.go"), ("gomoddirectives", "go.mod")}
