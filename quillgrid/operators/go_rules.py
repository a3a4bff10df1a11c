"""Rules over Go source files that need its syntax but no types, and rules over go.mod files.

A rule is a generator of (line, column, message) over a file as :mod:`..functions.golex` reads it. Files are read once and
all rules run on them in the task that holds the file; a rule that fails gives a warning in its own name, and a file that
can't be read gives one finding of ``typecheck``. Where a rule's original asks the type checker, this one goes by names
and shapes in the text, which its docstring says. Messages are worded like those of the rules' well-known originals, as
exclusion patterns are written against them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import golex
from ..functions.golex import Function, Source, Token, fields, named, statements, text_of

Hit = tuple[int, int, str]
FINDING = "linter string, message string, severity string, file string, package string, line int, column int"

#: Names that Go declares itself.
PREDECLARED = frozenset("any append bool byte cap clear close comparable complex complex128 complex64 copy delete error false float32 float64 imag int int16 int32 int64 int8 iota len make max min new nil panic print println real recover rune string true uint uint16 uint32 uint64 uint8 uintptr".split())
#: Directives that the compiler and its tools know.
DIRECTIVES = frozenset("build buildinfo cgo_export_dynamic cgo_export_static cgo_import_dynamic cgo_import_static cgo_ldflag cgo_dynamic_linker cgo_unsafe_args debug embed fix generate linkname nocheckptr noescape noinline nointerface nosplit norace notinheap nowritebarrier nowritebarrierrec registerparams systemstack uintptrescapes uintptrkeepalive wasmexport wasmimport yeswritebarrierrec".split())
#: Methods and status texts that net/http has constants for.
HTTP_METHODS = {"GET": "http.MethodGet", "HEAD": "http.MethodHead", "POST": "http.MethodPost", "PUT": "http.MethodPut", "PATCH": "http.MethodPatch", "DELETE": "http.MethodDelete", "CONNECT": "http.MethodConnect", "OPTIONS": "http.MethodOptions", "TRACE": "http.MethodTrace"}
#: Words that are often misspelled; more can be given.
MISSPELLED = {"recieve": "receive", "seperate": "separate", "occured": "occurred", "langauge": "language", "teh": "the", "adress": "address", "definately": "definitely", "enviroment": "environment", "existance": "existence", "neccessary": "necessary", "occurence": "occurrence", "paramater": "parameter", "refered": "referred", "succesful": "successful", "sucess": "success", "transfered": "transferred", "untill": "until", "wich": "which", "beggining": "beginning", "lenght": "length"}

#: Messages that exclusion patterns are written against.
MESSAGES = {
    "init": "init function",
    "blanks": "declaration has {} blank identifiers",
    "leading": "unnecessary leading newline",
    "trailing": "unnecessary trailing newline",
    "malformed": "nolintlint: directive is malformed; expected `//nolint:<linter>[,<linter>]* [// explanation]`",
    "unspecific": "nolintlint: directive must name at least one specific linter (e.g. `//nolint:errcheck`)",
    "unexplained": "nolintlint: directive {} must have an explanation (e.g. `// explain why`)",
}

here = lambda t: (t.line, t.column)


def body(s: Source, f: Function) -> list[Token]:
    return s.tokens[f.body[0] + 1 : f.body[1]] if f.body else []


def calls(s: Source, pattern: str) -> Iterator[tuple[Token, list[list[Token]], int]]:
    """Calls of a dotted name: its first token, its arguments, and the index of its opening bracket."""
    want = re.compile(pattern).fullmatch
    for i, t in enumerate(s.tokens):
        if t == "(" and i >= 3 and s.tokens[i - 1].kind == "name" and s.tokens[i - 2] == "." and s.tokens[i - 3].kind == "name" and want(f"{s.tokens[i - 3].text}.{s.tokens[i - 1].text}"):
            yield s.tokens[i - 3], fields(s.tokens[i + 1 : t.pair]), i


def is_test(f: Function) -> bool:
    return bool(re.match(r"Test([A-Z_0-9]|$)", f.name)) and "testing.T" in text_of(f.params)


# declarations


def gochecknoinits(s: Source) -> Iterator[Hit]:
    for f in s.functions:
        if f.name == "init" and not f.receiver:
            yield *here(s.tokens[f.at]), MESSAGES["init"]


def gochecknoglobals(s: Source) -> Iterator[Hit]:
    """Errors by their name, blank names and embedded files may be global."""
    embedded = {c.end_line + 1 for c in s.comments if c.text.startswith("//go:embed")}
    for d in s.declarations:
        for n in d.names if d.keyword == "var" else ():
            if n.text != "_" and not re.match("[eE]rr([A-Z]|$)", n.text) and n.line not in embedded:
                yield *here(n), f"{n.text} is a global variable"


def testpackage(s: Source) -> Iterator[Hit]:
    if s.file.endswith("_test.go") and not re.search(r"(export|internal)_test\.go$", s.file) and s.package != "main" and not s.package.endswith("_test"):
        yield 1, 1, f"package should be {s.package}_test instead of {s.package}"


def importas(s: Source, aliases: dict[str, str] | None = None, no_unaliased: bool = False) -> Iterator[Hit]:
    """``aliases``: wanted alias by path."""
    for alias, path, t in s.imports:
        want = (aliases or {}).get(path)
        if want and alias != want and (alias or no_unaliased):
            yield *here(t), f"import {path!r} should have the alias {want!r}, not {alias!r}"


def depguard(s: Source, deny: dict[str, str] | None = None, allow: tuple[str, ...] = ()) -> Iterator[Hit]:
    """Imports by prefix of whole path elements: denied ones with their reason, and, where there is an allow list, all that isn't on it."""
    under = lambda path, p: path == p or path.startswith(p.rstrip("/") + "/")
    for _, path, t in s.imports:
        reason = next((f"import {path!r} is not allowed: {why}" for p, why in (deny or {}).items() if under(path, p)), None)
        if reason is None and allow and not any(under(path, p) for p in allow):
            reason = f"import {path!r} is not on the list of allowed ones"
        if reason:
            yield *here(t), reason


def exptostd(s: Source) -> Iterator[Hit]:
    for _, path, t in s.imports:
        if path in ("golang.org/x/exp/maps", "golang.org/x/exp/slices", "golang.org/x/exp/constraints"):
            yield *here(t), f"import {path!r} can be replaced by {'cmp' if path.endswith('constraints') else path.rsplit('/', 1)[1]!r}"


def predeclared(s: Source, ignore: tuple[str, ...] = ()) -> Iterator[Hit]:
    found = [n for d in s.declarations for n in d.names]
    for f in s.functions:
        found += named(f.params) + named(f.results[1:-1]) + named(f.receiver) + ([] if f.receiver else [Token("name", f.name, *here(s.tokens[f.at]), f.line)])
        inner = body(s, f)
        for i, t in enumerate(inner):
            if t == ":=":
                j = i - 1
                while j >= 0 and (inner[j].kind == "name" or inner[j] == ",") and inner[j].line == t.line and inner[j].text not in ("for", "if", "switch", "case"):
                    found += [inner[j]] if inner[j].kind == "name" else []
                    j -= 1
    for n in found:
        if n.text in PREDECLARED and n.text not in ignore:
            yield *here(n), f"{n.text} is also the name of a predeclared identifier"


def grouper(s: Source, single: tuple[str, ...] = (), grouped: tuple[str, ...] = ()) -> Iterator[Hit]:
    """Keywords that may stand once only, and those whose declarations must be in brackets."""
    for k in single:
        mine = [d for d in s.declarations if d.keyword == k]
        for d in mine[1:]:
            yield d.line, d.column, f"should have one {k} declaration only, found {len(mine)}"
    for d in s.declarations:
        if d.keyword in grouped and not d.grouped:
            yield d.line, d.column, f"{d.keyword} declarations should be in brackets"


def decorder(s: Source, order: tuple[str, ...] = ("type", "const", "var", "func"), init_first: bool = False) -> Iterator[Hit]:
    rows = sorted([(d.line, d.column, d.keyword) for d in s.declarations if d.keyword != "import"] + [(f.line, 1, "func") for f in s.functions if not f.receiver])
    latest = ""
    for line, column, k in rows:
        if latest and order.index(k) < order.index(latest):
            yield line, column, f"{k} must not be placed after {latest}"
        else:
            latest = k
    if init_first and (fs := [f for f in s.functions if not f.receiver]):
        for f in fs[1:]:
            if f.name == "init":
                yield f.line, 1, "init func must be the first function in file"


def types(s: Source, kind: str) -> Iterator[tuple[Token, int, int]]:
    """(name, opening brace, closing brace) of the struct or interface types that a file declares."""
    for d in s.declarations:
        if d.keyword == "type":
            for i in range(d.at, d.end):
                if s.tokens[i] == kind and s.tokens[i + 1] == "{" and s.tokens[i - 1].kind == "name":
                    yield s.tokens[i - 1], i + 1, s.tokens[i + 1].pair


def members(s: Source, lo: int, hi: int) -> list[list[Token]]:
    return [s.tokens[a:b] for a, b in golex.specs_of(s.tokens, lo + 1, hi)]


def interfacebloat(s: Source, max: int = 10) -> Iterator[Hit]:
    for name, lo, hi in types(s, "interface"):
        n = sum(len(m) > 1 and m[1] == "(" for m in members(s, lo, hi))
        if n > max:
            yield *here(name), f"the interface has more than {max} methods: {n}"


def inamedparam(s: Source) -> Iterator[Hit]:
    for _, lo, hi in types(s, "interface"):
        for m in members(s, lo, hi):
            if len(m) > 2 and m[1] == "(":
                end = next(k for k, t in enumerate(m) if t is s.tokens[m[1].pair])
                params = m[2:end]
                if params and not named(params):
                    yield *here(m[0]), f"interface method {m[0].text} must have named params"


def containedctx(s: Source) -> Iterator[Hit]:
    """Fields whose type is written context.Context."""
    for _, lo, hi in types(s, "struct"):
        for m in members(s, lo, hi):
            if text_of(m[-3:]) == "context.Context":
                yield *here(m[0]), "found a struct that contains a context.Context field"


def embeddedstructfieldcheck(s: Source) -> Iterator[Hit]:
    for _, lo, hi in types(s, "struct"):
        last_line, regular = None, False
        for m in members(s, lo, hi):
            core = [t for t in m if t.kind != "str"]
            embedded = bool(core) and (core[0] == "*" or len(core) == 1 or (len(core) > 1 and core[1] == "."))
            if embedded and regular:
                yield *here(m[0]), "embedded fields should be listed before regular fields"
            elif not embedded and not regular and last_line is not None and m[0].line <= last_line + 1:
                yield *here(m[0]), "there must be an empty line separating embedded fields from regular fields"
            regular, last_line = regular or not embedded, m[-1].end_line


def tagliatelle(s: Source, case: str = "camel", key: str = "json") -> Iterator[Hit]:
    form = {"camel": r"[a-z][a-zA-Z0-9]*", "snake": r"[a-z][a-z0-9]*(_[a-z0-9]+)*", "kebab": r"[a-z][a-z0-9]*(-[a-z0-9]+)*", "pascal": r"[A-Z][a-zA-Z0-9]*"}[case]
    for t in s.tokens:
        if t.kind == "str" and t.text[0] == "`" and (m := re.search(rf'\b{key}:"([^",]*)', t.text)) and m[1] not in ("", "-") and not re.fullmatch(form, m[1]):
            yield *here(t), f"{key}({case}): the name {m[1]!r} is in another case"


def recvcheck(s: Source) -> Iterator[Hit]:
    """Types whose methods in this file have receivers of both kinds."""
    kinds: dict[str, dict[bool, Function]] = {}
    for f in s.functions:
        if f.receiver:
            names = [t for t in f.receiver if t.kind == "name"]
            base = re.sub(r"\[.*", "", text_of([t for t in f.receiver if t != "*"][(1 if len(names) > 1 else 0) :]))
            kinds.setdefault(base, {}).setdefault(any(t == "*" for t in f.receiver), f)
    for base, both in kinds.items():
        if len(both) == 2:
            yield min(f.line for f in both.values()), 1, f"the methods of {base!r} use pointer receiver and non-pointer receiver"


def funcorder(s: Source) -> Iterator[Hit]:
    places = {n.text: n.line for n, _, _ in types(s, "struct")}
    private: dict[str, Function] = {}
    for f in s.functions:
        if f.receiver:
            base = [t.text for t in f.receiver if t.kind == "name"][-1]
            if f.name[:1].isupper() and base in private:
                yield f.line, 1, f"unexported method {private[base].name!r} for struct {base!r} should be placed after the exported method {f.name!r}"
            elif not f.name[:1].isupper():
                private.setdefault(base, f)
        elif (m := re.match("(?:New|Must|Or)(.+)", f.name)) and m[1] in places:
            if f.line < places[m[1]]:
                yield f.line, 1, f"constructor {f.name!r} should be placed after the struct declaration"
            elif any(g.receiver and g.line < f.line and [t.text for t in g.receiver if t.kind == "name"][-1] == m[1] for g in s.functions):
                yield f.line, 1, f"constructor {f.name!r} for struct {m[1]!r} should be placed before its methods"


def errname(s: Source) -> Iterator[Hit]:
    """Variables made by errors.New or fmt.Errorf, and types with an Error method in this file."""
    for d in s.declarations:
        if d.keyword == "var":
            for n in d.names:
                i = next(k for k in range(d.at, d.end + 1) if s.tokens[k] is n)
                made = text_of([t for t in s.tokens[i + 1 : i + 5]])
                if re.match(r"=(errors\.New|fmt\.Errorf)", made) and not re.match("[eE]rr([A-Z]|$)", n.text):
                    yield *here(n), f"the sentinel error name {n.text!r} should conform to the {'Err' if n.text[:1].isupper() else 'err'}Xxx format"
    for f in s.functions:
        if f.name == "Error" and f.receiver and text_of(f.results) == "string" and not f.params:
            base = [t.text for t in f.receiver if t.kind == "name"][-1]
            if not base.endswith(("Error", "Errors")):
                yield f.line, 1, f"the error type name {base!r} should conform to the {'X' if base[:1].isupper() else 'x'}xxError format"


# functions


def funlen(s: Source, lines: int = 60, statement_limit: int = 40) -> Iterator[Hit]:
    for f in s.functions:
        if f.body:
            n, k = f.end_line - f.line - 1, sum(len(statements(s, b)) for b in s.blocks if f.body[0] <= b[0] <= f.body[1])
            if n > lines > 0:
                yield f.line, 1, f"function {f.name!r} is too long ({n} > {lines})"
            elif k > statement_limit > 0:
                yield f.line, 1, f"function {f.name!r} has too many statements ({k} > {statement_limit})"


def complexity(s: Source, f: Function) -> int:
    return 1 + sum(t.text in ("if", "for", "case", "&&", "||") and t.kind in ("name", "op") for t in body(s, f))


def gocyclo(s: Source, over: int = 30) -> Iterator[Hit]:
    for f in s.functions:
        if (n := complexity(s, f)) > over:
            yield f.line, 1, f"cyclomatic complexity {n} of func {f.name!r} is high (> {over})"


def cyclop(s: Source, max_complexity: int = 10) -> Iterator[Hit]:
    for f in s.functions:
        if (n := complexity(s, f)) > max_complexity:
            yield f.line, 1, f"calculated cyclomatic complexity for function {f.name} is {n}, max is {max_complexity}"


def cognitive(s: Source, f: Function) -> int:
    """Each branch counts 1 and its nesting; else, labelled jumps, runs of equal && or || and recursion count 1."""
    if not f.body:
        return 0
    inside = [b for b in s.blocks if f.body[0] < b[0] <= f.body[1]]
    total, last = 0, ""
    for i in range(f.body[0] + 1, f.body[1]):
        t, before = s.tokens[i], s.tokens[i - 1]
        if t.kind == "name" and t.text in ("if", "for", "switch", "select"):
            total += 1 if t == "if" and before == "else" else 1 + sum(a < i < b for a, b in inside)
        elif t == "else" and s.tokens[i + 1] != "if" or t == "goto" or t.text in ("break", "continue") and s.tokens[i + 1].kind == "name" and s.tokens[i + 1].line == t.line or t.kind == "name" and t.text == f.name and s.tokens[i + 1] == "(" and not f.receiver and before != ".":
            total += 1
        if t.text in ("&&", "||"):
            total += t.text != last
            last = t.text
        elif t.text in ("{", "}", ";", "(", ","):
            last = ""
    return total


def gocognit(s: Source, over: int = 30) -> Iterator[Hit]:
    for f in s.functions:
        if (n := cognitive(s, f)) > over:
            yield f.line, 1, f"cognitive complexity {n} of func {f.name!r} is high (> {over})"


def nestif(s: Source, least: int = 5) -> Iterator[Hit]:
    """An outermost if with what is nested in it: each nested if counts its depth, each else 1."""
    for f in s.functions:
        if not f.body:
            continue
        i = f.body[0] + 1
        while i < f.body[1]:
            if s.tokens[i] != "if":
                i += 1
                continue
            spans = [(a, b) for a, b in s.blocks if a > i]
            end = i
            chain = []
            while spans and (end == i or s.tokens[end + 1] == "else"):
                span = next((x for x in spans if x[0] > end), None)
                if span is None:
                    break
                chain.append(span)
                end = span[1]
            nested = [k for k in range(i + 1, end) if s.tokens[k] == "if" and s.tokens[k - 1] != "else"]
            depth = lambda k: sum(a < k < b for a, b in s.blocks if i < a and b <= end)  # noqa: B023,E731
            n = sum(depth(k) for k in nested) + sum(s.tokens[k] == "else" and depth(k) > 0 for k in range(i + 1, end))
            if n >= least:
                yield *here(s.tokens[i]), f"if has complex nested blocks (complexity: {n})"
            i = end + 1


def maintidx(s: Source, under: int = 20) -> Iterator[Hit]:
    """The index 171 - 5.2 ln(volume) - 0.23 complexity - 16.2 ln(lines), as a share of 171."""
    for f in s.functions:
        inner = body(s, f)
        if inner:
            words = Counter(t.text for t in inner)
            volume, lines = sum(words.values()) * math.log2(max(2, len(words))), max(1, f.end_line - f.line + 1)
            index = max(0, int((171 - 5.2 * math.log(volume) - 0.23 * complexity(s, f) - 16.2 * math.log(lines)) * 100 / 171))
            if index < under:
                yield f.line, 1, f"Function name: {f.name}, Cyclomatic Complexity: {complexity(s, f)}, Maintainability Index: {index}"


def nakedret(s: Source, max_lines: int = 30) -> Iterator[Hit]:
    for f in s.functions:
        if f.body and f.results and f.results[0] == "(" and named(f.results[1:-1]) and f.end_line - f.line > max_lines:
            for i in range(f.body[0], f.body[1]):
                if s.tokens[i] == "return" and s.tokens[i + 1].line > s.tokens[i].line:
                    yield *here(s.tokens[i]), f"naked return in func {f.name!r} with {f.end_line - f.line + 1} lines of code"


def nonamedreturns(s: Source) -> Iterator[Hit]:
    for f in s.functions:
        for n in named(f.results[1:-1]) if f.results and f.results[0] == "(" else ():
            if n.text != "_":
                yield f.line, 1, f"named return {n.text!r} found"
                break


def goprintffuncname(s: Source) -> Iterator[Hit]:
    for f in s.functions:
        parts = [text_of(p) for p in fields(f.params)]
        if len(parts) > 1 and re.search(r"\.\.\.(any|interface\{\})$", parts[-1]) and re.fullmatch("formatstring|format", parts[-2]) and "string" in parts[-2] + text_of(f.params) and not f.name.endswith("f"):
            yield f.line, 1, f"printf-like formatting function {f.name!r} should be named {f.name + 'f'!r}"


def nilnil(s: Source) -> Iterator[Hit]:
    """Functions that return a pointer, map, slice, channel or function beside an error, going by how the type is written."""
    for f in s.functions:
        results = [text_of(p) for p in fields(f.results[1:-1])] if f.results and f.results[0] == "(" else []
        if f.body and len(results) == 2 and results[1].endswith("error") and re.match(r"(\w+)?(\*|map\[|chan|func\(|interface\{|any$)", results[0]):
            for i in range(f.body[0], f.body[1] - 3):
                if s.tokens[i] == "return" and text_of(s.tokens[i + 1 : i + 4]) == "nil,nil" and s.tokens[i + 4].line > s.tokens[i + 3].line:
                    yield *here(s.tokens[i]), "return both a `nil` error and an invalid value: use a sentinel error instead"


def paralleltest(s: Source) -> Iterator[Hit]:
    for f in s.functions:
        if s.file.endswith("_test.go") and is_test(f) and not re.search(r"\b\w+\.Parallel\(\)", text_of(body(s, f))):
            yield f.line, 1, f"Function {f.name} missing the call to method parallel"


def testableexamples(s: Source) -> Iterator[Hit]:
    for f in s.functions:
        if s.file.endswith("_test.go") and re.match("Example([A-Z_]|$)", f.name) and f.body and not f.params:
            if not any(f.line < c.line <= f.end_line and re.match(r"(?i)//\s*(unordered )?output:", c.text) for c in s.comments):
                yield f.line, 1, f"missing output for example, go test can't validate it: {f.name}"


def thelper(s: Source) -> Iterator[Hit]:
    """Test helpers by their parameter of type *testing.T, *testing.B or testing.TB."""
    for f in s.functions:
        parts = [p for p in fields(f.params) if re.search(r"testing\.(T|B|TB|F)$", text_of(p))]
        if not parts or not f.body or re.match("(Test|Benchmark|Fuzz)([A-Z_0-9]|$)", f.name):
            continue
        kind = text_of(parts[0]).rsplit(".", 1)[1]
        want = {"T": "t", "B": "b", "TB": "tb", "F": "f"}[kind]
        if fields(f.params)[0] is not parts[0] and text_of(fields(f.params)[0]) != text_of(parts[0]) and "context.Context" not in text_of(fields(f.params)[0]):
            yield f.line, 1, f"parameter *testing.{kind} should be the first or after context.Context"
        if parts[0][0].text != want and len(parts[0]) > 3:
            yield f.line, 1, f"parameter *testing.{kind} should have name {want}"
        if not text_of(s.tokens[f.body[0] + 1 : f.body[0] + 6]).endswith(".Helper()"):
            yield f.line, 1, f"test helper function should start from {want}.Helper()"


def usetesting(s: Source) -> Iterator[Hit]:
    instead = {"os.Setenv": "t.Setenv", "os.MkdirTemp": "t.TempDir", "os.TempDir": "t.TempDir", "os.Chdir": "t.Chdir", "context.Background": "t.Context", "context.TODO": "t.Context"}
    if s.file.endswith("_test.go"):
        for t, _, i in calls(s, "os\\.(Setenv|MkdirTemp|TempDir|Chdir)|context\\.(Background|TODO)"):
            name = f"{t.text}.{s.tokens[i - 1].text}"
            if any(f.body and f.body[0] < i < f.body[1] and "testing." in text_of(f.params) for f in s.functions):
                yield *here(t), f"{name}() could be replaced by {instead[name]}()"


# statements


def dogsled(s: Source, max_blank_identifiers: int = 2) -> Iterator[Hit]:
    for b in s.blocks:
        for i, j in statements(s, b):
            k = next((k for k in range(i, j + 1) if s.tokens[k].text in ("=", ":=")), None)
            n = sum(text_of(p) == "_" for p in fields(s.tokens[i:k])) if k is not None else 0
            if n > max_blank_identifiers:
                yield *here(s.tokens[i]), MESSAGES["blanks"].format(n)


def copyloopvar(s: Source) -> Iterator[Hit]:
    for i, t in enumerate(s.tokens):
        if t == "for" and (span := next(((a, b) for a, b in s.blocks if a > i), None)):
            head = s.tokens[i + 1 : span[0]]
            names = {x.text for x in head[: next((k for k, x in enumerate(head) if x == ":="), 0)] if x.kind == "name"} - {"_"}
            for a, b in statements(s, span):
                part = s.tokens[a : b + 1]
                if len(part) == 3 and part[1] == ":=" and part[0].text == part[2].text and part[0].text in names:
                    yield *here(part[0]), f'The copy of the "for" variable "{part[0].text}" can be deleted (Go 1.22+)'


def intrange(s: Source) -> Iterator[Hit]:
    for i, t in enumerate(s.tokens):
        if t == "for" and i + 13 < len(s.tokens):
            head = [x.text for x in s.tokens[i + 1 : i + 6]]
            if len(set(head[:1])) and head[1:4] == [":=", "0", ";"] and head[4] == head[0] and s.tokens[i + 6] == "<":
                rest = text_of(s.tokens[i + 7 : next((a for a, _ in s.blocks if a > i), i)])
                if rest.endswith(f";{head[0]}++"):
                    yield *here(t), "for loop can be changed to use an integer range (Go 1.22+)"


def noinlineerr(s: Source) -> Iterator[Hit]:
    for i, t in enumerate(s.tokens):
        if t == "if" and i + 2 < len(s.tokens) and s.tokens[i + 1] == "err" and s.tokens[i + 2] == ":=":
            yield *here(t), "avoid inline error handling using `if err := ...; err != nil`; use plain assignment `err := ...`"


def nlreturn(s: Source, block_size: int = 1) -> Iterator[Hit]:
    for b in s.blocks:
        inside = statements(s, b)
        for (i0, _), (_, end), (i, _) in zip([inside[0]] * len(inside), inside, inside[1:]):
            t = s.tokens[i]
            if t.text in ("return", "break", "continue", "goto", "fallthrough") and t.line - s.tokens[i0].line >= block_size and s.tokens[end] != ":":
                if all(x.strip() for x in s.lines[s.tokens[end].end_line : t.line - 1]):
                    yield *here(t), f"{t.text} with no blank line before"


def forcetypeassert(s: Source) -> Iterator[Hit]:
    for b in s.blocks:
        for i, j in statements(s, b):
            part = s.tokens[i : j + 1]
            k = next((k for k, x in enumerate(part) if x.text in ("=", ":=")), None)
            if k is not None and part[0].text not in ("if", "switch", "for") and len(fields(part[:k])) == 1 and part[-1] == ")" and len(part) > 3:
                open_ = part.index(s.tokens[part[-1].pair]) if s.tokens[part[-1].pair] in part else -1
                if open_ > 1 and part[open_ - 1] == "." and text_of(part[open_ + 1 : -1]) != "type":
                    yield *here(part[0]), "type assertion must be checked"


def errorlint(s: Source) -> Iterator[Hit]:
    """Errors by their names: err and those that begin with Err, and io.EOF."""
    for i, t in enumerate(s.tokens):
        if t.text in ("==", "!=") and i and i + 1 < len(s.tokens):
            left, right = s.tokens[i - 1], text_of(s.tokens[i + 1 : i + 4])
            if left == "err" and re.match(r"(\w+\.)?(Err[A-Z]\w*|EOF)", right):
                yield *here(left), f"comparing with {t.text} will fail on wrapped errors. Use errors.Is to check for a specific error"
        if t == "err" and text_of(s.tokens[i + 1 : i + 3]) == ".(":
            yield *here(t), "type assertion on error will fail on wrapped errors. Use errors.As to check for specific errors"
    for t, args, _ in calls(s, "fmt\\.Errorf"):
        if args and args[0][0].kind == "str" and args[-1][0] == "err" and len(args[-1]) == 1 and re.search("%[vs]", args[0][0].text) and "%w" not in args[0][0].text:
            yield *here(t), "non-wrapping format verb for fmt.Errorf. Use `%w` to format errors"


def nilerr(s: Source) -> Iterator[Hit]:
    for i, t in enumerate(s.tokens):
        if t == "if" and text_of(s.tokens[i + 1 : i + 5]) == "err!=nil{":
            span = (i + 4, s.tokens[i + 4].pair)
            for a, b in statements(s, span):
                if s.tokens[a] == "return" and b > a and s.tokens[b] == "nil" and not any(x == "err" for x in s.tokens[span[0] : span[1]]):
                    yield *here(s.tokens[a]), f"error is not nil (line {t.line}) but it returns nil"


def makezero(s: Source) -> Iterator[Hit]:
    for f in s.functions:
        sized: set[str] = set()
        for i in range(f.body[0], f.body[1] - 3) if f.body else ():
            t = s.tokens[i]
            if t.text in (":=", "=") and text_of(s.tokens[i + 1 : i + 5]) == "make([]":
                args = fields(s.tokens[i + 3 : s.tokens[i + 2].pair])
                if len(args) == 2 and text_of(args[1]) != "0":
                    sized.add(s.tokens[i - 1].text)
            if t == "append" and s.tokens[i + 1] == "(" and s.tokens[i + 2].text in sized and s.tokens[i + 3] == ",":
                yield *here(t), f"append to slice `{s.tokens[i + 2].text}` with non-zero initialized length"


# calls and texts


def usestdlibvars(s: Source) -> Iterator[Hit]:
    for t, args, i in calls(s, "http\\.(NewRequest|NewRequestWithContext)|httptest\\.NewRequest"):
        at = 1 if s.tokens[i - 1] == "NewRequestWithContext" else 0
        if len(args) > at and len(args[at]) == 1 and (name := HTTP_METHODS.get(args[at][0].text.strip('"').upper())) and args[at][0].kind == "str":
            yield *here(args[at][0]), f"{args[at][0].text} can be replaced by {name}"


def noctx(s: Source) -> Iterator[Hit]:
    for t, _, i in calls(s, "http\\.(Get|Head|Post|PostForm|NewRequest)|exec\\.Command|net\\.(Dial|Listen)"):
        yield *here(t), f"{t.text}.{s.tokens[i - 1].text} must not be called. Use the form with a context"


def perfsprint(s: Source) -> Iterator[Hit]:
    for t, args, i in calls(s, "fmt\\.(Sprintf|Errorf)"):
        literal = args[0][0].text if args and args[0][0].kind == "str" and len(args[0]) == 1 else ""
        if s.tokens[i - 1] == "Errorf" and len(args) == 1 and literal and "%" not in literal:
            yield *here(t), "fmt.Errorf can be replaced with errors.New"
        elif s.tokens[i - 1] == "Sprintf" and (literal and len(args) == 1 and "%" not in literal or literal in ('"%d"', '"%t"', '"%x"') and len(args) == 2):
            yield *here(t), "fmt.Sprintf can be replaced with " + {'"%d"': "faster strconv.Itoa", '"%t"': "faster strconv.FormatBool", '"%x"': "faster hex.EncodeToString"}.get(literal, "just using the string")


def nosprintfhostport(s: Source) -> Iterator[Hit]:
    for t, args, _ in calls(s, "fmt\\.Sprintf"):
        if args and args[0][0].kind == "str" and re.match(r'"[a-zA-Z0-9+.-]*://(%s|%v)(@%s)?:(%d|%s|%v)', args[0][0].text):
            yield *here(t), "host:port in url should be constructed with net.JoinHostPort and not directly with fmt.Sprintf"


def canonicalheader(s: Source) -> Iterator[Hit]:
    for i, t in enumerate(s.tokens):
        k = i + (3 if text_of(s.tokens[i + 1 : i + 3]) == "()" else 1)  # w.Header().Set and r.Header.Set
        if t == "Header" and re.fullmatch(r"\.(Get|Set|Add|Del|Values)\(", text_of(s.tokens[k : k + 3])) and k + 3 < len(s.tokens) and s.tokens[k + 3].kind == "str":
            key = s.tokens[k + 3].text.strip('"`')
            good = "-".join(p[:1].upper() + p[1:].lower() for p in key.split("-"))
            if key != good and re.fullmatch(r"[A-Za-z0-9-]+", key):
                yield *here(s.tokens[k + 3]), f"non-canonical header {key!r}, instead use: {good!r}"


def gosmopolitan(s: Source) -> Iterator[Hit]:
    for i, t in enumerate(s.tokens):
        if t.kind in ("str", "char") and re.search("[㐀-鿿]", t.text):
            yield *here(t), "string literal contains rune in Han script"
        if t == "time" and text_of(s.tokens[i + 1 : i + 3]) == ".Local":
            yield *here(t), "usage of time.Local"


def reassign(s: Source, pattern: str = "EOF|Err.*") -> Iterator[Hit]:
    packages = {alias or path.rsplit("/", 1)[-1] for alias, path, _ in s.imports}
    for i, t in enumerate(s.tokens):
        if t == "=" and i >= 3 and s.tokens[i - 2] == "." and s.tokens[i - 3].text in packages and re.fullmatch(pattern, s.tokens[i - 1].text):
            yield *here(s.tokens[i - 3]), f"reassigning variable {s.tokens[i - 1].text} in other package {s.tokens[i - 3].text}"


def misspell(s: Source, words: dict[str, str] | None = None) -> Iterator[Hit]:
    """In comments and texts."""
    known = MISSPELLED | (words or {})
    for t in [*s.comments, *(t for t in s.tokens if t.kind == "str")]:
        for m in re.finditer(r"[A-Za-z]+", t.text):
            if (right := known.get(m[0].lower())) is not None:
                line = t.line + t.text.count("\n", 0, m.start())
                yield line, t.column + m.start() if line == t.line else m.start() - t.text.rfind("\n", 0, m.start()), f"`{m[0]}` is a misspelling of `{right}`"


# comments and white space


def godot(s: Source) -> Iterator[Hit]:
    """The last comment above a declaration of the outermost level must end a sentence; directives and marks don't count."""
    starts = {d.line for d in s.declarations if d.keyword != "import"} | {f.line for f in s.functions}
    for c in s.comments:
        last = c.text.removeprefix("/*").removesuffix("*/") if c.text.startswith("/*") else c.text[2:]
        if c.column == 1 and c.end_line + 1 in starts and last.strip() and not re.match(r"//(go:|\w+:|nolint|[ \t]*\+build)", c.text):
            if not re.search(r"[.?!:。？！：]\)?$", last.rstrip()):
                yield c.end_line, c.column, "Comment should end in a period"


def godoclint(s: Source) -> Iterator[Hit]:
    tops = {c.end_line: c for c in s.comments if c.column == 1 and c.text.startswith("//")}
    for f in s.functions:
        line = f.line - 1
        if line in tops and f.name[:1].isupper():
            while line - 1 in tops:
                line -= 1
            first = tops[line].text[2:].strip()
            if first and not re.match(rf"(?:(?:A|An|The) )?{re.escape(f.name)}\b|Deprecated:", first):
                yield line, 1, f'godoc should start with symbol name ("{f.name}")'


def gocheckcompilerdirectives(s: Source) -> Iterator[Hit]:
    for c in s.comments:
        if m := re.match(r"//(\s*)go:(\w*)", c.text):
            if m[1]:
                yield *here(c), f"compiler directive contains space: {c.text}"
            elif m[2] not in DIRECTIVES:
                yield *here(c), f"compiler directive unrecognized: {c.text}"


def nolintlint(s: Source, require_specific: bool = False, require_explanation: bool = False, allow_no_explanation: tuple[str, ...] = ()) -> Iterator[Hit]:
    for c in s.comments:
        inner = c.text[2:-2] if c.text.startswith("/*") else c.text[2:]
        m = re.match(r"(?is)[ \t]*nolint(.*)$", inner)
        if not m:
            continue
        head, mark, why = m[1].partition("//")
        head = head.rstrip(" \t")
        if head and not head.startswith(":"):
            continue
        listed = head[1:].strip()
        names = [] if listed.lower() == "all" else [x.strip().lower() for x in listed.split(",")] if listed else []
        if head and (not listed or "" in names):
            yield *here(c), MESSAGES["malformed"]
            continue
        if require_specific and not names:
            yield *here(c), MESSAGES["unspecific"]
        if require_explanation and not why.strip() and not (names and allow_no_explanation and set(names) <= set(allow_no_explanation)):
            told = "//nolint" + (":" + ",".join(names) if names else "")
            yield *here(c), MESSAGES["unexplained"].format(f'"{told}"')


def whitespace(s: Source) -> Iterator[Hit]:
    """Blank lines at the start and at the end of blocks; comments count as lines."""
    for a, b in s.blocks:
        if b <= a + 1:
            continue
        top, bottom, first, last = s.tokens[a], s.tokens[b], s.tokens[a + 1].line, s.tokens[b - 1].end_line
        for c in s.comments:
            if top.line < c.line and c.end_line < bottom.line:
                first, last = min(first, c.line), max(last, c.end_line)
        if top.line + 1 < first:
            yield top.line, top.column + 1, MESSAGES["leading"]
        if bottom.line - 1 > last:
            yield *here(bottom), MESSAGES["trailing"]


def tracecheck(s: Source, pattern: str = r"\w+\.Start(Span)?") -> Iterator[Hit]:
    """The name that a function gives its span must be its own in snake case."""
    for t, args, i in calls(s, pattern):
        f = next((f for f in s.functions if f.body and f.body[0] < i < f.body[1]), None)
        name = next((a[0].text.strip('"') for a in args if len(a) == 1 and a[0].kind == "str"), None)
        if f and name is not None:
            want = re.sub("_i_ds(_|$)", r"_ids\1", re.sub("([A-Z]+)([A-Z][a-z])", r"\1_\2", re.sub("([a-z0-9])([A-Z])", r"\1_\2", f.name)).lower())
            if want != name:
                yield *here(t), f"span name {name!r} should be {want!r}"


#: name -> rule; further keyword arguments are its settings.
GO_RULES: dict[str, Callable[..., Iterator[Hit]]] = {
    f.__name__: f
    for f in (
        gochecknoinits, gochecknoglobals, testpackage, importas, depguard, exptostd, predeclared, grouper, decorder, interfacebloat, inamedparam, containedctx, embeddedstructfieldcheck, tagliatelle, recvcheck, funcorder, errname, funlen, gocyclo, cyclop, gocognit, nestif, maintidx, nakedret, nonamedreturns, goprintffuncname,
        nilnil, paralleltest, testableexamples, thelper, usetesting, dogsled, copyloopvar, intrange, noinlineerr, nlreturn, forcetypeassert, errorlint, nilerr, makezero, usestdlibvars, noctx, perfsprint, nosprintfhostport, canonicalheader, gosmopolitan, reassign, misspell, godot, godoclint, gocheckcompilerdirectives, nolintlint,
        whitespace, tracecheck,
    )
}


# go.mod


def mod_lines(text: str) -> Iterator[tuple[int, str, str]]:
    """(line, directive, rest) of a go.mod file, blocks opened."""
    block = ""
    for k, raw in enumerate(text.split("\n"), 1):
        code = raw.split("//")[0].strip()
        if block:
            if code == ")":
                block = ""
            elif code:
                yield k, block, code
        elif m := re.match(r"(\w+)\s*\($", code):
            block = m[1]
        elif code:
            word, _, rest = code.partition(" ")
            yield k, word, rest.strip()


def gomoddirectives(file: str, text: str, replace_local: bool = False, replace_allow: tuple[str, ...] = (), exclude_forbidden: bool = False, retract_allow_no_explanation: bool = False, toolchain_forbidden: bool = False) -> Iterator[Hit]:
    raw = text.split("\n")
    for k, word, rest in mod_lines(text):
        if word == "replace":
            old, _, new = (x.strip() for x in rest.partition("=>"))
            if new.startswith(("./", "../", "/")):
                if not replace_local:
                    yield k, 1, f"local replacement are not allowed: {old.split()[0]}"
            elif old.split()[0] not in replace_allow:
                yield k, 1, f"replacement are not allowed: {old.split()[0]}"
        elif word == "retract" and not retract_allow_no_explanation and "//" not in raw[k - 1] and not (k > 1 and raw[k - 2].strip().startswith("//")):
            yield k, 1, "a comment is mandatory to explain why the version has been retracted"
        elif word == "exclude" and exclude_forbidden:
            yield k, 1, "exclude directive is not allowed"
        elif word == "toolchain" and toolchain_forbidden:
            yield k, 1, "toolchain directive is not allowed"


def version_key(v: str) -> tuple:
    return tuple(int(x) for x in re.findall(r"\d+", v.split("-")[0])[:3])


def gomodguard(file: str, text: str, blocked: dict[str, str] | None = None, allowed: tuple[str, ...] = (), versions: dict[str, str] | None = None) -> Iterator[Hit]:
    """``blocked``: module -> what to use instead; ``versions``: module -> constraint such as ``<= 1.2.0`` that blocks it."""
    for k, word, rest in mod_lines(text):
        if word != "require":
            continue
        module, version = (rest.split() + [""])[:2]
        if module in (blocked or {}):
            yield k, 1, f"import of package `{module}` is blocked because the module is in the blocked modules list. {blocked[module]}".rstrip()
        elif allowed and not any(module == a or module.startswith(a.rstrip("/") + "/") for a in allowed):
            yield k, 1, f"import of package `{module}` is blocked because the module is not in the allowed modules list."
        elif m := re.match(r"(<=|>=|<|>|=)\s*v?(\S+)", (versions or {}).get(module, "")):
            a, b = version_key(version), version_key(m[2])
            if {"<=": a <= b, ">=": a >= b, "<": a < b, ">": a > b, "=": a == b}[m[1]]:
                yield k, 1, f"import of package `{module}` is blocked because the module is in the blocked modules list. version `{version}` is blocked because it does not meet the version constraint `{versions[module]}`"


#: Rules of module scope: run once for each go.mod file.
MODULE_RULES: dict[str, Callable[..., Iterator[Hit]]] = {"gomoddirectives": gomoddirectives, "gomodguard": gomodguard}


# running


def hits(file: str, text: str, planned: dict[str, dict]) -> Iterator[tuple[str, str, str, int, int]]:
    """(linter, message, severity, line, column) of all planned rules on one file."""
    module = file.rsplit("/", 1)[-1] == "go.mod"
    source = None
    if not module:
        try:
            source = golex.read(file, text)
        except golex.Unreadable as e:
            yield "typecheck", str(e), "error", e.line, 0
            return
    for name, settings in planned.items():
        rule = (MODULE_RULES if module else GO_RULES).get(name)
        if rule is None:
            continue
        try:
            found = list(rule(file, text, **settings)) if module else list(rule(source, **settings))
            yield from ((name, message, "error", line, column) for line, column, message in found)
        except Exception as e:  # one rule's failure is a warning of its own
            yield name, f"rule failed: {type(e).__name__}: {e}", "warning", 1, 0


def findings(files: DataFrame, planned: dict[str, dict]) -> DataFrame:
    """Findings of the planned rules (name -> settings) on the .go and go.mod files among ``files`` (file, package, text)."""
    unknown = sorted(set(planned) - set(GO_RULES) - set(MODULE_RULES))
    if unknown:
        raise ValueError(f"no such rules: {', '.join(unknown)}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(n, m, sev, f, p, line, column) for f, p, t in zip(batch["file"], batch["package"], batch["text"], strict=True) for n, m, sev, line, column in hits(f, t or "", planned)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINDING.split(", ")])

    mine = files.where(F.col("file").rlike(r"(\.go|(^|/)go\.mod)$")).select("file", "package", "text")
    return mine.mapInPandas(run, FINDING)


SYMBOL = "file string, package string, name string, kind string, receiver string, line int, end_line int"


def declared(s: Source) -> Iterator[tuple[str, str, str, int, int]]:
    """(name, kind, receiver, line, end line) of the outermost declarations."""
    for d in s.declarations:
        if d.keyword == "type":
            kinds = {id(n): k for k in ("struct", "interface") for n, _, _ in types(s, k)}
            names = [s.tokens[a] for a, _ in (golex.specs_of(s.tokens, d.at + 2, d.end) if d.grouped else [(d.at + 1, d.end + 1)])]
            yield from ((n.text, kinds.get(id(n), "type"), "", n.line, s.tokens[d.end].end_line) for n in names)
        elif d.keyword in ("var", "const"):
            yield from ((n.text, d.keyword, "", n.line, n.line) for n in d.names)
    for f in s.functions:
        base = [t.text for t in f.receiver if t.kind == "name"]
        yield f.name, "method" if f.receiver else "func", base[-1] if base else "", f.line, f.end_line


def symbols(files: DataFrame) -> DataFrame:
    """The outermost declarations of Go files (file, package, text); files that can't be read have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, p, t in zip(batch["file"], batch["package"], batch["text"], strict=True):
                try:
                    rows += [(f, p, *x) for x in declared(golex.read(f, t or ""))]
                except golex.Unreadable:
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SYMBOL.split(", ")])

    return files.where(F.endswith("file", F.lit(".go"))).select("file", "package", "text").mapInPandas(run, SYMBOL)


TEST = "file string, package string, name string, kind string, line int"


def tests_in(s: Source) -> Iterator[tuple[str, str, int]]:
    """(name, kind, line) of tests, benchmarks, fuzz targets and examples, and of sub-tests that are run by a literal name."""
    from .dedup import unique_names

    for f in s.functions:
        kind = re.match("(Test|Benchmark|Fuzz|Example)([A-Z_0-9]|$)", f.name)
        if f.receiver or kind is None or not s.file.endswith("_test.go"):
            continue
        yield f.name, kind[1].lower(), f.line
        runs = [(s.tokens[i + 2], s.tokens[i]) for i in range(*f.body) if s.tokens[i] == "Run" and s.tokens[i - 1] == "." and s.tokens[i + 1] == "(" and s.tokens[i + 2].kind == "str"] if f.body else []
        for name, (_, t) in zip(unique_names([n.text[1:-1].replace(" ", "_") for n, _ in runs]), runs, strict=True):
            yield f"{f.name}/{name}", "subtest", t.line


def tests(files: DataFrame) -> DataFrame:
    """The index of tests of Go files (file, package, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f, p, t in zip(batch["file"], batch["package"], batch["text"], strict=True):
                try:
                    rows += [(f, p, *x) for x in tests_in(golex.read(f, t or ""))]
                except golex.Unreadable:
                    continue
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TEST.split(", ")])

    return files.where(F.endswith("file", F.lit("_test.go"))).select("file", "package", "text").mapInPandas(run, TEST)
