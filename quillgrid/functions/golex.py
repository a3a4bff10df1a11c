"""A light reading of Go source text: tokens, declarations and blocks, enough for rules that need no types.

One pass of a regular expression gives the tokens; brackets are matched with a stack; declarations are read from the
tokens at the outermost level. Text that doesn't scan, or whose brackets don't match, raises :class:`Unreadable`.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

OPENING, CLOSING = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
token_of = re.compile(
    r"""(?P<space>[ \t\r\n]+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<raw>`[^`]*`)|(?P<str>"(?:\\.|[^"\\\n])*")|(?P<char>'(?:\\.|[^'\\\n])+')"""
    r"""|(?P<num>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<name>[^\W\d]\w*)|(?P<op>&\^=|<<=|>>=|\.\.\.|:=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|[-+*/%&|^]=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])""",
    re.S,
).match


class Unreadable(ValueError):
    def __init__(self, line: int, message: str):
        super().__init__(message)
        self.line = line


@dataclass
class Token:
    kind: str
    text: str
    line: int
    column: int
    end_line: int
    pair: int = -1  # the bracket that this one matches

    def __eq__(self, other) -> bool:
        return self.text == other if isinstance(other, str) else self is other


@dataclass
class Function:
    name: str
    receiver: list[Token]
    params: list[Token]
    results: list[Token]
    at: int  # token index of "func"
    body: tuple[int, int] | None  # token indices of its braces
    line: int
    end_line: int


@dataclass
class Declaration:
    keyword: str
    line: int
    column: int
    grouped: bool
    names: list[Token]
    at: int
    end: int


@dataclass
class Source:
    file: str
    package: str = ""
    tokens: list[Token] = field(default_factory=list)
    comments: list[Token] = field(default_factory=list)
    imports: list[tuple[str, str, Token]] = field(default_factory=list)  # alias, path, token
    functions: list[Function] = field(default_factory=list)
    declarations: list[Declaration] = field(default_factory=list)
    blocks: list[tuple[int, int]] = field(default_factory=list)  # braces of statement blocks
    lines: list[str] = field(default_factory=list)


def scan(text: str) -> tuple[list[Token], list[Token]]:
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    tokens, comments, at = [], [], 0
    while at < len(text):
        m = token_of(text, at)
        line = bisect_right(starts, at)
        if m is None:
            raise Unreadable(line, f"unexpected {text[at]!r}")
        if m.lastgroup != "space":
            t = Token("str" if m.lastgroup == "raw" else m.lastgroup, m.group(), line, len(text[starts[line - 1] : at].encode()) + 1, bisect_right(starts, m.end() - 1))
            (comments if t.kind == "comment" else tokens).append(t)
        at = m.end()
    return tokens, comments


def matched(tokens: list[Token]) -> None:
    stack: list[int] = []
    for i, t in enumerate(tokens):
        if t.kind == "op" and t.text in OPENING:
            stack.append(i)
        elif t.kind == "op" and t.text in CLOSING:
            if not stack or OPENING[tokens[stack[-1]].text] != t.text:
                raise Unreadable(t.line, f"{t.text} closes nothing")
            j = stack.pop()
            t.pair, tokens[j].pair = j, i
    if stack:
        raise Unreadable(tokens[stack[-1]].line, f"{tokens[stack[-1]].text} isn't closed")


def signature(tokens: list[Token], i: int) -> tuple[list[Token], list[Token], list[Token], str, int]:
    """(receiver, params, results, name, index after them) of a function whose "func" stands at i."""
    i += 1
    receiver: list[Token] = []
    if i < len(tokens) and tokens[i] == "(" and tokens[i].pair + 1 < len(tokens) and tokens[tokens[i].pair + 1].kind == "name":
        receiver, i = tokens[i + 1 : tokens[i].pair], tokens[i].pair + 1
    name = ""
    if i < len(tokens) and tokens[i].kind == "name":
        name, i = tokens[i].text, i + 1
    if i < len(tokens) and tokens[i] == "[":
        i = tokens[i].pair + 1
    if i >= len(tokens) or tokens[i] != "(":
        return receiver, [], [], name, i
    params, i = tokens[i + 1 : tokens[i].pair], tokens[i].pair + 1
    begin = i
    if i < len(tokens) and tokens[i] == "(":
        i = tokens[i].pair + 1
    else:  # one result type, up to the body or the end of the line
        line = tokens[i - 1].line
        while i < len(tokens) and tokens[i].line == line and tokens[i].text not in ("{", ")", ",", ";", "}", "="):
            if tokens[i].text in ("struct", "interface") and i + 1 < len(tokens) and tokens[i + 1] == "{":
                i = tokens[i + 1].pair
                line = tokens[i].line
            elif tokens[i].text in OPENING:
                i = tokens[i].pair
            i += 1
    return receiver, params, tokens[begin:i], name, i


def fields(tokens: list[Token]) -> list[list[Token]]:
    """The comma-separated parts of a list of tokens."""
    out: list[list[Token]] = [[]]
    skip = 0
    for t in tokens:
        if skip == 0 and t == ",":
            out.append([])
            continue
        skip += (t.text in OPENING) - (t.text in CLOSING)
        out[-1].append(t)
    return [x for x in out if x]


def named(tokens: list[Token]) -> list[Token]:
    """Names of a parameter list; none if it has types only."""
    parts = fields(tokens)
    if not any(len(p) > 1 and p[0].kind == "name" and (p[1].kind == "name" or p[1].text in ("*", "[", "...", "(", "<-")) for p in parts):
        return []
    return [p[0] for p in parts if p[0].kind == "name"]


def text_of(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens)


def read(file: str, text: str) -> Source:
    tokens, comments = scan(text)
    matched(tokens)
    s = Source(file, tokens=tokens, comments=comments, lines=text.split("\n"))
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        if t == "package" and i + 1 < n:
            s.package, i = tokens[i + 1].text, i + 2
        elif t == "func":
            receiver, params, results, name, j = signature(tokens, i)
            body = (j, tokens[j].pair) if j < n and tokens[j] == "{" else None
            s.functions.append(Function(name, receiver, params, results, i, body, t.line, tokens[body[1]].line if body else t.line))
            i = body[1] + 1 if body else max(i + 1, j)
        elif t.text in ("import", "var", "const", "type"):
            grouped = i + 1 < n and tokens[i + 1] == "("
            end = tokens[i + 1].pair if grouped else spec_end(tokens, i + 1)
            specs = specs_of(tokens, i + 2, end) if grouped else [(i + 1, end + 1)]
            if t == "import":
                for a, b in specs:
                    path = next((x for x in tokens[a:b] if x.kind == "str"), None)
                    if path is not None:
                        s.imports.append((tokens[a].text if tokens[a] is not path else "", path.text[1:-1], path))
            names = [x for a, b in specs for x in spec_names(tokens[a:b])] if t != "import" else []
            s.declarations.append(Declaration(t.text, t.line, t.column, grouped, names, i, end))
            i = end + 1
        else:
            i = t.pair + 1 if t.text in OPENING else i + 1
    s.blocks = statement_blocks(tokens)
    return s


def spec_end(tokens: list[Token], i: int) -> int:
    """Index of the last token of a declaration that begins at i: it ends with its line, brackets apart."""
    while i < len(tokens):
        end = tokens[i].pair if tokens[i].text in OPENING else i
        if end + 1 >= len(tokens) or (tokens[end + 1].line > tokens[end].end_line and (tokens[end].kind != "op" or tokens[end].text in CLOSING)) or tokens[end + 1] == ";":
            return end
        i = end + 1
    return len(tokens) - 1


def specs_of(tokens: list[Token], i: int, end: int) -> list[tuple[int, int]]:
    out = []
    while i < end:
        j = min(spec_end(tokens, i), end - 1)
        out.append((i, j + 1))
        i = j + 1
        while i < end and tokens[i] == ";":
            i += 1
    return out


def spec_names(spec: list[Token]) -> list[Token]:
    out = []
    for k, t in enumerate(spec):
        if t.kind != "name":
            break
        out.append(t)
        if k + 1 >= len(spec) or spec[k + 1] != ",":
            break
    else:
        return out
    k = 0
    names = []
    while k < len(spec) and spec[k].kind == "name":
        names.append(spec[k])
        if k + 1 < len(spec) and spec[k + 1] == ",":
            k += 2
        else:
            break
    return names


def statement_blocks(tokens: list[Token]) -> list[tuple[int, int]]:
    """Braces of blocks of statements: of functions, if, else, for, switch, select, and blocks that stand alone."""
    out, heads = [], []  # heads: bracket depth at which a block is waited for
    depth = 0
    for i, t in enumerate(tokens):
        if t.kind == "name" and t.text in ("if", "for", "switch", "select", "else"):
            if not (t == "if" and i and tokens[i - 1] == "else"):
                heads.append(depth)
        elif t == "func" and t.kind == "name":
            _, _, _, _, j = signature(tokens, i)
            if j < len(tokens) and tokens[j] == "{":
                out.append((j, tokens[j].pair))
        elif t.kind == "op" and t.text in OPENING:
            if t == "{" and heads and heads[-1] == depth and not (i and tokens[i - 1].text in ("struct", "interface")) and not (i and tokens[i - 1] == "]"):
                heads.pop()
                out.append((i, t.pair))
            depth += 1
        elif t.kind == "op" and t.text in CLOSING:
            depth -= 1
            while heads and heads[-1] > depth:
                heads.pop()
    return sorted(set(out))


def statements(s: Source, block: tuple[int, int]) -> list[tuple[int, int]]:
    """(first, last) token indices of a block's statements; an if goes on through its else."""
    tokens, out, i = s.tokens, [], block[0] + 1
    while i < block[1]:
        if tokens[i].text in ("if", "for", "switch", "select"):
            j = i
            while True:
                inner = next(((a, b) for a, b in s.blocks if a > j and b < block[1]), None)
                if inner is None:
                    j = block[1] - 1
                    break
                j = inner[1]
                if j + 1 >= block[1] or tokens[j + 1] != "else":
                    break
        else:
            j = min(spec_end(tokens, i), block[1] - 1)
        out.append((i, j))
        i = j + 1
        while i < block[1] and tokens[i] == ";":
            i += 1
    return out
