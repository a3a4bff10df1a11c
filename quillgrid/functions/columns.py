"""Column expressions of the findings engine: all built-in functions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for each severity; any other word counts as an error.
SEVERITY_WORDS = {
    "error": ("error", "err", "high", "fatal"),
    "warning": ("warning", "warn", "medium"),
    "info": ("info", "note", "low", "hint"),
}
#: Findings under these names belong to govet.
GOVET_MEMBERS = tuple(
    "appends asmdecl assign atomic atomicalign bools buildtag cgocall composites copylocks deepequalerrors defers directive errorsas fieldalignment findcall framepointer hostport httpmux httpresponse ifaceassert loopclosure lostcancel nilfunc nilness printf reflectvaluecompare shadow shift sigchanyzer slog sortslice stdmethods stdversion stringintconv structtag testinggoroutine tests timeformat unmarshal unreachable unsafeptr unusedresult unusedwrite usesgenerics waitgroup".split()
)
STATICCHECK_PREFIXES = ("SA", "ST", "S1", "QF")
#: Style checks that are off unless checks are chosen by hand.
DEFAULT_DISABLED = ("ST1000", "ST1003", "ST1016", "ST1020", "ST1021", "ST1022")
STEM_BYTES = 80

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def severity_of(c: C) -> Column:
    """Any spelling of a severity -> error, warning or info."""
    word = F.lower(F.trim(col(c)))
    return F.when(word.isin(*SEVERITY_WORDS["warning"]), "warning").when(word.isin(*SEVERITY_WORDS["info"]), "info").otherwise("error")


def protocol_severity(code: C) -> Column:
    """Editor-protocol number (1 error, 2 warning, 3 information, 4 hint) -> severity."""
    return F.when(col(code) == 2, "warning").when(col(code).isin(3, 4), "info").otherwise("error")


def sanitised(c: C, allowed: tuple[str, ...], default: str) -> Column:
    """The severity if a format allows it, else the format's default."""
    return F.when(col(c).isin(*allowed), col(c)).otherwise(default)


def position(file: C = "file", line: C = "line", column: C = "column") -> Column:
    """file:line[:column], ``-`` for no file; column 0 is unknown and left out."""
    name = F.when(F.coalesce(col(file), F.lit("")) == "", "-").otherwise(col(file))
    return F.concat_ws(":", name, col(line).cast("string"), F.when(col(column) != 0, col(column).cast("string")))


def description(linter: C = "linter", message: C = "message") -> Column:
    return F.concat(col(linter), F.lit(": "), col(message))


def fingerprint(file: C = "file", message: C = "message", source_lines: C | None = "source_lines") -> Column:
    """Upper-case MD5 of file, message and the first source line."""
    first = F.lit("") if source_lines is None else F.coalesce(F.try_element_at(col(source_lines), F.lit(1)), F.lit(""))
    return F.upper(F.md5(F.concat(col(file), col(message), first)))


def message_stem(linter: C = "linter", message: C = "message") -> Column:
    """What is left of a message for pairing: trimmed, lower case, without its linter's name and end marks, cut at 80 bytes (a character that would be cut apart goes)."""
    trim = lambda c: F.regexp_replace(c, r"^[\s\x{85}]+|[\s\x{85}]+$", "")
    s = F.lower(trim(col(message)))
    prefix = F.concat(F.lower(col(linter)), F.lit(": "))
    s = F.when(F.startswith(s, prefix), F.substr(s, F.length(prefix) + 1)).otherwise(s)
    s = F.when(F.startswith(s, F.lit(": ")), F.substr(s, F.lit(3))).otherwise(s)
    s = F.regexp_replace(s, r"[.,;:!? \t\r\n]+$", "")
    cut = lambda n: F.substring(s.cast("binary"), 1, n).cast("string")
    whole = F.coalesce(*[F.when(F.is_valid_utf8(cut(n)), cut(n)) for n in range(STEM_BYTES, STEM_BYTES - 4, -1)])
    return F.when(F.octet_length(s) <= STEM_BYTES, s).otherwise(whole)


def human_bytes(n: C, units: str = "KMGTPE") -> Column:
    """1024-based units, one decimal from K on; what is beyond the last unit is still given in it. Integers or decimals without a fraction."""
    n = col(n)
    out = F.when(n.isNull(), F.lit(None).cast("string")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units, 1):
        text = F.concat(F.format_string("%.1f", F.bround(n.cast("double") / float(1024**k), 1)), F.lit(unit))
        out = out.when(n < 1024 ** (k + 1), text) if k < len(units) else out.otherwise(text)
    return out


def family(linter: C = "linter") -> Column:
    """The umbrella name of a check: staticcheck for its id prefixes, govet for its members, else the name itself."""
    name = col(linter)
    static = reduce(lambda a, b: a | b, [F.startswith(name, F.lit(p)) for p in STATICCHECK_PREFIXES])
    return F.when(static, "staticcheck").when(name.isin(*GOVET_MEMBERS), "govet").otherwise(name)


def selects(names: C, linter: C = "linter") -> Column:
    """Whether an array of names holds the linter or its family."""
    return F.array_contains(col(names), col(linter)) | F.array_contains(col(names), family(linter))


def canonical_path(package: C, file: C = "file") -> Column:
    """<package>/<base name>; without a package the path as it is."""
    base = F.element_at(F.split(col(file), "/"), -1)
    return F.when(F.coalesce(col(package), F.lit("")) == "", col(file)).otherwise(F.concat(col(package), F.lit("/"), base))


def relative_path(base: str, file: C = "file") -> Column:
    """Below ``base`` the rest of the path; another path as it is. Always forward slashes."""
    p = F.replace(col(file), F.lit("\\"), F.lit("/"))
    root = base.rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(root)), F.substr(p, F.lit(len(root) + 1))).otherwise(p)


def csv_items(c: C) -> Column:
    """A comma list: trimmed, empty items dropped."""
    return F.filter(F.transform(F.split(col(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def expanded_length(line: C, tab_width: int = 1) -> Column:
    """Code points of a line with its tabs expanded."""
    return F.char_length(F.replace(col(line), F.lit("\t"), F.lit(" " * tab_width)))


def repeated_neighbours(line: C) -> Column:
    """How many tokens (between single spaces) equal the token before them; empty tokens don't count."""
    w = F.split(col(line), " ", -1)
    same = F.zip_with(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), w, lambda b, a: (a == b) & (b != ""))
    return F.size(F.filter(same, lambda x: x))


def framed(*parts: C) -> Column:
    """Parts with their lengths in bytes, so that no two lists of parts give the same text."""
    return F.concat(*[F.concat(F.octet_length(F.coalesce(col(p), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(col(p), F.lit(""))) for p in parts])


def tagged(tag: str, value: C) -> Column:
    return F.concat(F.lit(f"{tag}:"), F.octet_length(col(value)).cast("string"), F.lit(":"), col(value))


def digest(*parts: C) -> Column:
    return F.sha2(framed(*parts), 256)


def shard_path(key: C) -> Column:
    """<first two hex digits>/<key>."""
    return F.concat(F.substring(col(key), 1, 2), F.lit("/"), col(key))


def is_digest(key: C) -> Column:
    return col(key).rlike("^[0-9a-fA-F]{64}$")


def namespaced_key(namespace: C, key: C) -> Column:
    return F.sha2(F.concat(col(namespace), F.lit("\u0000"), col(key)), 256)


def xml_escaped(c: C) -> Column:
    """As Go's encoder writes attributes and text."""
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;"), ("\t", "&#x9;"), ("\n", "&#xA;"), ("\r", "&#xD;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def json_string(c: C) -> Column:
    """A JSON string with <, > and & escaped."""
    whole = F.to_json(F.struct(col(c).alias("v")))  # {"v":"..."}
    out = F.substr(whole, F.lit(6), F.length(whole) - 6)
    for a, b in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def teamcity_escaped(c: C, limit: int) -> Column:
    """Service-message escapes; cut at ``limit`` units, of which an escape takes two and is never cut apart."""
    marks = {"'": "|'", "\n": "|n", "\r": "|r", "|": "||", "[": "|[", "]": "|]"}
    escape = F.create_map(*[F.lit(x) for kv in marks.items() for x in kv])
    chars = F.filter(F.split(col(c), ""), lambda x: x != "")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def add(acc: Column, ch: Column) -> Column:
        piece = F.coalesce(escape[ch], ch)
        used = acc["used"] + F.when(escape[ch].isNotNull(), 2).otherwise(1)
        fits = used <= limit
        # what doesn't fit ends the text: later characters find it full
        return F.struct(F.when(fits, F.concat(acc["text"], piece)).otherwise(acc["text"]).alias("text"), F.when(fits, used).otherwise(limit).alias("used"))

    whole = reduce(lambda s, kv: F.replace(s, F.lit(kv[0]), F.lit(kv[1])), [("|", "||")] + [(a, b) for a, b in marks.items() if a != "|"], col(c))
    return F.when(F.char_length(whole) <= limit, whole).otherwise(F.aggregate(chars, start, add)["text"])


def error_parts(c: C) -> Column:
    """file:line:column: message -> struct; line and column may be missing."""
    pattern = r"^(.*?)(?::(\d+))?(?::(\d+))?(?:: (.*))?$"
    part = lambda i: F.regexp_extract(col(c), pattern, i)
    number = lambda i: F.when(part(i) != "", part(i).cast("int"))
    return F.struct(part(1).alias("file"), number(2).alias("line"), number(3).alias("column"), part(4).alias("message"))


def directive(comment: C) -> Column:
    """The suppression directive of a comment: struct of found, malformed and linters (empty: all), null if there is none.

    ``//nolint``, ``// nolint:a,b // why`` and ``/* nolint:all */`` are directives; a colon without names is malformed.
    """
    text = col(comment)
    body = F.when(F.startswith(text, F.lit("//")), F.regexp_replace(F.substr(text, F.lit(3)), r"^[ \t]+", "")).when(
        text.rlike(r"^/\*[\s\S]*\*/$"), F.regexp_replace(F.substr(text, F.lit(3), F.length(text) - 4), r"^\s+|\s+$", "")
    )
    rest = F.regexp_replace(F.regexp_replace(F.substr(body, F.lit(7)), r"//[\s\S]*$", ""), r"^\s+|\s+$", "")
    names = F.transform(F.split(F.substr(rest, F.lit(2)), ",", -1), lambda x: F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")))
    whole = F.lower(F.regexp_replace(F.substr(rest, F.lit(2)), r"^\s+|\s+$", ""))
    listed = F.startswith(rest, F.lit(":"))
    malformed = ~((rest == "") | (listed & (whole != "") & ~F.exists(names, lambda x: x == "")))
    linters = F.when(listed & (whole != "all") & ~malformed, names).otherwise(F.array().cast("array<string>"))
    found = body.rlike(r"(?i)^nolint([ \t:]|$)")
    return F.when(found, F.struct(malformed.alias("malformed"), linters.alias("linters")))


def release_tags(minor: C) -> Column:
    """1.N -> go1.1 to go1.N."""
    return F.transform(F.sequence(F.lit(1), col(minor)), lambda i: F.concat(F.lit("go1."), i.cast("string")))


def strict_generated(text: C) -> Column:
    return col(text).rlike(r"(?m)^// Code generated .* DO NOT EDIT\.$")


#: Lower-cased marks of generated files.
LAX_MARKS = ("code generated", "do not edit", "autogenerated file", "* generated by: swagger codegen ")


def lax_generated(comments: C) -> Column:
    low = F.lower(col(comments))
    return reduce(lambda a, b: a | b, [F.instr(low, m) > 0 for m in LAX_MARKS])


#: What third-party code writes to its log.
NOISE = ("new node, remapping ", "deduplicating ")


def is_noise(line: C) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(col(line), F.lit(p)) for p in NOISE])


def version_skew(linter: C = "linter", message: C = "message") -> Column:
    return (col(linter) == "noctx") & F.startswith(col(message), F.lit("net/http/httptest.NewRequest must not be called"))


def import_visible(importer: C, imported: C) -> Column:
    """Whether a path below an ``internal`` element may be imported from here."""
    parent = F.regexp_extract(col(imported), r"^(.*)/internal(?:/|$)", 1)
    return ~col(imported).rlike(r"/internal(/|$)") | (col(importer) == parent) | F.startswith(col(importer), F.concat(parent, F.lit("/")))


def has_prefix(path: C, prefix: C) -> Column:
    """Whole path elements."""
    return (col(path) == col(prefix)) | F.startswith(col(path), F.concat(col(prefix), F.lit("/")))


def imports_c(text: C) -> Column:
    """Whether a source file imports the C pseudo package."""
    return col(text).rlike(r'(?m)^\s*import\s+"C"')


def from_editor(line0: C = "line", column0: C = "column") -> tuple[Column, Column]:
    """Editor positions count from 0, findings from 1."""
    return (col(line0) + 1).alias("line"), (col(column0) + 1).alias("column")


def snake_case(name: C) -> Column:
    """fooBarIDs -> foo_bar_ids."""
    parts = F.regexp_replace(F.regexp_replace(col(name), "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.regexp_replace(F.lower(parts), "_i_ds(_|$)", "_ids$1")


def place_of(text: C, offset: C) -> Column:
    """(line, column) from 1 of a byte offset at a character's start; columns count bytes."""
    head = F.substr(col(text).cast("binary"), F.lit(1), col(offset)).cast("string")
    return F.struct((F.regexp_count(head, F.lit("\n")) + 1).alias("line"), (F.octet_length(F.substring_index(head, "\n", -1)) + 1).alias("column"))


def explanation(comment: C) -> Column:
    """What stands behind a second // of a suppression directive, trimmed; "" if there is nothing."""
    return F.trim(F.regexp_extract(F.regexp_replace(col(comment), r"^(//|/\*)", ""), r"//([\s\S]*)$", 1))


def span_mismatch(function: C, span: C) -> Column:
    """Whether a span isn't named like its function."""
    return snake_case(function) != col(span)


#: Seconds of a unit of durations.
UNIT_SECONDS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def duration_seconds(text: C) -> Column:
    """Seconds of a duration such as -1h2m3.5s; null if it is none."""
    units = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    body = F.regexp_replace(col(text), "^[+-]", "")
    pieces = F.regexp_extract_all(body, F.lit(r"((?:\d+\.?\d*|\.\d+)(?:h|ms|us|µs|ns|m|s))"), F.lit(1))
    value = lambda p: F.regexp_extract(p, r"^([\d.]+)", 1).cast("double") * units[F.regexp_extract(p, r"([a-zµ]+)$", 1)]
    total = F.aggregate(F.transform(pieces, value), F.lit(0.0), lambda a, x: a + x)
    sign = F.when(F.startswith(col(text), F.lit("-")), -1.0).otherwise(1.0)
    return F.when(col(text).isin("", "0"), 0.0).when((F.size(pieces) > 0) & (F.array_join(pieces, "") == body), sign * total)


def first_or(a: C, default: C) -> Column:
    """The first element of an array, or the default of an empty one."""
    return F.coalesce(F.get(col(a), 0), col(default))


def every(a: C, holds) -> Column:
    return F.forall(col(a), holds)


def some(a: C, holds) -> Column:
    return F.exists(col(a), holds)


def is_empty(a: C) -> Column:
    return F.size(col(a)) == 0


def any_entry(m: C) -> Column:
    """The entry of a map's smallest key, null for an empty one: an arbitrary one, but always the same."""
    return F.get(F.array_sort(F.map_entries(col(m))), 0)


def without_keys(m: C, gone) -> Column:
    """A map without the entries whose key and value ``gone`` holds for."""
    return F.map_filter(col(m), lambda k, v: ~gone(k, v))
