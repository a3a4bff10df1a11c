"""Path patterns: compiled on the driver to regular expressions that Spark evaluates."""

from __future__ import annotations

import posixpath
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders that a file listing leaves out.
SKIPPED_FOLDERS = (".git", ".idea", ".vscode", "node_modules", "testdata", "vendor")


def glob_regex(pattern: str) -> str:
    """``*``, ``?`` and ``[...]`` stay in a path element; ``**`` spans elements."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "(?:/.*)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = f"{out}[{'^' + body[1:] if body[0] in '!^' else body}]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    """A pattern without a slash is also tried on the last path element."""
    hit = path.rlike(glob_regex(pattern))
    return hit if "/" in pattern else hit | F.element_at(F.split(path, "/"), -1).rlike(glob_regex(pattern))


def targets(patterns: list[str]) -> list[tuple[str, bool]] | None:
    """(folder, recursive) of command-line targets; None if any of them means everything."""
    out = []
    for p in patterns:
        p = p.removeprefix("./")
        if p in ("...", "all"):
            return None
        deep = p.endswith("/...")
        out.append((p.removesuffix("/...").replace("\\", "/") or ".", deep))
    return out


def in_targets(path: Column, wanted: list[tuple[str, bool]] | None) -> Column:
    """Whether a file lies in one of the folders, or below it where it is recursive."""
    if not wanted:
        return F.lit(True)
    folder = F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")
    one = lambda d, deep: F.lit(True) if d in (".", "") and deep else ((folder == d) | (F.startswith(folder, F.lit(d + "/")) if deep else F.lit(False)))
    return reduce(lambda a, b: a | b, [one(d, deep) for d, deep in wanted])


def last_match(path: Column, rules: list[str]) -> Column:
    """Ordered rules ``+folder`` and ``-folder``; the last that matches decides, and without a match the path is in."""
    out = F.lit(True)
    for r in rules:
        body = r[1:].strip("/")
        hit = path.rlike(glob_regex(body)[:-1] + "(?:/|$)") if body else F.lit(True)
        out = F.when(hit, r[0] == "+").otherwise(out)
    return out


def go_files(path: Column) -> Column:
    """Whether a listed file is a source file outside the skipped folders."""
    skip = "|".join(re.escape(x) for x in SKIPPED_FOLDERS)
    return F.endswith(path, F.lit(".go")) & ~path.rlike(f"(^|/)({skip})/")


def absolute(path: str, root: str) -> str:
    """Cleaned and absolute; an empty path stays empty."""
    return "" if not path else posixpath.normpath(path if path.startswith("/") else posixpath.join(root, path))


def confined(path: str, top: str) -> str:
    """The real path of an output file, which must lie inside ``top`` with all links resolved."""
    import os

    real, base = os.path.realpath(os.path.join(top, path)), os.path.realpath(top)
    if real != base and not real.startswith(base + os.sep):
        raise ValueError(f"{path} is outside {top}")
    return real


def file_suffix_fits(name: str, goos: str, goarch: str, known_os: frozenset[str], known_arch: frozenset[str]) -> bool:
    """_<os>, _<arch> and _<os>_<arch> at the end of a file name must be the wanted ones."""
    parts = name.removesuffix(".go").removesuffix("_test").split("_")[1:]
    if len(parts) > 1 and parts[-2] in known_os and parts[-1] in known_arch:
        return parts[-2] == goos and parts[-1] == goarch
    if parts and parts[-1] in known_os:
        return parts[-1] == goos
    return not (parts and parts[-1] in known_arch) or parts[-1] == goarch


def tag_expression(text: str, tags: set[str]) -> bool:
    """A build constraint of tags, !, &&, || and brackets."""
    tokens = re.findall(r"\(|\)|&&|\|\||!|[\w.]+", text)
    at = 0

    def either() -> bool:
        nonlocal at
        value = both()
        while at < len(tokens) and tokens[at] == "||":
            at += 1
            value = both() or value
        return value

    def both() -> bool:
        nonlocal at
        value = single()
        while at < len(tokens) and tokens[at] == "&&":
            at += 1
            value = single() and value
        return value

    def single() -> bool:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"constraint ends early: {text}")
        t = tokens[at]
        at += 1
        if t == "!":
            return not single()
        if t == "(":
            value = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError(f"bracket isn't closed: {text}")
            at += 1
            return value
        return t in tags

    value = either()
    if at < len(tokens):
        raise ValueError(f"constraint goes on: {text}")
    return value


def absolute_column(path: Column, root: str) -> Column:
    """As :func:`absolute`, of a column."""
    whole = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    parts = F.aggregate(F.filter(F.split(whole, "/"), lambda x: ~x.isin("", ".")), F.array().cast("array<string>"), step)
    return F.when(path == "", "").otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))
