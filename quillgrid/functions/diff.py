"""Line differences, edits and merges. Irregular by nature, so plain Python, run for each file in a pandas UDF."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Edit = tuple[int, int, str]  # start, end, new text; offsets into the text


def common_runs(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the runs of a longest common subsequence, in order.

    Greedy by the number of differences d: for each diagonal the furthest point that d differences reach, of which the
    way back is kept; equal heads and tails are set aside first. Time and memory grow with length times differences.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    far, trace = {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(far))
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
            while x < n and x - k < m and a[head + x] == b[head + x - k]:
                x += 1
            far[k] = x
            if x >= n and x - k >= m:
                break
        else:
            continue
        break
    pairs, x, y = [], n, m
    for d in range(len(trace) - 1, -1, -1):
        k, old = x - y, trace[d]
        before = k + 1 if k == -d or (k != d and old[k - 1] < old[k + 1]) else k - 1
        x0 = old[before] if d else 0
        y0 = x0 - before if d else 0
        while x > x0 and y > y0:
            x, y = x - 1, y - 1
            pairs.append((x, y))
        if d:
            x, y = x0, y0
    same = [(i, i) for i in range(head)] + [(head + x, head + y) for x, y in reversed(pairs)] + [(len(a) - i, len(b) - i) for i in range(tail, 0, -1)]
    runs: list[list[int]] = []
    for i, j in same:
        if runs and i == runs[-1][0] + runs[-1][2] and j == runs[-1][1] + runs[-1][2]:
            runs[-1][2] += 1
        else:
            runs.append([i, j, 1])
    return [tuple(r) for r in runs]


def changes(a: Sequence, b: Sequence) -> list[tuple[int, int, int, int]]:
    """(from, to in a, from, to in b) of what lies between the common runs."""
    out, i, j = [], 0, 0
    for x, y, n in [*common_runs(a, b), (len(a), len(b), 0)]:
        if x > i or y > j:
            out.append((i, x, j, y))
        i, j = x + n, y + n
    return out


def line_edits(before: str, after: str) -> list[Edit]:
    """The fewest edits of whole lines that turn one text into the other."""
    a, b = before.splitlines(keepends=True), after.splitlines(keepends=True)
    at = [0]
    for x in a:
        at.append(at[-1] + len(x))
    return [(at[i], at[j], "".join(b[k:l])) for i, j, k, l in changes(a, b)]


def text_edits(before: str, after: str) -> list[Edit]:
    return [(i, j, after[k:l]) for i, j, k, l in changes(before, after)]


def apply_edits(text: str, edits: list[Edit]) -> str:
    """Edits must be in bounds and must not overlap."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: e[:2]):
        if start < at or end < start or end > len(text):
            raise ValueError(f"edit {start}-{end} overlaps or is out of bounds")
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def unified(name: str, before: str, after: str, context: int = 3) -> str:
    """Hunks with so many lines around the changes; changes at most twice that apart share a hunk. "" without changes."""
    a, b = before.splitlines(keepends=True), after.splitlines(keepends=True)
    groups: list[list[tuple[int, int, int, int]]] = []
    for c in changes(a, b):
        if groups and c[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = [f"--- {name}\n+++ {name}\n"] if groups else []
    count = lambda start, n: f"{start + (n > 0)}" + (f",{n}" if n != 1 else "")
    for g in groups:
        lo, hi = max(0, g[0][0] - context), min(len(a), g[-1][1] + context)
        start = g[0][2] - (g[0][0] - lo)
        stop = g[-1][3] + (hi - g[-1][1])
        out.append(f"@@ -{count(lo, hi - lo)} +{count(start, stop - start)} @@\n")
        at = lo
        for i, j, k, l in g:
            out += [" " + x for x in a[at:i]] + ["-" + x for x in a[i:j]] + ["+" + x for x in b[k:l]]
            at = j
        out += [" " + x for x in a[at:hi]]
    return "".join(out)


def apply_unified(before: str, patch: str) -> str:
    """Replays the hunks of a unified difference."""
    import re

    a, out, at = before.splitlines(keepends=True), [], 0
    for line in patch.splitlines(keepends=True)[2:]:
        if m := re.match(r"@@ -(\d+)(?:,(\d+))? ", line):
            start = int(m[1]) - (m[2] != "0")
            out += a[at:start]
            at = start
        elif line[0] in " -":
            if at >= len(a) or a[at] != line[1:]:
                raise ValueError(f"line {at + 1} is not what the hunk expects")
            at += 1
            if line[0] == " ":
                out.append(line[1:])
        elif line[0] == "+":
            out.append(line[1:])
    return "".join(out + a[at:])


def whole_lines(text: str, edits: list[Edit]) -> list[Edit]:
    """The same change as edits that replace whole lines; those that touch the same lines are one."""
    groups: list[tuple[int, int, list[Edit]]] = []
    for e in sorted(edits, key=lambda e: e[:2]):
        lo = text.rfind("\n", 0, e[0]) + 1
        hi = e[1] if e[1] > lo and text[e[1] - 1] == "\n" else (text.find("\n", e[1]) + 1 or len(text))
        if groups and lo < groups[-1][1]:
            start, end, held = groups.pop()
            groups.append((start, max(end, hi), [*held, e]))
        else:
            groups.append((lo, hi, [e]))
    return [(lo, hi, apply_edits(text[lo:hi], [(s - lo, t - lo, new) for s, t, new in held])) for lo, hi, held in groups]


def merged_edits(x: list[Edit], y: list[Edit]) -> list[Edit] | None:
    """Both lists' edits in order, equal ones once; None if they conflict.

    Of insertions at one point the first list's come first. An edit that reaches into another one's text is split: what
    lies before it is deleted, the rest is tried again. Two unequal edits that begin at the same point are a conflict.
    """
    left, right, out = list(sorted(x, key=lambda e: e[:2]))[::-1], list(sorted(y, key=lambda e: e[:2]))[::-1], []
    while left and right:
        a, b = left[-1], right[-1]
        if a == b:
            out.append(a)
            left.pop()
            right.pop()
        elif a[1] <= b[0]:
            out.append(left.pop())
        elif b[1] <= a[0]:
            out.append(right.pop())
        elif a[0] == b[0]:
            return None
        else:
            first, other = (left, b) if a[0] < b[0] else (right, a)
            start, end, new = first[-1]
            out.append((start, other[0], ""))
            first[-1] = other[0], end, new
    return out + left[::-1] + right[::-1]


def unified_column(name: Column, before: Column, after: Column) -> Column:
    """The unified difference of two text columns."""

    def run(names: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([unified(*x) for x in zip(names, a, b, strict=True)])

    return F.pandas_udf(run, "string")(name, before, after)


def fixed(text: str, fixes: list[list[Edit]]) -> tuple[str, int]:
    """The text after each fix in order that doesn't conflict with those before it, and how many did."""
    edits: list[Edit] = []
    conflicts = 0
    for f in fixes:
        both = merged_edits(edits, f)
        if both is None:
            conflicts += 1
        else:
            edits = both
    return apply_edits(text, edits), conflicts


def position_of(text: str, offset: int) -> tuple[int, int, int]:
    """(line, byte column, UTF-16 column) from 1, 1 and 0 of a byte offset."""
    head = text.encode()[:offset].decode(errors="ignore")
    last = head.rsplit("\n", 1)[-1]
    return head.count("\n") + 1, len(last.encode()) + 1, len(last.encode("utf-16-le")) // 2
