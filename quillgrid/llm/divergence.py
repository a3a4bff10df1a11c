"""Operator 1: quality rules by distribution divergence.

Each document's histogram of character classes, and its histogram of common words, are compared with references of
every language by the Jensen-Shannon distance (base 2, square root, 0 to 1); the nearest language counts. References
are counted over all documents that have a language, as sums that don't depend on the partitioning: for each
character class how many documents have which share of it (in STEPS steps of the share's root), of which the median
is the reference, so that a minority of odd documents doesn't bend it; and the common words, those that make at least
COMMON of a language's words (lower-cased, without marks at their ends), of which each is a cell and the rest is one more.

Words are counted in two passes. In the first, a task hands on the words that make at least SEEN of those it has counted
for a language since it last did so, which finds all words that may be common: the share of one is at most SEEN too low.
In the second, these are counted again, all of them, so that the references don't depend on how rows are dealt. What is
shuffled has a bound of 1 / SEEN words for each language and task, what the driver gets one of 1 / (COMMON - SEEN) for
each language.

A document with too few characters or words to have a shape is not judged by that histogram (minimum-length guards),
and the thresholds give way by a slack over sqrt(n) for short ones.

Defined results: a null or empty text has no words, so it fails the base rule. Documents without a language count
for no reference but are judged. Without any reference the base rule alone decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, bounded_batches, ensure_checkpoint_dir, fresh_name, struct_udf, with_struct, words_of

CLASSES = ("lower", "upper", "digit", "space", "line end", "sentence mark", "quote or bracket", "exclamation mark", "symbol", "beyond ASCII lower", "beyond ASCII other")
STEPS = 250
CELLS = len(CLASSES) * (STEPS + 1)
#: Share of a language's words from which a word is common, and from which a task tells it.
COMMON, SEEN = 0.002, 0.0001
#: Distinct words of a language that a task counts before it hands them on.
DISTINCT = 50_000
MARKS = ".,;:!?"
#: Languages whose counts a task holds at once; with more it hands them on.
HELD = 100
MIN_CHARS, MIN_WORDS = 40, 30
CHAR_LIMIT, WORD_LIMIT, CHAR_SLACK, WORD_SLACK = 0.12, 0.42, 2.0, 0.5
WINDOW = 5


def class_table() -> np.ndarray:
    out = np.full(0x250, 10, np.uint8)
    for c in range(0x250):
        ch = chr(c)
        if c < 128:
            out[c] = 0 if ch.islower() else 1 if ch.isupper() else 2 if ch.isdigit() else 4 if ch == "\n" else 3 if ch in " \t\r\x0b\x0c" else 5 if ch in ".,;:?-" else 6 if ch in "'\"()[]{}" else 7 if ch == "!" else 8
        elif ch.islower():
            out[c] = 9
    return out


TABLE = class_table()
symbols_of = re.compile(r"[#*$%&|<>]").findall


def class_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(TABLE[np.minimum(codes, len(TABLE) - 1)], minlength=len(CLASSES))


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text, the first included. Exact: windows are ranked, not hashed."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    rank, width = codes, 1
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ codes[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h.sort()
    if not (h[1:] == h[:-1]).any():  # a cheap proof that no window occurs twice: equal windows have equal hashes
        return 0
    while width < window:
        step = min(width, window - width)
        a, b = rank[: len(rank) - step], rank[step:]
        _, rank = np.unique(a * np.int64(len(words) + 1) + b, return_inverse=True)
        width += step
    seen = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(seen)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


@dataclass
class References:
    languages: list[str]
    chars: np.ndarray  # languages x classes, shares
    cells: dict[str, int]  # common word -> cell; the last cell is for the rest
    words: np.ndarray  # languages x cells, shares


def step_cells(text: str) -> np.ndarray:
    """For each class the cell of its share, in a table of len(CLASSES) rows of STEPS + 1."""
    c = class_counts(text)
    return np.arange(len(CLASSES)) * (STEPS + 1) + np.round(np.sqrt(c / max(1, c.sum())) * STEPS).astype(int)


def medians(steps: np.ndarray) -> np.ndarray:
    """Shares of the classes from a table of documents by class and step."""
    sums = np.cumsum(steps.reshape(len(CLASSES), STEPS + 1), axis=1)
    shares = ((sums < (sums[:, -1:] + 1) // 2).sum(1) / STEPS) ** 2
    return shares / max(1e-12, shares.sum())


def references_of(chars: dict[str, np.ndarray], totals: dict[str, int], counts: list[tuple[str, str, int]]) -> References:
    """Of each language its class shares and its words in all, and (language, word, number) of words that are common in some language."""
    languages = sorted(chars)
    place = {x: i for i, x in enumerate(languages)}
    cells = {w: i for i, w in enumerate(sorted({w for _, w, _ in counts}))}
    words = np.zeros((len(languages), len(cells) + 1))
    for x, w, n in counts:
        words[place[x], cells[w]] = n / totals[x]
    words[:, -1] = np.maximum(0, 1 - words[:, :-1].sum(1))
    return References(languages, np.array([chars[x] for x in languages]).reshape(len(languages), len(CLASSES)), cells, words)


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> References:
    """Counts over all documents and labels; the driver gets of each label its class medians and the numbers of common words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null and text is not null")

    def told(x: str, words: list, cells: list, n: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array([x] * len(n), pa.string()), "word": pa.array(words, pa.string()), "cell": pa.array(cells, pa.int32()), "n": pa.array(n, pa.int64())})

    def counts_of(wanted: frozenset[str] | None) -> DataFrame:
        """(lang, word, cell, n): without wanted words the often seen ones, all words as "", and the steps of the classes; else the wanted ones."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chars = defaultdict(lambda: np.zeros(CELLS, np.int64))
            counters: dict[str, Counter] = defaultdict(Counter)

            def words_told(x: str) -> pa.RecordBatch:
                stripped: Counter = Counter()
                for w, n in counters.pop(x).items():
                    stripped[w.strip(MARKS)] += n
                if wanted is not None:
                    some = [(w, n) for w, n in stripped.items() if w in wanted]
                else:
                    total = stripped.total()
                    some = [("", total), *((w, n) for w, n in stripped.items() if w and n >= SEEN * total)]
                return told(x, [w for w, _ in some], [None] * len(some), [n for _, n in some])

            def handed() -> Iterator[pa.RecordBatch]:
                for x in list(counters):
                    yield words_told(x)
                for x, steps in chars.items():
                    at = np.flatnonzero(steps)
                    yield told(x, [None] * len(at), at.tolist(), steps[at].tolist())
                chars.clear()

            for whole in batches:
                for k in range(0, whole.num_rows, SLICE):
                    b = whole.slice(k, SLICE)
                    if len(counters) > HELD:
                        yield from handed()
                    for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        if wanted is None:
                            chars[x][step_cells(t)] += 1
                        c = counters[x]
                        c.update(words_of(t.lower()))
                        if len(c) > DISTINCT:
                            yield words_told(x)
            yield from handed()

        return rows.mapInArrow(run, "lang string, word string, cell int, n long").groupBy("lang", "word", "cell").agg(F.sum("n").alias("n"))

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                steps = np.zeros(CELLS)
                steps[r["cells"]] = r["ns"]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([r["lang"]], pa.string()), "chars": pa.array([medians(steps).tolist()])})

    ensure_checkpoint_dir(spark)
    bounded_batches(spark)
    sums = counts_of(None).checkpoint()
    packed = sums.where("cell is not null").groupBy("lang").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("ns"))  # CELLS entries at most
    chars = {r["lang"]: np.array(r["chars"]) for r in packed.mapInArrow(shapes, "lang string, chars array<double>").collect()}
    totals = sums.where("word = ''").select("lang", F.col("n").alias("total"))
    total = {r["lang"]: r["total"] for r in totals.collect()}
    maybe = sums.where("word <> ''").join(totals, "lang").where(F.col("n") >= (COMMON - SEEN) * F.col("total")).select("word").distinct()
    found = [(r["lang"], r["word"], r["n"]) for r in counts_of(frozenset(r["word"] for r in maybe.collect())).collect()] if total else []
    common = {w for x, w, n in found if n >= COMMON * total[x]}
    return references_of(chars, total, [r for r in found if r[1] in common])


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of a distribution to each row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(0, (a + b) / 2))


class Rules:
    def __init__(self, r: References):
        self.r = r

    def __call__(self, text: str | None) -> tuple:
        text = text or ""
        words = words_of(text)
        n = len(words)
        lines = [x for x in text.split("\n") if words_of(x[:200]) or words_of(x)]
        repeats = repeat_words(words)
        failed = n < 10 or 100 * repeats > 20 * n
        char_js = word_js = None
        if len(text) >= MIN_CHARS and self.r.languages:
            c = class_counts(text)
            char_js = float(distances(c / c.sum(), self.r.chars).min())
        if n >= MIN_WORDS and self.r.languages:
            counts, rest = Counter(words_of(text.lower())), len(self.r.cells)
            find = self.r.cells.get
            c = np.bincount([find(w.strip(MARKS), rest) for w in counts], list(counts.values()), rest + 1)
            word_js = float(distances(c / c.sum(), self.r.words).min())
        kept = not failed and (char_js is None or char_js <= CHAR_LIMIT + CHAR_SLACK / np.sqrt(len(text))) and (word_js is None or word_js <= WORD_LIMIT + WORD_SLACK / np.sqrt(n))
        return n, sum(map(len, words)), len(symbols_of(text)), len(lines) - len(set(lines)), repeats, failed, bool(kept), char_js, word_js


FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("char_distance", "double"), ("word_distance", "double")]


def with_verdict(docs: DataFrame, refs: References, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of FIELDS; also the struct's name. Other columns stay as they are."""

    def setup() -> Callable:
        return Rules(refs)

    name = fresh_name(docs, "rules")
    return with_struct(docs, struct_udf(setup, FIELDS), text, name), name
