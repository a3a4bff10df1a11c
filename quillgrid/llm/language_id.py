"""Operator 3: language identification, word first, backing off to shorter and shorter character n-grams.

A known word scores by its log frequency in each language. An unseen word is cut greedily: at each position the
longest known n-gram, of at most NGRAM letters and marked where the word begins and ends, scores by its log
frequency, and the next cut begins after it; the word's score is the mean over its cuts. A text's score in a
language is the mean over its words. Words are runs of letters (Unicode category L), lower-cased.

The model is fitted on a bounded sample of labelled rows: about SAMPLE documents, shared evenly by all labels, of each
label at least LEAST_DOCUMENTS or all it has, drawn by a hash of id and text. Words and n-grams are counted where the
texts lie; the driver gets of each label the VOCABULARY most frequent words and the GRAMS most frequent n-grams (of
equal ones the smaller), and their counts in the other labels. Fitting and scoring read whole texts; words of more than
MOST_LETTERS letters are not learned. The model holds what differs from half an occurrence only, so that a label costs
as much as its own words.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Rows whose label, text or fold is null
are not learned from. With no labelled row at all every text is ``und``. Of languages that score the same the smaller
name is predicted. Repeated rows are learned from as often as they stand there.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, bounded_batches, ensure_checkpoint_dir, fresh_name, struct_udf, with_struct
from .graph import release

UNKNOWN = "und"
SAMPLE = 6000
LEAST_DOCUMENTS = 20
NGRAM = 5
#: Of each language.
VOCABULARY = 40_000
GRAMS = 60_000
#: Occurrences of a word, of an n-gram, from which a language may make it known.
LEAST = (3, 2)
MOST_LETTERS = 200
#: Words from which a mean score counts as sure as it will.
SURE = 12
#: Words, and their languages, that a task remembers.
MEMO, MEMO_ENTRIES = 120_000, 4_000_000
#: Entries up to which the n-grams' table is unpacked, with a row of all languages for each.
UNPACKED = 4_000_000
#: Counts that a task of the fit holds at once.
HELD = 300_000


def no_letters() -> str:
    """Ranges of the characters that Python's \\w holds beside letters, decimal digits and the underscore: other numerals."""
    odd = [c for c in range(sys.maxunicode + 1) if chr(c).isalnum() and not chr(c).isdecimal() and unicodedata.category(chr(c))[0] != "L"]
    held = set(odd)
    lows, highs = [c for c in odd if c - 1 not in held], [c for c in odd if c + 1 not in held]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(lows, highs, strict=True))


nearly_letters = re.compile(r"[^\W\d_]+").findall
other_numeral = re.compile(f"[{no_letters()}]").search
only_letters = re.compile(rf"[^\W\d_{no_letters()}]+").findall


def letters_of(text: str) -> list[str]:
    """The runs of letters."""
    return only_letters(text) if other_numeral(text) else nearly_letters(text)


def letter_counts(text: str) -> Counter:
    """As letters_of, counted; the short class, which is much quicker, does where none of its words holds another numeral."""
    found = Counter(nearly_letters(text))
    return Counter(only_letters(text)) if other_numeral("".join(found)) else found


@dataclass
class Entries:
    """Known words or n-grams: of the k-th key, languages at[start[k]:start[k + 1]] and by how much its log frequency there is over that of half an occurrence."""

    keys: list[str]
    start: np.ndarray
    at: np.ndarray
    over: np.ndarray
    none: np.ndarray  # of each language, the log frequency of half an occurrence


@dataclass
class Model:
    languages: list[str]
    words: Entries
    grams: Entries


def grams_of(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + n] for n in range(1, NGRAM + 1) for i in range(len(w) - n + 1)]


def gram_counts(words: Counter) -> Counter:
    out: Counter = Counter()
    for w, n in words.items():
        for g in grams_of(w):
            out[g] += n
    return out


def entries(languages: list[str], totals: dict[str, int], counts: list[tuple[str, str, int]]) -> Entries:
    """From (key, language, occurrences) of all known keys; log frequencies add half an occurrence everywhere."""
    place = {x: i for i, x in enumerate(languages)}
    rows = sorted((k, place[x], n) for k, x, n in counts)
    keys = sorted({r[0] for r in rows})
    number = {k: i for i, k in enumerate(keys)}
    start = np.zeros(len(keys) + 1, np.int64)
    np.add.at(start, np.array([number[r[0]] + 1 for r in rows], np.int64), 1)
    none = np.log(0.5 / (np.array([totals.get(x, 0) for x in languages], float) + 0.5 * len(keys) + 1))
    return Entries(keys, np.cumsum(start), np.array([r[1] for r in rows], np.int64), np.log(2 * np.array([r[2] for r in rows], float) + 1), none)


def fit_rows(rows: list[tuple[str, str]]) -> Model:
    """From (lang, text) pairs, all in one place."""
    languages = sorted({x for x, t in rows if x is not None and t is not None})
    words = {x: Counter() for x in languages}
    for x, t in rows:
        if x is not None and t is not None:
            words[x].update(w for w in letters_of(t.lower()) if len(w) <= MOST_LETTERS)
    out = []
    for counts, most, least in ((words, VOCABULARY, LEAST[0]), ({x: gram_counts(c) for x, c in words.items()}, GRAMS, LEAST[1])):
        known = {k for c in counts.values() for k, n in sorted(c.items(), key=lambda e: (-e[1], e[0].encode()))[:most] if n >= least}
        out.append(entries(languages, {x: c.total() for x, c in counts.items()}, [(k, x, c[k]) for x, c in counts.items() for k in known & c.keys()]))
    return Model(languages, *out)


def counted(rows: DataFrame) -> DataFrame:
    """(lang, kind, key, n) of the words (kind 0) and n-grams (kind 1) of (lang, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for x, c in words.items():
                for kind, counts in ((0, c), (1, gram_counts(c))):
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * len(counts), pa.string()), "kind": pa.array([kind] * len(counts), pa.int32()), "key": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            words.clear()

        held = 0
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE)
                for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    c = words.setdefault(x, Counter())
                    before = len(c)
                    c.update(w for w in letters_of(t.lower()) if len(w) <= MOST_LETTERS)
                    held += len(c) - before
                    if held > HELD:
                        yield from handed()
                        held = 0
        yield from handed()

    return rows.mapInArrow(run, "lang string, kind int, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits on rows where ``usable`` holds and label and text are not null."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").cast("string").alias("id"), usable.alias("usable")).where("usable and lang is not null and text is not null")
    counts = [(r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]  # one row for each label, as in the model
    if not counts:
        return fit_rows([])
    ensure_checkpoint_dir(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    shares = docs.sparkSession.createDataFrame([(x, max(sample / len(counts), LEAST_DOCUMENTS) / n) for x, n in counts], "lang string, share double")
    draw = F.xxhash64("id", "text", F.lit("language")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    found = counted(rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text")).checkpoint()
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    most = F.when(F.col("kind") == 0, VOCABULARY).otherwise(GRAMS)
    known = found.where(F.when(F.col("kind") == 0, F.col("n") >= LEAST[0]).otherwise(F.col("n") >= LEAST[1])).withColumn("rank", rank).where(F.col("rank") <= most).select("kind", "key").distinct()
    kept = found.join(known, ["kind", "key"]).select("kind", "key", "lang", "n").toPandas()  # VOCABULARY and GRAMS rows for each label at most, and these keys' counts in other labels
    totals = {(r["lang"], r["kind"]): r["n"] for r in found.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(x for x, _ in counts)
    of = lambda k: entries(languages, {x: totals.get((x, k), 0) for x in languages}, list(kept[kept["kind"] == k][["key", "lang", "n"]].itertuples(index=False, name=None)))
    model = Model(languages, of(0), of(1))
    del kept
    release(docs)
    return model


class Scorer:
    """Scores texts. Words stand in flat arrays: of remembered word i the entries from start[i], size[i] of them; kind 0 is known, 1 cut, 2 without a letter ever seen."""

    def __init__(self, m: Model):
        self.m, self.n = m, len(m.languages)
        self.words, self.grams = ({k: i for i, k in enumerate(e.keys)} for e in (m.words, m.grams))
        self.longest = max(map(len, m.grams.keys), default=1)
        # known words stand in the model's own arrays; what is found for others comes behind them
        self.first = len(m.words.at)
        self.start, self.size, self.kind = np.zeros(MEMO, np.int64), np.zeros(MEMO, np.int64), np.zeros(MEMO, np.int64)
        self.at, self.over = m.words.at, m.words.over
        self.every, self.rows = np.arange(self.n), None
        if len(m.grams.keys) * self.n <= UNPACKED:
            self.rows = np.zeros((len(m.grams.keys), self.n))
            self.rows[np.repeat(np.arange(len(m.grams.keys)), np.diff(m.grams.start)), m.grams.at] = m.grams.over
        self.memo: dict[str, int] = {}
        self.used = self.first
        #: Words that are looked up at a time.
        self.slice = max(1, min(MEMO, MEMO_ENTRIES // max(1, self.n)) // 2)

    def remember(self, w: str) -> int:
        i, self.memo[w] = len(self.memo), len(self.memo)
        if (k := self.words.get(w)) is not None:
            self.start[i], self.kind[i] = (lo := self.m.words.start[k]), 0
            self.size[i] = self.m.words.start[k + 1] - lo
            return i
        cuts = self.cuts(w)
        if not cuts:
            self.size[i], self.kind[i] = 0, 2
            return i
        at, over = self.mean(cuts)
        end = self.used + len(at)
        if end > len(self.at):
            more = max(end, 2 * len(self.at)) - len(self.at)
            self.at, self.over = np.concatenate([self.at, np.zeros(more, np.int64)]), np.concatenate([self.over, np.zeros(more)])
        self.at[self.used : end], self.over[self.used : end] = at, over
        self.start[i], self.size[i], self.kind[i], self.used = self.used, len(at), 1, end
        return i

    def cuts(self, w: str) -> list[int]:
        """The n-grams of an unseen word, from the left, always the longest; a letter that was never seen says nothing."""
        marked, at, out, find, end = f"<{w}>", 0, [], self.grams.get, len(w) + 2
        while at < end:
            for to in range(min(at + self.longest, end), at, -1):
                if (i := find(marked[at:to])) is not None:
                    out.append(i)
                    at = to
                    break
            else:
                at += 1
        return out

    def mean(self, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Languages, and the mean over the cuts of log frequencies over that of half an occurrence."""
        if self.rows is not None:
            return self.every, self.rows[cuts].sum(0) / len(cuts)
        e = self.m.grams
        sums = np.bincount(np.concatenate([e.at[e.start[i] : e.start[i + 1]] for i in cuts]), np.concatenate([e.over[e.start[i] : e.start[i + 1]] for i in cuts]))
        at = np.flatnonzero(sums)
        return at, sums[at] / len(cuts)

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = letter_counts((text or "").lower())
        if not counts or not self.n:
            return UNKNOWN, 0.0
        words, sums, kinds = list(counts), np.zeros(self.n), np.zeros(3)
        for k in range(0, len(words), self.slice):
            some = words[k : k + self.slice]
            if len(self.memo) + len(some) > MEMO or self.used - self.first + len(some) * self.n > MEMO_ENTRIES:
                self.memo.clear()
                self.used = self.first
            ids = list(map(self.memo.get, some))
            if None in ids:
                ids = [self.remember(w) if i is None else i for w, i in zip(some, ids)]
            ids = np.array(ids)
            times, size = np.array([counts[w] for w in some], float), self.size[ids]
            place = np.repeat(self.start[ids] - np.cumsum(size) + size, size) + np.arange(size.sum())
            sums += np.bincount(self.at[place], self.over[place] * np.repeat(times, size), self.n)
            kinds += np.bincount(self.kind[ids], times, 3)
        total = counts.total()
        mean = (sums + kinds[0] * self.m.words.none + kinds[1] * self.m.grams.none) / total
        odds = np.exp((mean - mean.max()) * min(SURE, total))
        best = int(mean.argmax())
        return self.m.languages[best], float(odds[best] / odds.sum())


def with_language(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of lang_pred and score; also the struct's name. Other columns stay as they are."""

    def setup() -> Callable:
        return Scorer(model)

    name = fresh_name(docs, "language")
    return with_struct(docs, struct_udf(setup, [("lang_pred", "string"), ("score", "double")]), text, name), name
