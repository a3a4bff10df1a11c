"""Operator 2: a quality classifier, a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), so all pairwise interactions
cost as much as the features. Features of a text: its distinct lower-cased words, hashed to WORDS buckets, with
log-damped counts scaled to length 1; STATISTICS of its structure, each also as one of BINS indicator features; and
the length as metadata. Labels, language, source and id are no features.

The machine is fitted with AdaGrad on a bounded sample of SAMPLE labelled documents, drawn by a hash of the id; the
driver gets their features, one row for each id (of an id with several texts the smallest).
Scoring reads every whole text.

Defined results: null and empty texts have statistics of zero and are scored like any other. Label rows with a null
or that are repeated count once (the largest label); without any label every score is 0.5.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, bounded_batches, fresh_name, struct_udf, with_struct, words_of
from .graph import release

WORDS = 1 << 15
BINS = 10
RANK = 8
SAMPLE = 6000
EPOCHS = 6
BATCH = 64
SEED = 7
KEEP = 0.7
MEMO = 150_000
STATISTICS = (
    "upper of letters", "symbols", "digits", "exclamation marks", "bars", "letters of characters", "mean word length", "distinct of words", "repeats of the word before",
    "repeated lines", "words that end in a symbol", "words in capitals", "sentence marks of words", "length",
)
FEATURES = WORDS + len(STATISTICS) * (BINS + 1)

upper_of = re.compile("[A-ZÀ-ÖØ-Þ]").findall
ends_in_symbol = re.compile(r"[#*$%&|<>!=~^_\\](?=[ \t-\r]|$)").findall
capitals = re.compile(r"(?<![^ \t-\r])[A-ZÀ-ÖØ-Þ]{2,}[^a-zß-öø-ÿ \t-\r]*(?=[ \t-\r]|$)").findall


def statistics(text: str, words: list[str], distinct: int) -> list[float]:
    """Each between 0 and 1."""
    n, w = max(1, len(text)), max(1, len(words))
    count = text.count
    symbols = sum(map(count, "#*$%&<>=~^_\\{}[]@+"))
    bars, bangs = count("|"), count("!")
    digits = sum(map(count, "0123456789"))
    spaces = count(" ") + count("\n") + count("\t")
    marks = count(".") + count(",") + count("?") + count(";") + count(":")
    letters = max(0, len(text) - symbols - bars - bangs - digits - spaces - marks)
    lines = [x for x in text.split("\n") if x]
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        len(upper_of(text)) / max(1, letters), symbols / n, digits / n, bangs / n, bars / n, letters / n, min(1.0, letters / w / 20), distinct / w, same / w,
        1 - len(set(lines)) / max(1, len(lines)), len(ends_in_symbol(text)) / w, len(capitals(text)) / w, min(1.0, marks / w), min(1.0, np.log1p(n) / 16),
    ]


class Features:
    def __init__(self):
        self.memo: dict[str, int] = {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Indices and values of a text's features that aren't 0."""
        text = text or ""
        words = words_of(text)
        counts = Counter(words_of(text.lower()))
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, ids = self.memo, []
        for k in counts:
            i = memo.get(k)
            if i is None:
                i = zlib.crc32(k.encode("utf-8", "surrogatepass")) % WORDS
                if len(k) < 100:
                    memo[k] = i
            ids.append(i)
        values = np.log1p(np.fromiter(counts.values(), float, len(counts)))
        values /= max(1e-9, np.sqrt(values @ values))
        s = np.array(statistics(text, words, len(set(words))))
        bins = np.minimum(BINS - 1, (np.sqrt(s) * BINS).astype(int))
        at = WORDS + np.arange(len(s)) * (BINS + 1)
        return np.concatenate([np.array(ids, int), at, at + 1 + bins]), np.concatenate([values, s, np.full(len(s), 0.5)])


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, ids: np.ndarray, x: np.ndarray) -> float:
        """Linear time: the pairwise sum by sums of squares."""
        vx = self.v[ids] * x[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[ids] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(ids, x), -30, 30))))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> Machine:
    """AdaGrad on the log loss; rows are (indices, values, label)."""
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32)
    gw, gv, w0, g0 = np.full(FEATURES, 1e-3, np.float32), np.full((FEATURES, RANK), 1e-3, np.float32), 0.0, 1e-3
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, x, y = rows[i]
            vx = v[ids] * x[:, None]
            s = vx.sum(0)
            raw = w0 + w[ids] @ x + 0.5 * (s @ s - (vx * vx).sum())
            g = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y
            if abs(g) < 1e-3:
                continue
            g0 += g * g
            w0 -= 0.1 * g / np.sqrt(g0)
            d = g * x + 1e-5 * w[ids]
            gw[ids] += d * d
            w[ids] -= 0.1 * d / np.sqrt(gw[ids])
            d = g * (x[:, None] * s - v[ids] * (x * x)[:, None]) + 1e-5 * v[ids]
            gv[ids] += d * d
            v[ids] -= 0.05 * d / np.sqrt(gv[ids])
    return Machine(float(w0), w, v)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """Fits on at most ``sample`` labelled documents whose id meets ``usable`` (an expression over the column ``id``)."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where(F.col("label").isNotNull() & usable)
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id", F.lit("quality")), "id").limit(sample)
    picked = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))  # `sample` rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE).to_pydict()
                got = [features(t) for t in b["text"]]
                yield pa.RecordBatch.from_pydict({"id": pa.array([str(i) for i in b["id"]]), "label": pa.array(b["label"], pa.int32()), "ids": pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())), "x": pa.array([x.astype(np.float32) for _, x in got], pa.list_(pa.float32()))})

    rows = sorted(picked.mapInArrow(run, "id string, label int, ids array<int>, x array<float>").collect(), key=lambda r: (len(r["id"]), r["id"], r["x"]))
    machine = fit_rows([(np.array(r["ids"]), np.array(r["x"], np.float32), int(r["label"] > 0)) for r in rows])
    del rows
    release(docs)
    return machine


def with_quality(docs: DataFrame, machine: Machine, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of score and predicted; also the struct's name. Other columns stay as they are."""

    def setup() -> Callable:
        features = Features()

        def one(t: str | None) -> tuple[float, int]:
            p = machine.score(*features(t))
            return p, int(p >= KEEP)

        return one

    name = fresh_name(docs, "quality")
    return with_struct(docs, struct_udf(setup, [("score", "double"), ("predicted", "int")]), text, name), name
