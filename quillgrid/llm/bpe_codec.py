"""Operator 4: BPE encoding and decoding by contiguous rank arrays.

A short word is held as two parallel lists: the part that starts at each remaining boundary, and the rank of
merging it with the part after it. The smallest rank is looked for again and again; its right boundary is
deleted, and only the ranks left and right of the merged part are looked up anew.

Defined results: null and empty texts, and texts of white space alone, have no tokens and decode to "".
Special strings inside texts become their ids. Columns besides the text column are left as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, bounded_batches, fresh_name, struct_udf, with_struct, words_of
from .wordbpe import Generations, Splitter, Vocabulary, load

NONE = 1 << 60
#: Entries of each generation of a task's memos, of runs and of the pieces in them.
RUN_MEMO, PIECE_MEMO = 100_000, 120_000


def encode_word(word: bytes, v: Vocabulary) -> list[int]:
    """Ids of one word, by the rank array."""
    first, pairs, merged = v.first, v.pairs.get, v.merged
    parts = [first[b] for b in word[:-1]]
    parts.append(v.last[word[-1]])
    ranks = [pairs(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
    while ranks:
        low = min(ranks)
        if low == NONE:
            break
        i = ranks.index(low)  # of equal ranks the leftmost
        here = parts[i] = merged[low]
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = pairs(parts[i - 1] << 32 | here, NONE)
        if i < len(ranks):
            ranks[i] = pairs(here << 32 | parts[i + 1], NONE)
    return parts


def encode_long_word(word: bytes, v: Vocabulary) -> list[int]:
    """As encode_word, in n log n steps, for words too long to scan for each merge: linked parts and a heap."""
    import heapq

    parts = [v.first[b] for b in word[:-1]] + [v.last[word[-1]]]
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := v.pairs.get(parts[i] << 32 | parts[i + 1], NONE)) < NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] < 0 or j >= n or v.pairs.get(parts[i] << 32 | parts[j], NONE) != r:
            continue  # one of the two parts has changed
        parts[i], parts[j] = v.merged[r], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (s := v.pairs.get(parts[i] << 32 | parts[k], NONE)) < NONE:
                heapq.heappush(heap, (s, i))
        if (h := before[i]) >= 0 and (s := v.pairs.get(parts[h] << 32 | parts[i], NONE)) < NONE:
            heapq.heappush(heap, (s, h))
    return [p for p in parts if p >= 0]


#: Bytes of a word from which the heap is quicker than scanning the array.
LONG = 200


class Codec:
    """Encodes and decodes texts; keeps what it found for words in a bounded memo."""

    def __init__(self, v: Vocabulary):
        self.v, self.split = v, Splitter(v.special)
        self.memo, self.pieces = Generations(RUN_MEMO), Generations(PIECE_MEMO)

    def piece(self, p: str | int) -> tuple[int, ...]:
        if isinstance(p, int):
            return (p,)
        found = self.pieces.young.get(p) or self.pieces.old.get(p)
        if found is None:
            b = p.encode("utf-8", "surrogatepass")
            found = tuple(encode_word(b, self.v) if len(b) < LONG else encode_long_word(b, self.v))
            if len(b) < LONG:
                self.pieces.put(p, found)
        return found

    def decode(self, ids) -> str:
        """The text of ids: this vocabulary has no decoder, so tokens are joined by spaces."""
        tokens = self.v.tokens
        return " ".join([tokens[i] for i in ids])

    def word(self, w: str) -> tuple[str, str]:
        """Ids as text and decoded text of a run without white space; runs don't change each other's tokens."""
        ids = [i for p in self.split(w) for i in self.piece(p)]
        found = " ".join(map(str, ids)), self.decode(ids)
        return self.memo.put(w, found) if len(w) < LONG else found

    def runs(self, text: str | None) -> list[tuple[str, str]]:
        """What word() gives for each run of the text that has tokens."""
        words = words_of(text or "")
        found = list(map(self.memo.young.get, words))
        if None in found:
            new = {}
            for w in {w for w, r in zip(words, found) if r is None}:
                new[w] = self.memo.put(w, r) if (r := self.memo.old.get(w)) else self.word(w)
            found = [r or new[w] for w, r in zip(words, found)]
        return found if ("", "") not in found else [r for r in found if r[0]]

    def encode(self, text: str | None) -> list[int]:
        return list(map(int, " ".join([r[0] for r in self.runs(text)]).split()))


def digest(runs) -> tuple[int, str, str]:
    """n_tokens and the two SHA-256 of what encode() and decode() give for a text."""
    ids, text = (" ".join(x) for x in zip(*runs, strict=True)) if runs else ("", "")
    sha = hashlib.sha256
    return ids.count(" ") + bool(ids), sha(ids.encode()).hexdigest(), sha(text.encode("utf-8", "surrogatepass")).hexdigest()


def with_digests(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of n_tokens, ids_sha256 and decoded_sha256; also the struct's name."""
    v = load(path)

    def setup() -> Callable:
        codec = Codec(v)
        return lambda t: digest(codec.runs(t))

    name = fresh_name(docs, "bpe")
    return with_struct(docs, struct_udf(setup, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]), text, name), name


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text as an array, and the decoded text if a name is given for it."""
    v = load(path)
    bounded_batches(docs.sparkSession)
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(ids), *([F.lit(None).cast("string").alias(decoded)] if decoded else [])).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(v)
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                b = whole.slice(k, SLICE)
                rows = [codec.runs(t) for t in b.column(at).to_pylist()]
                flat = [np.array(" ".join([r[0] for r in rs]).split(), np.int32) for rs in rows]
                off = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
                got = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))]
                if decoded:
                    got.append(pa.array([" ".join([r[1] for r in rs]) for rs in rows], pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns, *got], names=[*b.schema.names, ids, *([decoded] if decoded else [])])

    return docs.mapInArrow(run, schema)
