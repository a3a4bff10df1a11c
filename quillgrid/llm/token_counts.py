"""Operator 8: token counts by a compiled finite-state tokenizer.

BPE is deterministic from left to right: a sequence of tokens is what the merges give if and only if each pair
of neighbours, encoded alone, stays that pair. So the last token of a prefix is the one token that ends there and
fits the last token before it, and a state needs no more than the last tokens at the positions where a longer
token may still begin. The transducer reads bytes; each transition carries by how many tokens the best
segmentation grows (or shrinks), and a word's last byte takes a transition of its own, because it carries the
end-of-word mark. States are numbered when they are first reached.

A text is read as the bytes of its pieces, in chunks of CHUNK bytes that may begin and end inside a word. A chunk's
state map gives, for any state in which it may be entered, the state in which it is left and the tokens emitted: the
bytes of the word that it is entered in are the only ones that depend on the entry state, so the map holds them, the
count of all that follows, and the exit state. Maps compose associatively, and a prefix scan over them gives the count
at the end of each chunk, the last of which is the text's. A text within one chunk has one map, of its count alone.

Defined results: null and empty texts have 0 bytes, 0 tokens and one chunk of 0 tokens. Special strings inside texts are one token.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .bpe_codec import NONE
from .common import fresh_name, struct_udf, with_struct, words_of
from .wordbpe import Generations, Splitter, Vocabulary, byte_symbols, load

START = -1
#: Transitions after which the machine is compiled anew, to bound its memory.
TRANSITIONS = 400_000
MEMO = 300_000
#: Bytes of a chunk.
CHUNK = 4096
#: A state: the bytes that may still be part of a longer token, the last token at each of them, and its count less the newest.
State = tuple[bytes, tuple[int, ...], tuple[int, ...]]
BEGIN: State = (b"", (START,), (0,))


class Transducer:
    """Counts the tokens of one word, given as bytes."""

    def __init__(self, v: Vocabulary, end: str = "</w>"):
        self.v = v
        back = {c: b for b, c in byte_symbols().items()}
        self.inner: dict[bytes, int] = {}
        self.ends: dict[bytes, int] = {}
        special = set(v.special.values())
        for i, t in enumerate(v.tokens):
            if i not in special:
                kind, t = (self.ends, t[: -len(end)]) if t.endswith(end) else (self.inner, t)
                kind[bytes([back[c] for c in t])] = i
        self.text = {i: b for kind in (self.inner, self.ends) for b, i in kind.items()}
        self.starts = {b[:n] for kind in (self.inner, self.ends) for b in kind for n in range(len(b))}
        self.fit: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states = [BEGIN]
        self.number = {BEGIN: 0}
        self.go: dict[int, tuple[int, int]] = {}
        self.stop: dict[int, int] = {}

    def merge(self, raw: bytes, ended: bool) -> list[int]:
        v = self.v
        parts = [v.first[b] for b in raw]
        if ended:
            parts[-1] = v.last[raw[-1]]
        while True:
            ranks = [v.pairs.get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
            low = min(ranks, default=NONE)
            if low == NONE:
                return parts
            i = ranks.index(low)
            parts[i : i + 2] = [v.merged[low]]

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens, side by side, are what the merges make of their bytes."""
        key = before, token
        if (known := self.fit.get(key)) is None:
            raw = self.text[token]
            ended = self.ends.get(raw) == token
            got = self.merge((b"" if before == START else self.text[before]) + raw, ended)
            if len(self.fit) > TRANSITIONS:
                self.fit.clear()
            known = self.fit[key] = got == [x for x in key if x != START]
        return known

    def last(self, state: State, byte: int, tokens: dict[bytes, int]) -> tuple[int, int]:
        """The token that ends at this byte, and the growth of the count."""
        raw, lasts, counts = state
        raw += bytes([byte])
        for k, before in enumerate(lasts):
            token = tokens.get(raw[k:])
            if token is not None and self.fits(before, token):
                return token, counts[k] + 1
        raise ValueError("each byte is a token, so one always fits")

    def step(self, at: int, byte: int) -> tuple[int, int]:
        """Compiles the transition of a byte inside a word."""
        state = self.states[at]
        token, grown = self.last(state, byte, self.inner)
        raw = state[0] + bytes([byte])
        k = 0
        while raw[k:] not in self.starts:
            k += 1
        raw = raw[k:]
        to = self.numbered((raw, (*state[1][k:], token), (*[c - grown for c in state[2][k:]], 0)))
        self.go[at << 8 | byte] = to, grown
        return to, grown

    def numbered(self, state: State) -> int:
        at = self.number.get(state)
        if at is None:
            at = self.number[state] = len(self.states)
            self.states.append(state)
        return at

    def advance(self, state: State, part: bytes) -> tuple[State, int]:
        """The state after bytes that don't end a word, and the growth of the count."""
        if len(self.go) > TRANSITIONS:
            self.reset()
        at, n, go = self.numbered(state), 0, self.go.get
        for b in part:
            at, grown = go(at << 8 | b) or self.step(at, b)
            n += grown
        return self.states[at], n

    def finish(self, state: State, part: bytes) -> int:
        """The growth of the count over the rest of a word, which ends it."""
        state, n = self.advance(state, part[:-1])
        key = self.number[state] << 8 | part[-1]
        grown = self.stop.get(key)
        if grown is None:
            grown = self.stop[key] = self.last(state, part[-1], self.ends)[1]
        return n + grown


    def count(self, word: bytes) -> int:
        """The tokens of a whole word."""
        if len(self.go) > TRANSITIONS:
            self.reset()
        at, n, go = 0, 0, self.go.get  # BEGIN is state 0
        for b in word[:-1]:
            at, grown = go(at << 8 | b) or self.step(at, b)
            n += grown
        grown = self.stop.get(at << 8 | word[-1])
        if grown is None:
            grown = self.stop[at << 8 | word[-1]] = self.last(self.states[at], word[-1], self.ends)[1]
        return n + grown


#: The bytes that it is entered with, whether they end their word, the tokens after them, and the exit state.
StateMap = tuple[bytes, bool, int, State]


class Counter:
    def __init__(self, v: Vocabulary, chunk: int = CHUNK):
        self.split, self.machine, self.chunk = Splitter(v.special), Transducer(v), chunk
        self.memo, self.pieces = Generations(MEMO), Generations(MEMO)

    def piece(self, p: str | int) -> int:
        """Bytes << 32 | tokens of a piece, so that sums of pieces are sums of both; a special token is one token of one byte."""
        if isinstance(p, int):
            return 1 << 32 | 1
        k = self.pieces.young.get(p) or self.pieces.old.get(p)
        if k is None:
            raw = p.encode("utf-8", "surrogatepass")
            k = len(raw) << 32 | self.machine.count(raw)
            if len(p) < 200:
                self.pieces.put(p, k)
        return k

    def run(self, w: str) -> int:
        """As piece(), of a run without white space."""
        return sum(map(self.piece, self.split(w)))

    def runs(self, words: list[str]) -> list[int]:
        found = list(map(self.memo.young.get, words))
        if None in found:
            new = {}
            for w in {w for w, n in zip(words, found) if n is None}:
                n = self.memo.old.get(w)
                n = self.run(w) if n is None else n
                new[w] = n if len(w) >= 200 else self.memo.put(w, n)
            found = [new[w] if n is None else n for w, n in zip(words, found)]
        return found

    def state_maps(self, words: list[str], found: list[int]) -> list[StateMap]:
        """The chunks' maps. Runs within a chunk add their counts; only words in which a chunk ends are read in parts."""
        both = np.array(found, np.int64)
        tokens, sizes = both & 0xFFFFFFFF, both >> 32
        ends = np.cumsum(sizes)
        first, last = (ends - sizes) // self.chunk, np.maximum(ends - 1, ends - sizes) // self.chunk
        n = int(ends[-1] - 1) // self.chunk + 1
        whole = first == last
        inside = np.bincount(np.minimum(first[whole], n - 1), tokens[whole], n).astype(np.int64).tolist()
        heads, ended, exits = [b""] * n, [True] * n, [BEGIN] * n
        for i in np.flatnonzero(~whole).tolist():
            at = int(ends[i] - sizes[i])
            for p in self.split(words[i]):
                both = self.piece(p)
                k, size = both & 0xFFFFFFFF, both >> 32
                lo, hi = at // self.chunk, (at + size - 1) // self.chunk
                if lo == hi:
                    inside[lo] += k
                else:
                    raw = p.encode("utf-8", "surrogatepass")
                    for c in range(lo, hi + 1):
                        part = raw[max(0, c * self.chunk - at) : (c + 1) * self.chunk - at]
                        if c == lo:
                            exits[c], grown = self.machine.advance(BEGIN, part)
                            inside[c] += grown
                        else:
                            heads[c], ended[c] = part, c == hi
                at += size
        return list(zip(heads, ended, inside, exits, strict=True))

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of a followed by b."""
        if not a[1]:
            return a[0] + b[0], b[1], b[2], b[3]
        if not b[0]:
            return a[0], True, a[2] + b[2], b[3]
        if b[1]:
            return a[0], True, a[2] + self.machine.finish(a[3], b[0]) + b[2], b[3]
        state, grown = self.machine.advance(a[3], b[0])
        return a[0], True, a[2] + grown, state

    def scan(self, maps: list[StateMap]) -> list[StateMap]:
        """All prefixes' maps, composed in pairs (work-efficient: half the maps at each level)."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])])
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]))
        return out

    def counts(self, text: str | None) -> list[int]:
        """Tokens up to the end of each chunk; a word that the chunk leaves open counts as far as it goes."""
        words = words_of(text or "")
        found = self.runs(words)
        both = sum(found)
        if both >> 32 <= self.chunk:
            return [both & 0xFFFFFFFF]
        return [m[2] for m in self.scan(self.state_maps(words, found))]

    def count(self, text: str | None) -> int:
        return self.counts(text)[-1]


def with_counts(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct of n_bytes, n_tokens and chunk_tokens (see Counter.counts); also the struct's name. Other columns stay as they are."""
    v = load(path)

    def setup() -> Callable:
        counter = Counter(v)

        def one(t: str | None) -> tuple:
            counts = counter.counts(t)
            return len((t or "").encode("utf-8", "surrogatepass")), counts[-1], counts

        return one

    name = fresh_name(docs, "tokens")
    return with_struct(docs, struct_udf(setup, [("n_bytes", "long"), ("n_tokens", "long"), ("chunk_tokens", "array<long>")]), text, name), name
