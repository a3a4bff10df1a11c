"""The word-level BPE vocabulary: normaliser, word splitter and the two encoders' shared tables.

A vocabulary file is read once on the driver into a :class:`Vocabulary`, a few integers for each merge, which
Spark ships to the executors with the function that uses it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

import regex

#: The file's pattern of a piece of text, contractions first.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


MARKS = frozenset(",.!?;:")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    tokens: list[str]  # by id
    first: list[int]  # id of a byte inside a word
    last: list[int]  # id of a byte that ends a word
    pairs: dict[int, int]  # left id << 32 | right id -> rank
    merged: list[int]  # rank -> id
    special: dict[str, int] = field(default_factory=dict)


def load(path: str) -> Vocabulary:
    """Reads a ``tokenizers`` BPE file with an end-of-word suffix; another kind of file is an error."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    end = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not end or model.get("unk_token"):
        raise ValueError("a BPE vocabulary with an end-of-word suffix and without an unknown token is needed")
    vocab = model["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [""] * (1 + max([*vocab.values(), *special.values()]))
    for t, i in (vocab | special).items():
        tokens[i] = t
    symbols = byte_symbols()
    pairs, merged = {}, []
    for rank, m in enumerate(model["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        pairs[vocab[a] << 32 | vocab[b]] = rank
        merged.append(vocab[a + b])
    return Vocabulary(tokens, [vocab[symbols[b]] for b in range(256)], [vocab[symbols[b] + end] for b in range(256)], pairs, merged, special)


class Splitter:
    """Cuts a text into pieces as the vocabulary's normaliser and splitter do: bytes for a word, int for a special token."""

    def __init__(self, special: dict[str, int]):
        self.special = special
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.find = regex.compile(PIECE).findall
        self.settled = re.compile("[\x00-\u0557]*").fullmatch
        self.normal, self.cut = None, None
        self.bytes = {c: b for b, c in byte_symbols().items()}

    def asked(self, text: str) -> list[str]:
        """As plain(), by the library's normaliser and splitter: of rarer letters its Unicode tables know others than ours."""
        if self.cut is None:
            from tokenizers import Regex, normalizers, pre_tokenizers

            self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
            self.cut = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(PIECE), "removed", invert=True), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        pieces = self.cut.pre_tokenize_str(self.normal.normalize_str(text))
        return [bytes([self.bytes[c] for c in p]).decode() for p, _ in pieces]

    def plain(self, text: str) -> list[str]:
        if not self.settled(text):
            return self.asked(text)
        text = unicodedata.normalize("NFC", text)
        low = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])  # letter by letter: no final sigma
        return self.find(low)

    def __call__(self, text: str) -> list[str | int]:
        """Pieces of a text: str for a word, int for a special token's id."""
        # letters up to U+00FF, and one mark after them at most, need no look at the rest: most runs are such
        if text.isalpha() and max(text) <= "\u00ff":
            return [text.lower()]
        if text[-1:] in MARKS and text[:-1].isalpha() and max(text) <= "\u00ff":
            return [text[:-1].lower(), text[-1]]
        if self.specials is None or not self.specials.search(text):
            return self.plain(text)
        out: list[str | int] = []
        at = 0
        for m in self.specials.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.plain(text[at:])


class Generations:
    """A bounded memo: two dictionaries, the older of which is dropped when the younger is full."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def put(self, key, value):
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value
