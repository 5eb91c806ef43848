"""Subword tokenizers of encoders, in plain Python over the vocabularies that their files hold.

WordPiece cuts a word greedily into the longest pieces there are. Unigram finds the pieces of the highest total score. Both
count the pieces of a word, which is what passages are cut by, and both encode whole texts between their border ids.
"""

from __future__ import annotations

import base64
import json
import struct
import unicodedata
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import split_words

#: Bytes of a word beyond which WordPiece doesn't look for pieces; pieces of a text, with its borders.
LONGEST_WORD, MOST_PIECES, MOST_UNIGRAM = 100, 128, 512
#: Below the worst piece: the score of a character that no piece covers.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
_CLUSTER = regex.compile(r"\X")
_CLUSTER_BYTES = 6


def utf8_length(text: Column) -> Column:
    """Bytes of a text."""
    return F.octet_length(text)


@dataclass
class WordPiece:
    """Pieces by a vocabulary in which ``##`` marks those that go on."""

    vocab: Mapping[str, int]
    unknown: str = "[UNK]"
    start: str = "[CLS]"
    end: str = "[SEP]"
    remembered: dict[str, list[int]] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.longest = max(map(len, self.vocab), default=0)

    @classmethod
    def load(cls, path: str) -> "WordPiece":
        """From a file with a piece a line; its id is the line's number."""
        with open(path, encoding="utf-8") as f:
            return cls({line.rstrip("\r\n"): i for i, line in enumerate(f)})

    def pieces(self, word: str) -> list[int]:
        """Ids of a word; the unknown one alone if it is too long or some of it isn't covered."""
        if (known := self.remembered.get(word)) is not None:
            return known
        out, at = [], 0
        if len(word.encode()) > LONGEST_WORD:
            at = -1
        while 0 <= at < len(word):
            for z in range(min(len(word), at + self.longest), at, -1):
                k = self.vocab.get(word[at:z] if at == 0 else "##" + word[at:z])
                if k is not None:
                    out.append(k)
                    at = z
                    break
            else:
                at = -1
        out = out if at >= 0 else [self.vocab[self.unknown]]
        if len(self.remembered) < 100_000:
            self.remembered[word] = out
        return out

    def count(self, word: str) -> int:
        return len(self.pieces(word))

    def tokens(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of every piece, with the place of its word in code points."""
        return [(k, a, z) for w, a, z in split_words(text) for k in self.pieces(w)]

    def encode(self, text: str, most: int = MOST_PIECES) -> list[int]:
        return [self.vocab[self.start], *(k for k, *_ in self.tokens(text)[: most - 2]), self.vocab[self.end]]


class CharsMap:
    """A precompiled normalisation: a trie of UTF-8 byte strings in a double array, and the strings they become.

    The file begins with the trie's size in bytes, then come its 32-bit units and a pool of strings that end with a zero.
    """

    def __init__(self, data: bytes):
        (size,) = struct.unpack_from("<I", data)
        self.units = struct.unpack_from(f"<{size // 4}I", data, 4)
        self.pool = data[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def find(self, key: bytes) -> str | None:
        """What the shortest prefix of key that the trie holds becomes."""
        at = 0
        unit = self.units[at]
        at ^= self._offset(unit)
        for c in key:
            if c == 0:
                return None
            at ^= c
            unit = self.units[at] if at < len(self.units) else 0
            if unit & ((1 << 31) | 0xFF) != c:
                return None
            at ^= self._offset(unit)
            if (unit >> 8) & 1:
                begin = self.units[at] & 0x7FFFFFFF
                return self.pool[begin : self.pool.index(0, begin)].decode()
        return None

    def normalize(self, text: str) -> str:
        """Short clusters of characters as a whole where they are known, else character by character."""
        out = []
        for cluster in _CLUSTER.findall(text):
            if len(raw := cluster.encode("utf-8", "surrogatepass")) < _CLUSTER_BYTES and (to := self.find(raw)) is not None:
                out.append(to)
                continue
            for c in cluster:
                to = self.find(c.encode("utf-8", "surrogatepass"))
                out.append(c if to is None else to)
        return "".join(out)


@dataclass
class Unigram:
    """Pieces by scores; ids are places in ``scores``. charsmap: the normalisation, NFKC if there is none."""

    scores: list[tuple[str, float]]
    unknown: int = 0
    start: int | None = None
    end: int | None = None
    specials: Mapping[str, int] = field(default_factory=dict)
    charsmap: CharsMap | None = None
    remembered: dict[str, list[int]] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.place = {}
        for i, (piece, score) in enumerate(self.scores):
            self.place.setdefault(piece, (i, score))
        self.longest = max((len(p) for p, _ in self.scores), default=0)
        self.worst = min((s for _, s in self.scores), default=0.0) - UNKNOWN_PENALTY
        names = sorted(self.specials, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, names))) if names else None

    @classmethod
    def load(cls, path: str) -> "Unigram":
        """From a tokenizer.json of this kind."""
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        added = {a["content"]: a["id"] for a in d.get("added_tokens", []) if a.get("special")}
        steps = (d.get("normalizer") or {}).get("normalizers", [d.get("normalizer") or {}])
        packed = next((s["precompiled_charsmap"] for s in steps if s.get("type") == "Precompiled"), None)
        charsmap = CharsMap(base64.b64decode(packed)) if packed else None
        return cls([(p, s) for p, s in d["model"]["vocab"]], d["model"]["unk_id"], added.get("<s>"), added.get("</s>"), added, charsmap)

    def normalize(self, text: str) -> str:
        """Normalised, with single spaces and none at the borders."""
        text = self.charsmap.normalize(text) if self.charsmap else unicodedata.normalize("NFKC", text)
        return " ".join(text.split())

    def pieces(self, word: str) -> list[int]:
        """Ids of the best cut of a word; the earlier of equals; neighbouring unknown characters are one."""
        if (known := self.remembered.get(word)) is not None:
            return known
        n = len(word)
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)] + [(-float("inf"), 0, 0)] * n  # score, from, id
        for a in range(n):
            base = best[a][0]
            single = False
            for z in range(a + 1, min(n, a + self.longest) + 1):
                hit = self.place.get(word[a:z])
                if hit is not None:
                    single |= z == a + 1
                    if base + hit[1] > best[z][0]:
                        best[z] = (base + hit[1], a, hit[0])
            if not single and base + self.worst > best[a + 1][0]:
                best[a + 1] = (base + self.worst, a, self.unknown)
        out, z = [], n
        while z:
            _, a, k = best[z]
            if not (k == self.unknown and out and out[-1] == self.unknown):
                out.append(k)
            z = a
        out.reverse()
        if len(self.remembered) < 100_000:
            self.remembered[word] = out
        return out

    def _parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of text, and the special pieces between them."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield text[at : m.start()], self.specials[m[0]]
            at = m.end()
        yield text[at:], None

    def ids(self, text: str) -> list[int]:
        out = []
        for part, special in self._parts(text):
            for word in self.normalize(part).split(" "):
                if word:
                    out += self.pieces(SPACE + word)
            if special is not None:
                out.append(special)
        return out

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def encode(self, text: str, most: int = MOST_UNIGRAM) -> list[int]:
        borders = [[k] if k is not None else [] for k in (self.start, self.end)]
        return borders[0] + self.ids(text)[: most - len(borders[0]) - len(borders[1])] + borders[1]


def encoding(make: Callable[[], WordPiece | Unigram], most: int):
    """An Arrow UDF from texts to arrays of ids; make is called once in each task's process."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = make()
        for s in batches:
            yield s.map(lambda x: t.encode(x, most) if x is not None else None)

    return run


def counting(make: Callable[[], WordPiece | Unigram]):
    """An Arrow UDF from texts to their number of pieces, without borders."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = make()
        for s in batches:
            yield s.map(lambda x: sum(t.count(w) for w, _, _ in split_words(x)) if x is not None else None).astype("Int64")

    return run
