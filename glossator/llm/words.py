"""Words of many texts at once, in numpy: places, 64-bit hashes, shingles.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A word's hash is a polynomial over random byte
values modulo 2**64, read off running sums, then mixed; it depends on the word alone.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes between words: white space; or all of ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
#: Bytes hashed at once.
SEGMENT = 1 << 20
_cached: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers from 0 to n, and those of its inverse; kept for ordinary segments."""
    if _cached and len(_cached[0]) > n:
        return _cached[0], _cached[1]
    made = []
    for x in (_ODD, _INV):
        p = np.full(max(n, SEGMENT) + 1, x, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if n <= SEGMENT:
        _cached[:] = made
    return made[0], made[1]


def pieces(batch: pa.RecordBatch, column: int, most: int = 4 << 20):
    """Slices of a batch with about so many bytes of a text column each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield batch.slice(i, j - i)
        i = j


#: Marks between words of East Asian scripts; and letters of scripts that don't put spaces between words: Thai and Lao,
#: Tibetan, Myanmar, Khmer, Tai Le to Khmer signs, Tai Tham, kana and Han with their extensions.
_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u3030\u303d-\u303f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")
_UNSPACED = re.compile(
    "([\u0e01-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u3005-\u3007\u3021-\u302f\u3031-\u303c\u3040-\u30fa\u30fc-\u30ff\u31f0-\u31ff"
    "\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001aff0-\U0001b16f\U00020000-\U0003ffff])"
)


def _fold(text: str) -> str:
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return _UNSPACED.sub(r" \1 ", _MARKS.sub(" ", text))


def folded(texts: pa.Array) -> pa.Array:
    """The texts without differences of case or composition, by Unicode, with each character of a script without spaces a
    word of its own; pure ASCII ones as they are, for Words folds A-Z."""
    plain = pc.fill_null(pc.string_is_ascii(texts), True)
    if pc.all(plain).as_py():
        return texts
    return pa.array([t if same else _fold(t) for t, same in zip(texts.to_pylist(), plain.to_pylist(), strict=True)], pa.large_string())


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and each text's start, with the end last. Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


class Words:
    """hashes: of every word of all texts; doc: index of its text; first: per text the index of its first word, the end last;
    start, end: byte places."""

    def __init__(self, texts: pa.Array, between: np.ndarray = SPACE, hashed: bool = True):
        raw, offsets = text_bytes(texts)
        n = len(raw)
        inside = np.zeros(n + 2, bool)
        np.logical_not(between[raw], out=inside[1:-1])
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.raw, self.offsets, self.start, self.end = raw, offsets, starts, ends
        self.first = np.searchsorted(starts, offsets)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hashes = self._hash(raw, starts, ends) if hashed else np.zeros(0, np.uint64)

    @staticmethod
    def _hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """In segments of about SEGMENT bytes, so that the 64-bit sums of a long text don't all lie in memory."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
            at, n = starts[i], int(ends[j - 1] - starts[i])
            power, back = _powers(n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_VALUES[raw[at : at + n]] * power[:n], out=total[1:])
            a, b = starts[i:j] - at, ends[i:j] - at
            out[i:j] = mix64((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            i = j
        return out

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each text's distinct runs of k words (of all its words, if it has fewer), sorted within a text; and
        each text's first index among them, the end last."""
        n = np.diff(self.first)
        m = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        first = np.concatenate([[0], np.cumsum(m)])
        doc = np.repeat(np.arange(len(n)), m)
        at = np.arange(first[-1]) - first[doc] + self.first[doc]
        length = np.minimum(n, k)[doc]
        h = length.astype(np.uint64)
        padded = np.concatenate([self.hashes, np.zeros(k, np.uint64)])
        for j in range(k):
            h = np.where(j < length, mix64(h * _ODD + padded[at + j]), h)
        out, size = [], np.zeros(len(n), np.int64)
        for i in range(len(n)):
            u = np.unique(h[first[i] : first[i + 1]])
            size[i] = len(u)
            out.append(u)
        return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(size)])
