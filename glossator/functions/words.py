"""Words of passages as runs of one script, and passages of whole words; both as plain functions and as Arrow UDFs.

Controls and format characters are deleted without ending a run; white space ends a run of a script, but lies inside a run of
common characters (digits, punctuation) without being part of it. Runs that begin with Han, that hold an emoji, or that are
all punctuation and symbols fall apart into characters.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

_SCRIPTS = (
    "Common Inherited Latin Greek Cyrillic Armenian Hebrew Arabic Syriac Thaana Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Thai Lao Tibetan Myanmar "
    "Georgian Hangul Ethiopic Cherokee Khmer Mongolian Hiragana Katakana Bopomofo Han"
).split()
_KIND = [(name, regex.compile(rf"\p{{Script={name}}}")) for name in _SCRIPTS]
_LATIN = regex.compile(r"\p{Script=Latin}")
_DROPPED = regex.compile(r"[\p{Cc}\p{Cf}]")
_BLANK = regex.compile(r"[\s﻿]")
_EMOJI = regex.compile(r"\p{Extended_Pictographic}")
_MARKS = regex.compile(r"[\p{P}\p{S}|]+")
#: Characters that end a sentence.
ENDS = frozenset(".!?;:…»”)]")
#: Pieces of a passage's end that are too few to stand alone, and the share of the limit before which no sentence end cuts.
LEAST, CUT = 12, 0.6


@lru_cache(maxsize=65536)
def char_class(c: str) -> str:
    """blank, dropped, or the script's name."""
    if _BLANK.match(c):
        return "blank"
    if _DROPPED.match(c):
        return "dropped"
    return next((name for name, p in _KIND if p.match(c)), "Unknown")


_SIMPLE = regex.compile(r"(?V1)[[\p{Script=Latin}\p{Script=Common}\s﻿]--[[\p{Cc}\p{Cf}]--[\s﻿]]--\p{Extended_Pictographic}]*+")
_RUN = regex.compile(r"\p{Script=Latin}++|(?![\s\uFEFF])\p{Script=Common}(?:[\s\uFEFF]*+\p{Script=Common})*+")


def split_words(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end), offsets in code points of text."""
    if not _SIMPLE.fullmatch(text):
        return split_by_character(text)
    out = []
    for m in _RUN.finditer(text):
        word, start = m[0], m.start()
        if word[0].isalpha() and _LATIN.match(word):
            out.append((word, start, m.end()))
            continue
        if len(word) == 1:
            out.append((word, start, start + 1))
            continue
        inside = [(c, start + i) for i, c in enumerate(word) if not (c.isspace() or c == "\ufeff")]
        word = "".join(c for c, _ in inside)
        if _MARKS.fullmatch(word):
            out += [(c, i, i + 1) for c, i in inside]
        else:
            out.append((word, start, inside[-1][1] + 1))
    return out


def split_by_character(text: str) -> list[tuple[str, int, int]]:
    """What split_words gives, for any text."""
    out: list[tuple[str, int, int]] = []
    run: list[tuple[str, int]] = []
    script = ""

    def flush() -> None:
        nonlocal script
        if run:
            word = "".join(c for c, _ in run)
            if char_class(word[0]) == "Han" or _EMOJI.search(word) or _MARKS.fullmatch(word):
                out.extend((c, i, i + 1) for c, i in run)
            else:
                out.append((word, run[0][1], run[-1][1] + 1))
        run.clear()
        script = ""

    for i, c in enumerate(text):
        kind = char_class(c)
        if kind == "dropped":
            continue
        if kind == "blank":
            if script not in ("", "Common"):
                flush()
            continue
        if kind != script:
            # blanks before a common run belong to it, so a following script always starts anew
            flush()
            script = kind
        run.append((c, i))
    flush()
    return out


def plain_count(word: str) -> int:
    """Pieces of a word without a vocabulary: one for each six characters begun."""
    return max(1, -(-len(word) // 6))


#: Of every code point, as texts bring them: 0 not looked at yet, 1 blank, 2 dropped, else its script's place from 3, and whether it
#: is an emoji or a mark.
_KNOWN = np.zeros(0x110000, np.uint8)
_PLACE = {"blank": 1, "dropped": 2} | {name: n for n, name in enumerate([*_SCRIPTS, "Unknown"], 3)}
_KIND_BITS, _EMOJI_BIT, _MARK_BIT = 63, 64, 128
_END_CODES = np.array(sorted(map(ord, ENDS)), np.uint32)


def _properties(codes: np.ndarray) -> np.ndarray:
    found = _KNOWN[codes]
    if not found.all():
        for code in np.unique(codes[found == 0]).tolist():
            c = chr(code)
            _KNOWN[code] = _PLACE[char_class(c)] | (_EMOJI_BIT if _EMOJI.match(c) else 0) | (_MARK_BIT if _MARKS.match(c) else 0)
        found = _KNOWN[codes]
    return found


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The start, end and length of each word that split_words gives for a text of these code points."""
    props = _properties(codes)
    kinds = props & _KIND_BITS
    at = np.flatnonzero(kinds > 2)
    if not len(at):
        return at, at, at
    kind, blanks = kinds[at], np.cumsum(kinds == 1)[at]
    begins = np.ones(len(at), bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (blanks[1:] != blanks[:-1]) & (kind[:-1] != _PLACE["Common"])
    first = np.flatnonzero(begins)
    props = props[at]
    apart = (kind[first] == _PLACE["Han"]) | (np.bitwise_or.reduceat(props, first) & _EMOJI_BIT > 0) | (np.bitwise_and.reduceat(props, first) & _MARK_BIT > 0)
    if apart.any():
        begins |= np.repeat(apart, np.diff(first, append=len(at)))
        first = np.flatnonzero(begins)
    length = np.diff(first, append=len(at))
    return at[first], at[first + length - 1] + 1, length


def chunk_pages(pages: list[str], count: Callable[[str], int], most: int = 126) -> list[dict]:
    """Passages of at most ``most`` pieces over all pages, cut after a sentence where one ends late enough.

    Each has text, page (from 0), char_start (code points, in the pages joined by newlines), char_start_utf16 and pieces.
    """
    codes = [_codes(page) for page in pages]
    if count is plain_count:
        spans = [word_spans(c) for c in codes]
        n = np.concatenate([np.zeros(0, np.int64), *(np.maximum(1, -(-length // 6)) for *_, length in spans)])
    else:
        words = [split_words(page) for page in pages]
        spans = [(np.array([s for _, s, _ in ws], np.int64), np.array([e for *_, e in ws], np.int64)) for ws in words]
        n = np.array([count(w) for ws in words for w, *_ in ws], np.int64)
    starts, ends = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in spans)]) for k in (0, 1))
    until = list(accumulate(len(x[0]) for x in spans))  # words of the pages up to each
    ends_here = np.concatenate([np.zeros(0, bool), *(np.isin(c[x[1] - 1], _END_CODES) for c, x in zip(codes, spans))])
    ended_at = np.maximum.accumulate(np.where(ends_here, np.arange(len(n)), -1))
    total = np.concatenate([[0], np.cumsum(n)])
    cuts, begin, i, since = [], 0, 1, 0
    while True:
        i = max(int(np.searchsorted(total, most + total[begin], "right")) - 1, i, begin + 1)  # the first word too many
        if i >= len(n):
            break
        ended = int(ended_at[i - 1])
        cut = ended + 1 if ended >= since and total[ended + 1] - total[begin] >= int(CUT * most) else i
        cuts.append((begin, cut))
        begin, since, i = cut, i, i + 1
    if begin < len(n):
        if cuts and total[-1] - total[begin] < LEAST and total[-1] - total[cuts[-1][0]] <= most:
            cuts[-1] = (cuts[-1][0], len(n))
        else:
            cuts.append((begin, len(n)))
    ahead = list(accumulate((len(p) + 1 for p in pages), initial=0))
    wide = [np.flatnonzero(c > 0xFFFF) for c in codes]  # characters of two units
    ahead16 = list(accumulate((len(p) + len(w) + 1 for p, w in zip(pages, wide)), initial=0))
    out = []
    for a, z in cuts:
        page, last = bisect_right(until, a), bisect_right(until, z - 1)
        parts, at = [], a
        for k in range(page, last + 1):
            to = min(z, until[k])
            if at < to:
                parts.append(pages[k][starts[at] : ends[to - 1]])
                at = to
        start = int(starts[a])
        out.append(
            {
                "text": " ".join(parts),
                "page": page,
                "char_start": ahead[page] + start,
                "char_start_utf16": ahead16[page] + start + int(np.searchsorted(wide[page], start)),
                "pieces": int(total[z] - total[a]),
            }
        )
    return out


CHUNK = "array<struct<text:string,page:int,char_start:int,char_start_utf16:int,pieces:int>>"
_FIELDS = [pa.field("text", pa.string()), *(pa.field(name, pa.int32()) for name in ("page", "char_start", "char_start_utf16", "pieces"))]


def chunks(most: int = 126, count: Callable[[str], int] = plain_count):
    """An Arrow UDF from an array of pages to an array of passages."""

    @F.arrow_udf(CHUNK)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        remembered = count if count is plain_count else lru_cache(maxsize=100_000)(count)
        for b in batches:
            made, ends = [], [0]
            for pages in b:
                made += chunk_pages([p or "" for p in pages.as_py()], remembered, most) if pages.is_valid else []
                ends.append(len(made))
            columns = [pa.array([c[f.name] for c in made], f.type) for f in _FIELDS]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=_FIELDS))

    return run
