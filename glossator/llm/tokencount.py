"""Token counts with a whole-token shortcut.

Offline, every vocabulary string that could be a pre-token is encoded alone; those that give exactly their own id are proven
whole. Counting then looks pre-tokens up in that set and merges only the rest, through the tokenizer library.

Texts are cut at white space first, where no pre-token of this vocabulary crosses, and the count of each such chunk is
remembered by a worker up to ``CACHE`` chunks. Anything that the plain rules might treat otherwise than the library (special
strings, control separators, rare scripts, texts not in NFC) goes to the library whole, chunk by chunk or text by text.

Defined cases: a null or empty text has 0 bytes and 0 tokens; very long texts and words are counted whole; repeated rows each
get a row; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import arrow, table

#: Chunks that a worker remembers, and the longest one remembered.
CACHE, CACHE_CHARS = 600_000, 64
#: Separators on which Python's and the library's ideas of white space differ.
ODD_SPACE = re.compile("[\x1c-\x1f\x85]")
#: Characters for which Python's lower case and letter classes are known to be the library's.
PLAIN = re.compile(r"[!-~¡-¬®-΢Τ-ԯ‐-‧‰-⁞€]+")
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer(path: str):
    """The library's tokenizer of a .json file, one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proven to be one token when they are a pre-token on their own."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, letters = model.get("end_of_word_suffix") or "", byte_letters()
    named = {}
    for piece, k in model["vocab"].items():
        if piece.endswith(end) and (body := piece[: len(piece) - len(end)]):
            try:
                named[bytes(letters[c] for c in body).decode()] = k
            except (KeyError, UnicodeDecodeError):
                continue  # not a text of its own
    t = tokenizer(path)
    strings = [s for s in named if t.normalizer is None or t.normalizer.normalize_str(s) == s]
    return frozenset(s for s, e in zip(strings, t.encode_batch(strings, add_special_tokens=False), strict=True) if e.ids == [named[s]])


class ChunkCounter(dict):
    """Token counts by white-space chunk, filled on demand."""

    def __init__(self, path: str, whole: frozenset[str]):
        import regex

        super().__init__()
        self.whole, self.tokenizer, self.find = whole, tokenizer(path), regex.compile(PRETOKEN).findall
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.merged: dict[str, int] = {}

    def by_library(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def plain(self, chunk: str) -> bool:
        return PLAIN.fullmatch(chunk) is not None and unicodedata.is_normalized("NFC", chunk) and not any(s in chunk for s in self.specials)

    def learn(self, chunks: set[str]) -> None:
        """Count the chunks that aren't known."""
        new = [c for c in chunks if c not in self]
        parts = {c: self.find(c.lower()) for c in new if self.plain(c)}
        rest = list({p for ps in parts.values() for p in ps if p not in self.whole and p not in self.merged})
        self.merged.update(zip(rest, self.by_library(rest), strict=True))
        for c, ps in parts.items():
            self[c] = sum(1 if p in self.whole else self.merged[p] for p in ps)
        odd = [c for c in new if c not in parts]
        self.update(zip(odd, self.by_library(odd), strict=True))

    def counts(self, texts: list[str]) -> list[int]:
        if len(self) > CACHE:  # before anything counts on what is known
            self.clear()
            self.merged.clear()
        out, at, split = [0] * len(texts), [], []
        for i, t in enumerate(texts):
            if ODD_SPACE.search(t):
                out[i] = self.by_library([t])[0]
            else:
                at.append(i)
                split.append(t.split())
        known = self.keys()
        chunks: set[str] = set()
        for s in split:
            chunks.update(s)
        self.learn(chunks - known)
        for i, s in zip(at, split, strict=True):
            out[i] = sum(map(self.__getitem__, s))
        return out


_counter: tuple[str, ChunkCounter] | None = None


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048) -> DataFrame:
    """keep's columns with n_bytes, n_tokens and over_limit for every text of docs; no shuffle.

    The proven set is bounded by the vocabulary and broadcast.
    """
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(path))
    kept = docs.select(*keep, text)
    schema = StructType([*(kept.schema[c] for c in keep)]).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _counter
        if _counter is None or _counter[0] != path:
            _counter = (path, ChunkCounter(path, whole.value))
        counter = _counter[1]
        for b in batches:
            for k in range(0, b.num_rows, 500):
                piece = b.slice(k, 500)
                texts = [t or "" for t in piece.column(len(keep)).to_pylist()]
                n = counter.counts(texts)
                size = [len(t.encode()) for t in texts]
                cols = [piece.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return arrow(kept, run, schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """The contract's counts of documents."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
