"""Encoders turn texts into vectors. Weights are not part of the library: any object with ``dim`` and ``encode(texts)`` will do."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructType

from ..models import MODELS, Model
from .words import chunk_pages, plain_count, split_words


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Unit vectors of signed word hashes; the same everywhere, without weights."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float64)
        for row, text in zip(out, texts, strict=True):
            for word, _, _ in split_words(text.lower()):
                h = zlib.crc32(word.encode())
                row[h % self.dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n, n, 1)).astype(np.float32)


def batches_of(sizes: list[int], budget: int = 16384) -> list[list[int]]:
    """Indices by length, in batches whose count times longest stays within the budget; one at least each."""
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        if out and (len(out[-1]) + 1) * sizes[i] <= budget:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def embed(df: DataFrame, text: str, encoder: Encoder, prefix: str = "", out: str = "embedding") -> DataFrame:
    """df with the vector of prefix + text; the encoder is sent once and batches run by length."""
    names = [c for c in df.columns if c != out]
    schema = StructType([df.schema[c] for c in names]).add(out, ArrayType(FloatType()))
    sent = df.sparkSession.sparkContext.broadcast(encoder)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [prefix + (t or "") for t in b.column(at).to_pylist()]
            found: list = [None] * len(texts)
            for group in batches_of([plain_count(t) for t in texts]):
                for i, v in zip(group, sent.value.encode([texts[i] for i in group]), strict=True):
                    found[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.float32()))], names=[*names, out])

    return df.select(*names).mapInArrow(run, schema)


def query_segments(query: str, encoder: Encoder, model: Model | str) -> list[tuple[int, str, list[float]]]:
    """(segment, text, vector) of a query: the whole, then its passages if it is longer than one."""
    m = MODELS[model] if isinstance(model, str) else model
    parts = [query]
    if sum(plain_count(w) for w, _, _ in split_words(query)) > m.max_pieces:
        parts += [c["text"] for c in chunk_pages([query], plain_count, m.max_pieces)]
    vectors = encoder.encode([m.query_prefix + p for p in parts])
    return [(i, p, [float(x) for x in v]) for i, (p, v) in enumerate(zip(parts, vectors, strict=True))]
