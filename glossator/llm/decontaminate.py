"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring words: the hash of the words at its ones, whatever stands at its zeros. Each place of
a benchmark item and of a training text gives one hash a mask. Where hashes meet, the two texts are laid over each other at
that offset; the item leaks if some ``WINDOW`` words of it (all, if it has fewer) agree with the text in at least 80 %.
The masks hit every such overlap of 10 to 20 words, whichever words are substituted (a test tries all patterns).
An item of fewer than ``LEAST`` words has one hash, of all its words, and leaks where they all stand in a row.

Words are runs of letters, digits and non-ASCII characters, case-folded and composed (NFC) by Unicode, so neither punctuation,
capitals nor decomposed accents hide a passage. In scripts without spaces (Han, kana, Thai and others) each character is a word.

Training hashes that can't match are dropped before any shuffle by a Bloom filter of the benchmark's hashes. Its size is
fixed, whatever the benchmark's; with too many hashes it lets more through, and the join that follows is exact anyway. Texts
don't move: of each text with hits, only the hashed words around them do. The join on hashes is salted.

Defined cases: items without words take no part; null and empty texts have no leaks; a passage cut short at a text's
border counts by the words that are there; each repeated row gets its own leaks once; an empty table gives no leaks; columns
other than id and text are not read. The id may be of any type that compares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, few, table, written
from .graph import bloom, may_hold
from .words import PUNCTUATION, Words, folded, mix64, pieces

#: Words at the ones must agree.
MASKS = ("110111", "11010011", "11111")
WINDOW, SHARE, LEAST = 20, 0.8, 10
SALTS = 16


def seeds(hashes: np.ndarray, doc: np.ndarray, masks: tuple[str, ...] = MASKS, tag: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per mask: the places where it fits into one text, and its hash there, told apart from other masks' by the tag."""
    for m, mask in enumerate(masks):
        span = len(mask)
        n = max(0, len(hashes) - span + 1)
        h = np.full(n, m + tag, np.uint64)
        for j, bit in enumerate(mask):
            if bit == "1":
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
        fits = doc[:n] == doc[span - 1 : span - 1 + n]
        yield np.flatnonzero(fits), h[fits]


def whole(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of n words in one text, and the hash of all of them there."""
    return next(seeds(hashes, doc, ("1" * n,), len(MASKS) + n))


def benchmark_seeds(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Seeds (key, item_uid, at), and items (item_uid, item_id, words) with hashed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, 1):
                w = Words(folded(p.column(1)), PUNCTUATION)
                some = np.diff(w.first) > 0
                words = [w.hashes[w.first[i] : w.first[i + 1]].tobytes() if some[i] else None for i in range(p.num_rows)]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(words, pa.binary())], names=["item_id", "words"])

    kind = benchmark.schema[item].dataType.simpleString()
    items = arrow(benchmark.select(F.col(item).alias("item_id"), F.col(text).alias("text")), run, f"item_id {kind}, words binary")
    items = written(items.where("words is not null").distinct().withColumn("item_uid", F.xxhash64("item_id", "words")), "leak-items")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, words in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = np.frombuffer(words.as_buffer(), np.uint64)
                doc = np.zeros(len(h), np.int8)
                for at, key in seeds(h, doc) if len(h) >= LEAST else [whole(h, doc, len(h))]:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(at), uid)), pa.array(at)], names=["key", "item_uid", "at"])

    return written(arrow(items.select("item_uid", "words"), cut, "key long, item_uid long, at long"), "leak-seeds"), items


def leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, first_word, n_words, n_equal: every leak, the best window of each document and item.

    text_hash (xxhash64) tells apart documents that share an id.
    """
    spark = docs.sparkSession
    bench, items = benchmark_seeds(benchmark, item, item_text)
    sieve = spark.sparkContext.broadcast(bloom(bench))
    short = [r.n for r in items.select((F.length("words") / 8).cast("int").alias("n")).where(F.col("n") < LEAST).distinct().collect()]
    given = docs.select(F.col(doc).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = may_hold(sieve.value)
        for b in batches:
            for p in pieces(b, 2, 2 << 20):
                w = Words(folded(p.column(2)), PUNCTUATION)
                at, keys = [], []
                for places, key in seeds(w.hashes, w.doc):
                    may = np.flatnonzero(test(key))
                    at.append(places[may])
                    keys.append(key[may])
                for n in short:
                    places, key = whole(w.hashes, w.doc, n)
                    may = np.flatnonzero(test(key))
                    # equal keys are exact copies: a text's first one tells, however common the item
                    may = may[np.lexsort((places[may], key[may], w.doc[places[may]]))]
                    new = np.ones(len(may), bool)
                    new[1:] = (np.diff(w.doc[places[may]]) != 0) | (key[may][1:] != key[may][:-1])
                    at.append(places[may[new]])
                    keys.append(key[may[new]])
                where, key = np.concatenate(at), np.concatenate(keys)
                if not len(where):
                    continue
                order = np.argsort(where, kind="stable")
                where, key = where[order], key[order]
                owner = w.doc[where]
                # a region: hits of one text whose windows touch
                fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (np.diff(where) > 2 * WINDOW)])
                first, last = np.flatnonzero(fresh), np.concatenate([np.flatnonzero(fresh)[1:], [len(where)]])
                low = np.maximum(where[first] - WINDOW, w.first[owner[first]])
                high = np.minimum(where[last - 1] + 2 * WINDOW, w.first[owner[first] + 1])
                of = owner[first]
                region = np.repeat(np.arange(len(first)), last - first)
                at, key = where - low[region], key.view(np.int64)
                order = np.lexsort((at, key, region))
                region, key, at = region[order], key[order], at[order]
                new = np.concatenate([[True], (np.diff(region) != 0) | (key[1:] != key[:-1]) | (np.diff(at) != 0)])
                ends = np.concatenate([[0], np.cumsum(np.bincount(region[new], minlength=len(first)))]).astype(np.int32)
                hits = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(key[new]), pa.array(at[new])], names=["key", "at"]))
                words = pa.array([w.hashes[x:y].tobytes() for x, y in zip(low, high, strict=True)], pa.binary())
                whose = pa.array(of)
                yield pa.RecordBatch.from_arrays([p.column(0).take(whose), p.column(1).take(whose), pa.array(low - w.first[of]), words, hits], names=["doc_id", "text_hash", "start", "words", "hits"])

    kind = given.schema["doc_id"].dataType.simpleString()
    regions = arrow(given, run, f"doc_id {kind}, text_hash long, start long, words binary, hits array<struct<key:long,at:long>>")
    regions = written(regions.distinct().withColumn("region", F.xxhash64("doc_id", "text_hash", "start")), "leak-regions")
    hits = regions.select("region", F.explode("hits").alias("hit")).select("region", "hit.key", F.col("hit.at").alias("place")).withColumn("salt", F.pmod(F.xxhash64("region"), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    laid = hits.join(bench.select("*", salts), ["key", "salt"]).select("region", "salt", "item_uid", (F.col("place") - F.col("at")).alias("shift")).distinct()
    laid = laid.join(items.select("*", salts), ["item_uid", "salt"]).drop("salt").withColumnRenamed("words", "item_words").join(regions.drop("hits"), "region")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, first, size, equal = [], [], [], []
            for i, (shift, start, mine, theirs) in enumerate(zip(b.column(4).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(5), strict=True)):
                got, want = np.frombuffer(mine.as_buffer(), np.uint64), np.frombuffer(theirs.as_buffer(), np.uint64)
                length = min(WINDOW, len(want))
                a, z = max(0, -shift), min(len(want), len(got) - shift)  # the item's words that lie over the region
                if z - a < length:
                    if z - a < LEAST:
                        continue
                    length = z - a
                same = np.concatenate([[0], np.cumsum(got[a + shift : z + shift] == want[a:z])])
                runs = same[length:] - same[:-length]
                best = int(runs.argmax())
                share = SHARE if len(want) >= LEAST else 1
                if runs[best] >= share * length - 1e-9 and (length == min(WINDOW, len(want)) or runs[best] >= LEAST):
                    keep.append(i)
                    first.append(start + a + shift + best)
                    size.append(length)
                    equal.append(int(runs[best]))
            t = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(6), pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(equal, pa.int64())], names=["doc_id", "text_hash", "item_id", "first_word", "n_words", "n_equal"])

    item_kind = items.schema["item_id"].dataType.simpleString()
    found = arrow(laid.select("doc_id", "text_hash", "start", "words", "shift", "item_words", "item_id"), verify, f"doc_id {kind}, text_hash long, item_id {item_kind}, first_word long, n_words long, n_equal long")
    best = F.max(F.struct((F.col("n_equal") / F.col("n_words")).alias("share"), "n_words", (-F.col("first_word")).alias("o"), "n_equal"))
    found = found.groupBy("doc_id", "text_hash", "item_id").agg(best.alias("b"))
    return found.select("doc_id", "text_hash", "item_id", (-F.col("b.o")).alias("first_word"), "b.n_words", "b.n_equal")


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs less the documents that leak a benchmark item; all columns stay."""
    bad = leaks(docs, benchmark, doc, text).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    bad = few(bad, "leak-documents")  # else every text would be shuffled to be held against a few ids
    return docs.join(bad, F.col(doc).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text)) == F.col("_hash")), "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that leaks into it."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
