"""Language ID as inference of a mixture.

Each learned language is a distribution over hashed four-byte n-grams of letter runs. A document is a mixture: each stretch of
up to ``STRETCH`` words comes from one language, and expectation-maximisation finds the document's proportions. Starting from
all languages, the one with the least proportion is dropped for as long as the log-likelihood, less a penalty for every
language, gains by it. The language with the largest proportion among those left is predicted.

Counting and prediction each read whole texts once, without a shuffle of texts. The model is bounded by languages times
``BUCKETS``; counts are summed on the executors before they reach the driver.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and so is every text if there is nothing to learn
from; repeated rows each get a row; ties go to the language first in order; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructType

from .common import arrow, crc_mod, table
from .words import Words, pieces

BUCKETS = 1 << 16
STRETCH = 4
#: Added to counts of n-grams; to stretches of a language; per language in the penalised likelihood, times log(1 + stretches).
SMOOTH, PRIOR, PENALTY = 0.5, 0.05, 2.0
STEPS = 12

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[_BETWEEN] = 32


def grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram at every byte of every word, and each word's first; borders of words read as spaces."""
    size = w.end - w.start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) + np.repeat(w.start - first, size)
    b = _FOLD[w.raw]
    a = b[at]
    before, after = np.empty_like(a), np.empty_like(a)
    before[1:], after[:-1] = a[:-1], a[1:]
    before[first], after[first + size - 1] = 32, 32
    then = np.empty_like(a)
    then[:-1] = after[1:]
    then[first + size - 1] = 32
    key = (before << np.uint32(24)) | (a << np.uint32(16)) | (after << np.uint32(8)) | then
    key *= np.uint32(0x9E3779B1)
    key ^= key >> np.uint32(15)
    key *= np.uint32(0x85EBCA77)
    return (key >> np.uint32(16)).astype(np.int64), first


def has_letter(texts: list[str | None]) -> np.ndarray:
    import regex

    find = regex.compile(r"\p{L}").search
    return np.array([bool(t and find(t)) for t in texts])


def learn(labelled: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each bucket (rows) in each (columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for p in pieces(b, 0, 1 << 20):
                w = Words(p.column(0), _BETWEEN, hashed=False)
                if not len(w.start):
                    continue
                bucket, first = grams(w)
                names, code = np.unique(np.array(p.column(1).to_pylist()), return_inverse=True)
                of = np.repeat(code[w.doc], w.end - w.start)
                n = np.bincount(of * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, row in zip(names, n, strict=True):
                    total[str(name)] = total.get(str(name), 0) + row
        for name, row in total.items():
            used = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used), pa.array(row[used])], names=["lang", "bucket", "n"])

    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    found = arrow(known, run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    if langs:
        counts[found.bucket.to_numpy(), np.searchsorted(langs, found["lang"].to_numpy().astype(str))] = found.n.to_numpy()
    return langs, np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS)) if langs else counts


def mixture(like: np.ndarray, first: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: proportions and log-likelihoods. like: log-likelihoods of stretches (rows) by language,
    those of document i from first[i] on. share: where to begin; a share of 0 stays 0."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    top = like.max(1)
    p = np.exp(like - top[:, None])
    fit = np.zeros(len(doc))
    for step in range(STEPS + 1):
        r = p * share[doc]
        fit = r.sum(1)
        if step == STEPS:
            break
        r /= np.maximum(fit, 1e-300)[:, None]
        new = (np.add.reduceat(r, first[:-1], axis=0) + PRIOR) * (share > 0)
        new /= new.sum(1, keepdims=True)
        moved = np.abs(new - share).max(initial=0)
        share = new
        if moved < 1e-4:
            fit = (p * share[doc]).sum(1)
            break
    return share, np.add.reduceat(np.log(np.maximum(fit, 1e-300)) + top, first[:-1])


def proportions(like: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each document's proportions over the languages that penalised likelihood keeps."""
    n, k = np.diff(first), like.shape[1]
    share, fit = mixture(like, first, np.full((len(n), k), 1 / k))
    cost = PENALTY * np.log1p(n)
    open_ = np.flatnonzero((share > 0).sum(1) > 1)
    while len(open_):
        rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in open_])
        begin = np.concatenate([[0], np.cumsum(n[open_])])
        less = share[open_].copy()
        least = np.where(less > 0, less, np.inf)[:, ::-1].argmin(1)  # of equals the last goes
        less[np.arange(len(open_)), k - 1 - least] = 0
        less /= less.sum(1, keepdims=True)
        tried, tried_fit = mixture(like[rows], begin, less)
        gain = tried_fit + cost[open_] >= fit[open_]
        at = open_[gain]
        share[at], fit[at] = tried[gain], tried_fit[gain]
        open_ = at[(share[at] > 0).sum(1) > 1]
    return share


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, keep: list[str], text: str) -> DataFrame:
    """keep's columns with lang_pred, score and langs, the languages kept with their proportions."""
    kept = docs.select(*keep, F.col(text).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    at = len(keep)
    schema = StructType([*(kept.schema[c] for c in keep)]).add("lang_pred", "string").add("score", "double").add("langs", MapType(StringType(), DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = sent.value
        for b in batches:
            for p in pieces(b, at, 1 << 20):
                w = Words(p.column(at), _BETWEEN, hashed=False)
                n_words = np.diff(w.first)
                name, score = np.full(p.num_rows, "und", object), np.zeros(p.num_rows)
                found: list[list[tuple[str, float]]] = [[] for _ in range(p.num_rows)]
                fine = n_words > 0
                odd = np.flatnonzero(fine)
                # bytes above ASCII may be no letters: look closer where there is nothing else
                ascii_letter = np.zeros(len(w.raw) + 1, np.int64)
                np.cumsum((w.raw < 128) & ~_BETWEEN[w.raw], out=ascii_letter[1:])
                odd = odd[ascii_letter[w.offsets[odd + 1]] == ascii_letter[w.offsets[odd]]]
                if len(odd):
                    fine[odd] = has_letter(p.column(at).take(pa.array(odd)).to_pylist())
                docs_ = np.flatnonzero(fine)
                if len(docs_) and langs:
                    bucket, first = grams(w)
                    by_word = np.add.reduceat(table_[bucket], first, axis=0).astype(np.float64)
                    # stretches: every STRETCH-th word of a text begins one
                    place = np.arange(len(w.doc)) - w.first[w.doc]
                    heads = np.flatnonzero((place % STRETCH == 0) & fine[w.doc])
                    mine = fine[w.doc]
                    packed = by_word[mine]
                    head_at = np.cumsum(mine)[heads] - 1
                    like = np.add.reduceat(packed, head_at, axis=0)
                    begin = np.concatenate([[0], np.cumsum(-(-n_words[docs_] // STRETCH))])
                    share = proportions(like, begin)
                    best = share.argmax(1)
                    name[docs_], score[docs_] = np.array(langs, object)[best], share[np.arange(len(best)), best]
                    for i, row in zip(docs_, share, strict=True):
                        found[i] = [(langs[j], float(row[j])) for j in np.flatnonzero(row)]
                yield pa.RecordBatch.from_arrays(
                    [*(p.column(i) for i in range(at)), pa.array(list(name), pa.string()), pa.array(score), pa.array(found, pa.map_(pa.string(), pa.float64()))],
                    names=[*keep, "lang_pred", "score", "langs"],
                )

    return arrow(kept, run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents never learned from; a null id counts as an empty text."""
    return crc_mod(F.coalesce(doc_id.cast("string"), F.lit("")), 3) == 1


def identify(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and langs of every document."""
    langs, model = learn(docs.where(~held_out(F.col(doc))), text, lang)
    out = predict(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), langs, model, ["doc_id"], "text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs")


def with_language(docs: DataFrame, least: float = 0.0, doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs in which any learned language is found; their columns stay as they are. Texts that are null or have no letter go,
    and so does, if ``least`` is given, what has no language of such a proportion; mixed documents stay otherwise."""
    langs, model = learn(docs.where(~held_out(F.col(doc))), text, lang)
    whole = docs.select(F.struct("*").alias("_doc"), F.col(text).alias("_body"))
    out = predict(whole, langs, model, ["_doc"], "_body").where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return out.select("_doc.*")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The contract's predictions for documents."""
    return identify(table(spark, sf_dir, "documents"))
