"""Toxicity from positive and unlabelled documents.

A linear classifier over the presence of hashed features (words of letters and their first 4, 5 and 6 bytes) is fitted with
numpy on the non-negative risk of positive-unlabelled learning:

    prior * E_positive[l(f)] + max(0, E_unlabelled[l(-f)] - prior * E_positive[l(-f)])

with the logistic loss l and an L1 penalty. Positives are labelled toxic; the unlabelled texts are a sample of all labelled
rows whose labels are hidden, positives among them, so that both come from one population (texts from all documents gave worse
results). When the bracket goes negative, its gradient is followed backwards, as usual. The class prior is
the share of toxic among all rows that may be learned from.

The fit uses bounded samples, ``POSITIVES`` and ``UNLABELLED`` rows of at most ``SAMPLE_BYTES`` of features, the first by a hash;
the prior and all scores cover all rows. Scoring is one pass without a shuffle.

Defined cases: null and empty texts get the score of a text without features; without positives every score is the prior;
repeated rows each get a row; of repeated labels the highest counts; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, crc_mod, give_back, table, written
from .language import _BETWEEN, _FOLD
from .words import Words, mix64, pieces

#: Rows that the classifier is fitted on, at most, and bytes of their features.
POSITIVES, UNLABELLED, SAMPLE_BYTES = 3000, 6000, 256 << 20
BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
ROUNDS, RATE, L1 = 200, 0.2, 1e-3


def word_features(w: Words) -> np.ndarray:
    """A row of buckets for each word: itself, then its first bytes (the word again, if it is shorter)."""
    out = np.empty((len(w.start), 1 + len(PREFIXES)), np.int64)
    out[:, 0] = w.hashes & np.uint64(BUCKETS - 1)
    size = w.end - w.start
    h = np.zeros(len(w.start), np.uint64)
    raw = np.concatenate([w.raw, np.zeros(max(PREFIXES), np.uint8)])
    for j in range(max(PREFIXES)):
        here = np.where(j < size, _FOLD[raw[w.start + j]], 0).astype(np.uint64)
        h = h * np.uint64(257) + here
        if j + 1 in PREFIXES:
            out[:, 1 + PREFIXES.index(j + 1)] = mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j)) & np.uint64(BUCKETS - 1)
    return out


def fit(features: list[np.ndarray], positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias. features: distinct buckets of each document; positive: True for confirmed ones,
    False for unlabelled ones. A second pass over the weights that the first one leaves undoes most of the penalty's pull."""
    flat = np.concatenate(features) if features else np.zeros(0, np.uint32)
    n = np.fromiter(map(len, features), np.int64, len(features))
    doc = np.repeat(np.arange(len(features), dtype=np.int32), n)
    seen = np.bincount(flat[positive[doc]], minlength=BUCKETS)
    used = np.flatnonzero(seen >= 3)  # a bucket that few positives have can't tell anything apart
    weights, bias = np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    for rounds, penalty in ((ROUNDS, L1), (ROUNDS // 2, L1 / 10)):
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        keep = place[flat] >= 0
        w, bias = _descend(place[flat[keep]], doc[keep], positive, prior, weights[used], bias, rounds, penalty)
        weights[used] = w
        used = used[w != 0]
    return weights, bias


def _descend(col: np.ndarray, row: np.ndarray, positive: np.ndarray, prior: float, w: np.ndarray, bias: float, rounds: int, penalty: float) -> tuple[np.ndarray, float]:
    """Proximal AdaGrad on the risk; col, row: the places of ones in the matrix of documents (rows) by buckets."""
    square, square_b = np.full(len(w), 1e-12), 1e-12
    n_p, n_u = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    for _ in range(rounds):
        f = bias + np.bincount(row, weights=w[col], minlength=len(positive))
        up = 1 / (1 + np.exp(-np.clip(f, -40, 40)))  # the slope of l(-f); that of l(f) is up - 1
        soft = np.logaddexp(0, f)
        negative = soft[~positive].sum() / n_u - prior * soft[positive].sum() / n_p
        if negative >= 0:
            g = np.where(positive, -prior / n_p, up / n_u)
        else:
            g = np.where(positive, prior / n_p * up, -up / n_u)
        grad, grad_b = np.bincount(col, weights=g[row], minlength=len(w)), float(g.sum())
        square += grad**2
        square_b += grad_b**2
        step = RATE / np.sqrt(square)
        w = w - step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        bias -= RATE * grad_b / np.sqrt(square_b)
    return w, bias


def held_out(doc_id: Column) -> Column:
    """Documents never learned from; a null id counts as an empty text."""
    return crc_mod(F.coalesce(doc_id.cast("string"), F.lit("")), 5) == 0


def train(docs: DataFrame, labels: DataFrame, doc: str, text: str, label: str) -> tuple[np.ndarray, float]:
    """Fit on the rows of labels that aren't held out."""
    marks = labels.where(F.col(doc).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(doc)))
    marks = marks.groupBy(F.col(doc).alias("id")).agg(F.max(label).alias("label"))
    share = marks.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0] or 0.0
    prior = min(max(share, 1e-6), 1 - 1e-6)
    none = np.zeros(BUCKETS), float(np.log(prior / (1 - prior)))
    if not share:
        return none[0], -40.0
    # each kind the first by a hash
    one = marks.where("label = 1").orderBy(F.xxhash64("id", F.lit("positive")), "id").limit(POSITIVES).select("id", F.lit(True).alias("positive"))
    two = marks.orderBy(F.xxhash64("id", F.lit("unlabelled")), "id").limit(UNLABELLED).select("id", F.lit(False).alias("positive"))
    both = one.unionByName(two)  # bounded by the two parameters, so it may be broadcast
    sample = docs.select(F.col(doc).alias("_id"), F.col(text).alias("text")).join(F.broadcast(both), F.col("_id") == F.col("id"))
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, 0, 1 << 20):
                w = Words(p.column(0), _BETWEEN)
                rows = word_features(w)
                found = [np.unique(rows[w.first[i] : w.first[i + 1]]).astype("<u4").tobytes() for i in range(p.num_rows)]
                yield pa.RecordBatch.from_arrays([p.column(1), p.column(2), pa.array(found, pa.binary())], names=["id", "positive", "features"])

    found = arrow(sample.select("text", "id", "positive"), run, f"id {kind}, positive boolean, features binary")
    # of several texts under an id one is taken; then what fits SAMPLE_BYTES, by hash: a few thousand rows, whatever the tables
    found = written(found.groupBy("id", "positive").agg(F.min("features").alias("features")), "toxic-sample")
    running = F.sum(F.length("features")).over(Window.orderBy(F.xxhash64("id", "positive"), "id", "positive").rowsBetween(Window.unboundedPreceding, 0))
    got = found.withColumn("_bytes", running).where(F.col("_bytes") <= SAMPLE_BYTES).select("features", "positive").toArrow()
    # the order of rows is arbitrary; sums are made in one order
    rows = sorted(zip(got["features"].to_pylist(), got["positive"].to_pylist(), strict=True))
    del got  # else the driver holds the sample twice while it fits
    give_back()
    positive = np.array([p for _, p in rows], bool)
    if not positive.any() or positive.all():
        return none
    return fit([np.frombuffer(f, "<u4") for f, _ in rows], positive, prior)


def scores(docs: DataFrame, model: tuple[np.ndarray, float], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every document."""
    weights = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, bias = weights.value
        for b in batches:
            for p in pieces(b, 1, 1 << 20):
                w = Words(p.column(1), _BETWEEN)
                rows = word_features(w)
                telling = by[rows] != 0
                owner = np.broadcast_to(w.doc[:, None], rows.shape)[telling]
                key = np.unique(owner * BUCKETS + rows[telling])  # each feature counts once a text
                f = bias + np.bincount(key // BUCKETS, weights=by[key % BUCKETS], minlength=p.num_rows)
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(1 / (1 + np.exp(-np.clip(f, -40, 40))))], names=["doc_id", "score"])

    kept = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    return arrow(kept, run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    out = scores(docs, train(docs, labels, doc, text, label), doc, text)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's scores of documents."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
