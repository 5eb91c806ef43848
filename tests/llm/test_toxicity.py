"""Toxicity: held-out quality and odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest

from glossator.llm import toxicity
from glossator.llm.language import _BETWEEN
from glossator.llm.words import Words


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    n = label.sum()
    return (rank[label].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out():
    assert auc(np.array([0.1, 0.2, 0.3, 0.9]), np.array([False, False, False, True])) == 1


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op8_toxicity(spark, d).toPandas()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    toxic = held.toxic.to_numpy() == 1
    print(auc(held.score.to_numpy(), toxic), (held.predicted[toxic] == 1).mean(), (held.predicted[~toxic] == 1).mean())
    assert auc(held.score.to_numpy(), toxic) > 0.93
    assert (held.predicted[toxic] == 1).mean() > 0.85 and (held.predicted[~toxic] == 1).mean() < 0.03
    assert ((got.score >= 0.5) == (got.predicted == 1)).all() and got.score.between(0, 1).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, "clean words of no kind" if i % 2 else "vile idiot words", "s") for i in range(60)] + [(100, None, None), (101, "", None), (None, "vile idiot", None), (0, "vile idiot words", "s"), (102, "x" * 100000, None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == 65
    assert (got[got.doc_id % 2 == 0].query("doc_id < 60").predicted == 1).all() and (got[got.doc_id % 2 == 1].query("doc_id < 60").predicted == 0).all()
    assert got[got.doc_id == 100].score.iloc[0] == got[got.doc_id == 101].score.iloc[0]
    assert (toxicity.toxicity(docs, labels.limit(0)).toPandas().predicted == 0).all()
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def plain_fit(features, positive, prior, rounds, rate, l1):
    """The non-negative risk in loops over documents and features: proximal AdaGrad as in the module, a step at a time."""
    n_p, n_u = positive.count(True), positive.count(False)
    used = sorted(k for k in {k for f in features for k in f} if sum(k in f for f, p in zip(features, positive) if p) >= 3)
    w, bias = dict.fromkeys(used, 0.0), math.log(prior / (1 - prior))
    for steps, penalty in ((rounds, l1), (rounds // 2, l1 / 10)):
        square, square_b = dict.fromkeys(w, 1e-12), 1e-12
        for _ in range(steps):
            score = [bias + sum(w[k] for k in f if k in w) for f in features]
            soft = lambda v: math.log1p(math.exp(-abs(v))) + max(v, 0)  # noqa: E731 - the loss of calling v positive
            bracket = sum(soft(v) for v, p in zip(score, positive) if not p) / n_u - prior * sum(soft(v) for v, p in zip(score, positive) if p) / n_p
            slope = []
            for v, p in zip(score, positive):
                up = 1 / (1 + math.exp(-v))
                if bracket >= 0:  # all of the risk: prior * (l(f) - l(-f)) of positives is linear in f
                    slope.append(-prior / n_p if p else up / n_u)
                else:  # back out of the bracket
                    slope.append(prior / n_p * up if p else -up / n_u)
            grad = {k: sum(g for g, f in zip(slope, features) if k in f) for k in w}
            square = {k: square[k] + grad[k] ** 2 for k in w}
            square_b += sum(slope) ** 2
            for k in w:
                step = rate / math.sqrt(square[k])
                v = w[k] - step * grad[k]
                w[k] = math.copysign(max(abs(v) - step * penalty, 0), v)
            bias -= rate * sum(slope) / math.sqrt(square_b)
        w = {k: v for k, v in w.items() if v}
    return w, bias


def test_fit_against_plain(monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 12)
    rng = np.random.default_rng(3)
    positive = [True] * 9 + [False] * 14
    features = [set(rng.choice(30, 8, replace=False).tolist()) | ({40, 41} if p or i % 5 == 0 else set()) for i, p in enumerate(positive)]
    for prior in (0.3, 0.9):  # a high prior makes the bracket negative
        got, bias = toxicity.fit([np.array(sorted(f), np.uint32) for f in features], np.array(positive), prior)
        want, plain_bias = plain_fit(features, positive, prior, 12, toxicity.RATE, toxicity.L1)
        assert bias == pytest.approx(plain_bias) and {k: v for k, v in enumerate(got) if v} == pytest.approx(want)


def test_scores_against_plain(spark):
    """The same sum of weights, feature by feature."""
    weights = np.zeros(toxicity.BUCKETS)
    weights[::3] = np.random.default_rng(1).normal(0, 0.1, len(weights[::3]))
    texts = ["Some plain words, some more", "", None, "été Über naïve x1y", "a " * 300]
    got = [r.score for r in toxicity.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (weights, -0.5)).orderBy("doc_id").collect()]
    for score, text in zip(got, texts):
        w = Words(pa.array([text], pa.string()), _BETWEEN)
        f = -0.5 + sum(float(np.float32(weights[k])) for k in {int(k) for row in toxicity.word_features(w) for k in row})
        assert score == pytest.approx(1 / (1 + math.exp(-f)), abs=1e-6)


def test_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("vile idiot words " if i % 3 == 0 else "clean words ") + f"w{i}") for i in range(90)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda f, p, prior: seen.append((sum(x.nbytes for x in f), len(f), int(p.sum()))) or fit(f, p, prior))
    monkeypatch.setattr(toxicity, "POSITIVES", 20)
    monkeypatch.setattr(toxicity, "UNLABELLED", 30)
    toxicity.train(docs, labels, "doc_id", "text", "toxic")
    assert seen[0][1:] == (50, 20)  # repeated rows don't multiply it
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 600)
    toxicity.train(docs, labels, "doc_id", "text", "toxic")
    assert seen[1][0] <= 600 and seen[1][1] < 50
