"""Language ID: held-out accuracy, mixtures, odd rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossator.llm import language


def test_held_out_accuracy(spark, sf):
    got = language.op6_language_id(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    assert list(got.held_out) == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    both = got.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert len(both) == len(docs) and (held.lang_pred == held["lang"]).mean() > 0.97
    assert got.score.between(0, 1).all()
    kept = language.with_language(spark.read.parquet(f"{sf}/documents.parquet"))
    assert kept.count() >= 0.97 * len(docs)


def test_mixture_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = {r["lang"]: r.t for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("t")).collect()}
    half = " ".join(by["en"].split()[:400] + by["de"].split()[:300])
    rows = [(1, None), (2, ""), (3, "123 !? — 🚀"), (4, half), (4, half), (None, by["fr"]), (6, "日本語"), (7, by["es"] * 20)]
    odd = spark.createDataFrame([(k, t, "zz") for k, t in rows], "doc_id long, text string, score string")
    langs, model = language.learn(docs, "text", "lang")
    got = language.predict(odd, langs, model, ["doc_id"], "text").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.score for r in got[:3]] == [0, 0, 0]
    assert got[3].lang_pred == "en" and set(got[3].langs) == {"en", "de"} and abs(got[3].score - 4 / 7) < 0.05
    assert got[3] == got[4] and got[5].lang_pred == "fr" and got[7].lang_pred == "es"
    assert got[6].lang_pred in langs
    unlearned = odd.withColumn("lang", F.lit(None).cast("string"))
    labelled = docs.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    thirds = " ".join(w for g in ("en", "de", "fr") for w in by[g].split()[:200])
    more = labelled.unionByName(spark.createDataFrame([(9000, thirds, None)], labelled.schema))
    kept = {r.doc_id for r in language.with_language(more.where("doc_id >= 9000 or lang is not null or text is null or length(text) < 20")).where("lang is null").select("doc_id").collect()}
    assert kept == {9000, 6}  # three languages in equal parts are no reason to go; texts without a letter are
    assert {r.lang_pred for r in language.identify(unlearned).collect()} == {"und"}
    assert language.identify(unlearned.limit(0)).count() == 0
    assert language.with_language(unlearned).columns == unlearned.columns


def test_same_alone_and_together():
    rng = np.random.default_rng(1)
    like = rng.normal(-50, 4, (60, 3))
    first = np.array([0, 5, 6, 30, 60])
    whole = language.proportions(like, first)
    for i in range(4):
        alone = language.proportions(like[first[i] : first[i + 1]], np.array([0, first[i + 1] - first[i]]))
        assert np.abs(alone[0] - whole[i]).max() < 0.01


def plain_mixture(like, share):
    """Expectation-maximisation for one document, in loops: its proportions and log-likelihood."""
    k = len(share)
    for _ in range(language.STEPS):
        new = [0.0] * k
        for row in like:
            p = [math.exp(v - max(row)) * s for v, s in zip(row, share)]
            for j in range(k):
                new[j] += p[j] / max(sum(p), 1e-300)
        new = [(n + language.PRIOR) * (s > 0) for n, s in zip(new, share)]
        new = [n / sum(new) for n in new]
        moved = max(abs(a - b) for a, b in zip(new, share))
        share = new
        if moved < 1e-4:
            break
    return share, sum(math.log(max(sum(math.exp(v - max(row)) * s for v, s in zip(row, share)), 1e-300)) + max(row) for row in like)


def plain_proportions(like):
    """All languages first; the smallest goes for as long as penalised likelihood gains; the later of equals first."""
    k = len(like[0])
    share, fit = plain_mixture(like, [1 / k] * k)
    while sum(s > 0 for s in share) > 1:
        least = min((j for j in range(k) if share[j] > 0), key=lambda j: (share[j], -j))
        less = [0 if j == least else s for j, s in enumerate(share)]
        tried, tried_fit = plain_mixture(like, [s / sum(less) for s in less])
        if tried_fit + language.PENALTY * math.log1p(len(like)) < fit:
            break
        share, fit = tried, tried_fit
    return share


def test_proportions_against_plain():
    rng = np.random.default_rng(4)
    for spread, k in ((0.5, 3), (4, 3), (4, 5), (30, 2), (4, 1)):
        like = rng.normal(-60, spread, (25, k))
        like[:9, 0] += 2 * spread
        like[20:] = -50.0  # stretches that all languages explain alike
        assert language.proportions(like, np.array([0, 25]))[0] == pytest.approx(plain_proportions(like.tolist()), abs=1e-9)
    even = np.full((4, 3), -20.0)
    assert language.proportions(even, np.array([0, 4]))[0].tolist() == [1, 0, 0] == plain_proportions(even.tolist())  # ties: the first in order


def test_prediction_against_plain(spark):
    """Counts, stretches and mixtures by plain loops over words, on a small table."""
    rng = np.random.default_rng(6)
    words = {"aa": ["alma", "arna", "anda"], "bb": ["bobo", "bubi", "bonn"]}
    docs = [(i, " ".join(rng.choice(words[g], 12)), g) for i in range(60) for g in [("aa", "bb")[i % 2]]]
    docs += [(100, " ".join([*rng.choice(words["aa"], 16), *rng.choice(words["bb"], 8)]), None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    counts = {g: {} for g in words}

    def grams(word):
        s = f" {word} "
        return [(s[i : i + 3] + (s + " ")[i + 3 : i + 4]) for i in range(len(word))]

    for i, text, g in docs:
        if g and zlib.crc32(str(i).encode()) % 3 != 1:
            for w in text.split():
                for x in grams(w):
                    counts[g][x] = counts[g].get(x, 0) + 1
    total = {g: sum(c.values()) + language.SMOOTH * language.BUCKETS for g, c in counts.items()}
    for i, text, _ in docs:
        w = text.split()
        like = [[sum(math.log((counts[g].get(x, 0) + language.SMOOTH) / total[g]) for v in w[a : a + language.STRETCH] for x in grams(v)) for g in ("aa", "bb")] for a in range(0, len(w), language.STRETCH)]
        share = plain_proportions(like)
        assert got[i].score == pytest.approx(max(share), abs=1e-4) and got[i].lang_pred == ("aa", "bb")[share.index(max(share))]
