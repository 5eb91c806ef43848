"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossator.llm import vectors


def brute(ids, x, k=5, every=50):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in range(len(ids)):
        if ids[i] % every == 0:
            s = u @ u[i]
            s[ids == ids[i]] = -9
            out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -s))[: min(k, (ids != ids[i]).sum())]]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    d = f"/root/testdata/{sf}"
    got = vectors.op9_nearest(spark, d).toPandas()
    p = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x = np.stack(p.embedding.to_numpy()).astype(float)
    want = brute(p.vec_id.to_numpy(), x)
    found = {q: list(g.sort_values("rank").vec_id) for q, g in got.groupby("query_id")}
    hits = sum(len(set(found[q]) & set(v)) for q, v in want.items())
    assert found.keys() == want.keys() and hits >= 0.98 * sum(map(len, want.values()))
    row = {int(i): x[j] for j, i in enumerate(p.vec_id)}
    for r in got.itertuples():
        a, b = row[r.query_id], row[r.vec_id]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, [-1.0, 1e-3]), (50, [1e-30, 1e-30]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = vectors.nearest(df, F.col("vec_id") % 50 == 0)
    by = {}
    for r in got.orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 9)))
    assert by[0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 50, round(2**-0.5, 9)), (4, 9, round(-1 / np.hypot(1, 1e-3), 9))]
    assert [v for _, v, _ in by[50]] == [0, 1, 2, 9]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.nearest(df, F.col("vec_id") % 50 == 0).count() == 0
    df = spark.createDataFrame([(50, None)], "vec_id long, embedding array<float>")
    assert vectors.nearest(df, F.col("vec_id") % 50 == 0).count() == 0
