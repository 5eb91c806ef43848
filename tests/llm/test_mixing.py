"""Mixing: targets against the plain rule, apportionment against a seat-by-seat count, edge cases."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossator.llm import mixing


def plain_targets(sizes: dict, repeat: int = 3) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped, out = sum(sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(repeat * sizes[s] for s in capped)
        w = sum(weight[s] for s in free)
        out = {s: float(repeat * sizes[s]) if s in capped else left * weight[s] / w for s in names}
        over = {s for s in free if out[s] > repeat * sizes[s]}
        if not over:
            return out
        capped |= over


def seat_by_seat(votes: list[int], seats: int) -> list[int]:
    q = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * q[i] + 1), -i))
        q[best] += 1
    return q


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, n long")


def test_targets_and_taken(spark, sf):
    got = mixing.op1_mixing(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").toPandas()
    size = docs.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    want = plain_targets(size.groupby(docs.source).sum().to_dict())
    both = got.merge(docs[["doc_id", "source"]], on="doc_id")
    assert len(both) == len(docs)
    for source, part in both.groupby("source"):
        assert abs(part.target.iloc[0] - want[source]) < 1e-6 * want[source]
        assert abs(part.taken.sum() - want[source]) <= 0.005 * want[source] + 2
    assert (got.taken <= 3 * got["size"]).all()


def test_caps_and_odd_rows(spark):
    rows = [(i, "a b c " * 50, "big", "x", 1) for i in range(40)] + [(100, "one two", "tiny", None, 1), (101, None, None, None, None), (102, "", "tiny", "", 2), (None, "q\x0bw\te", None, None, 0), (5, "a b c " * 50, "big", "x", 1)]
    got = mixing.mix(documents(spark, rows)).toPandas()
    assert len(got) == len(rows)
    tiny = got[got.source == "tiny"]
    assert set(tiny.target) == {6.0} and tiny.taken.sum() == 6
    assert (got.taken <= 3 * got["size"]).all() and (got[got["size"] == 0].taken == 0).all()
    text = mixing.mix_texts(documents(spark, rows))
    assert text.columns == ["doc_id", "text", "source", "size", "n"]
    assert text.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == got.taken.sum()


def test_empty(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mix_texts(documents(spark, [(1, None, "a", None, None)])).count() == 0


def test_shards(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 3}", None, None) for i in range(600)]
    got = mixing.mix(documents(spark, rows), shard_tokens=300, shard_rows=50)
    again = mixing.mix(documents(spark, rows), shard_tokens=300, shard_rows=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    for r in got.groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 0.02 * r.target


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), min_size=1, max_size=12), st.integers(0, 60))
def test_apportion(spark, votes, seats):
    seats = seats if sum(votes) else 0
    df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, i int, v long, s long")
    got = [r.quota for r in mixing.apportion(df, ["g"], "v", "s", [F.col("i")]).orderBy("i").collect()]
    assert got == seat_by_seat(votes, seats)
