"""Ids that share tokens, against plain loops."""

import random

import pytest

from glossator.operators import overlap


def table(seed, n, first):
    r = random.Random(seed)
    return [(first + i if r.random() > 0.02 else None, f"t{int(r.random() ** 2 * 40)}") for i in range(n) for _ in range(r.choice([0, 1, 1, 2, 2, 6]))]


@pytest.mark.parametrize("sizes", [(256, 256, 64), (2, 3, 2), (1, 1, 1)])
def test_every_pair_once(spark, monkeypatch, sizes):
    for name, n in zip(("BLOCK", "TILE", "WIDE"), sizes):
        monkeypatch.setattr(overlap, name, n)
    a, b = table(1, 90, 0), table(2, 70, 60)
    left, right = (spark.createDataFrame(x, "id long, token string") for x in (a, b))
    met = [(x, y) for x, t in a for y, u in b if t == u]
    assert sorted(map(str, (tuple(r) for r in overlap.sharing(left, right).collect()))) == sorted(map(str, set(met)))
    own = {(x, y) for x, t in a for y, u in a if t == u and None not in (x, y) and x < y}
    assert sorted(tuple(r) for r in overlap.sharing(left).collect()) == sorted(own)


def test_pairs_are_not_shuffled(spark):
    """20 million pairs of one token: before, each went through a shuffle, and all through one task."""
    df = overlap.sharing(spark.range(6400).selectExpr("id", "if(id % 2 = 0, 'a', 'b') as other", "'t' as token").selectExpr("id", "explode(array(token, other)) as token"))
    group = "overlap-pairs"
    spark.sparkContext.setJobGroup(group, group)
    try:
        assert df.count() == 6400 * 6399 // 2
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    store = spark.sparkContext._jsc.sc().statusStore()
    jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    stages = {i for j in jobs for i in spark.sparkContext.statusTracker().getJobInfo(j).stageIds}
    assert sum(store.lastStageAttempt(i).shuffleWriteBytes() for i in stages) < 10_000_000
