"""Connected components of a distributed graph, and a fixed-size Bloom filter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import drop_path, join_hot, scratch, written

BLOOM_BITS = 1 << 23


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for every id in edges (a, b) the smallest id that it is connected to.

    Alternating large and small stars: each round links every node's larger (then smaller) neighbours to its least one, by
    minima and joins, until nothing changes. Edges never grow in number, and no node's neighbours are gathered. Every round
    is a written table, so a lost executor costs a round at most.
    """

    def star(e: DataFrame, large: bool, many: bool) -> DataFrame:
        # small star: from each node to its smaller neighbours; large star: both directions
        d = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if large:
            d = d.unionByName(d.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = d.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_rows")).withColumn("m", F.least("m", "u"))
        met = join_hot(d, written(least, "hubs"), "u") if many else d.join(least.drop("_rows"), "u")
        if large:
            met = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            met = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return met.where("a != b").distinct()

    spark = edges.sparkSession

    def kept(e: DataFrame) -> tuple[DataFrame, str]:
        path = scratch(spark, "edges")
        e.write.option("compression", "zstd").parquet(path)
        return spark.read.parquet(path), path

    now, path = kept(edges.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct())
    state = now.agg(F.count(F.lit(1)), F.lit(None)).first()
    while True:
        many = 2 * state[0] > common.HOT  # else no hub can have too many neighbours for a task
        after, new_path = kept(star(star(now, True, many), False, many))
        drop_path(spark, path)
        now, path = after, new_path
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    # now every edge goes from a node to its root
    return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root"))).groupBy("id").agg(F.min("root").alias("root"))


def bloom(keys: DataFrame) -> np.ndarray:
    """Packed bits of a filter of ``key`` (64-bit hashes). Words are or-ed on the executors; at most BLOOM_BITS / 64 are sent,
    however many keys there are. With too many keys more passes; nothing is ever lost."""
    both = F.array(F.col("key").bitwiseAND(BLOOM_BITS - 1), F.shiftrightunsigned("key", 32).bitwiseAND(BLOOM_BITS - 1))
    bit = keys.select(F.explode(both).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    found = bit.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    lanes = np.zeros(BLOOM_BITS // 64, np.int64)
    lanes[found.word.to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
    return np.packbits(np.unpackbits(lanes.view(np.uint8), bitorder="little"))


def may_hold(packed: np.ndarray):
    """A test of uint64 keys against the filter, as a function on arrays."""
    bits = np.unpackbits(packed).astype(bool)

    def test(key: np.ndarray) -> np.ndarray:
        return bits[key & np.uint64(BLOOM_BITS - 1)] & bits[(key >> np.uint64(32)) & np.uint64(BLOOM_BITS - 1)]

    return test
