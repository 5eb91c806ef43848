"""Pairs of ids that share a token, each once, without a shuffle of pairs.

Ids with the same tokens are one class, compared once, in blocks of BLOCK ids; the blocks that have a token are cut into tiles of
about TILE ids, and every pair of tiles is a row that any task may take, so neither a token nor a class that many ids have is left
to one. A pair is made at the least token that both have and at no other, which each block sees by its lesser tokens. Those are
carried for sets of at most WIDE tokens; blocks with a larger set meet at every token that both have, and once after a grouping.

Work and rows grow with the pairs that there are, which may be as many as the square of the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A pair of tiles is at most (BLOCK + TILE) ** 2 rows, which generated code holds at once.
BLOCK, TILE, WIDE = 256, 256, 64


def _tiles(tokens: DataFrame) -> DataFrame:
    """(token, tile, wide, held): the blocks of ids that have a token, about TILE ids together. tokens: (id, token)."""
    sets = tokens.groupBy("id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    place = F.row_number().over(Window.partitionBy("tokens").orderBy("id")) - 1
    # structs, as null ids count
    blocks = sets.withColumn("block", F.floor(place / BLOCK)).groupBy("tokens", "block").agg(F.collect_list(F.struct("id")).alias("ids"), F.min("id").alias("first"))
    wide = F.size("tokens") > WIDE
    rows = blocks.select("ids", "first", wide.alias("wide"), F.when(~wide, F.col("tokens")).alias("tokens"), F.posexplode("tokens").alias("at", "token"))
    rows = rows.select("token", "ids", "first", "wide", F.slice("tokens", F.lit(1), F.col("at")).alias("lesser"))
    before = F.sum(F.size("ids")).over(Window.partitionBy("token").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("tile", F.floor(F.coalesce(before, F.lit(0)) / TILE))
    return rows.groupBy("token", "tile").agg(F.max("wide").alias("wide"), F.collect_list(F.struct("first", "ids", "lesser")).alias("held"))


def sharing(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(a, b): each id of a with each of b that has a token in common. a, b: (id, token), of any types that can be ordered.
    Without b: pairs within a, the smaller id first, null ids left out."""
    spark, own = a.sparkSession, b is None
    left = _tiles(a.where("id is not null") if own else a)
    side = lambda t, x: t.select("token", *(F.col(c).alias(f"{c}_{x}") for c in ("tile", "wide", "held")))
    met = side(left, "a").join(side(left if own else _tiles(b), "b"), "token")
    if own:
        met = met.where("tile_a <= tile_b")
    # a stated number, as few bytes become many rows
    many = max(64, 8 * spark.sparkContext.defaultParallelism)
    met = met.repartition(many, "token", "tile_a", "tile_b")

    def blocks(rows: DataFrame, among: str) -> DataFrame:
        rows = rows.select(F.explode("held_a").alias("x"), "held_b").select("x", F.explode("held_b").alias("y")).where(among)
        return rows.where("x.first <= y.first") if own else rows

    def pairs(rows: DataFrame) -> DataFrame:
        rows = rows.select((F.col("x.first") == F.col("y.first")).alias("same"), F.explode("x.ids").alias("x"), F.col("y.ids").alias("y"))
        rows = rows.select("same", F.col("x.id").alias("x"), F.explode("y").alias("y")).select("same", "x", F.col("y.id").alias("y"))
        if own:
            return rows.where("not same or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return rows.select(F.col("x").alias("a"), F.col("y").alias("b"))

    once = blocks(met, "not arrays_overlap(x.lesser, y.lesser)")  # null, so left out, if one is wide
    again = blocks(met.where("wide_a or wide_b"), "x.lesser is null or y.lesser is null").select("x.first", F.struct("x.first", "x.ids").alias("x"), F.col("y.first").alias("other"), F.struct("y.first", "y.ids").alias("y"))
    wide = again.groupBy("first", "other").agg(F.first("x").alias("x"), F.first("y").alias("y")).repartition(many, "first", "other")
    return pairs(once).unionByName(pairs(wide))
