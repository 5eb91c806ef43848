"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Every source's target is its share of all words by weight, capped at ``max_repeat`` times its size, the excess reshared.
Targets become whole numbers of equal-token blocks: first per source, then per shard of a source, always by highest
quotients ``votes / (2 k + 1)``. A shard lays its documents end to end in a seeded order and cuts that line into blocks;
each block is taken ``quota div n`` times, and a seeded run of ``quota mod n`` neighbouring blocks (around the end, if need
be) once more. As the order is random, a run is a random choice of documents, of which two at most are cut.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 take 0;
repeated rows are separate documents; an empty table gives an empty result; columns of the input named like a result column
are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

#: Words (and rows) that a shard holds on average; bounds what one window sorts.
SHARD_TOKENS, SHARD_ROWS = 1 << 22, 1 << 16
SALTS = 32


def n_words(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(seed: int, *cols: Column) -> Column:
    """A whole number below 2**60 from md5, which every SQL engine has."""
    key = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, max_repeat: int = 3, weights: Column | None = None) -> DataFrame:
    """sources: (source, source_size, n_rows). Adds weight, target and block, the words in a block.

    Default weights are 1, 2, 3, repeating by code point of the source, null last. The capped shares are found in one pass
    over the sources sorted by the level at which each is capped. Only the aggregate, one row a source, is in one window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = weights if weights is not None else (F.row_number().over(by_name) - 1) % 3 + 1
    df = sources.withColumn("weight", w.cast("double"))
    df = df.withColumn("cap", (F.col("source_size") * max_repeat).cast("double")).withColumn("level", F.col("cap") / F.col("weight"))
    all_rows = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = all_rows.rowsBetween(Window.unboundedPreceding, -1)
    whole = all_rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = all_rows.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumn("mu", (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    df = df.withColumn("mu", F.min(F.when(F.col("mu") <= F.col("level"), F.struct("level", F.col("source").isNull().alias("n"), "source", "mu"))).over(whole)["mu"])
    df = df.withColumn("target", F.least("cap", F.col("weight") * F.coalesce("mu", F.lit(float("inf")))))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole)
    return df.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(1024), F.floor(least / 1000)))).drop("level", "mu", "cap")


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, tie: list[Column]) -> DataFrame:
    """Sainte-Lague: adds ``quota``, the party's seats by highest quotients within its group.

    The seats at the quotient ``votes / seats`` are counted in closed form; they miss the whole number wanted by at most half
    the parties, so only that many next (or last) quotients of each group are ranked. Ties go to the earlier party.
    """
    g = Window.partitionBy(*group)
    df = parties.withColumn("_v", F.sum(votes).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    df = df.withColumn("_q", F.when((F.col("_v") > 0) & (F.col(seats) > 0), F.floor(F.col(votes) * F.col(seats) / F.col("_v") + 0.5)).otherwise(0).cast("long"))
    df = df.withColumn("_d", F.when(F.col("_v") > 0, F.col(seats) - F.sum("_q").over(g)).otherwise(0).cast("long"))
    df = df.withColumn("_row", F.row_number().over(g.orderBy(*tie)))
    room = F.least(F.abs("_d"), F.ceil(F.col(votes) / F.col("_v") * 1.5 * F.col("_n")) + 1).cast("long")
    room = F.when(F.col("_d") < 0, F.least(room, F.col("_q"))).when(F.col(votes) > 0, room).otherwise(0)
    more = df.where("_d != 0").withColumn("_room", room).where("_room > 0").withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_room").cast("int"))))
    k = F.when(F.col("_d") > 0, F.col("_q") + F.col("_j") - 1).otherwise(F.col("_q") - F.col("_j"))
    quotient = F.col(votes) / (2 * k + 1)
    # highest first when seats are missing, lowest first (and the later party) when there are too many
    more = more.withColumn("_o", F.when(F.col("_d") > 0, -quotient).otherwise(quotient)).withColumn("_t", F.when(F.col("_d") > 0, F.col("_row")).otherwise(-F.col("_row")))
    more = more.withColumn("_rank", F.row_number().over(g.orderBy("_o", "_t"))).where(F.col("_rank") <= F.abs("_d"))
    more = more.groupBy(*group, "_row").agg(F.sum(F.signum("_d").cast("long")).alias("_more"))
    df = df.alias("p").join(more.alias("m"), [F.col(f"p.{c}").eqNullSafe(F.col(f"m.{c}")) for c in [*group, "_row"]], "left")
    keep = [F.col(f"p.{c}") for c in parties.columns]
    return df.select(*keep, (F.col("p._q") + F.coalesce("m._more", F.lit(0))).alias("quota"))


def sized(docs: DataFrame, text: str, source: str, order: list[str], seed: int) -> DataFrame:
    """docs with size, source and h, the seeded place of a document."""
    return docs.withColumns({"size": n_words(F.col(text)), "source": F.col(source), "h": seeded(seed, *(F.col(c) for c in order))})


def plan(measured: DataFrame, max_repeat: int = 3, seed: int = 17, weights: Column | None = None, shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """From (source, size, h): the sources with targets and shard counts, and per shard quota, block count and offset."""
    # two steps, so that a hot source is summed in SALTS places
    salted = measured.groupBy("source", (F.col("h") % SALTS).alias("salt")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    sources = targets(salted.groupBy("source").agg(F.sum("source_size").alias("source_size"), F.sum("n_rows").alias("n_rows")), max_repeat, weights)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens), F.ceil(F.col("n_rows") / shard_rows)).cast("long")
    sources = written(sources.withColumn("shards", shards).select("source", "source_size", "weight", "target", "block", "shards"), "mix-sources")
    rows = sharded(measured.select("source", "size", "h"), sources)
    per_shard = rows.groupBy("source", "shard", "target", "block").agg(F.sum("size").alias("shard_size"))
    voters = sources.withColumn("_all", F.lit(0))
    voters = voters.withColumn("seats", F.floor(F.sum("target").over(Window.partitionBy("_all")) / F.col("block") + 0.5).cast("long"))
    per_source = apportion(voters, ["_all"], "target", "seats", [F.col("source").asc_nulls_last()])
    per_source = per_source.select(F.col("source").alias("_source"), F.col("quota").alias("source_quota"))
    per_shard = per_shard.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    per_shard = apportion(per_shard, ["source"], "shard_size", "source_quota", [F.col("shard")])
    n = F.ceil(F.col("shard_size") / F.col("block")).cast("long")
    per_shard = per_shard.withColumn("n", n).withColumn("quota", F.least("quota", F.col("n") * max_repeat))
    per_shard = per_shard.withColumn("offset", F.when(F.col("n") > 0, seeded(seed, F.col("source"), F.col("shard")) % F.col("n")).otherwise(0))
    return sources, written(per_shard.select("source", "shard", "shard_size", "block", "quota", "n", "offset"), "mix-shards")


def sharded(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their source's figures and their shard. The join is salted, so a hot source is spread when it isn't broadcast."""
    many = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_source")
    met = rows.join(many, F.col("source").eqNullSafe(F.col("_source")) & (F.col("h") % SALTS == F.col("_salt")))
    return met.withColumn("shard", F.floor(F.col("h") / SALTS) % F.col("shards")).drop("_salt", "_source")


def place(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds to rows with (source, shard, size, h) what the mix takes of each.

    repeats: whole passes over the document; a1, b1, a2, b2: two (maybe empty) word ranges, from 0, that are taken once more;
    taken: words in all.
    """
    rows = rows.drop("block")
    s = shards.withColumnsRenamed({"source": "_source", "shard": "_shard"})
    df = rows.join(s, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))).drop("_source", "_shard")
    w = Window.partitionBy("source", "shard").orderBy("h", *(["doc_id"] if "doc_id" in rows.columns else []), "size").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_b", F.sum("size").over(w)).withColumn("_a", F.col("_b") - F.col("size"))
    df = df.withColumn("repeats", F.when(F.col("n") > 0, F.floor(F.col("quota") / F.col("n"))).otherwise(0).cast("long"))
    extra = F.when(F.col("n") > 0, F.col("quota") % F.col("n")).otherwise(0)
    end = F.col("offset") + extra

    def cut(lo: Column, hi: Column) -> tuple[Column, Column]:
        a = F.greatest(F.col("_a"), lo * F.col("block")) - F.col("_a")
        b = F.least(F.col("_b"), hi * F.col("block")) - F.col("_a")
        return F.least(a, F.col("size")).cast("long"), F.greatest(F.least(a, F.col("size")), b).cast("long")

    a1, b1 = cut(F.lit(0), F.greatest(end - F.col("n"), F.lit(0)))
    a2, b2 = cut(F.col("offset"), F.least(end, F.col("n")))
    df = df.withColumns({"a1": a1, "b1": b1, "a2": a2, "b2": b2})
    return df.withColumn("taken", F.col("repeats") * F.col("size") + F.col("b1") - F.col("a1") + F.col("b2") - F.col("a2")).drop("_a", "_b", "n", "quota", "offset", "block", "shard_size")


def mix(docs: DataFrame, text: str = "text", source: str = "source", order: tuple[str, ...] = ("doc_id",), seed: int = 17, **options) -> DataFrame:
    """Every row of docs without its text, with size, source_size, target, taken, repeats and the extra word ranges."""
    measured = written(sized(docs, text, source, list(order), seed).select(*order, "source", "size", "h"), "mix-sized")
    sources, shards = plan(measured, seed=seed, **options)
    return place(sharded(measured, sources), shards)


def mix_texts(docs: DataFrame, text: str = "text", source: str = "source", order: tuple[str, ...] = ("doc_id",), seed: int = 17, **options) -> DataFrame:
    """The mixed corpus: docs' columns, a row for each whole pass over a document and one for its extra words.

    A cut document's extra words are joined by one space.
    """
    carried = docs.select(*order, F.col(text).alias("_text"), F.col(source).alias("source"), F.struct("*").alias("_doc"))
    full = sized(carried, "_text", "source", list(order), seed)
    measured = written(full.select(*order, "source", "size", "h"), "mix-sized")
    sources, shards = plan(measured, seed=seed, **options)
    df = place(sharded(full, sources), shards)
    part = F.col("b1") - F.col("a1") + F.col("b2") - F.col("a2")
    pieces = F.split(F.regexp_replace("_text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")

    def words(a: str, b: str) -> Column:
        return F.slice(pieces, F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int"))

    cut = F.when(part == F.col("size"), F.col("_text")).otherwise(F.concat_ws(" ", words("a1", "b1"), words("a2", "b2")))
    whole = F.array_repeat(F.lit(False), F.col("repeats").cast("int"))
    df = df.withColumn("_cut", F.explode(F.concat(whole, F.when(part > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))))
    df = df.withColumn("_text", F.when(F.col("_cut"), cut).otherwise(F.col("_text")))
    new = {text: F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_text").cast(docs.schema["n_chars"].dataType)
    return df.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`mix` over documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"))
