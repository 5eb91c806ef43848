"""Near-duplicates: circulant MinHash, banding, exact Jaccard verification.

A document's set is that of its distinct five-word shingles, as 64-bit hashes. Its signature comes from two permutations of 32
bits: the first scatters the shingles, the second, shifted circularly by another step for every coordinate, ranks them, and the
least rank is the coordinate. ``BANDS`` bands of ``ROWS`` coordinates miss a pair of similarity 0.85 with a probability below
1e-6.

1. Signatures, sizes and fingerprints of all sets: one pass over the texts, no shuffle.
2. Documents with equal sets form a class; its smallest id stands for it.
3. Classes that share a band are joined to the least of the band; connected, they make clusters. No pair is emitted: a band of
   g classes gives g - 1 edges. All candidate pairs lie within clusters.
4. The sets of cluster members (found by a fixed-size Bloom filter while reading the texts again) go to their clusters. Large
   clusters are cut into blocks by set size and a hash, and each pair of blocks whose sizes can match is a group of its own, so
   that a task holds two blocks. Within a group all intersections are counted exactly as a matrix product over the
   shingles that occur twice, and the links are sent as a spanning forest.
5. The components of these links, and of those between the classes of an id that has several texts.

Bands, hubs and clusters with very many rows are met by a broadcast of those few keys, so none is one task's.

Defined cases: null and empty texts have an empty set and are linked with nothing; rows with a null id are linked with nothing
and stay; rows that share an id are one node; equal rows each get a row; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, few, join_hot, table, written
from .graph import bloom, components, may_hold
from .words import Words, mix64, pieces

SHINGLE, PERCENT = 5, 85
ROWS, BANDS = 5, 24
#: Shingles and documents in a block of a cluster.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 19, 512
SALTS = 16


def _second(x: np.ndarray) -> np.ndarray:
    """The permutation of 32 bits that is shifted."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(shingles: np.ndarray, first: np.ndarray, n: int = ROWS * BANDS) -> np.ndarray:
    """A row of n coordinates for each text; all ones for an empty set."""
    out = np.full((len(first) - 1, n), 0xFFFFFFFF, np.uint32)
    some = np.diff(first) > 0
    if some.any():
        scattered = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)
        at = first[:-1][some]
        for k in range(n):
            out[some, k] = np.minimum.reduceat(_second(scattered + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)), at)
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each text (rows) and band (columns)."""
    parts = signature.reshape(len(signature), -1, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h


def measured(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint of the set), bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, 1, 2 << 20):
                s, first = Words(p.column(1)).shingles(k)
                keys = band_keys(signatures(s, first))
                some = np.diff(first) > 0
                f1, f2 = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
                if len(s):
                    f1[some] = np.add.reduceat(mix64(s + np.uint64(1)), first[:-1][some])
                    f2[some] = np.bitwise_xor.reduceat(mix64(s ^ np.uint64(0xABCDEF1234567890)), first[:-1][some])
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(np.diff(first)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), bands], names=["doc_id", "n", "f1", "f2", "bands"])

    return arrow(docs, run, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by matrix products over the shingles that occur in two sets at least."""
    g = len(sets)
    out = np.zeros((g, g), np.float64)
    flat, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(g), [len(s) for s in sets])
    column = np.full(len(flat), -1)
    column[count > 1] = np.arange((count > 1).sum())
    col = column[inverse]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = 8192
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, z = np.searchsorted(col, [c, c + width])
        x = np.zeros((g, min(width, int(col[-1]) + 1 - c)), np.float32)
        x[row[a:z], col[a:z] - c] = 1
        out += x @ x.T  # whole numbers below 2**24: exact
    return out


def forest(ids: np.ndarray, links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect whatever the matrix of links does."""
    root = {int(i): int(i) for i in ids}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a, b in zip(*np.nonzero(np.triu(links, 1)), strict=True):
        x, y = find(int(ids[a])), find(int(ids[b]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(ids[a]), int(ids[b])))
    return out


def one_node(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) from each id to the representatives of all its classes, for ids whose rows have several sets."""
    kind = F.struct("f1", "f2", "n")
    several = named.groupBy("doc_id").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).where("lo != hi").select("doc_id")
    rows = named.join(several, "doc_id", "left_semi").select("doc_id", "f1", "f2", "n").distinct()
    return rows.join(classes, ["f1", "f2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs. percent: of the union, that a link must share."""
    spark = docs.sparkSession
    given = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(measured(given, k), "dedup-rows")
    named = rows.where("doc_id is not null and n > 0")
    classes = written(named.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "dedup-classes")

    # the bands of classes; a class's representative may be several equal rows
    of = named.join(classes, (named.doc_id == classes.rep) & (named.f1 == classes.f1) & (named.f2 == classes.f2) & (named.n == classes.n), "left_semi")
    banded = of.select("doc_id", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("_rows"))
    least = written(least.where("least != most").drop("most"), "dedup-bands")
    edges = join_hot(banded, least, "band").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    clusters = written(components(edges), "dedup-clusters").withColumnsRenamed({"id": "member", "root": "cluster"})

    # blocks: sets of a size within a cluster are spread over as many as they need, by a hash, so no cluster is in one task
    step = math.log(100 / percent)
    sized = named.join(clusters, named.doc_id == clusters.member, "inner").groupBy("cluster", "member").agg(F.sum("n").alias("weight"), F.min("n").alias("n"), F.max("n").alias("most"))
    sized = written(sized.withColumn("band", F.floor(F.log("n") / F.lit(step))), "dedup-sizes")
    need = sized.groupBy("cluster", "band").agg(F.sum("weight").alias("_weight"), F.count(F.lit(1)).alias("_rows"))
    need = need.withColumn("parts", F.greatest(F.ceil(F.col("_weight") / block_shingles), F.ceil(F.col("_rows") / BLOCK_DOCS))).drop("_weight")
    blocked = join_hot(sized, written(need, "dedup-needs"), ["cluster", "band"])
    block = F.struct("band", F.pmod(F.xxhash64("member"), F.col("parts")).alias("part"))
    blocked = written(blocked.select("cluster", "member", "n", "most", block.alias("block")), "dedup-blocks")
    span = blocked.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("most").alias("high"))
    left, right = span.alias("l"), span.alias("r")
    can = left.join(right, (F.col("l.cluster") == F.col("r.cluster")) & (F.col("l.block") <= F.col("r.block")) & (F.col("r.low") * percent <= F.col("l.high") * 100))
    can = can.select(F.col("l.cluster").alias("cluster"), F.col("l.block").alias("i"), F.col("r.block").alias("j"))
    tasks = can.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    places = blocked.select("cluster", "member", "block").join(tasks, ["cluster", "block"])

    sieve = spark.sparkContext.broadcast(bloom(clusters.select(F.xxhash64("member").alias("key"))))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = may_hold(sieve.value)
        for b in batches:
            b = b.take(pa.array(np.flatnonzero(test(b.column(2).to_numpy().view(np.uint64)))))
            for p in pieces(b, 1, 2 << 20):
                s, first = Words(p.column(1)).shingles(k)
                sets = [s[first[i] : first[i + 1]].tobytes() for i in range(p.num_rows)]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(sets, pa.binary())], names=["member", "shingles"])

    sets = arrow(given.where("doc_id is not null").withColumn("key", F.xxhash64("doc_id")), members, "member long, shingles binary")
    sets = sets.where(F.length("shingles") > 0).join(places, "member")

    def verify(group: pa.Table) -> pa.Table:
        ids = group["member"].to_numpy()
        found = [np.frombuffer(x.as_py(), np.uint64) for x in group["shingles"]]
        n = np.array([len(s) for s in found])
        same = overlaps(found)
        links = 100 * same >= percent * (n[:, None] + n[None] - same)
        out = forest(ids, links)
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    links = sets.groupBy("cluster", "i", "j").applyInArrow(verify, "a long, b long")
    joined = written(components(links.unionByName(one_node(named, classes))), "dedup-components")

    # back to rows: only classes with copies need a join, and hot ones are spread by a salt
    copied = classes.where("copies > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).drop("copies")
    salted = rows.drop("bands").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(copied, ["f1", "f2", "n", "salt"], "left").withColumn("rep", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    out = out.join(joined.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("root", "rep"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one document of each component; rows that repeat an id and a text come once. All columns stay.

    Which rows go is decided on ids and hashes; of the texts, only those of repeated rows move.
    """
    gone = near_duplicates(docs, doc, text, **options).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(few(gone, "dedup-gone"), F.col(doc) == F.col("_gone"), "left_anti")
    key = [F.col(doc), F.xxhash64(F.col(text))]
    again = docs.select(key[0].alias("_id"), key[1].alias("_hash")).groupBy("_id", "_hash").count().where("count > 1").drop("count")
    again = few(again, "dedup-repeats")
    on = key[0].eqNullSafe(F.col("_id")) & (key[1] == F.col("_hash"))
    once = Window.partitionBy(*key).orderBy(F.xxhash64(*docs.columns))
    repeated = left.join(again, on, "left_semi").withColumn("_copy", F.row_number().over(once)).where(F.col("_copy") == 1).drop("_copy")
    return left.join(again, on, "left_anti").unionByName(repeated)


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's components of documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
