"""Nearest neighbours by cosine from randomly rotated one-bit codes.

Unit vectors, less their mean, are padded with zeros to ``bits`` dimensions, rotated at random and kept as signs, packed.
With the sign vector s (scaled to length 1), a residual o and a query residual q, <s, q> / <s, o> estimates <o, q>; its error
stays below ``epsilon * sqrt((1 - <s, o>^2) / <s, o>^2) / sqrt(bits - 1)`` with high probability. The rows whose upper bound
reaches the k-th exact score found so far are scored exactly on their original vectors, in double precision.

Every row is indexed; the mean is over all rows, and nothing is fitted on a sample. Stated queries go against all rows in
blocks: a task holds one block of the index and streams blocks of queries from the shared folder; what it returns are k rows
a query, merged by a ranked window.

Defined cases: vectors that are null, zero, of another dimension than most, or that hold null or non-finite components take
no part; rows of the query's own id aren't its neighbours; ties go to the smaller id; repeated rows with another id are
ordinary neighbours; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, scratch, table, written

#: Rows of an index block and of a query block.
INDEX_ROWS, QUERY_ROWS = 32768, 256


def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """bits x dim, orthonormal columns."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def usable(v: Column, dim: int) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & fine & F.exists(v, lambda x: x != 0)


def stacked(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very small or large components are lost
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, length of the residual and <s, o>."""
    rest = unit(vectors) - mean
    size = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(size, size, 1)[:, None]) @ turn.T
    return np.packbits(turned >= 0, axis=1), size, np.abs(turned).sum(1) / np.sqrt(turn.shape[0])


def _mean(good: DataFrame, dim: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for b in batches:
            total += unit(stacked(b.column(0), dim)).sum(0)
            n += b.num_rows
        yield pa.RecordBatch.from_pydict({"k": [*range(dim), dim], "x": [*total, float(n)]})

    rows = arrow(good.select("vector"), run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    found = np.zeros(dim + 1)
    for r in rows:
        found[r.k] = r.x
    return found[:dim] / max(found[dim], 1)


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, bits: int | None = None, epsilon: float = 2.5, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each query row of vectors."""
    spark = vectors.sparkSession
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    sizes = named.where(F.col("vector").isNotNull()).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None or sizes.n < 1:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(sizes.n)
    bits = bits or -(-2 * dim // 64) * 64
    good = named.where(F.col("id").isNotNull() & usable(F.col("vector"), dim))
    mean, turn = _mean(good, dim), rotation(dim, bits, seed)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                packed, size, agree = codes(stacked(b.column(1), dim), mean, turn)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(size), pa.array(agree)], names=["id", "vector", "asks", "code", "size", "agree"])

    kind = named.schema["vector"].dataType.simpleString()
    indexed = written(arrow(good, index, f"id long, vector {kind}, asks boolean, code binary, size double, agree double"), "ann-index")
    folder = scratch(spark, "ann-queries")
    indexed.where("asks").select("id", "vector").write.parquet(folder)

    def query_blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        where, inner = fs.FileSystem.from_uri(folder)
        for f in sorted(x.path for x in where.get_file_info(fs.FileSelector(inner)) if x.path.endswith(".parquet")):
            with where.open_input_file(f) as opened:
                for b in pq.ParquetFile(opened).iter_batches(QUERY_ROWS):
                    if b.num_rows:
                        yield b.column(0).to_numpy(), stacked(b.column(1), dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= INDEX_ROWS:
                yield from block(held)
                held = []
        if held:
            yield from block(held)

    def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        if not t.num_rows:
            return
        ids = t["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, raw = ids[order], stacked(t["vector"].combine_chunks(), dim)[order]
        packed = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        signs = (np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(bits))
        size, agree = t["size"].to_numpy()[order], t["agree"].to_numpy()[order]
        safe = np.where(agree > 0, agree, 1)
        slack = np.where(size > 0, size * epsilon * np.sqrt(np.maximum(1 - safe**2, 0)) / safe / np.sqrt(bits - 1), 0)
        scale = raw / np.abs(raw).max(1, keepdims=True)
        norm = np.sqrt(np.einsum("ij,ij->i", scale, scale))
        middle = unit(raw) @ mean - mean @ mean
        for q_ids, q_raw in query_blocks():
            q_scale = q_raw / np.abs(q_raw).max(1, keepdims=True)
            q_norm = np.sqrt(np.einsum("ij,ij->i", q_scale, q_scale))
            q_unit = q_scale / q_norm[:, None]
            q_rest = q_unit - mean
            q_size = np.linalg.norm(q_rest, axis=1)
            near = (q_rest @ turn.T).astype(np.float32) @ signs.T  # <s, q> times the query residual's length
            guess = near * (size / safe)[None] + middle[None] + (q_unit @ mean)[:, None]
            out_q, out_v, out_s = [], [], []
            for i in range(len(q_ids)):
                own = ids == q_ids[i]
                g = np.where(own, -np.inf, guess[i])
                m = min(k, len(ids) - int(own.sum()))
                if m < 1:
                    continue

                def exact(at: np.ndarray, i: int = i) -> np.ndarray:
                    return np.einsum("ij,j->i", scale[at], q_scale[i]) / (norm[at] * q_norm[i])

                first = np.argpartition(-g, m - 1)[:m]
                least = exact(first).min()
                again = np.flatnonzero(g + slack * q_size[i] >= least - 1e-12)
                again = np.union1d(again, first)
                score = exact(again)
                best = np.lexsort((ids[again], -score))[:m]
                out_q.append(np.full(m, q_ids[i]))
                out_v.append(ids[again][best])
                out_s.append(score[best])
            if out_q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))], names=["query_id", "vec_id", "score"])

    partial = arrow(indexed.select("id", "vector", "code", "size", "agree"), search, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_nearest(spark, sf_dir: str) -> DataFrame:
    """The contract's search of embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
