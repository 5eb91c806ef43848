"""Ranking of passages against queries.

Passages have (rowid, id, section_number, embedding), queries (qid, segment, vec). A stated set of query segments goes against
all passages in blocks, by matrix products over Arrow batches; nothing but what may be returned leaves a task.
Every order ends with rowid, so ties are settled alike everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from ..functions.vectors import cosine, dequantized, quantized8, unit

#: Added below a threshold, and below the last score kept, when scores are approximate.
MARGIN = 0.02
#: Query segments in a block; pairs scored at once; error that a matrix product may have beside the sum in order.
MOST_QUERIES, PAIRS, SLACK = 10_000, 1 << 21, 1e-9


def usable(passages: DataFrame, dim: int, vec: str = "embedding") -> DataFrame:
    """Rows with a vector of the model's dimension."""
    return passages.where(F.col(vec).isNotNull() & (F.size(vec) == dim))


def restricted(passages: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Passages of some documents only, before any scoring; unknown keys don't matter."""
    return passages.join(keys.select(F.col(key).alias("_key")).distinct(), F.col(key) == F.col("_key"), "left_semi")


def blocks(queries: DataFrame, names: list[str]) -> Iterator[list[Row]]:
    """The rows of a stated set of queries, MOST_QUERIES at a time; the driver holds one block."""
    held: list[Row] = []
    for row in queries.select(*names).toLocalIterator():
        held.append(row)
        if len(held) == MOST_QUERIES:
            yield held
            held = []
    if held:
        yield held


def _matrix(vectors: list[list[float]]) -> np.ndarray:
    return np.array(vectors, np.float64).reshape(len(vectors), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.cumsum(x * x, axis=1)[:, -1])
    return np.where(n, n, 1)


def _bound(near: np.ndarray, k: int) -> np.ndarray:
    """For each column a value that k or more rows reach: the k-th of the largest in groups of rows."""
    groups = min(len(near), max(64, 4 * k))
    most = np.fmax.reduce(near[: len(near) // groups * groups].reshape(groups, -1, near.shape[1]), axis=1)
    return np.partition(np.where(np.isnan(most), -np.inf, most), -k, axis=0)[-k]


def _ranked(whose: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of each one's k best, ties to the smaller id; and of each k-th."""
    order = np.lexsort((ids, -score, whose))
    start = np.flatnonzero(np.diff(whose[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
    return order[rank < k], order[rank == k - 1]


def scored(passages: DataFrame, queries: DataFrame, least: float | None = None, best: int | None = None) -> DataFrame:
    """passages (without their vectors) x queries with similarity, the exact cosine; of least or more, and only each query's
    best in every task's passages, if wanted. Passages with a vector of another length than the queries' take no part.

    Matrix products over Arrow batches find the pairs; what is left is summed in order, so equal vectors score alike. Queries
    come in blocks, each sent to the executors once.
    """
    names = [c for c in passages.columns if c != "embedding"]
    kinds = {c: queries.schema[c].dataType for c in ("qid", "segment")}
    schema = StructType([passages.schema[c] for c in names] + [queries.schema["qid"], queries.schema["segment"]]).add("similarity", "double")
    at_row = names.index("rowid") if best else -1
    inner = [*(f"_{n}" for n in range(len(names))), "_j", "_exact"]

    def of(block: list[Row]) -> DataFrame:
        vectors = _matrix([r.vec for r in block])
        asked = [pa.array([r[c] for r in block], to_arrow_type(kinds[c])) for c in kinds]
        sent = passages.sparkSession.sparkContext.broadcast((vectors, vectors / _norms(vectors)[:, None]))

        def asking(found: pa.Table) -> Iterator[pa.RecordBatch]:
            whose = found["_j"]
            columns = [*(found.column(c) for c in range(len(names))), *(pa.chunked_array([x]).take(whose) for x in asked), found["_exact"]]
            yield from pa.Table.from_arrays(columns, schema=to_arrow_schema(schema)).combine_chunks().to_batches()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, q_unit = sent.value
            held: list[pa.Table] = []
            # single precision finds the pairs, so its error is allowed for as well
            q_unit, slack = q_unit.astype(np.float32), SLACK + (q.shape[1] + 8) * 2.0**-23
            floor, kept = np.full(len(q), -np.inf), None
            for b in batches:
                if not b.num_rows:
                    continue
                v = b.column(len(names)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                norm = _norms(v)
                v_unit = (v / norm[:, None]).astype(np.float32)
                step = max(1, PAIRS // b.num_rows)
                for k in range(0, len(q), step):
                    near = v_unit @ q_unit[k : k + step].T
                    enough = np.full(near.shape[1], -np.inf if least is None else least)
                    if best and b.num_rows > best:
                        enough = np.fmax(enough, np.fmax(_bound(near, best), floor[k : k + step]))
                    i, j = np.divmod(np.flatnonzero(~(near < (enough - slack).astype(np.float32))), near.shape[1])
                    exact = np.empty(len(i))
                    for n in range(0, len(i), 1 << 14):
                        x, y = v[i[n : n + (1 << 14)]], q[k + j[n : n + (1 << 14)]]
                        exact[n : n + (1 << 14)] = np.cumsum(x * y, axis=1)[:, -1] / (norm[i[n : n + (1 << 14)]] * _norms(y))
                    keep = np.ones(len(i), bool) if least is None else exact >= least
                    i, j, exact = i[keep], k + j[keep], exact[keep]
                    if best:
                        order, _ = _ranked(j, exact, b.column(at_row).to_numpy(zero_copy_only=False)[i], best)
                        i, j, exact = i[order], j[order], exact[order]
                    found = pa.Table.from_arrays([*(b.column(c).take(pa.array(i)) for c in range(len(names))), pa.array(j), pa.array(exact)], names=inner)
                    if best:
                        held.append(found)
                    else:
                        yield from asking(found)
                if best:
                    kept = pa.concat_tables(held if kept is None else [kept, *held]).combine_chunks()
                    held = []
                    j, exact = kept["_j"].to_numpy(), kept["_exact"].to_numpy()
                    order, full = _ranked(j, exact, kept.column(at_row).to_numpy(), best)
                    floor[j[full]] = exact[full]
                    kept = kept.take(pa.array(order))
            if kept is not None:
                yield from asking(kept)

        good = usable(passages, vectors.shape[1]).select(*names, "embedding")
        if best:  # a table of few bytes, read by few tasks, may be much work
            good = good.repartition(passages.sparkSession.sparkContext.defaultParallelism, "rowid")
        return good.mapInArrow(run, schema)

    out = [of(b) for b in blocks(queries, ["qid", "segment", "vec"])]
    return reduce(DataFrame.unionByName, out) if out else passages.sparkSession.createDataFrame([], schema)


def scan(passages: DataFrame, queries: list[tuple[int, int, list[float]]], least: float, block: int = 1024, approximate: bool = False) -> DataFrame:
    """(qid, segment, rowid, similarity >= least) by matrix products over Arrow batches, with queries in blocks.

    approximate: passages in 8 bits and queries in 16, as an index keeps them; the error stays below 0.01.
    """
    q = np.array([v for _, _, v in queries], np.float64).reshape(len(queries), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    qid, segment = np.array([a for a, _, _ in queries], np.int64), np.array([b for _, b, _ in queries], np.int32)
    if approximate:
        s = np.maximum(np.abs(q).max(1, keepdims=True, initial=0) / 32767, 1e-9)
        q = np.floor(q / s + 0.5) * s
    sent = passages.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            v = v / np.where(n, n, 1)
            if approximate:
                s = np.abs(v).max(1, keepdims=True) / 127
                s[s == 0] = 1e-9
                v = np.floor(v / s + 0.5) * s
            rowid = b.column(0).to_numpy()
            for k in range(0, len(sent.value), block):
                score = v @ sent.value[k : k + block].T
                i, j = np.nonzero(score >= least)
                yield pa.RecordBatch.from_arrays([pa.array(qid[k + j]), pa.array(segment[k + j]), pa.array(rowid[i]), pa.array(score[i, j])], names=["qid", "segment", "rowid", "similarity"])

    return passages.select(F.col("rowid").cast("long"), "embedding").mapInArrow(run, "qid long, segment int, rowid long, similarity double")


def top(scores: DataFrame, k: int, by: list[str], order: list[Column] | None = None) -> DataFrame:
    """The k best rows of each group, with rank from 1."""
    w = Window.partitionBy(*by).orderBy(*(order or [F.desc("similarity"), F.asc("rowid")]))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pooled(scores: DataFrame) -> DataFrame:
    """Per query and passage the best segment's score, and the first segment that reaches it."""
    keep = [c for c in scores.columns if c not in ("qid", "rowid", "segment", "similarity", "vec", "embedding")]
    best = F.max(F.struct("similarity", (-F.col("segment")).alias("o"))).alias("b")
    out = scores.groupBy("qid", "rowid").agg(best, *(F.first(c).alias(c) for c in keep))
    return out.select("qid", "rowid", *keep, F.col("b.similarity").alias("similarity"), (-F.col("b.o")).alias("segment"))


def collapsed(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of other documents with the same section and, to seven places, the same similarity become one, which lists them.

    First a document's own repeats go, then copies in other documents; the best row stays.
    """
    exact = F.col("similarity").cast("decimal(10,7)")
    order = [F.desc("similarity"), F.asc("rowid")]
    once = Window.partitionBy("qid", "id", "section_number").orderBy(*order)
    df = results.withColumn("_n", F.row_number().over(once)).where("_n = 1").withColumn("_print", exact)
    same = Window.partitionBy("qid", "section_number", "_print").orderBy(*order)
    others = F.collect_list("id").over(same.rowsBetween(1, Window.unboundedFollowing))
    df = df.withColumn("_n", F.row_number().over(same)).withColumn("duplicates", others).where("_n = 1").drop("_n", "_print")
    return top(df, limit, ["qid"]).drop("rank") if limit else df


def rank(passages: DataFrame, queries: DataFrame, least: float, limit: int, keys: DataFrame | None = None, cut_first: bool = False) -> DataFrame:
    """Search: score, pool segments, threshold, collapse, limit. cut_first: collapse after the limit, as if rows were cut early."""
    if keys is not None:
        passages = restricted(passages, keys)
    rows = pooled(scored(passages, queries, least))
    if cut_first:
        rows = top(rows, limit, ["qid"]).drop("rank")
    return top(collapsed(rows), limit, ["qid"])


def two_phase(passages: DataFrame, queries: list[tuple[int, int, list[float]]], least: float, limit: int, collapse: bool = True) -> DataFrame:
    """rank() by way of an approximate scan: candidates a margin below the threshold and below the limit's score, then exact.

    The cut comes before identical results collapse, as in an index, so fewer than limit rows may be left.
    """
    near = scan(passages, queries, least - MARGIN, approximate=True)
    best = near.groupBy("qid", "rowid").agg(F.max("similarity").alias("similarity"))
    kth = top(best, limit, ["qid"]).groupBy("qid").agg(F.when(F.count(F.lit(1)) >= limit, F.min("similarity")).alias("kth"))
    wanted = best.join(kth, "qid").where(F.col("kth").isNull() | (F.col("similarity") >= F.col("kth") - MARGIN)).select("qid", "rowid")
    q = passages.sparkSession.createDataFrame(queries, "qid long, segment int, vec array<double>")
    q = F.broadcast(q) if len(queries) <= MOST_QUERIES else q
    exact = wanted.join(passages, "rowid").join(q, "qid").withColumn("similarity", cosine(F.col("embedding"), F.col("vec")))
    rows = pooled(exact.where(F.col("similarity") >= least).drop("embedding", "vec"))
    return top(collapsed(rows) if collapse else rows, limit, ["qid"])


def centroids(passages: DataFrame) -> DataFrame:
    """(id, centroid): the unit vector along the sum of a document's unit vectors."""
    parts = passages.select("id", F.posexplode(unit(F.col("embedding"))).alias("k", "x")).groupBy("id", "k").agg(F.sum("x").alias("x"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda t: t["x"])
    return parts.groupBy("id").agg(vec.alias("v")).select("id", unit(F.col("v")).alias("centroid"))


def approximate_centroids(passages: DataFrame) -> DataFrame:
    """Centroids of what an index of 8-bit vectors holds."""
    q = passages.withColumn("q", quantized8(F.col("embedding")))
    return centroids(q.withColumn("embedding", dequantized(F.col("q.q"), F.col("q.scale"))))


def similar_documents(passages: DataFrame, sources: DataFrame, limit: int = 20, missing: DataFrame | None = None) -> DataFrame:
    """(source, id, best, mean, rowid, rank): documents nearest to each source's centroid, itself left out before the limit and
    missing ones after it. sources: (id, centroid).

    A batch of passages gives one row for each source and document that it holds."""
    kind = passages.schema["id"].dataType.simpleString()
    schema = f"source {sources.schema['id'].dataType.simpleString()}, id {kind}, best double, rowid long, total double, n long"

    def of(block: list[Row]) -> DataFrame:
        centers = _matrix([r.centroid for r in block])
        names = pa.array([r.id for r in block])
        sent = passages.sparkSession.sparkContext.broadcast(centers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                doc, rowid = b.column(0).dictionary_encode(), b.column(1).to_numpy()
                code = doc.indices.to_numpy()
                order = np.lexsort((rowid, code))
                first = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
                size = np.diff(np.concatenate([first, [len(order)]]))
                v, rowid, group = (v / _norms(v)[:, None])[order], rowid[order], np.repeat(np.arange(len(first)), size)
                step = max(1, PAIRS // b.num_rows)
                for k in range(0, len(sent.value), step):
                    score = v @ sent.value[k : k + step].T
                    even = np.round(score, 12)  # so that equal vectors tie
                    best = np.maximum.reduceat(even, first)
                    row = np.minimum.reduceat(np.where(even == best[group], rowid[:, None], np.iinfo(np.int64).max), first)
                    total = np.add.reduceat(score, first)
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(first)), np.arange(score.shape[1]), indexing="ij"))
                    of_doc = doc.dictionary.take(pa.array(code[order][first][i]))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(k + j)), of_doc, pa.array(best[i, j]), pa.array(row[i, j]), pa.array(total[i, j]), pa.array(size[i])], names=["source", "id", "best", "rowid", "total", "n"])

        rows = usable(passages, centers.shape[1]).where("id is not null").select("id", F.col("rowid").cast("long").alias("rowid"), "embedding")
        return rows.mapInArrow(run, schema).where("id != source")

    parts = [of(b) for b in blocks(sources, ["id", "centroid"])]
    hits = reduce(DataFrame.unionByName, parts) if parts else passages.sparkSession.createDataFrame([], schema)
    b = F.max(F.struct("best", (-F.col("rowid")).alias("o"))).alias("b")
    docs = hits.groupBy("source", "id").agg(b, (F.sum("total") / F.sum("n")).alias("mean"))
    docs = docs.select("source", "id", F.col("b.best").alias("best"), "mean", (-F.col("b.o")).alias("rowid"))
    docs = top(docs, limit, ["source"], [F.desc("best"), F.asc("rowid")])
    return docs if missing is None else docs.join(missing.select("id").distinct(), "id", "left_anti")


def grouped_by_document(results: DataFrame) -> DataFrame:
    """(qid, id, best, n, members): members in rank order, groups by best."""
    members = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("o"), "rowid"))), lambda t: t["rowid"])
    return results.groupBy("qid", "id").agg(F.max("similarity").alias("best"), F.count(F.lit(1)).alias("n"), members.alias("members"))


def best_per_document(results: DataFrame) -> DataFrame:
    return top(results, 1, ["qid", "id"]).drop("rank")


def context(passages: DataFrame, wanted: DataFrame, around: int = 1) -> DataFrame:
    """(id, section_number, text): a passage with its neighbours, joined by spaces. wanted: (id, section_number)."""
    around = max(0, min(5, around))
    here = F.col("section_number")
    w = wanted.select("id", here.alias("_s"), F.explode(F.sequence(here - around, here + around)).alias("section_number"))
    met = passages.join(w, ["id", "section_number"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_number", "chunk_text"))), lambda t: t["chunk_text"]), " ")
    return met.groupBy("id", F.col("_s").alias("section_number")).agg(text.alias("text"))


def shaped(results: DataFrame, most: int = 2500) -> DataFrame:
    """What the tools return: similarity to four places, pages from 1, days, texts cut."""
    from ..functions.texts import truncated
    from ..functions.vectors import round_to

    return results.select(
        "*",
        round_to(F.col("similarity"), 4).alias("score"),
        (F.col("page") + 1).alias("page_number"),
        F.substring(F.col("date").cast("string"), 1, 10).alias("day"),
        truncated(F.col("chunk_text"), most).alias("shown"),
    )
