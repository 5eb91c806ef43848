"""A search from words to a saved list: probe the cache, embed, rank, mark what matched, carry statuses, filter, save.

History and passages are DataFrames, and so is what comes out; the driver holds a query's few segments and one saved row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encoders import Encoder, query_segments
from ..functions.texts import excerpt, history_id
from ..models import MAX_RESULTS, MODELS, Model, positive
from . import search as s
from . import store


class ModelMissing(RuntimeError):
    """The encoder's files aren't there."""


@dataclass
class Found:
    """results (similarity, folder_id, file_name, section_number, rowid, status, page, duplicates, matched) of a search; history
    with the search saved, or as it was."""

    id: str
    query: str
    results: DataFrame
    history: DataFrame
    from_cache: bool = False
    saved: bool = False
    vectors: list[list[float]] = field(default_factory=list)


def shape(results: DataFrame) -> DataFrame:
    """What of a result is kept in the history."""
    kinds = {"similarity": "double", "folder_id": "string", "file_name": "string", "section_number": "int", "rowid": "bigint", "status": "tinyint", "page": "int", "duplicates": "array<string>", "matched": "string"}
    return results.select(*((F.col(c) if c in results.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()))


def with_matched(results: DataFrame, segments: list[str], most: int = 90) -> DataFrame:
    """results with the part of a long query that each passage matches; none for the whole query, and for short ones."""
    if len(segments) < 2:
        return results.withColumn("matched", F.lit(None).cast("string")).drop("segment")
    parts = results.sparkSession.createDataFrame(list(enumerate(segments)), "segment int, _part string")
    parts = F.broadcast(parts.select("segment", excerpt(F.col("_part"), most).alias("_part")))  # a query's segments
    met = results.join(parts, "segment", "left")
    return met.withColumn("matched", F.when(F.col("segment") > 0, F.col("_part"))).drop("segment", "_part")


def excluding(history: DataFrame, id: str, folder_id: str) -> DataFrame:
    """history with one document's rows taken out of a saved search."""
    mine = F.filter("results", lambda r: ~F.coalesce(r["folder_id"] == folder_id, F.lit(False)))
    return history.withColumn("results", F.when(F.col("id") == id, mine).otherwise(F.col("results")))


class Searcher:
    """Searches of one model. history: see schemas."""

    def __init__(self, passages: DataFrame, model: Model | str, encoder: Encoder | None, today: Column | None = None):
        self.model = MODELS[model] if isinstance(model, str) else model
        self.passages, self.encoder = passages, encoder
        self.spark, self.today = passages.sparkSession, today if today is not None else F.current_timestamp()

    def name(self, query: str, source: str = "manual") -> str:
        return self.spark.range(1).select(history_id(F.lit(query), F.lit(self.model.id), F.lit(source)).alias("id")).first().id

    def search(
        self, query: str, history: DataFrame, source: str = "manual", use_cache: bool = True, keys: DataFrame | None = None, least: float | None = None, limit: int = MAX_RESULTS,
        save: bool = True, carry_from: str | None = None, keep: Callable[[DataFrame], DataFrame] | None = None,
    ) -> Found:
        """The best passages for a query. A search within some documents (keys) is neither taken from the history nor, unless an
        assistant makes it, saved. Without the model, saved results do, though they be old."""
        query = query.strip()
        if not query:
            raise ValueError("the query is empty")
        source = "mcp" if source == "mcp" else "manual"
        least = positive(least, self.model.min_similarity)
        id, own = self.name(query, source), self.name(query)
        saved = history.where((F.col("id") == own) & (F.size("results") > 0)) if use_cache and keys is None else None
        if self.encoder is None:
            if saved is not None and not saved.isEmpty():
                return Found(own, query, saved.select(F.inline("results")), history, True)
            raise ModelMissing(self.model.id)
        state = store.state_key(self.passages).first().state
        if saved is not None:
            same = store.reusable(saved, state, least)
            if not same.isEmpty():
                return Found(own, query, same.select(F.inline("results")), history, True)
        parts = query_segments(query, self.encoder, self.model)
        q = self.spark.createDataFrame([(0, i, v) for i, _, v in parts], "qid long, segment int, vec array<double>")
        rows = self.passages.select("rowid", "id", "section_number", "embedding")
        found = s.rank(rows, q, least, limit, keys).select("rowid", F.col("id").alias("folder_id"), "section_number", "similarity", "segment", "duplicates")
        found = with_matched(found, [t for _, t, _ in parts])
        about = self.passages.select("rowid", "page", "file_name")
        found = found.join(about, "rowid", "left")
        old = history.where(F.col("id") == id).select(F.inline("results"))
        found = store.carried_by_section(found.withColumn("status", F.lit(None).cast("tinyint")), old)
        if carry_from and carry_from != id:
            other = history.where(F.col("id") == carry_from).select(F.posexplode("results").alias("rank", "r")).select("rank", "r.*")
            mine = found.select("rowid", F.col("status").alias("_mine"))
            found = store.carried_by_page(found, other).join(mine, "rowid").withColumn("status", F.coalesce("_mine", "status")).drop("_mine")
        if keep is not None:
            found = keep(found)
        results = shape(found)
        kept = save and (keys is None or source == "mcp")
        if kept:
            row = results.agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("o"), "rowid", F.struct("*").alias("r")))).alias("a"))
            row = row.select(
                F.lit(id).alias("id"), self.today.alias("date"), F.lit(query).alias("query"), F.array(*(F.array(*map(F.lit, v)) for _, _, v in parts)).cast("array<array<float>>").alias("query_embedding"),
                F.transform("a", lambda x: x["r"]).alias("results"), F.lit(self.model.id).alias("model"), F.lit(source).alias("source"), F.lit(state).alias("index_state"), F.lit(float(least)).alias("min_similarity"),
            )
            history = store.saved(history, row.select(*(c for c in history.columns if c in row.columns)))
        return Found(id, query, results, history, False, kept, [v for _, _, v in parts])

    def by_abstract(self, items: DataFrame, key: str, history: DataFrame, **options) -> Found:
        """A search with an item's abstract for its query."""
        row = items.where(F.col("key") == key).select(F.try_element_at("fields", F.lit("abstractNote")).alias("a")).first()
        if row is None or not (row.a or "").strip():
            raise ValueError(f"{key} has no abstract")
        return self.search(row.a, history, **options)


def located(places: DataFrame, encoder: Encoder, window: int = 900, reach: float = 1.5) -> DataFrame:
    """(rowid, char_start, match, chunk_text, page): where in its document each old passage stands that was kept without its text.

    places: (rowid, text, starts, section_number, sections, embedding). Windows around the place that the passage's number
    suggests are embedded, and the best one's neighbourhood once more, finer. Windows begin at words.
    """
    import numpy as np
    import pandas as pd

    from ..functions.vectors import as_doubles

    sent = places.sparkSession.sparkContext.broadcast(encoder)

    def word(text: str, at: float) -> int:
        return text.rfind(" ", 0, min(len(text), int(at + 0.5) + 1)) + 1

    def best(text: str, starts: list[int], vector: np.ndarray) -> tuple[float, int]:
        found = sent.value.encode([" ".join(text[a : a + window].split()) for a in starts]).astype(np.float64) @ vector
        k = int(found.argmax())
        return float(found[k]), starts[k]

    def one(text: str, section: int, sections: int, vector: np.ndarray) -> tuple[int, float]:
        n = max(sections, section + 1)
        span, center = len(text) / n, section / n * len(text)
        step = max(80, int(span / 16 + 0.5))
        coarse = np.arange(max(0.0, center - reach * span), min(len(text) - 1, center + reach * span) + 1e-9, step)
        top, at = best(text, list(dict.fromkeys(word(text, a) for a in coarse)) or [0], vector)
        fine = np.arange(at - step, at + step + 1e-9, max(15.0, step / 8))
        near = [x for x in dict.fromkeys(word(text, a) for a in fine if 0 <= a < len(text)) if x != at]
        if near:
            again, there = best(text, near, vector)
            if again > top:
                top, at = again, there
        return at, top

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples():
                if not r.text:
                    continue
                at, match = one(r.text, r.section_number, r.sections, np.asarray(r.embedding, np.float64))
                end = min(len(r.text), at + 1200)
                after = r.text.find(" ", end)
                end = after if after != -1 and after < end + 40 else end
                page = max(0, int(np.searchsorted(np.asarray(r.starts if r.starts is not None else [0]), at, "right")) - 1)
                out.append((r.rowid, at, match, " ".join(r.text[at:end].split()), page))
            yield pd.DataFrame(out, columns=["rowid", "char_start", "match", "chunk_text", "page"])

    cols = places.select("rowid", "text", "starts", "section_number", "sections", as_doubles(F.col("embedding")).alias("embedding"))
    return cols.mapInPandas(run, "rowid long, char_start int, match double, chunk_text string, page int")
