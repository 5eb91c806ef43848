"""From a library to passages: what is unprocessed, what becomes of each document, what is reconciled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encoders import Encoder, embed
from ..functions.texts import normalize_page, too_short
from ..functions.words import chunks, plain_count
from ..models import MODELS, Model

PDF, LINKED_URL = "application/pdf", 3


def library(attachments: DataFrame, deleted: DataFrame) -> DataFrame:
    """Attachments that can be indexed: stored PDFs that aren't deleted."""
    fine = attachments.where((F.col("content_type") == PDF) & (F.col("link_mode") != LINKED_URL))
    return fine.join(deleted.where("item_id is not null").select("item_id").distinct(), "item_id", "left_anti")


def resolved(attachments: DataFrame, data_dir: str, base_dir: str | None = None) -> DataFrame:
    """attachments with file, where their PDF lies; those under an unknown base folder go."""
    p = F.col("path")
    stored = F.concat(F.lit(f"{data_dir}/storage/"), F.col("key"), F.lit("/"), F.substring(p, 9, 1 << 30))
    based = F.concat(F.lit(f"{base_dir}/"), F.substring(p, 13, 1 << 30)) if base_dir else F.lit(None).cast("string")
    return attachments.withColumn("file", F.when(p.startswith("storage:"), stored).when(p.startswith("attachments:"), based).otherwise(p)).where("file is not null")


def unprocessed(keys: DataFrame, excluded: DataFrame, indexed: DataFrame, models: list[str]) -> DataFrame:
    """(id, targets): documents, not excluded, that some models lack, with those models in order. indexed: (id, model)."""
    left = keys.select("id").where("id is not null").distinct().join(excluded.where("id is not null").select("id").distinct(), "id", "left_anti")
    wanted = left.withColumn("model", F.explode(F.array(*map(F.lit, models))))
    lacking = wanted.join(indexed.select("id", "model").distinct(), ["id", "model"], "left_anti")
    return lacking.groupBy("id").agg(F.array_sort(F.collect_set("model")).alias("targets"))


def reconciled(cached: DataFrame, stored: DataFrame) -> DataFrame:
    """(rowid, action): tombstone for rows that only the cache has, load for those that only the store has."""
    c, s = cached.select(F.col("rowid").alias("c")).distinct(), stored.select(F.col("rowid").alias("s")).distinct()
    both = c.join(s, F.col("c") == F.col("s"), "full_outer").where("c is null or s is null")
    return both.select(F.coalesce("c", "s").alias("rowid"), F.when(F.col("s").isNull(), "tombstone").otherwise("load").alias("action"))


def texts(keys: DataFrame, own: DataFrame, host: DataFrame) -> DataFrame:
    """(id, text, origin): from the engine's cache, else the host's if it is complete; null where an extractor is needed."""
    o = own.select("id", F.col("text").alias("_own"))
    h = host.where("complete").select("id", F.col("text").alias("_host"))
    df = keys.join(o, "id", "left").join(h, "id", "left")
    origin = F.when(F.col("_own").isNotNull(), "own").when(F.col("_host").isNotNull(), "host")
    return df.select("id", F.coalesce("_own", "_host").alias("text"), origin.alias("origin"))


def outcomes(documents: DataFrame) -> DataFrame:
    """documents (id, pages, error) with status: index, retry (the extractor died or ran out of time), encrypted, unreadable or
    no_text, and normalised pages."""
    pages = F.transform("pages", normalize_page)
    error = F.lower("error")
    status = (
        F.when(error.rlike(r"\b(time ?out|timeouterror|timed out|time limit|crash(ed)?|unavailable)\b"), "retry")
        .when(error.rlike("password|encrypt"), "encrypted")
        .when(error.isNotNull(), "unreadable")
        .when(F.col("pages").isNull() | too_short(F.array_join("pages", "")), "no_text")
        .otherwise("index")
    )
    return documents.withColumn("status", status).withColumn("pages", pages)


def passages(documents: DataFrame, model: Model | str, count: Callable[[str], int] = plain_count) -> DataFrame:
    """(id, model, section_number, chunk_text, page, char_start, char_start_utf16, pieces, scheme) of documents (id, pages)."""
    m = MODELS[model] if isinstance(model, str) else model
    cut = documents.select("id", F.posexplode(chunks(m.max_pieces, count)("pages")).alias("section_number", "c"))
    return cut.select("id", F.lit(m.id).alias("model"), "section_number", F.col("c.text").alias("chunk_text"), "c.page", "c.char_start", "c.char_start_utf16", "c.pieces", F.lit(2).alias("scheme"))


def indexed(documents: DataFrame, model: Model | str, encoder: Encoder, count: Callable[[str], int] = plain_count) -> DataFrame:
    """Passages with vectors of the documents whose outcome is index."""
    m = MODELS[model] if isinstance(model, str) else model
    if encoder.dim != m.dim:
        raise ValueError(f"{m.id} has {m.dim} dimensions, the encoder {encoder.dim}")
    fine = outcomes(documents).where("status = 'index'")
    return embed(passages(fine, m, count), "chunk_text", encoder, m.passage_prefix)


def statistics(log: DataFrame) -> DataFrame:
    """Documents by status and passages a second of a log (id, status, passages, seconds)."""
    return log.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "index").alias("done"),
        F.count_if(F.col("status") == "retry").alias("failed"),
        F.count_if(~F.col("status").isin("index", "retry")).alias("excluded"),
        (F.sum("passages") / F.nullif(F.sum("seconds"), F.lit(0.0))).alias("passages_per_second"),
    )


def promoted(state: dict, model_ready: bool) -> dict:
    """The model switch: {active, building} moves on when the pass over the library is complete."""
    return {"active": state["building"], "building": None} if state.get("building") and model_ready else dict(state)
