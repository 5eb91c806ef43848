"""Bibliographic items: joins with attachments, filters, facets, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import identifier, isbns
from .overlap import sharing


def described(attachments: DataFrame, items: DataFrame) -> DataFrame:
    """Each attachment with its parent's (or its own) title, year, authors, publication, type and date added."""
    name = lambda c: F.coalesce(F.nullif(c["last_name"], F.lit("")), F.nullif(c["name"], F.lit("")), F.nullif(c["first_name"], F.lit("")))
    people = F.filter("p.creators", lambda c: c["creator_type"].isin("author", "editor"))
    authors = F.filter(F.transform(people, name), lambda x: x.isNotNull())
    year = F.substring(F.try_element_at("p.fields", F.lit("date")), 1, 4)
    met = attachments.alias("a").join(items.alias("p"), F.coalesce("a.parent_id", "a.item_id") == F.col("p.item_id"), "left")
    return met.select(
        "a.key",
        F.col("p.title").alias("title"),
        F.when(year != "0000", year).alias("year"),
        F.array_join(authors, ", ").alias("authors"),
        F.coalesce(F.try_element_at("p.fields", F.lit("publicationTitle")), F.try_element_at("p.fields", F.lit("bookTitle"))).alias("publication"),
        F.col("p.item_type").alias("item_type"),
        F.coalesce("p.date_added", "a.date_added").alias("date_added"),
        (F.coalesce("a.deleted", F.lit(False)) | F.coalesce("p.deleted", F.lit(False)) | F.col("p.item_id").isNull()).alias("missing"),
    )


def added_since(attachments: DataFrame, items: DataFrame, since: Column) -> DataFrame:
    """Attachments whose parent (else they themselves) was added at ``since`` or later."""
    p = items.select(F.col("item_id").alias("_parent"), F.col("date_added").alias("_added"))
    met = attachments.join(p, F.col("parent_id") == F.col("_parent"), "left")
    return met.where(F.coalesce("_added", "date_added") >= since).drop("_parent", "_added")


def enriched(results: DataFrame, passages: DataFrame, items: DataFrame) -> DataFrame:
    """results with the passage of their rowid (else of document and section) and their item; missing: no item, or a deleted one."""
    by_row = passages.select("rowid", F.col("chunk_text").alias("_t1"), F.col("page").alias("_p1"))
    by_place = passages.select("id", "section_number", F.col("chunk_text").alias("_t2"), F.col("page").alias("_p2"))
    df = results.join(by_row, "rowid", "left").join(by_place, ["id", "section_number"], "left")
    df = df.withColumn("chunk_text", F.coalesce("_t1", "_t2")).withColumn("page", F.coalesce("_p1", "_p2")).drop("_t1", "_t2", "_p1", "_p2")
    i = items.select(F.col("key").alias("id"), "item_type", "title", F.lit(True).alias("_there"), F.coalesce("deleted", F.lit(False)).alias("_deleted"))
    df = df.join(i, "id", "left")
    return df.withColumn("missing", F.coalesce("_deleted", F.lit(True)) | F.col("_there").isNull()).drop("_there", "_deleted")


def filtered(results: DataFrame, types: list[str] | None = None, since: Column | None = None, status: str | int = "all") -> DataFrame:
    """By item type, date added (a missing one drops) and status: all, hide-irrelevant, or a number, where null is 0."""
    if types:
        results = results.where(F.col("item_type").isin(types))
    if since is not None:
        results = results.where(F.col("date_added") >= since)
    own = F.coalesce("status", F.lit(0))
    if status == "hide-irrelevant":
        return results.where(own != 2)
    return results if status == "all" else results.where(own == int(status))


def facets(results: DataFrame, column: str = "item_type") -> DataFrame:
    """(item_type, n): how often each occurs; null doesn't count."""
    return results.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def paged(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """The total, and a page."""
    return df.agg(F.count(F.lit(1)).alias("total")), df.orderBy(*order).offset(offset).limit(limit)


def orphans(attachments: DataFrame, deleted: DataFrame) -> DataFrame:
    """Attachments without a parent that aren't deleted."""
    return attachments.where("parent_id is null").join(deleted.where("item_id is not null").select("item_id").distinct(), "item_id", "left_anti")


def identifiers(items: DataFrame) -> DataFrame:
    """(item_id, token): bare DOIs and ISBNs, a row each."""
    doi = F.nullif(identifier(F.try_element_at("fields", F.lit("DOI"))), F.lit(""))
    found = F.concat(F.filter(F.array(doi), lambda x: x.isNotNull()), F.coalesce(isbns(F.try_element_at("fields", F.lit("ISBN"))), F.array().cast("array<string>")))
    return items.select("item_id", F.explode(found).alias("token")).distinct()


def same_identifier(new: DataFrame, items: DataFrame) -> DataFrame:
    """(new_id, item_id): items that share any identifier with a new one."""
    a, b = (identifiers(x).withColumnRenamed("item_id", "id") for x in (new, items))
    return sharing(a, b).select(F.col("a").alias("new_id"), F.col("b").alias("item_id"))


def best_attachment(attachments: DataFrame) -> DataFrame:
    """One attachment of each item: PDFs first, then the oldest."""
    w = Window.partitionBy(F.coalesce("parent_id", "item_id")).orderBy(F.when(F.col("content_type") == "application/pdf", 0).otherwise(1), "date_added", "item_id")
    return attachments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def listed(results: DataFrame) -> DataFrame:
    """(n, line): a numbered line for each document - creators, year, title, its pages, its best similarity."""
    pages = F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: (p + 1).cast("string")), ", ")
    docs = results.groupBy("id", "authors", "year", "title").agg(F.max("similarity").alias("best"), pages.alias("pages"))
    docs = docs.withColumn("n", F.row_number().over(Window.orderBy(F.desc("best"), "id")))
    head = F.concat_ws(", ", F.nullif("authors", F.lit("")), "year", "title")
    return docs.select("n", F.concat(F.col("n").cast("string"), F.lit(". "), head, F.lit(" — p. "), "pages", F.format_string(" (%.3f)", "best")).alias("line"))


def collections(results: DataFrame, query: str) -> DataFrame:
    """(library_id, name, item_ids) to make of the results that are neither missing nor irrelevant."""
    name = query if len(query) <= 60 else query[:60] + "…"
    kept = results.where(~F.col("missing") & (F.coalesce("status", F.lit(0)) != 2))
    return kept.groupBy("library_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).select("library_id", F.lit(name).alias("name"), "item_ids")


def by_value(items: DataFrame, item_data: DataFrame, values: DataFrame, fields: list[str]) -> DataFrame:
    """(item_id, field, value): items' values of some fields, kept as (item_id, field, value_id) and (value_id, value)."""
    met = item_data.where(F.col("field").isin(fields)).join(values, "value_id").join(items.select("item_id").distinct(), "item_id", "left_semi")
    return met.where("value is not null").select("item_id", "field", "value")


def with_fields(items: DataFrame, item_data: DataFrame, values: DataFrame) -> DataFrame:
    """items with all their values as a map."""
    rows = item_data.join(values, "value_id").where("value is not null").groupBy("item_id", "field").agg(F.max("value").alias("value"))
    maps = rows.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    return items.join(maps, "item_id", "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))


def remapped(values: DataFrame, valid: DataFrame, bases: DataFrame) -> DataFrame:
    """(item_id, name, value, ignored): fields under a name that the item's type has - their own, else the type's own for a
    common one, else none. valid: (item_type, name); bases: (item_type, base, name). Empty values go."""
    v = values.withColumn("value", F.trim("value")).where("value != ''")
    own = valid.select("item_type", "name", F.lit(True).alias("_own")).distinct()
    by = bases.join(own.drop("_own"), ["item_type", "name"], "left_semi").select("item_type", F.col("base").alias("name"), F.col("name").alias("_to")).groupBy("item_type", "name").agg(F.min("_to").alias("_to"))
    met = v.join(own, ["item_type", "name"], "left").join(by, ["item_type", "name"], "left")
    name = F.when(F.col("_own"), F.col("name")).otherwise(F.col("_to"))
    return met.select("item_id", F.coalesce(name, F.col("name")).alias("name"), "value", name.isNull().alias("ignored"))


#: Fields that say nothing of how well a file is described.
BARE = ("title", "accessDate", "url", "dateAdded", "dateModified")


def described_files(attachments: DataFrame, parents: DataFrame) -> DataFrame:
    """What is shown of each copy of a file: its parent's title, year, type and numbers. attachments: (key, item_id, parent_id,
    title, date_added, annotations); parents: (item_id, title, item_type, fields, creators, collections, date_added)."""
    p = parents.select(*(F.col(c).alias(f"p_{c}") for c in ("item_id", "title", "item_type", "fields", "creators", "collections", "date_added")))
    df = attachments.join(p, F.col("parent_id") == F.col("p_item_id"), "left")
    filled = F.size(F.map_filter("p_fields", lambda k, v: ~k.isin(*BARE) & v.isNotNull() & (v != "")))
    makers = F.coalesce(F.array_size("p_creators"), F.lit(0))
    here = F.col("p_item_id").isNotNull()
    year = F.substring(F.try_element_at("p_fields", F.lit("date")), 1, 4)
    return df.select(
        "key", F.when(here, F.col("p_title")).otherwise(F.col("title")).alias("title"), F.when(year != "0000", year).alias("year"), F.col("p_item_type").alias("item_type"),
        F.when(here, F.coalesce(filled, F.lit(0)) + makers).otherwise(0).alias("field_count"),
        (here & ((F.coalesce(filled, F.lit(0)) > 0) | (makers > 0))).alias("has_metadata"), F.coalesce("p_date_added", "date_added").alias("date_added"),
        F.coalesce(F.array_size("p_collections"), F.lit(0)).alias("collections"), F.coalesce("annotations", F.lit(0)).alias("annotations"),
    )
