"""Byte-identical files: hashes, groups, and the edits that merge a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def to_hash(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Files that have no hash yet, or whose size or time has changed since."""
    h = hashes.select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    return files.join(h, (F.col("key") == F.col("_key")) & (F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), "left_anti")


def pruned(hashes: DataFrame, live: DataFrame) -> DataFrame:
    """hashes of keys that still exist."""
    return hashes.join(live.select("key").distinct(), "key", "left_semi")


def groups(hashes: DataFrame, ignored: DataFrame, live: DataFrame) -> DataFrame:
    """(hash, size, n, keys): hashes of two or more live files that aren't ignored."""
    known = ignored.where("hash is not null").select("hash").distinct()
    fine = hashes.join(live.select("key").distinct(), "key", "left_semi").join(known, "hash", "left_anti")
    return fine.groupBy("hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("key")).alias("keys")).where("n > 1")


def keeper(members: DataFrame) -> DataFrame:
    """(hash, key): the file of each group to keep - one under the master item, then the one with most annotations, then the oldest."""
    order = F.struct((F.col("parent_id") != F.col("master_id")).cast("int").alias("a"), (-F.col("annotations")).alias("b"), "date_added", "key")
    return members.groupBy("hash").agg(F.min_by("key", order).alias("key"))


def preview_keeper(members: DataFrame) -> DataFrame:
    """(hash, key): what the reader is shown - of files with a parent the one modified last, else the one added first."""
    w = Window.partitionBy("hash").orderBy(
        F.col("parent_id").isNull(), F.when(F.col("parent_id").isNotNull(), F.col("date_modified")).desc_nulls_last(), F.col("date_added"), F.col("key")
    )
    return members.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("hash", "key")


def merged_fields(parents: DataFrame) -> DataFrame:
    """(hash, fields): parents' fields folded from oldest to newest; later values win, empty ones never do."""
    rows = parents.select("hash", "date_modified", "item_id", F.explode("fields").alias("name", "value")).where("value is not null and value != ''")
    last = rows.groupBy("hash", "name").agg(F.max_by("value", F.struct("date_modified", "item_id")).alias("value"))
    return last.groupBy("hash").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))


def merge_plan(members: DataFrame, parents: DataFrame) -> DataFrame:
    """(hash, key, action, target): the edits that make one of each group.

    members: (hash, key, parent_id, annotations, date_added); parents: (hash, item_id, date_modified, fields, ...). The master is
    the newest parent. Its best file is kept; the others hand over their annotations and are trashed.
    """
    master = parents.groupBy("hash").agg(F.max_by("item_id", F.struct("date_modified", "item_id")).alias("master_id"))
    own = members.join(master, "hash", "left")
    best = keeper(own.withColumn("master_id", F.coalesce("master_id", F.lit(-1))).withColumn("parent_id", F.coalesce("parent_id", F.lit(-2)))).withColumnRenamed("key", "target")
    met = own.join(best, "hash")
    action = F.when(F.col("key") == F.col("target"), "keep").when(F.col("annotations") > 0, "move_annotations_and_trash").otherwise("trash")
    return met.select("hash", "key", action.alias("action"), "target", "master_id")


def empty_parents(parents: DataFrame, attachments: DataFrame, notes: DataFrame, trashed: DataFrame) -> DataFrame:
    """Parents that can be trashed: all their attachments are, and they have no notes."""
    left = attachments.join(trashed.select("key").distinct(), "key", "left_anti").select(F.col("parent_id").alias("item_id"))
    busy = left.unionByName(notes.select(F.col("parent_id").alias("item_id"))).where("item_id is not null").distinct()
    return parents.join(busy, "item_id", "left_anti")
