"""Tables as versioned Parquet folders, and the mutations of the stores.

A table is a folder of versions; the highest with a marker counts. A writer makes a folder of its own, ``v=N-...``, and then, in
one step, its marker ``_done-N-...``, so readers never see half a write or none, and nothing that is being read is overwritten.
Of two writers at once, one has the last word for all readers. The mutations
themselves are functions from DataFrames to a DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Table:
    """A versioned table at a path of a shared file system."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _current(self) -> tuple[int, str]:
        """The version that counts, and its folder's name."""
        fs, p = self._fs(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        done = [n.removeprefix("_done-") for n in names if n.startswith("_done-")]
        return max(((int(n.split("-")[0]), f"v={n}") for n in done), default=(0, ""))

    def version(self) -> int:
        """0 before the first write; grows with each."""
        return self._current()[0]

    def read(self) -> DataFrame:
        """The current rows; columns that a version lacks are null."""
        n, name = self._current()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}") if n else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Make df the table's rows."""
        n = self.version() + 1
        name = f"{n}-{uuid.uuid4().hex}"
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in df.columns]
        out = df.select("*", *missing).select(*self.schema.names)
        out.write.mode("overwrite").parquet(f"{self.path}/v={name}", partitionBy=partition_by)
        fs, p = self._fs(f"{self.path}/_done-{name}")
        fs.create(p, False).close()
        return n

    def vacuum(self, keep: int = 2) -> None:
        """Delete all versions but the last few."""
        last = self.version()
        fs, p = self._fs(self.path)
        for x in fs.listStatus(p):
            kind, _, rest = x.getPath().getName().replace("v=", "v-", 1).partition("-")
            if kind in ("v", "_done") and int(rest.split("-")[0]) <= last - keep:
                fs.delete(x.getPath(), True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows, and old's whose key is not among them. Null keys are equal."""
    n = new.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return old.join(n, on, "left_anti").unionByName(new, allowMissingColumns=True)


def without(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """old less the rows with one of the keys."""
    k = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct()
    return old.join(k, F.col(key) == F.col("_key"), "left_anti")


def replace_documents(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """passages with the documents of chunks (model, id, section_number, ...) replaced. rowids go on from the highest."""
    base = passages.agg(F.coalesce(F.max("rowid"), F.lit(0)).alias("base"))
    # ranks within documents and running sums over documents, so no window holds all passages
    sizes = chunks.groupBy("model", "id").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.orderBy("model", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("model", "id", F.coalesce(F.sum("_size").over(w), F.lit(0)).alias("_before"))
    at = Window.partitionBy("model", "id").orderBy("section_number")
    numbered = chunks.drop("rowid").join(before, ["model", "id"]).join(F.broadcast(base), F.lit(True))
    numbered = numbered.withColumn("rowid", F.col("base") + F.col("_before") + F.row_number().over(at)).drop("base", "_before")
    gone = chunks.select(F.col("model").alias("_model"), F.col("id").alias("_id")).distinct()
    left = passages.join(gone, (F.col("model") == F.col("_model")) & (F.col("id") == F.col("_id")), "left_anti")
    return left.unionByName(numbered, allowMissingColumns=True)


def exclude(excluded: DataFrame, passages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exclusions with new ones, and passages, of all models, without those documents."""
    return upsert(excluded, new, ["id"]), without(passages, new)


def relocated(passages: DataFrame, found: DataFrame) -> DataFrame:
    """Legacy rows (no scheme) given chunk_text, page and char_start of found, by rowid."""
    f = found.select("rowid", *(F.col(c).alias(f"_{c}") for c in ("chunk_text", "page", "char_start")), F.lit(True).alias("_found"))
    df = passages.join(f, "rowid", "left")
    old = F.col("scheme").isNull() & F.coalesce("_found", F.lit(False))
    for c in ("chunk_text", "page", "char_start"):
        df = df.withColumn(c, F.when(old, F.col(f"_{c}")).otherwise(F.col(c)))
    return df.select(*passages.columns)


def saved(history: DataFrame, new: DataFrame) -> DataFrame:
    """history with new searches; only an assistant's source is kept, and only finite thresholds."""
    t = F.col("min_similarity")
    fine = new.withColumn("source", F.when(F.col("source") == "mcp", "mcp")).withColumn("min_similarity", F.when(~F.isnan(t) & (F.abs(t) < float("inf")), t))
    return upsert(history, fine, ["id"])


def latest(history: DataFrame) -> DataFrame:
    """The newest row of each search, with its number of results."""
    w = Window.partitionBy("id").orderBy(F.desc("date"), F.desc("rowid") if "rowid" in history.columns else F.desc("query"))
    return history.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("n_results", F.coalesce(F.array_size("results"), F.lit(0)))


def matching(history: DataFrame, text: str = "", source: str = "all") -> DataFrame:
    """Searches whose query holds text in any case, of a source: all, manual or mcp."""
    df = history.where(F.contains(F.lower("query"), F.lower(F.lit(text))))
    return df if source == "all" else df.where(F.coalesce("source", F.lit("manual")) == source)


def reusable(history: DataFrame, state: str, least: float) -> DataFrame:
    """Saved searches that stand for a new one: some results, the same index state and threshold."""
    return history.where((F.size("results") > 0) & (F.col("index_state") == state) & (F.abs(F.col("min_similarity") - least) < 1e-6))


def with_status(results: Column, folder: Column, section: Column, status: Column) -> Column:
    """A saved array of results with one row's status set."""
    return F.transform(results, lambda r: F.when((r["folder_id"] == folder) & (r["section_number"] == section), r.withField("status", status)).otherwise(r))


def carried_by_section(results: DataFrame, old: DataFrame) -> DataFrame:
    """results with the status that the same query's old rows have at their section."""
    o = old.where(F.coalesce("status", F.lit(0)) != 0).groupBy("folder_id", "section_number").agg(F.min("status").alias("_status"))
    return results.drop("status").join(o, ["folder_id", "section_number"], "left").withColumnRenamed("_status", "status")


def carried_by_page(results: DataFrame, old: DataFrame) -> DataFrame:
    """results with the status of another model's rows on their page: cited (1) first, else the first one's. old: with rank."""
    o = old.where(F.coalesce("status", F.lit(0)) != 0)
    pick = F.min_by("status", F.struct(F.when(F.col("status") == 1, 0).otherwise(1).alias("cited"), "rank")).alias("_status")
    o = o.groupBy("folder_id", "page").agg(pick)
    return results.drop("status").join(o, ["folder_id", "page"], "left").withColumnRenamed("_status", "status")


def state_key(passages: DataFrame, version: int | None = None) -> DataFrame:
    """count:highest rowid of the rows, 0:0 without any; with the table's version it can't stay the same over a change."""
    key = F.concat_ws(":", F.count("rowid"), F.coalesce(F.max("rowid"), F.lit(0)), *([] if version is None else [F.lit(version)]))
    return passages.agg(key.alias("state"))


def document_info(passages: DataFrame) -> DataFrame:
    """Per document: sections, first date, scheme (1 if unset), file name."""
    return passages.groupBy("id").agg(
        F.count(F.lit(1)).alias("sections"),
        F.min("date").alias("date"),
        F.coalesce(F.max("scheme"), F.lit(1)).alias("scheme"),
        F.max("file_name").alias("file_name"),
    )


def fitting(files: DataFrame, cap: int) -> DataFrame:
    """(key, size, mtime) of a cache that stay: the newest files whose sizes together are within cap.

    Sizes are first summed by mtime, so the running sum is over distinct times, not files.
    """
    times = files.groupBy("mtime").agg(F.sum("size").alias("_all"))
    w = Window.orderBy(F.desc("mtime")).rowsBetween(Window.unboundedPreceding, -1)
    times = times.select("mtime", F.coalesce(F.sum("_all").over(w), F.lit(0)).alias("_newer"))
    at = Window.partitionBy("mtime").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return files.join(times, "mtime").where(F.col("_newer") < cap).withColumn("_here", F.sum("size").over(at)).where(F.col("_newer") + F.col("_here") <= cap).drop("_newer", "_here")


def by_rowids(passages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The passages of a list of rowids; the scan reads no other columns of the list."""
    return passages.join(wanted.where("rowid is not null").select("rowid").distinct(), "rowid", "left_semi")


def in_range(passages: DataFrame, low: int, high: int) -> DataFrame:
    """The passages from low to high, both included; Parquet skips row groups by it."""
    return passages.where(F.col("rowid").between(low, high))


def rowids(passages: DataFrame) -> DataFrame:
    """All rowids, and nothing else read."""
    return passages.select("rowid")


def indexed_ids(passages: DataFrame, legacy: bool = False) -> DataFrame:
    """Documents that have passages; legacy: passages without a scheme."""
    return (passages.where("scheme is null") if legacy else passages).where("id is not null").select("id").distinct()


def without_model(passages: DataFrame, model: str, active: str, building: str | None = None) -> DataFrame:
    """passages less a model's; refused for the one in use and the one being built."""
    if model in (active, building):
        raise ValueError(f"{model} is in use")
    return passages.where(~F.col("model").eqNullSafe(F.lit(model)))


def entries(passages: DataFrame) -> DataFrame:
    """What an index knows of each passage: rowid, document, file, section, and the document's number of sections."""
    n = passages.groupBy("id").agg(F.count(F.lit(1)).alias("section_count"))
    return passages.select("rowid", "id", "file_name", "section_number").join(n, "id").select("rowid", "id", "file_name", "section_number", "section_count")


def compacted(index: DataFrame) -> DataFrame:
    """index (place, id, live, ...) without its tombstones, documents numbered anew by where they come first."""
    live = index.where("live")
    first = live.groupBy("id").agg(F.min("place").alias("_first"))
    number = first.withColumn("document", F.row_number().over(Window.orderBy("_first")) - 1).drop("_first")  # a row a document
    return live.drop("document").join(number, "id").drop("live")


def history_without(history: DataFrame, id: str) -> DataFrame:
    return history.where(~F.col("id").eqNullSafe(F.lit(id)))


def history_updated(history: DataFrame, id: str, results: Column) -> DataFrame:
    """history with a search's results set; other searches stay."""
    return history.withColumn("results", F.when(F.col("id") == id, results).otherwise(F.col("results")))


def results_of(text: Column, kind: str) -> Column:
    """Saved results from JSON; an empty list where it is none."""
    return F.coalesce(F.from_json(text, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
