"""Helpers the corpus operators share: table access, the shared scratch folder, written tables."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word of the corpus operators, as a Java and as a Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that a batch to or from Python may hold; a longer row is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Rows of a table of keys that may be broadcast once they are counted; and rows of one key that aren't left to one task.
FEW, HOT = 1 << 19, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only a session of one machine (``local[...]``), as in tests, gets a folder of its own when the setting is absent.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="glossator-")
        spark.sparkContext.setCheckpointDir(path)
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


#: Paths made since the last :func:`tidy`.
_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def tidy(spark: SparkSession, *keep: str) -> None:
    """Delete what was made in the shared folder since the last time, but for some paths. For when all that reads it is done."""
    for path in _made:
        if path not in keep:
            drop_path(spark, path)
    _made.clear()


def written(df: DataFrame, name: str) -> DataFrame:
    """df through a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`scratch`."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of a column's text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % n


def give_back() -> None:
    """Return freed memory to the system, as a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow in batches of bounded size, which the session's settings may only lower; memory is returned after each."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            conf.set(key, str(most))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one_by_one() -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b
                del b
                give_back()

        try:
            yield from run(one_by_one())
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def few(df: DataFrame, name: str) -> DataFrame:
    """df as a written table, to be broadcast if it has at most FEW rows; the join shuffles it otherwise."""
    out = written(df, name)
    return F.broadcast(out) if out.limit(FEW + 1).count() <= FEW else out


def join_hot(rows: DataFrame, keyed: DataFrame, on: str | list[str]) -> DataFrame:
    """rows joined to keyed, a written table with a row for each key and ``_rows``, the number of rows that have the key.

    Keys of more than HOT rows, of which there are at most 1 / HOT as many as rows, are broadcast, so their rows stay where
    they are; the rest is shuffled.
    """
    if keyed.where(F.col("_rows") > HOT).isEmpty():
        return rows.join(keyed.drop("_rows"), on)
    hot, rest = F.broadcast(keyed.where(F.col("_rows") > HOT).drop("_rows")), keyed.where(F.col("_rows") <= HOT).drop("_rows")
    names = [on] if isinstance(on, str) else on
    return rows.join(hot, names).unionByName(rows.join(hot.select(*names), names, "left_anti").join(rest, names))
