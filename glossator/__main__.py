"""A batch job: spark-submit -m glossator --files FOLDER --out TABLE [--model ID] [--pattern *.txt] [--encoder module:name].

Files that the table lacks are read, cut into passages, embedded and added; a file that fails is listed, and the job goes on.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from . import schemas
from .functions.encoders import HashingEncoder
from .models import MODELS
from .operators import ingest, store
from .session import session, ship
from .sources.files import extracted, read_bytes


def index(spark, files: str, out: str, model: str = "hash64", pattern: str = "*", encoder=None) -> dict[str, int]:
    """Documents by outcome; new passages are in the table at out."""
    m = MODELS[model]
    encoder = encoder or HashingEncoder(m.dim)
    table = store.Table(spark, out, schemas.PASSAGES)
    old = table.read()
    found = read_bytes(spark, files, pattern).select("path", "content", F.element_at(F.split("path", "/"), -1).alias("id"))
    known = old.where(F.col("model") == m.id).select("id").distinct()
    new = found.join(known, "id", "left_anti")
    documents = ingest.outcomes(extracted(new).withColumn("id", F.element_at(F.split("path", "/"), -1))).cache()
    try:
        rows = ingest.indexed(documents, m, encoder).withColumn("date", F.current_date()).withColumn("file_name", F.col("id"))
        counts = {r.status: r["count"] for r in documents.groupBy("status").count().collect()}
        if counts.get("index"):
            table.write(store.replace_documents(old, rows))
    finally:
        documents.unpersist()
    return counts


def main(argv: list[str] | None = None) -> dict[str, int]:
    p = argparse.ArgumentParser("glossator")
    p.add_argument("--files", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--model", default="hash64", choices=sorted(MODELS))
    p.add_argument("--pattern", default="*")
    p.add_argument("--encoder", help="module:name of a callable that gives an encoder")
    a = p.parse_args(argv)
    encoder = None
    if a.encoder:
        module, _, name = a.encoder.partition(":")
        encoder = getattr(importlib.import_module(module), name)()
    counts = index(ship(session("glossator-index")), a.files, a.out, a.model, a.pattern, encoder)
    print(counts)
    return counts


if __name__ == "__main__":
    main()
