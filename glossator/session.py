"""The session that the engine expects."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: ANSI errors, UTC, adaptive plans, Arrow; of equal map keys the last wins.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def session(name: str = "glossator", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS, overridden by conf."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python this package, once a context, wherever the driver was started."""
    sc = spark.sparkContext
    if not getattr(sc, "_glossator_shipped", False):
        here = os.path.dirname(os.path.abspath(__file__))
        aside = tempfile.mkdtemp(prefix="glossator-")  # on the driver, which serves the file as long as it runs
        atexit.register(shutil.rmtree, aside, ignore_errors=True)
        shutil.copytree(here, f"{aside}/src/glossator", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{aside}/glossator", "zip", f"{aside}/src"))
        sc._glossator_shipped = True
    return spark
