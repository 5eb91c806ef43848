"""The engine's functions by name in SQL: vectors as expressions, passages as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .words import chunk_pages, plain_count

_DOUBLES = "transform({0}, x -> cast(x as double))"
_NORM = "coalesce(nullif(sqrt(aggregate({0}, 0D, (s, x) -> s + cast(x as double) * cast(x as double))), 0D), 1D)"
_DOT = "aggregate(zip_with(a, b, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)"


def register(spark: SparkSession) -> None:
    """vector_dot, vector_norm, vector_cosine and vector_unit as SQL functions that Catalyst inlines; vector_mean, an aggregate;
    and the table function passages(text, most)."""
    args = "a array<float>, b array<float>"
    for name, inputs, kind, body in (
        ("vector_dot", args, "double", _DOT),
        ("vector_norm", "a array<float>", "double", _NORM.format("a")),
        ("vector_cosine", args, "double", f"{_DOT} / ({_NORM.format('a')} * {_NORM.format('b')})"),
        ("vector_unit", "a array<float>", "array<double>", f"transform(a, x -> cast(x as double) / {_NORM.format('a')})"),
    ):
        spark.sql(f"create or replace temporary function {name}({inputs}) returns {kind} return {body}")
    spark.udf.register("vector_mean", vector_mean)
    spark.udtf.register("passages", Passages)


@F.pandas_udf(ArrayType(DoubleType()))
def vector_mean(v: pd.Series) -> list:
    """The unit vector along the sum of a group's unit vectors; null without any. A group is gathered by one task, so it is for
    groups of a document's size; search.centroids sums whatever the size."""
    rows = [np.asarray(x, np.float64) for x in v if x is not None and len(x)]
    if not rows:
        return None
    total = sum(x / (np.linalg.norm(x) or 1) for x in rows)
    return (total / (np.linalg.norm(total) or 1)).tolist()


@F.udtf(returnType="section_number int, chunk_text string, page int, char_start int, pieces int")
class Passages:
    """The passages of a text whose pages are parted by form feeds."""

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        for i, c in enumerate(chunk_pages((text or "").split("\f"), plain_count, most)):
            yield i, c["text"], c["page"], c["char_start"], c["pieces"]
