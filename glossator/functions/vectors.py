"""Vector expressions over array columns, all in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in order."""
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length; 1 for a zero vector, so that it can be divided by."""
    n = F.sqrt(F.aggregate(as_doubles(v), F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(F.nullif(n, F.lit(0.0)), F.lit(1.0))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(as_doubles(v), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upwards."""
    return F.floor(x + F.lit(0.5))


def round_to(x: Column, digits: int) -> Column:
    """Nearest multiple of a power of ten, halves upwards."""
    return half_up(x * F.lit(10.0**digits)) / F.lit(10.0**digits)


def _symmetric(v: Column, top: int, kind: str) -> tuple[Column, Column]:
    u = unit(v)
    largest = F.array_max(F.transform(u, F.abs)) / F.lit(float(top))
    scale = F.coalesce(F.nullif(largest, F.lit(0.0)), F.lit(1e-9))
    return F.transform(u, lambda x: half_up(x / scale)).cast(f"array<{kind}>"), scale


def quantized8(v: Column) -> Column:
    """struct(q, scale): the unit vector in whole numbers of -127 to 127."""
    q, scale = _symmetric(v, 127, "tinyint")
    return F.struct(q.alias("q"), scale.alias("scale"))


def quantized16(v: Column) -> Column:
    """struct(q, scale) in whole numbers of -32767 to 32767, for queries."""
    q, scale = _symmetric(v, 32767, "smallint")
    return F.struct(q.alias("q"), scale.alias("scale"))


def dequantized(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * scale)


def scanned(passage: Column, query: Column) -> Column:
    """Approximate inner product of quantized8 and quantized16 structs: whole numbers until the last step."""
    whole = F.aggregate(F.zip_with(passage["q"], query["q"], lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return whole.cast("double") * passage["scale"] * query["scale"]


def mean_unit(vectors: Column) -> Column:
    """The unit vector along the sum of an array of vectors."""
    zero = F.transform(as_doubles(F.get(vectors, F.lit(0))), lambda x: F.lit(0.0))
    return unit(F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, as_doubles(v), lambda x, y: x + y)))


def from_json_vector(text: Column) -> Column:
    """[...] or [[...]] as floats; null if it is neither."""
    flat = F.from_json(text, "array<float>")
    nested = F.from_json(text, "array<array<float>>")
    return F.coalesce(F.when(F.exists(flat, lambda x: x.isNotNull()), flat), F.when(F.size(nested) == 1, F.get(nested, F.lit(0))))
