"""Half-precision vectors as bytes: IEEE half, little-endian, rounded to even."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def encode_f16(vector) -> bytes:
    with np.errstate(over="ignore"):
        return np.asarray(vector, np.float32).astype("<f2").tobytes()


def decode_f16(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f2").astype(np.float32)


@F.pandas_udf(BinaryType())
def f16_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else encode_f16(x))


@F.pandas_udf(ArrayType(FloatType()))
def f16_vector(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else decode_f16(x))


def bytes_of_units(text: Column) -> Column:
    """The bytes of a vector that was kept as a string of 16-bit units."""
    return F.encode(text, "UTF-16LE")
