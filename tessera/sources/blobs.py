"""Vectors and mixtures in binary: little-endian floats, as other stores keep them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.BinaryType())
def encode(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """array<double> to 32-bit floats, little-endian; null stays null."""
    for part in vectors:
        yield part.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decode(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The floats of a blob; null for null and for a length that is no multiple of four."""
    for part in blobs:
        yield part.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4").astype(float))


def decoded(blob: Column, dim: int) -> Column:
    """decode(), null unless it has so many components."""
    v = decode(F.when(F.length(blob) == 4 * dim, blob))
    return v


#: A mixture as it is stored: weights and means of its components.
MIXTURE = "struct<weights: array<double>, means: array<array<double>>>"
