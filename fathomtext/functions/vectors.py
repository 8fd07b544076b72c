"""Vector Columns: cosine similarity, little-endian encoding, dimension fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def cosine(a: Column, b: Column) -> Column:
    """0 for unequal lengths, empty vectors and zero norms; sums in double precision."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0), 0.0).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def encode_floats(vector: Column) -> Column:
    """Four little-endian bytes an element."""

    @pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(vector)


def decode_floats(encoded: Column) -> Column:
    """Whole elements; bytes left over are dropped."""

    @pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.frombuffer(x, "<f4", len(x) // 4))

    return run(encoded)


class MismatchError(ValueError):
    """Stored vectors are of another model or dimension than the current ones."""


def fingerprint(vectors: DataFrame, model: str, column: str = "vector") -> DataFrame:
    """The (model, dim) pairs of a vector table; dim 0 where there is no vector."""
    return vectors.select(F.lit(model).alias("model"), F.coalesce(F.when(F.size(column) > 0, F.size(column)), F.lit(0)).alias("dim")).distinct()


def check_fingerprint(stored: tuple[str, int], current: tuple[str, int]) -> None:
    if tuple(stored) != tuple(current):
        raise MismatchError(f"embedding: stored vectors are {stored[0]!r} of {stored[1]}, current ones {current[0]!r} of {current[1]}")


def fingerprint_error(vector: Column, stored: str, current: tuple[str, int]) -> Column:
    """check_fingerprint of each stored vector, as a Column: null where it is of the current model and dimension."""
    dim = F.coalesce(F.when(F.size(vector) > 0, F.size(vector)), F.lit(0))
    why = F.concat(F.lit(f"embedding: stored vectors are {stored!r} of "), dim.cast("string"), F.lit(f", current ones {current[0]!r} of {current[1]}"))
    return F.when((F.lit(stored) != current[0]) | (dim != current[1]), why)
