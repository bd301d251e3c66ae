"""Embeddings as classes of equal vectors, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """A vector that is there, is not zero, and holds neither nulls nor non-finite numbers."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def as_doubles(vector: str = "embedding") -> Column:
    """Doubles without negative zeros, so that equal vectors are equal bit by bit."""
    return F.transform(F.col(f"`{vector}`").cast("array<double>"), lambda x: x + F.lit(0.0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal sizes."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal rows."""
    edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    return np.concatenate([[0], edges]), np.concatenate([edges, [len(keys)]])
