"""Exact integer vectors, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columnar import quoted

LARGEST = 1.7976931348623157e308
#: Rows that are worked on at once.
ROWS = 4096


def finite(vector: str) -> Column:
    """Whether a vector is there and none of its components is null, NaN or infinite."""
    return F.coalesce(F.forall(F.col(quoted(vector)).cast("array<double>"), lambda x: x.isNotNull() & x.between(-LARGEST, LARGEST)), F.lit(False))


def scaled(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length; a component whose product has more than 62 bits is an error."""
    n = len(column)
    x = np.floor(np.asarray(column.flatten().cast(pa.float64())) * float(scale)).reshape(n, -1 if n else 0)
    if n and x.size and np.abs(x).max() >= 2.0**62:
        raise ValueError("a component is too large for exact integers of 64 bits")
    return x.astype(np.int64)


def exact(x: np.ndarray, bits: int, *others: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are if all components have at most so many bits, else as Python's integers, which don't overflow."""
    wide = any(a.size and np.abs(a).max() >= 1 << bits for a in (x, *others))
    return [a.astype(object) if wide else a.astype(np.int64) for a in (x, *others)]
