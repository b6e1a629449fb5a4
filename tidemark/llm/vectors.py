"""What the operators on vectors have in common: integer components, batches as matrices and exact inner products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer components beyond this are set to it, so that squared distances of some dozens of components stay in a long.
LARGEST = 1 << 27


def usable(vector: Column) -> Column:
    """True for an array of doubles without null or non-finite components, false for others and for null."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component of an array of doubles, between -LARGEST and LARGEST."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x * float(scale), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as an int64 matrix; shorter lists are filled up with zeros, none may be longer or null."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) == len(sizes) * width:
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two int64 matrices, by floating point where no sum can leave its 53 bits."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
