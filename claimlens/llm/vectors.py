"""Embeddings as integer vectors: what the operators on vectors share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Integers up to this size are taken: all sums and products below then fit 64 bits, and matrix products are exact.
LARGEST = 1 << 22


def usable(vec: Column) -> Column:
    """The vector is there, and all its components are there and finite."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(col: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column without nulls as rows of integers; shorter vectors are padded with zeros to ``width`` (or the longest)."""
    lengths = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * col.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}: its integer products may not fit 64 bits")
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(col), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out
