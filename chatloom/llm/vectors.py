"""Helpers for operators on vectors: which rows take part, and lists as matrices of whole numbers."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Whole-number components are held within these limits, so that sums of products fit 64 bits.
MOST = float(1 << 24)


def finite(name):
    """Whether a list column is a vector: not null, and without null or non-finite components."""
    x = F.col(name)
    return x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def longest(rows, name):
    """The number of components of the longest vector; 0 without rows."""
    return rows.agg(F.max(F.size(name))).first()[0] or 0


def padded(column, size):
    """Lists of numbers as an (n, size) array of doubles; shorter lists end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * size:
        return flat.reshape(len(column), size)
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), size))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def whole(vectors, scale):
    """floor(scale * x) of every component, held within ``MOST``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * vectors), -MOST, MOST)


def lists(matrix, kind):
    """The rows of a matrix as an Arrow list column."""
    n, size = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size), pa.array(matrix.ravel().astype(kind)))


def products(a, b):
    """Exact inner products of the rows of two arrays of whole numbers, as 64-bit integers."""
    if not len(a) or not len(b) or not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    bound = np.sqrt((a * a).sum(axis=1).max()) * np.sqrt((b * b).sum(axis=1).max())
    # Partial sums stay below the product of the lengths, so they are exact while that fits the mantissa.
    for kind, bits in ((np.float32, 24), (np.float64, 53)):
        if bound < 1 << bits - 1:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T
