"""Helpers shared by the operators: table reading and Arrow text columns as numpy arrays."""

import numpy as np
import pyarrow as pa

from chatloom.session import shared_folder

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def with_checkpoints(df):
    """The DataFrame, in a session that has a folder for checkpoints: its own, or else one of the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column):
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0]:at[-1]], at - at[0]


def slices(batches, column, limit):
    """Consecutive row slices of Arrow batches with about ``limit`` text bytes each.

    A slice has at least one row, so a text longer than the limit is a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def row_sums(values, ends):
    """Sums of consecutive groups of ``values``; group i ends before ``ends[i]``. Groups may be empty."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return np.diff(total[np.concatenate([[0], ends])])
