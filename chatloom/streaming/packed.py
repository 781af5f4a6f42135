"""Rows of a bucket as one value of keyed state."""

import pyarrow as pa


def packed(rows, schema):
    """A pandas frame as the bytes of one Arrow batch."""
    return pa.RecordBatch.from_pandas(rows, schema, preserve_index=False).serialize().to_pybytes()


def unpacked(data, schema):
    """The frame that ``packed`` made the bytes from; empty without any."""
    if data is None:
        return schema.empty_table().to_pandas()
    return pa.ipc.read_record_batch(pa.py_buffer(bytes(data)), schema).to_pandas()
