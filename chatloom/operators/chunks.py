"""Window work on sessions of any length.

A plain window puts a whole session into one task. Here each session is cut into chunks by
its ordinals, the window runs inside the chunks, and only the few rows next to a chunk
border take part in a second window over the session. There is one way for sessions of
every size: keys may be NULL, ordinals negative, sparse or NULL (such rows come first).
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65536

_CHUNK, _POS, _LEFT = "__chunk", "__pos", "__left"
_BEFORE_ALL = -(1 << 62)  # the chunk of rows without an ordinal


def _chunked(df, order, chunk):
    return df.withColumn(_CHUNK, F.coalesce(F.floor(F.col(order) / chunk), F.lit(_BEFORE_ALL)))


def with_lookback(df, key, order, depth, columns, chunk=CHUNK_ROWS):
    """Add columns that look at up to ``depth`` rows before each row of a session.

    ``columns`` maps a name to a function of a window specification (partitioned and
    ordered, without a frame). ``order`` is the ordinal of a row in its session.
    """
    chunked = _chunked(df, order, chunk)
    inner = Window.partitionBy(key, _CHUNK).orderBy(order)
    marked = chunked.withColumns({
        _POS: F.row_number().over(inner),
        _LEFT: F.count(F.lit(1)).over(Window.partitionBy(key, _CHUNK)) - F.row_number().over(inner),
        **{name: make(inner) for name, make in columns.items()},
    })
    out = df.columns + list(columns)
    # Every row is in one of two sets: those with enough rows before them in their chunk,
    # and the first ones of a chunk, which look into the last rows of earlier chunks.
    settled = marked.filter(F.col(_POS) > depth)
    edges = marked.filter((F.col(_POS) <= depth) | (F.col(_LEFT) < depth)).drop(*columns)
    outer = Window.partitionBy(key).orderBy(_CHUNK, _POS)
    mended = edges.withColumns({name: make(outer) for name, make in columns.items()}).filter(F.col(_POS) <= depth)
    return settled.select(*out).unionByName(mended.select(*out))


def with_running_total(df, key, order, totals, chunk=CHUNK_ROWS):
    """Add running sums over all rows before each row of a session (0 for the first).

    ``totals`` maps a name to the column to sum. Only one row per chunk takes part
    in the window over the whole session.
    """
    summed = _with_running(df, key, order, totals, chunk, F.sum)
    return summed.select(*df.columns, *[
        (F.coalesce(n, F.lit(0)) + F.coalesce(f"__{n}", F.lit(0))).alias(n) for n in totals])


def with_running_max(df, key, order, columns, chunk=CHUNK_ROWS):
    """Add the largest value over all rows before each row of a session (NULL for the first)."""
    found = _with_running(df, key, order, columns, chunk, F.max)
    return found.select(*df.columns, *[F.greatest(n, f"__{n}").alias(n) for n in columns])


def _with_running(df, key, order, columns, chunk, fold):
    """Per name the fold over earlier rows of the chunk, and as ``__name`` that over earlier chunks."""
    chunked = _chunked(df, order, chunk)
    before = Window.partitionBy(key, _CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = chunked.withColumns({n: fold(c).over(before) for n, c in columns.items()})

    per_chunk = chunked.groupBy(key, _CHUNK).agg(*[fold(c).alias(f"__{n}") for n, c in columns.items()])
    earlier = Window.partitionBy(key).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        F.col(key).alias("__key"), F.col(_CHUNK).alias("__of"), *[fold(f"__{n}").over(earlier).alias(f"__{n}") for n in columns])
    return inside.join(offsets, F.col(key).eqNullSafe(F.col("__key")) & (F.col(_CHUNK) == F.col("__of")), "left")
