"""Vectors as short codes: one codebook for each part of a vector, entries searched by equal averages.

Components become whole numbers, a vector is cut into equal parts, and every part is
replaced by the number of the nearest entry of its codebook. Codebooks start from the rows
with the smallest ids; a round assigns all parts and moves each entry to the mean of its parts.

The search: entries are sorted by the sum of their components. A part starts at its own
sum and expands to both sides. The squared gap between two sums, divided by the number of
components, is at most the squared distance; a side ends when it strictly exceeds the best
distance so far, so ties are still seen and go to the lower index. Parts with similar sums
expand together.

Rounds read the table again; a task gives back one sum per entry. The driver holds the
codebooks only: ``entries`` times the components of a vector.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chatloom.llm.columns import with_checkpoints
from chatloom.llm.vectors import finite, longest, padded, whole

#: Parts that expand together, and entries that a side takes in a step.
TOGETHER, STEP = 256, 16
#: Rows that are worked on at a time.
ROWS = 8192


class Codebook:
    """The entries of one part, an (n, width) array of whole numbers, ready for the search."""

    def __init__(self, entries):
        self.entries = np.asarray(entries, np.int64)
        self.width = max(1, self.entries.shape[1])
        sums = self.entries.sum(axis=1)
        self.index = np.lexsort([np.arange(len(sums)), sums])
        self.sums, self.sorted = sums[self.index], self.entries[self.index].astype(np.float64)
        self.squares = (self.sorted ** 2).sum(axis=1)

    def nearest(self, parts):
        """Index of the nearest entry of each part, ties to the lower one, and its squared distance."""
        sums, squares = parts.sum(axis=1), (parts ** 2).sum(axis=1)
        # Doubles hold all terms of a distance exactly up to this size; beyond, 64-bit integers do.
        exact = squares.max(initial=0) + self.squares.max(initial=0) < 1 << 51
        kind = np.float64 if exact else np.int64
        x, entries = parts.astype(kind), self.sorted.astype(kind)
        xx, ee = (x * x).sum(axis=1), (entries * entries).sum(axis=1)
        index, best = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        order = np.argsort(sums, kind="stable")
        for start in range(0, len(order), TOGETHER):
            rows = order[start:start + TOGETHER]
            index[rows], best[rows] = self._expand(x[rows], xx[rows], sums[rows], entries, ee)
        return index, best

    def _expand(self, x, xx, sums, entries, ee):
        index, best = np.full(len(x), len(ee)), np.full(len(x), np.inf if x.dtype == np.float64 else np.iinfo(np.int64).max, x.dtype)

        def compare(low, high):
            distances = xx[:, None] - 2 * (x @ entries[low:high].T) + ee[low:high]
            found = distances.min(axis=1)
            first = np.where(distances == found[:, None], self.index[low:high], len(ee)).min(axis=1)
            better = (found < best) | ((found == best) & (first < index))
            best[better], index[better] = found[better], first[better]

        def reaches(k):
            # The margin only matters for numbers that doubles round: then a side ends later, never sooner.
            gap = (self.sums[k] - sums).astype(np.float64)
            return (gap * gap <= self.width * best.astype(np.float64) * (1 + 1e-12)).any()

        low, high = np.searchsorted(self.sums, sums[[0, -1]])  # the parts come sorted by their sums
        if low < high:
            compare(low, high)
        left = right = True
        while left or right:
            left, right = left and low > 0 and reaches(low - 1), right and high < len(ee) and reaches(high)
            if left:
                compare(max(0, low - STEP), low)
                low = max(0, low - STEP)
            if right:
                compare(high, min(len(ee), high + STEP))
                high = min(len(ee), high + STEP)
        return index, best.astype(np.int64)


def _parts(column, size, scale, parts):
    numbers = whole(padded(column, size), scale)
    return np.split(numbers, parts, axis=1)


def _rows(vectors, id_col, vector_col, label_col=None):
    columns = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")]
    if label_col:
        columns.append(F.col(label_col).alias("label"))
    return vectors.select(*columns).where(finite("v"))


def _size(rows, parts):
    """The components of the longest vector, filled up to whole parts."""
    return -(-longest(rows, "v") // parts) * parts


def train(vectors, parts=4, entries=256, rounds=4, scale=1024, id_col="vec_id", vector_col="embedding"):
    """The codebooks, one per part, after ``rounds`` rounds over all rows.

    They start from the rows with the smallest ids (ties: the smaller vector first; rows
    without an id last); with fewer rows there are fewer entries, with none an empty list
    comes back. An entry that no part is nearest to stays as it is.
    """
    rows = _rows(vectors, id_col, vector_col)
    size = _size(rows, parts)
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow().column("v")
    if not len(first):
        return []
    books = [Codebook(p) for p in _parts(first, size, scale, parts)]
    width = size // parts
    for _ in range(rounds):
        sums = _sums(rows, books, size, scale)
        books = [Codebook(_moved(book.entries, [r for r in sums if r.part == k], width)) for k, book in enumerate(books)]
    return books


def _sums(rows, books, size, scale):
    """A row per part and entry: the number of parts it is nearest to, and their sum."""
    width = size // len(books)

    def run(batches):
        sums = [np.zeros((len(b.entries), width), np.int64) for b in books]
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                column = batch.column(0).slice(start, ROWS)
                for k, part in enumerate(_parts(column, size, scale, len(books))):
                    index, _ = books[k].nearest(part)
                    order = np.argsort(index, kind="stable")
                    used, begin = np.unique(index[order], return_index=True)
                    sums[k][used] += np.add.reduceat(part[order].astype(np.int64), begin, axis=0)
                    counts[k] += np.bincount(index, minlength=len(counts[k]))
        for k, n in enumerate(counts):
            used = np.flatnonzero(n)
            if len(used):
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([k] * len(used), pa.int32()), "entry": pa.array(used.astype(np.int32)), "n": pa.array(n[used]),
                    "sums": pa.array(list(sums[k][used]), pa.list_(pa.int64()))})

    found = rows.select("v").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    total = F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(width)]) if width else F.array().cast("array<bigint>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("sums")).collect()  # bounded: parts * entries


def _moved(entries, sums, width):
    out = entries.copy()
    for row in sums:
        out[row.entry] = np.array(row.sums, np.int64).reshape(width) // row.n
    return out


def encode(vectors, books, scale=1024, id_col="vec_id", vector_col="embedding", label_col="label"):
    """``id_col``, ``label_col``, ``codes`` (an index per part) and ``error``, the sum of the parts' squared distances.

    Rows whose vector is null or holds null or non-finite components are left out, repeated
    rows and rows without id or label are kept. A vector ends in zeros where it is shorter
    than the longest, or than whole parts; one longer than the codebooks is an error.
    Components are held within 2^24 after scaling. Other columns are not read.
    """
    rows = _rows(vectors, id_col, vector_col, label_col)
    size = sum(b.entries.shape[1] for b in books)
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                found = [book.nearest(p) for book, p in zip(books, _parts(piece.column(1), size, scale, len(books)))]
                codes = np.stack([index for index, _ in found], axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(2), pa.array(list(codes), pa.list_(pa.int32())), pa.array(sum(best for _, best in found))],
                    ["id", "label", "codes", "error"])

    schema = f"id bigint, label {kind}, codes array<int>, error bigint"
    coded = rows.select("id", "v", "label").mapInArrow(run, schema) if books else rows.sparkSession.createDataFrame([], schema)
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "codes", "error")


def books_sha256(books):
    """Digest of all entries: their numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()


def digests(coded, books, label_col="label"):
    """The codes as two hexadecimal digits per part, with the error of all rows of the same label (nulls together)."""
    coded = with_checkpoints(coded).checkpoint()
    # One row per label; a label with many rows is a skewed side of the join, which Spark splits.
    sums = coded.groupBy(F.col(label_col).alias("_label")).agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col("_label"))).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
