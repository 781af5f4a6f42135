"""Nearest neighbours by inner product with shifted space-filling curves.

1. Equal vectors become one class that remembers its smallest ids; more than the wanted
   neighbours and the query itself are never needed of a class.
2. Every curve projects the vectors on a few random directions, shifts them, and orders them
   by the Hilbert index of their cells. Spark sorts all curves at once by ranges of
   (curve, index); a row's place in that order is its rank.
3. A query meets the rows whose rank is near its own on each curve. Rows are dealt into
   blocks of equal numbers of ranks, so no vector, however frequent its surroundings, makes
   a block larger than others. A block is bounded in bytes, whatever the window; queries are
   dealt into blocks of their own, and every pair of blocks within the window is one group,
   searched exactly, in double precision.
4. The finds of all curves are merged and ranked.

Inner products are turned into distances by one more coordinate: rows get
sqrt(longest^2 - length^2) and queries 0, so that the largest inner product is nearest.

The width of the windows is measured: a bounded sample of queries is compared with all rows,
and the window is what would have held the wanted share of their true neighbours.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatloom.llm.columns import with_checkpoints

#: Number of curves, directions of each, and bits of a direction.
CURVES, DIRECTIONS, BITS = 8, 8, 6
#: Queries compared with all rows to measure the window, chosen by a digest of their id.
SAMPLE = 128
#: Share of true neighbours that the window holds for the sample.
RECALL = 0.955
#: Windows are never narrower than this, to each side.
LEAST_WINDOW = 256
#: Bytes of the vectors, in double precision, of a block of rows or of queries at most.
BLOCK_BYTES = 32 << 20


def hilbert_index(cells, bits):
    """Hilbert indices of integer points, an (n, d) array with values below 2^bits; d * bits <= 63.

    The coordinates are turned, bit plane by bit plane from the top, into those of the
    curve's transposed index, Gray-coded, and their bits interleaved.
    """
    x = cells.astype(np.uint64).T.copy()
    count = len(x)
    for plane in range(bits - 1, 0, -1):
        bit, below = np.uint64(1 << plane), np.uint64((1 << plane) - 1)
        for axis in range(count):
            flip = (x[axis] & bit) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[axis]) & below)
            x[0] ^= np.where(flip, below, swap)
            x[axis] ^= swap
    for axis in range(1, count):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint64(plane)) & np.uint64(1) != 0, np.uint64((1 << plane) - 1), np.uint64(0))
    x ^= turn
    index = np.zeros(x.shape[1], np.uint64)
    for plane in range(bits - 1, -1, -1):
        for axis in range(count):
            index = (index << np.uint64(1)) | ((x[axis] >> np.uint64(plane)) & np.uint64(1))
    return index.astype(np.int64)


class Curves:
    """Directions and shifts of all curves for vectors of ``size`` components, none longer than ``longest``."""

    def __init__(self, size, longest, mean, spread, extra_mean=0.0, extra_spread=0.0, seed=17):
        rng = np.random.default_rng(seed)
        self.longest = longest
        self.maps = [np.linalg.qr(rng.normal(size=(size + 1, size + 1)))[0][:, :min(DIRECTIONS, size + 1)] for _ in range(CURVES)]
        self.shifts = [rng.uniform(0, 1, m.shape[1]) for m in self.maps]
        spread = max(spread, 1e-300)
        # The extra coordinate by its own mean, and by its own spread where this is the larger one.
        self.mean, self.spread = np.append(mean, extra_mean), np.append(np.full(size, spread), max(spread, extra_spread))

    def keys(self, vectors, query):
        """(n, curves) indices; one more coordinate makes inner products distances."""
        extra = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(0, self.longest ** 2 - (vectors ** 2).sum(axis=1)))
        wide = (np.column_stack([vectors, extra]) - self.mean) / self.spread
        if query:  # one very long vector puts all rows far from 0, at the same place; queries stay beside them
            wide[:, -1] = np.maximum(wide[:, -1], -3.0)
        out = np.empty((len(vectors), CURVES), np.int64)
        for c, (directions, shift) in enumerate(zip(self.maps, self.shifts)):
            # Most projections lie within three spreads of the mean; those beyond share the outer cells.
            cells = ((wide @ directions + 3) / 7 + shift / 7) * (1 << BITS)
            out[:, c] = hilbert_index(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)
        return out


def matrix(column):
    """A column of equally long lists as an array of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def valid(vectors, id_col, vector_col):
    """``vec_id`` and ``v`` of rows that take part: an id, the most frequent length, finite and not all zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (size["size"] if size else 0)), size["size"] if size else 0


def _classes(rows, wanted):
    """``id`` (the smallest), ``v`` and the ``wanted + 1`` smallest ``ids`` of each distinct vector."""
    order = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    least = rows.dropDuplicates(["vec_id", "v"]).withColumn("n", order).where(F.col("n") <= wanted + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.get("ids", F.lit(0)).alias("id"), "v", "ids")


def _shape(classes, size):
    """Longest length, mean vector and spread, from sums per task."""
    def run(batches):
        total, squares, n, longest = np.zeros(size), 0.0, 0, 0.0
        for batch in batches:
            m = matrix(batch.column(0))
            if len(m):
                total += m.sum(axis=0)
                squares += (m ** 2).sum()
                n += len(m)
                longest = max(longest, (m ** 2).sum(axis=1).max())
        if n:
            yield pa.RecordBatch.from_pydict({"total": [total.tolist()], "squares": [squares], "n": [n], "longest": [longest]})

    parts = classes.select("v").mapInArrow(run, "total array<double>, squares double, n bigint, longest double")
    sums = parts.agg(F.array(*[F.sum(F.get("total", F.lit(k))) for k in range(size)]), F.sum("squares"), F.sum("n"), F.max("longest")).first()
    mean = np.array(sums[0]) / sums[2]
    spread = math.sqrt(max(0.0, sums[1] / sums[2] - (mean ** 2).sum()) / size)
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    extra = F.sqrt(F.greatest(F.lit(0.0), F.lit(float(sums[3])) - squared))
    own = classes.agg(F.avg(extra), F.stddev_pop(extra)).first()
    return math.sqrt(sums[3]), mean, spread, own[0], own[1]


def _ranked(classes, searched, curves):
    """``id``, ``is_query``, ``curve`` and ``rank`` of all rows and queries on all curves."""
    def keyed(query):
        def run(batches):
            for batch in batches:
                for start in range(0, batch.num_rows, 2048):
                    part = batch.slice(start, 2048)
                    keys = curves.keys(matrix(part.column(1)), query)
                    yield pa.RecordBatch.from_pydict({
                        "curve": pa.array(np.tile(np.arange(CURVES, dtype=np.int32), part.num_rows)), "key": pa.array(keys.ravel()),
                        "id": pa.array(np.repeat(part.column(0).to_numpy(), CURVES)), "is_query": pa.array([query] * keys.size)})
        return run

    schema = "curve int, key bigint, id bigint, is_query boolean"
    rows = classes.select("id", "v").mapInArrow(keyed(False), schema).union(
        classes.join(searched, "id", "left_semi").select("id", "v").mapInArrow(keyed(True), schema))
    order = ["curve", "key", "id", "is_query"]
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The upper bits number the partition, the lower 33 the row in it; written once, so that ranks hold.
    placed = placed.select("id", "is_query", "curve", F.monotonically_increasing_id().alias("place")).checkpoint()
    part = F.shiftright("place", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    ahead = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))  # a row per partition
    return placed.withColumn("part", part).join(F.broadcast(ahead), "part").select(
        "id", "is_query", "curve", (F.col("ahead") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("rank"))


def _best(scores, ids, k):
    """Positions of the k largest scores, ties to smaller ids, in order."""
    chosen = np.arange(len(scores))
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        chosen = np.flatnonzero(scores >= limit)
    return chosen[np.lexsort([ids[chosen], -scores[chosen]])][:k]


def _finds(rows, query_ids, queries, k):
    """Arrow rows ``q``, ``id``, ``score`` of the k best rows of a block for each query."""
    ids, vectors = rows
    q, found, scores = [], [], []
    for start in range(0, len(query_ids), 256):
        products = queries[start:start + 256] @ vectors.T
        for row, own in zip(query_ids[start:start + 256], products):
            best = _best(own, ids, k)
            q.append(np.full(len(best), row))
            found.append(ids[best])
            scores.append(own[best])
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind), pa.from_numpy_dtype(kind))
    return {"q": join(q, np.int64), "id": join(found, np.int64), "score": join(scores, np.float64)}


def _nearest(finds, k):
    """The k best distinct finds of each query."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return finds.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def _window(classes, searched, ranked, k):
    """Half the width of the windows, from the true neighbours of a bounded sample of queries."""
    sample = classes.join(searched, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").toArrow()
    q, queries = sample.column("id").to_numpy(), matrix(sample.column("v"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict(_finds((batch.column(0).to_numpy(), matrix(batch.column(1))), q, queries, k))

    true = _nearest(classes.select("id", "v").mapInArrow(run, "q bigint, id bigint, score double"), k)
    places = ranked.where("not is_query").select("id", "curve", "rank")
    own = ranked.where("is_query").select(F.col("id").alias("q"), "curve", F.col("rank").alias("at"))
    gaps = F.broadcast(true.select("q", "id")).join(places, "id").join(own, ["q", "curve"]).groupBy("q", "id").agg(
        F.min(F.abs(F.col("rank") - F.col("at"))).alias("gap"))
    return max(LEAST_WINDOW, int(gaps.agg(F.percentile("gap", F.lit(RECALL))).first()[0]))


def nearest(vectors, k=20, every=20, id_col="vec_id", vector_col="embedding"):
    """The k nearest other rows of every row whose id is divisible by ``every``, by inner product.

    ``query_id``, ``rank`` from 1, ``vec_id``, ``score`` (the inner product in double
    precision); ties go to smaller ids. Rows that are null, zero, of another length than
    most, or hold null or non-finite components take no part, nor do rows without an id; a
    row that is repeated counts once. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows, size = valid(with_checkpoints(vectors), id_col, vector_col)
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not size:
        return spark.createDataFrame([], result)
    classes = _classes(rows, k).checkpoint()
    asked = rows.where(F.col("vec_id") % every == 0).join(classes.select("v", "id"), "v").select(
        F.col("vec_id").alias("query_id"), F.col("id").alias("q")).distinct().checkpoint()
    searched = asked.select(F.col("q").alias("id")).distinct()
    if searched.isEmpty():
        return spark.createDataFrame([], result)
    ranked = _ranked(classes, searched, Curves(size, *_shape(classes, size))).checkpoint()
    window = _window(classes, searched, ranked, k + 1)
    block = max(1, min(math.ceil(window / 2), BLOCK_BYTES // (8 * size)))
    # Queries are dealt by their own ranks, too: a pair of blocks is a group where a window reaches from one to the other.
    ask = max(1, BLOCK_BYTES // (8 * size))
    place, asked_by = F.floor(F.col("rank") / block), F.floor(F.col("rank") / ask)
    low, high = F.floor((F.col("rank") - window) / block), F.floor((F.col("rank") + window) / block)
    first, last = F.floor((place * block - window) / ask), F.floor(((place + 1) * block + window - 1) / ask)
    pairs = F.when(F.col("is_query"), F.transform(F.sequence(low, high), lambda x: F.struct(x.alias("block"), asked_by.alias("asked")))) \
        .otherwise(F.transform(F.sequence(first, last), lambda x: F.struct(place.alias("block"), x.alias("asked"))))
    dealt = ranked.select("id", "is_query", F.explode(pairs).alias("p")).select("id", "is_query", "p.block", "p.asked").distinct().join(
        classes.select("id", "v"), "id")

    def search(part):
        query = part.column("is_query").to_numpy()
        ids, vectors = part.column("id").to_numpy(), matrix(part.column("v"))
        return pa.table(_finds((ids[~query], vectors[~query]), ids[query], vectors[query], k + 1))

    finds = dealt.groupBy("block", "asked").applyInArrow(search, "q bigint, id bigint, score double")
    best = _nearest(finds, k + 1).join(classes.select("id", "ids"), "id").select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return asked.join(best, "q").where("query_id <> vec_id").withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
