"""Near duplicates of vectors: randomly rotated binary codes, estimates with bounds, exact cosines.

1. Equal vectors of a group (label and length) form a class, which counts for all of its rows.
2. Unit vectors are turned by random rotations. The signs of the first one are the code of
   a vector; its inner product with the turned vector is stored as the correction factor. The
   turned vector itself is rounded at random to 4 bits, without bias. Code times rounded
   vector, divided by the factor, estimates the cosine without bias.
3. Bands of sign bits, of all rotations, make buckets. Their length follows from the largest
   group, so that a bucket of unrelated vectors has about ``BUCKET`` rows at any size, and
   their number from the limit, so that a pair at the limit shares no band with probability
   ``MISS``. A pair is treated in the first band it shares, in no other.
4. Within a bucket the estimate and its bound decide which pairs need the exact cosine. In
   usual buckets these pairs are joined with their vectors. Buckets beyond ``CROWD`` rows, as
   large groups of near copies make them, are compared in pairs of blocks that hold the vectors and
   give back a number of links per class and the few links that join them, never the pairs.
5. Links make components, of keys that classes have of their own, so repeated ids do not mix.
"""

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chatloom.llm.columns import with_checkpoints
from chatloom.llm.components import components
from chatloom.llm.vectors import finite, padded

#: Rows of a bucket of unrelated vectors, and rows beyond which a bucket is compared in blocks.
BUCKET, CROWD = 64, 512
#: Rows of a block, and rows compared together with those of smaller buckets.
BLOCK_ROWS, TOGETHER = 1024, 256
#: Probability that a pair at the limit shares no band.
MISS = 1e-4
#: Deviations of an estimate that its bound covers.
DEVIATIONS = 5.0
#: Bits of a band at most.
MOST_BITS = 30


class Plan:
    """Bits and bands for a limit of the cosine and the largest group."""

    def __init__(self, least, largest):
        self.least = least
        agree = 1 - math.acos(min(1.0, max(-1.0, least))) / math.pi
        self.bits = min(MOST_BITS, max(1, round(math.log2(max(2, largest / BUCKET)))))
        self.bands = 1 if agree >= 1 else math.ceil(math.log(MISS) / math.log1p(-agree ** self.bits))

    def rotations(self, size):
        return -(-self.bits * self.bands // size)

    def patterns(self, codes):
        """The bits of every band of packed codes as numbers, (n, bands)."""
        bits = np.unpackbits(codes, axis=1)[:, :self.bits * self.bands].reshape(len(codes), self.bands, self.bits)
        return bits.astype(np.int64) @ (np.int64(1) << np.arange(self.bits))

    def bound(self, factors, steps, size):
        """The least estimate that a pair at the limit has.

        A code leaves the vector by an angle known from its factor; what the rest of the other
        vector adds is at most its length, and in a random direction of ``size - 1`` about that by
        the root. Random rounding by steps adds half a step of deviation at most.
        """
        aside = np.sqrt(np.maximum(0, 1 - factors ** 2)) / factors
        share = min(1.0, DEVIATIONS / math.sqrt(max(1, size - 1)))
        return self.least - aside * math.sqrt(max(0.0, 1 - self.least ** 2)) * share - DEVIATIONS * steps.max(initial=0) / 2 / factors - 1e-6


@functools.lru_cache(maxsize=8)
def rotation(size, number):
    """A random rotation, the same on every machine."""
    found, upper = np.linalg.qr(np.random.default_rng([size, number]).normal(size=(size, size)))
    return found * np.sign(np.diag(upper))


def coded(vectors, plan, seed):
    """Packed sign bits of all rotations, factor, step, and packed 4-bit numbers of each row of an array."""
    size = vectors.shape[1]
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = units @ rotation(size, 0)
    bits = [turned > 0] + [units @ rotation(size, k) > 0 for k in range(1, plan.rotations(size))]
    steps = np.abs(turned).max(axis=1) * 2 / 15
    chance = np.random.default_rng(seed).uniform(size=turned.shape)
    rounded = np.clip(np.floor(turned / steps[:, None] + 7.5 + chance), 0, 15).astype(np.uint8)
    if size % 2:
        rounded = np.column_stack([rounded, np.zeros(len(rounded), np.uint8)])
    packed = rounded[:, ::2] << 4 | rounded[:, 1::2]
    return (np.packbits(np.concatenate(bits, axis=1), axis=1), (np.abs(turned).sum(axis=1) / math.sqrt(size)).astype(np.float32),
            steps.astype(np.float32), packed)


class Codes:
    """The codes of rows of equal length, as they come from Arrow columns."""

    def __init__(self, table, size, plan):
        n = table.num_rows
        self.plan, self.size = plan, size
        self.code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(n, -1)
        self.factor, self.step = (table.column(c).to_numpy().astype(np.float32) for c in ("factor", "step"))
        packed = np.frombuffer(b"".join(table.column("rounded").to_pylist()), np.uint8).reshape(n, -1)
        self.turned = np.stack([packed >> 4, packed & 15], axis=2).reshape(n, -1)[:, :size].astype(np.float32) - np.float32(7.5)
        self.turned *= self.step[:, None]
        self.signs = np.unpackbits(self.code, axis=1)[:, :size].astype(np.float32) * 2 - 1
        self.patterns = plan.patterns(self.code)

    def close(self, rows, columns, other):
        """Whether the estimate for each pair of own ``rows`` and the other's ``columns`` allows the limit."""
        estimate = self.turned[rows] @ other.signs[columns].T / (math.sqrt(self.size) * other.factor[columns])
        return estimate >= self.plan.bound(other.factor[columns].astype(np.float64), self.step[rows], self.size)

    def first_shared(self, rows, columns, other, band):
        """Whether ``band`` is the first that pairs share."""
        return (self.patterns[rows] == other.patterns[columns]).argmax(axis=1) == band


def _classes(rows):
    """A row per distinct vector of a group: ``key``, ``label``, ``v``, the smallest ``id`` and ``n`` rows."""
    grouped = rows.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return grouped.select(F.monotonically_increasing_id().alias("key"), "label", "v", "id", "n").checkpoint()


def _coded(classes, plan):
    """``key``, ``group``, ``size``, ``code``, ``factor``, ``step``, ``rounded`` of each class."""
    names = ["key", "group", "size", "code", "factor", "step", "rounded"]

    def run(batches):
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy()
            for size in np.unique(lengths):
                own = np.flatnonzero(lengths == size)
                for start in range(0, len(own), 4096):
                    part = batch.take(pa.array(own[start:start + 4096]))
                    code, factor, step, rounded = coded(padded(part.column(2), int(size)), plan, part.column(0)[0].as_py())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(np.full(len(code), size, np.int32)), pa.array([c.tobytes() for c in code], pa.binary()),
                         pa.array(factor), pa.array(step), pa.array([r.tobytes() for r in rounded], pa.binary())], names)

    return classes.select("key", F.xxhash64("label", F.size("v")).alias("group"), "v").mapInArrow(
        run, "key bigint, group bigint, size int, code binary, factor float, step float, rounded binary")


def _buckets(codes, plan):
    """Every class once per band, with the ``bucket`` it falls into."""
    names = ["key", "group", "band", "pattern", "size", "code", "factor", "step", "rounded"]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                lengths = np.array([len(c) for c in part.column(3).to_pylist()])
                for length in np.unique(lengths):
                    piece = part.take(pa.array(np.flatnonzero(lengths == length)))
                    code = np.frombuffer(b"".join(piece.column(3).to_pylist()), np.uint8).reshape(piece.num_rows, -1)
                    patterns = plan.patterns(code)
                    at = pa.array(np.repeat(np.arange(piece.num_rows), plan.bands))
                    bands = pa.array(np.tile(np.arange(plan.bands, dtype=np.int32), piece.num_rows))
                    wide = [piece.column(c).take(at) for c in range(piece.num_columns)]
                    yield pa.RecordBatch.from_arrays([*wide[:2], bands, pa.array(patterns.ravel()), *wide[2:]], names)

    rows = codes.mapInArrow(
        run, "key bigint, group bigint, band int, pattern bigint, size int, code binary, factor float, step float, rounded binary")
    return rows.withColumn("bucket", F.xxhash64("group", "band", "pattern")).drop("group", "pattern")


def _runs(batches):
    """Tables of whole buckets, about ``TOGETHER`` rows each, from batches sorted by bucket."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        buckets = held.column("bucket").to_numpy()
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        start = 0
        for end in starts[1:]:
            if end - start >= TOGETHER:
                yield held.slice(start, end - start)
                start = end
        held = held.slice(start)
    if held is not None and held.num_rows:
        yield held


def _candidates(buckets, plan):
    """Pairs ``a``, ``b`` within usual buckets whose estimates allow the limit, once each."""
    def run(batches):
        for table in _runs(batches):
            sizes = table.column("size").to_numpy()
            for size in np.unique(sizes):
                part = table.take(pa.array(np.flatnonzero(sizes == size))).combine_chunks()
                bucket, band, key = (part.column(c).to_numpy() for c in ("bucket", "band", "key"))
                codes = Codes(part, int(size), plan)
                a, b = [], []
                for start in range(0, len(key), TOGETHER):
                    rows = np.arange(start, min(start + TOGETHER, len(key)))
                    stop = np.searchsorted(bucket, bucket[rows[-1]], side="right")
                    columns = np.arange(start, stop)
                    open_ = codes.close(rows, columns, codes) & (bucket[rows][:, None] == bucket[columns]) & (rows[:, None] < columns)
                    i, j = np.nonzero(open_)
                    first = codes.first_shared(rows[i], columns[j], codes, band[rows[i]])
                    a.append(key[rows[i[first]]])
                    b.append(key[columns[j[first]]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    placed = buckets.repartition("bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(run, "a bigint, b bigint")


def cosines(a, b):
    """Cosines of the rows of two arrays, in double precision."""
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1))


def _verified(pairs, classes, plan):
    """Those pairs ``a``, ``b`` of the same group that reach the limit, with the rows ``na``, ``nb`` of both."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                part = batch.slice(start, 8192)
                left, right = part.column(4), part.column(5)
                lengths = left.value_lengths().to_numpy()
                keep = lengths == right.value_lengths().to_numpy()
                size = int(lengths.max(initial=0))
                x, y = padded(left, size), padded(right, max(size, int(right.value_lengths().to_numpy().max(initial=0))))[:, :size]
                cosine = (x * y).sum(axis=1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
                yield part.select([0, 1, 2, 3]).filter(pa.array(keep & (cosine >= plan.least)))

    side = lambda name: classes.select(
        F.col("key").alias(name), F.col("label").alias(f"l{name}"), F.col("n").alias(f"n{name}"), F.col("v").alias(f"v{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where("la = lb")
    return both.select("a", "b", "na", "nb", "va", "vb").mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint")


def joined(adjacent, same):
    """The smallest number that links reach within a block pair; columns are numbered behind rows unless they are the ``same``."""
    n, m = adjacent.shape
    if same:
        adjacent = adjacent | adjacent.T
    rows = np.arange(n)
    columns = rows if same else np.arange(n, n + m)
    while True:
        before = rows, columns
        rows = np.minimum(rows, np.where(adjacent, columns[None, :], n + m).min(axis=1, initial=n + m))
        columns = rows if same else np.minimum(columns, np.where(adjacent, rows[:, None], n + m).min(axis=0, initial=n + m))
        if (rows == before[0]).all() and (columns == before[1]).all():
            return rows if same else np.concatenate([rows, columns])


def _crowds(buckets, crowds, classes, plan):
    """Links within crowded buckets: ``key`` with a number of ``links``, and joining links ``key``, ``other``."""
    def compare(table):
        size = table.column("size")[0].as_py()
        band = table.column("band")[0].as_py()
        i, j, block = (table.column(c).to_numpy() for c in ("i", "j", "block"))
        same = bool(i[0] == j[0])
        own = [table.filter(pa.array(block == k)).combine_chunks() for k in ((i[0],) if same else (i[0], j[0]))]
        left, right = own[0], own[-1]
        codes = [Codes(t, size, plan) for t in own]
        v = [padded(t.column("v"), size) for t in own]
        n = [t.column("n").to_numpy() for t in own]
        label = [np.array(t.column("group").to_pylist(), np.int64) for t in own]
        adjacent = np.zeros((left.num_rows, right.num_rows), bool)
        counts = [np.zeros(t.num_rows, np.int64) for t in own]
        everything = np.arange(right.num_rows)
        for start in range(0, left.num_rows, 64):
            rows = np.arange(start, min(start + 64, left.num_rows))
            open_ = codes[0].close(rows, everything, codes[-1]) & (label[0][rows][:, None] == label[-1])
            if same:
                open_ &= rows[:, None] < everything
            used = np.flatnonzero(open_.any(axis=0))
            linked = open_[:, used] & (cosines(v[0][rows], v[-1][used]) >= plan.least)
            a, b = np.nonzero(linked)
            a, b = rows[a], used[b]
            first = codes[0].first_shared(a, b, codes[-1], band)
            a, b = a[first], b[first]
            adjacent[a, b] = True
            counts[0] += np.bincount(a, n[-1][b], left.num_rows).astype(np.int64)
            counts[-1] += np.bincount(b, n[0][a], right.num_rows).astype(np.int64)
        keys = np.concatenate([t.column("key").to_numpy() for t in own])
        total = np.concatenate(counts)
        root = joined(adjacent, same)
        some, moved = np.flatnonzero(total), np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"key": pa.array(np.concatenate([keys[some], keys[moved]])),
                         "links": pa.array(np.concatenate([total[some], np.zeros(len(moved), np.int64)])),
                         "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(keys[root[moved]])])})

    blocks = F.ceil(F.col("members") / BLOCK_ROWS).cast("int")
    members = buckets.join(crowds, "bucket").withColumn("blocks", blocks)
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    tasks = members.withColumn("pair", F.explode(pair)).withColumns({"i": F.col("pair.i"), "j": F.col("pair.j")}).drop("pair", "members", "blocks")
    tasks = tasks.join(classes.select("key", "v", "n", F.xxhash64("label", F.size("v")).alias("group")), "key")
    return tasks.groupBy("bucket", "size", "i", "j").applyInArrow(compare, "key bigint, links bigint, other bigint")


def near_duplicates(vectors, least=0.93, id_col="vec_id", vector_col="embedding", group_col="label"):
    """Links and component of every row: id column, ``n_links``, ``component_id``, ``kept``.

    Two rows of the same non-null group are linked when the cosine of their vectors, in
    double precision, is ``least`` or more; vectors of different lengths are not compared.
    ``n_links`` counts the other rows linked with it, ``component_id`` is the smallest id that
    links reach, and the row with that id is kept. No pair below the limit is linked; one
    at the limit is missed with probability ``MISS`` (and an estimate off by over five
    deviations), closer ones far less. Rows with a null or zero vector, null or non-finite
    components, or no group, are linked with nothing. Rows without an id take no part: no
    links, null component, kept. Equal rows are linked with each other, and repeated ids are
    judged by their own vectors. Other columns are not read.
    """
    source = with_checkpoints(vectors).select(
        F.col(id_col).cast("long").alias("id"), F.col(group_col).alias("label"), F.col(vector_col).alias("v"))
    takes_part = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & finite("v") & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = source.where(takes_part)
    classes = _classes(rows)
    largest = classes.groupBy("label", F.size("v")).count().agg(F.max("count")).first()[0] or 0
    plan = Plan(least, largest)
    buckets = _buckets(_coded(classes, plan).checkpoint(), plan)
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("members"))
    crowds = sizes.where(F.col("members") > CROWD).checkpoint()
    usual = buckets.join(crowds, "bucket", "left_anti")
    links = _verified(_candidates(usual, plan), classes, plan).checkpoint()
    crowded = _crowds(buckets, crowds, classes, plan).checkpoint()

    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        crowded.where("other is not null").select(F.col("key").alias("u"), F.col("other").alias("v"))))
    counts = links.select(F.col("a").alias("key"), F.col("nb").alias("links")).union(
        links.select(F.col("b").alias("key"), F.col("na").alias("links"))).union(
        crowded.select("key", "links")).groupBy("key").agg(F.sum("links").alias("links"))
    least_id = classes.join(found, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key"))
    names = least_id.groupBy("component").agg(F.min("id").alias("component_id"))
    judged = least_id.join(names, "component").join(counts, "key", "left").select(
        F.col("label").alias("_label"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    own = rows.join(judged, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v"))).select("id", "n_links", "component_id")
    alone = source.where(~takes_part).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return own.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
