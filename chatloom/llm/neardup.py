"""Near duplicates by MinHash: banding, signature verification, exact check, components.

1. Every text becomes its set of word shingles (64-bit hashes), a fingerprint of the set and
   the minima of many universal hash functions.
2. Texts with equal sets form a class, which has a key of its own from here on: ids may repeat
   with different texts. Components are named by the smallest id of their classes at the end.
3. Classes that agree in a band of minima share a bucket. All members are compared with the
   smallest key of the bucket: linear in the bucket, whatever its size.
   Pairs pass the estimate from their signatures first, then full sets are compared.
4. Links found so far give components. Only in buckets that still hold several components
   are further comparisons needed, and only between components: members outside the
   bucket's largest component are compared, in blocks, with each other and with the rest.
   A block gives back no pairs, only the few links that join its components.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.llm.columns import slices, utf8, with_checkpoints
from chatloom.llm.components import components
from chatloom.llm.shingles import mix, shingle_sets

#: Text bytes that are hashed at a time.
BLOCK_BYTES = 2 << 20
#: Sets that are compared as one block: so many, or so many shingles together.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 21
#: Most rows of ids that are broadcast, 32 bytes each.
BROADCAST_IDS = 1 << 20
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096
#: A pair at the similarity limit is missed by all bands with at most this probability.
MISS = 1e-6


class Plan:
    """Widths and numbers that follow from a similarity limit given in per cent."""

    def __init__(self, width, percent, most_hashes=128):
        self.width, self.percent = width, percent
        limit = percent / 100
        for rows in range(12, 0, -1):
            bands = math.ceil(math.log(MISS) / math.log1p(-limit ** rows)) if limit < 1 else 1
            if rows == 1 or bands * rows <= most_hashes:
                break
        self.rows, self.bands = rows, bands
        self.hashes = rows * bands
        # Agreeing minima are binomial; six deviations below the limit loses about one pair in 10^9.
        deviation = math.sqrt(self.hashes * limit * (1 - limit))
        self.least_agreement = max(1, math.floor(self.hashes * limit - 6 * deviation))
        rng = np.random.default_rng(11)
        self.factors = rng.integers(1, 1 << 63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = rng.integers(1, 1 << 63, self.hashes, dtype=np.uint64)

    def signatures(self, sets):
        """Minima of the hash functions for non-empty sets, one row of 32-bit numbers each."""
        joined = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        out = np.empty((len(sets), self.hashes), np.uint32)
        for k in range(self.hashes):
            hashed = joined * self.factors[k]
            hashed += self.shifts[k]
            hashed >>= np.uint64(32)
            out[:, k] = np.minimum.reduceat(hashed.astype(np.uint32), starts)
        return out

    def band_keys(self, signatures):
        """A 64-bit key per row and band."""
        wide = signatures.astype(np.uint64).reshape(len(signatures), self.bands, self.rows)
        keys = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), wide.shape[:2])
        for k in range(self.rows):
            keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + wide[:, :, k])
        return keys.view(np.int64)


def _set_batches(batches, width):
    for part in slices(batches, 1, BLOCK_BYTES):
        data, at = utf8(part.column(1))
        yield part.column(0), shingle_sets(data, at[1:], width)


def fingerprint(items):
    """Two 64-bit sums that stand for a non-empty set of shingles."""
    return [int(mix(x).sum(dtype=np.uint64).view(np.int64)) for x in (items, items ^ np.uint64(0xA5A5A5A5A5A5A5A5))]


def sketches(docs, plan):
    """``id``, ``n_shingles``, fingerprint ``fa``, ``fb`` and ``sig`` of each text; empty sets have neither."""
    def run(batches):
        for ids, sets in _set_batches(batches, plan.width):
            some = [i for i, s in enumerate(sets) if len(s)]
            sig, fa, fb = ([None] * len(sets) for _ in range(3))
            if some:
                rows = plan.signatures([sets[i] for i in some])
                for i, row in zip(some, rows):
                    sig[i] = row.tobytes()
                    fa[i], fb[i] = fingerprint(sets[i])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()),
                 pa.array(sig, pa.binary())], ["id", "n_shingles", "fa", "fb", "sig"])

    return docs.mapInArrow(run, "id bigint, n_shingles bigint, fa bigint, fb bigint, sig binary")


def _buckets(classes, plan):
    """``bucket``, ``key`` of classes in buckets with several members, with the smallest key and the number of members."""
    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 4096):
                part = batch.slice(row, 4096)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(part.num_rows, plan.hashes)
                keys = plan.band_keys(sig)
                own = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(own, plan.bands))], ["bucket", "key"])

    rows = classes.select("key", "sig").mapInArrow(run, "bucket bigint, key bigint")
    many = rows.groupBy("bucket").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1")
    return rows.join(many, "bucket")


def _agreeing(pairs, classes, plan):
    """The pairs ``a``, ``b`` whose signatures agree often enough."""
    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 2048):
                part = batch.slice(row, 2048)
                left, right = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(part.num_rows, -1)
                               for c in part.columns[2:])
                keep = pa.array((left == right).sum(axis=1) >= plan.least_agreement)
                yield part.select([0, 1]).filter(keep)

    sig = classes.select("key", "sig")
    both = pairs.join(sig.select(F.col("key").alias("a"), F.col("sig").alias("sa")), "a").join(
        sig.select(F.col("key").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _counted(ids):
    """Rows with an id, written and counted, and marked for broadcast while they are at most ``BROADCAST_IDS``.

    Then the texts that are joined with them need not be shuffled; beyond, they are. Both ways give the same rows.
    """
    ids = ids.checkpoint()
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _items(docs, keys, classes, plan):
    """The full sets of the classes named in ``keys``: ``key``, ``items``, a row for each.

    The texts are found by the id of the class; of several texts with that id, the fingerprint tells which is meant.
    """
    def sets(batches):
        for _, found in _set_batches(batches, plan.width):
            marks = [fingerprint(x) if len(x) else (None, None) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()),
                 pa.array([x.tobytes() for x in found], pa.binary())], ["fa", "fb", "items"])

    wanted = _counted(classes.join(keys.distinct(), "key", "left_semi").select("id", "key", "fa", "fb"))
    texts = docs.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "text")
    rows = texts.mapInArrow(sets, "fa bigint, fb bigint, items binary").join(wanted.select("fa", "fb", "key"), ["fa", "fb"])
    return rows.select("key", "items").dropDuplicates(["key"])


def _verified(pairs, docs, classes, plan):
    """Those pairs ``a``, ``b`` whose full sets are similar enough, as ``u``, ``v``."""
    def compare(batches):
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= plan.percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    items = _items(docs, pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))), classes, plan)
    both = pairs.join(items.select(F.col("key").alias("a"), F.col("items").alias("ia")), "a").join(
        items.select(F.col("key").alias("b"), F.col("items").alias("ib")), "b")
    return both.select("a", "b", "ia", "ib").mapInArrow(compare, "a bigint, b bigint").toDF("u", "v")


def _regions(buckets, classes, found):
    """What is still to be compared: ``region``, ``key``, ``component``, ``own``.

    A region is made of the buckets of three or more members whose largest component is
    the same: the members of that component, and with ``own`` all other members. A row is
    in a region once, however many buckets it shares.
    """
    labelled = buckets.where("n > 2").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    sizes = labelled.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("size", "component"))["component"].alias("region"), F.count("*").alias("parts"))
    rows = labelled.join(largest.where("parts > 1").drop("parts"), "bucket")
    rows = rows.select("region", "key", "component", (F.col("region") != F.col("component")).alias("own")).distinct()
    return rows.join(classes.select("key", "n_shingles"), "key")


def _dealt(regions):
    """The rows of regions by task, ``region``, ``i``, ``j``: pairs of blocks, at least one of them of own rows.

    Blocks are bounded in rows and shingles; a small region is one block.
    """
    def blocks(rows, shingles):
        return F.ceil(F.greatest(rows / F.lit(float(BLOCK_ROWS)), shingles / F.lit(float(BLOCK_SHINGLES)))).cast("int")

    own, size = F.col("own"), F.col("n_shingles")
    sums = regions.groupBy("region").agg(
        F.count(F.when(own, 1)).alias("own_rows"), F.coalesce(F.sum(F.when(own, size)), F.lit(0)).alias("own_size"),
        F.count(F.when(~own, 1)).alias("main_rows"), F.coalesce(F.sum(F.when(~own, size)), F.lit(0)).alias("main_size"))
    sums = sums.select(
        "region", blocks(F.col("own_rows"), F.col("own_size")).alias("owns"), blocks(F.col("main_rows"), F.col("main_size")).alias("mains"),
        (blocks(F.col("own_rows") + F.col("main_rows"), F.col("own_size") + F.col("main_size")) == 1).alias("small"))
    rows = regions.join(sums, "region")
    block = F.pmod(F.xxhash64("key"), F.when(own, F.col("owns")).otherwise(F.col("mains"))).cast("int")
    all_own = F.sequence(F.lit(0), F.col("owns") - 1)
    # Main blocks are numbered behind the own blocks.
    task = F.when(F.col("small"), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).when(
        ~own, F.transform(all_own, lambda i: F.struct(i.alias("i"), (F.col("block") + F.col("owns")).alias("j")))
    ).otherwise(F.concat(
        F.transform(all_own, lambda i: F.struct(F.least(i, "block").alias("i"), F.greatest(i, "block").alias("j"))),
        F.transform(F.sequence(F.col("owns"), F.col("owns") + F.col("mains") - 1),
                    lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))))
    return rows.withColumn("block", block).select("region", "key", "component", F.explode(task).alias("task")).select(
        "region", "task.i", "task.j", "key", "component")


def common_counts(sets):
    """The sizes of all pairwise intersections, from products of incidence matrices with bounded columns."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    for start in range(0, int(shared.sum()), COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[low:high], column[low:high] - start] = 1
        out += part @ part.T
    return out


def _joining(ids, component, sets, plan):
    """Links between different components, as few as join what is linked at all."""
    sizes = np.array([len(s) for s in sets])
    common = common_counts(sets)
    linked = 100 * common >= plan.percent * (sizes[:, None] + sizes[None, :] - common)
    _, part = np.unique(component, return_inverse=True)
    linked &= part[:, None] < part[None, :]
    left, right = np.nonzero(linked)
    _, first = np.unique(part[left] * len(ids) + part[right], return_index=True)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in first.tolist():
        a, b = find(int(part[left[k]])), find(int(part[right[k]]))
        if a != b:
            root[a] = b
            yield int(ids[left[k]]), int(ids[right[k]])


def _rest(regions, docs, classes, plan):
    """Links between components within regions, from full sets, as ``u``, ``v``."""
    def meet(table):
        ids, component = table.column("key").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        links = list(_joining(ids, component, sets, plan))
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    rows = _dealt(regions).join(_items(docs, regions.select("key"), classes, plan), "key")
    return rows.groupBy("region", "i", "j").applyInArrow(meet, "u bigint, v bigint")


def _judged(docs, plan):
    """``id``, ``n_shingles``, ``fa``, ``fb``, ``component_id`` and ``kept`` of every row of (id, text)."""
    drawn = sketches(docs, plan).checkpoint()
    classes = drawn.where("fa is not null and id is not null").groupBy("fa", "fb").agg(
        F.min("id").alias("id"), F.min_by("sig", "id").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = classes.withColumn("key", F.monotonically_increasing_id()).checkpoint()
    buckets = _buckets(classes, plan).checkpoint()
    pairs = buckets.where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    links = _verified(_agreeing(pairs, classes, plan).checkpoint(), docs, classes, plan).checkpoint()
    found = components(links)
    regions = _regions(buckets, classes, found).checkpoint()
    rest = _rest(regions, docs, classes, plan).checkpoint()
    if not rest.isEmpty():
        found = components(links.union(rest))
    placed = classes.select("key", "id", "fa", "fb").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    names = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    by_set = placed.join(names, "component").select("fa", "fb", "component_id")
    out = drawn.drop("sig").join(by_set, ["fa", "fb"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.withColumn("component_id", component).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def _source(docs, id_col, text_col):
    return with_checkpoints(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def near_duplicates(docs, width=5, percent=80, id_col="doc_id", text_col="text"):
    """Component and set size of every row: id column, ``n_shingles``, ``component_id``, ``kept``.

    Texts are linked when 100 * common shingles >= percent * all shingles; the component is
    the smallest id that links reach, and the row with that id is kept. A null or wordless
    text has no shingles and is linked with nothing. Repeated rows are judged alike; rows that
    repeat an id with another text are judged by their own text. A row
    without an id takes no part: null ``component_id``, kept. Other columns are not read.
    """
    found = _judged(_source(docs, id_col, text_col), Plan(width, percent))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _with_fingerprints(docs, text_col, plan):
    """``row`` (all columns), ``text``, ``fa``, ``fb`` of every row."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        for part in slices(batches, 1, BLOCK_BYTES):
            data, at = utf8(part.column(1))
            marks = [fingerprint(x) if len(x) else (None, None) for x in shingle_sets(data, at[1:], plan.width)]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64())],
                ["row", "text", "fa", "fb"])

    sums = [T.StructField(name, T.LongType()) for name in ("fa", "fb")]
    return packed.mapInArrow(run, T.StructType([*packed.schema.fields, *sums]))


def deduplicated(docs, width=5, percent=80, id_col="doc_id", text_col="text"):
    """The rows that are kept, with all their columns: one of each group of near duplicates.

    Rows that repeat an id and its words are one document and stay once, whichever of them
    it is; of rows that repeat an id with other texts each is judged by its own. Rows without an id stay.
    """
    plan = Plan(width, percent)
    found = _judged(_source(docs, id_col, text_col), plan).where("id is not null").checkpoint()
    ids = found.groupBy(F.col("id").alias(id_col)).agg(F.count("*").alias("_n"), F.count_if("kept").alias("_kept")).where("_kept > 0")
    ids = _counted(ids.drop("_kept"))
    once = docs.join(ids.where("_n = 1").select(id_col), id_col, "left_semi")
    # Only rows that repeat an id are told apart by their texts.
    many = docs.join(ids.where("_n > 1").select(id_col), id_col, "left_semi")
    kept = found.where("kept").select(F.col("id").alias("_id"), F.col("fa").alias("_fa"), F.col("fb").alias("_fb")).distinct()
    own = _with_fingerprints(many, text_col, plan).withColumn("_own", F.col(f"row.`{id_col}`").cast("long"))
    same = (F.col("_own") == F.col("_id")) & F.col("fa").eqNullSafe(F.col("_fa")) & F.col("fb").eqNullSafe(F.col("_fb"))
    wordless = F.when(F.col("fa").isNull(), F.coalesce("text", F.lit("")))
    more = own.join(kept, same, "left_semi").withColumn("_wordless", wordless).dropDuplicates(["_own", "fa", "fb", "_wordless"]).select("row.*")
    return once.unionByName(more).unionByName(docs.where(F.col(id_col).isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])
