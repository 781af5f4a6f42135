"""Hard negatives by angular triangle filtering.

A hard negative of an anchor and one of its positives is a row of another label whose score,
the inner product with the anchor, lies in a window just below that of the positive.

1. Components become whole numbers, so scores are exact. Every row stores its length and its
   angles to a few reference directions.
2. Rows are dealt into places: the nearest reference, then a band of angles to it. A place
   of many rows has several blocks of bounded size, so equal rows fill as many as they need.
   The spread of angles and lengths of each place is known everywhere: a bounded number of rows.
3. The angle between two rows lies between the difference and the sum of their angles to any
   reference. All references together give an interval of cosines, the lengths make it one of
   scores, widened by more than rounding can add. An anchor is sent only to places whose
   interval overlaps what it looks for; there each row has an interval of its own, and
   only rows whose interval overlaps get the integer score.
4. Positives: the score that the anchor's own block offers is a limit below which no other
   block is searched. Negatives: the windows of the positives found.

References are chosen from a bounded sample of rows, far from each other. They only decide
how narrow the intervals are; results never depend on them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatloom.llm.columns import with_checkpoints
from chatloom.llm.vectors import finite, lists, longest, padded, products, whole

#: Reference directions, and rows (by a digest of their id) from which they are chosen.
REFERENCES, SAMPLE = 16, 1024
#: Bands of a reference at most, rows of a block, and anchors that meet a block at a time.
BANDS, BLOCK_ROWS, BLOCK_ANCHORS = 256, 8192, 2048
#: Anchors whose intervals are formed at a time.
CHUNK = 32
#: Cosines are widened by this; angles and cosines in single precision are off by a tenth of it at most.
SLACK = np.float32(1e-5)

_ROW = "key bigint, id bigint, label bigint, x array<int>, norm float, angles array<float>"


def references(sample, count=REFERENCES):
    """Unit directions among the rows of ``sample``, each the farthest from those before."""
    norms = np.linalg.norm(sample, axis=1)
    units = sample[norms > 0] / norms[norms > 0, None]
    if not len(units):
        return np.zeros((0, sample.shape[1]))
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < min(count, len(units)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def angles(x, directions):
    """Length and angles to the references of each row; a row of length 0 is at right angles to all."""
    norms = np.linalg.norm(x, axis=1)
    cosines = (x @ directions.T) / np.where(norms > 0, norms, 1)[:, None]
    return norms.astype(np.float32), np.arccos(np.clip(cosines, -1, 1)).astype(np.float32)


def bounds(anchor_norms, anchor_angles, low_norms, high_norms, low_angles, high_angles):
    """Least and largest score of each anchor with rows whose lengths and angles lie within limits.

    For single rows both limits are the same. (anchors, rows) arrays come back.
    """
    shape = len(anchor_norms), len(low_norms)
    least, most = np.zeros(shape, np.float32), np.full(shape, np.pi, np.float32)
    for a, low, high in zip(anchor_angles.T, low_angles.T, high_angles.T):
        a = a[:, None]
        np.maximum(least, np.maximum(low - a, a - high), out=least)
        np.minimum(most, np.minimum(high + a, np.float32(2 * np.pi) - low - a), out=most)
    above, below = np.cos(np.minimum(least, np.float32(np.pi))) + SLACK, np.cos(np.clip(most, 0, np.pi)) - SLACK
    scale = anchor_norms[:, None]
    return (scale * np.where(below >= 0, low_norms, high_norms) * below, scale * np.where(above >= 0, high_norms, low_norms) * above)


def first(scores, ids, k):
    """Positions of the k largest scores, ties to smaller ids, in order."""
    chosen = np.arange(len(scores))
    if len(scores) > k:
        chosen = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return chosen[np.lexsort([ids[chosen], -scores[chosen]])][:k]


class Side:
    """Rows of an Arrow table as arrays."""

    def __init__(self, table, size, count):
        self.id, self.label = (table.column(c).to_numpy() for c in ("id", "label"))
        self.x, self.angles = padded(table.column("x"), size), padded(table.column("angles"), count).astype(np.float32)
        self.norm = table.column("norm").to_numpy()
        self.key = table.column("key").to_numpy()

    def bounds(self, anchors, chosen, own):
        """Score intervals of the rows at ``own`` with the anchors at ``chosen``."""
        norm, angle = self.norm[own], self.angles[own]
        return bounds(anchors.norm[chosen], anchors.angles[chosen], norm, norm, angle, angle)


class Search:
    """What tasks need to know: sizes, places with their limits, and how many are wanted."""

    def __init__(self, size, count, positives, negatives):
        self.size, self.count, self.positives, self.negatives = size, count, positives, negatives

    def places(self, stats):
        """Keep the limits of all places, in the order of their numbers."""
        self.place = np.array([r.place for r in stats], np.int32)
        self.salts = np.array([-(-r.n // BLOCK_ROWS) for r in stats], np.int32)
        self.norms = [np.array([r[c] for r in stats], np.float32) for c in ("low_norm", "high_norm")]
        self.limits = [np.array([r[c] for r in stats], np.float32).reshape(len(stats), self.count) for c in ("low", "high")]

    def targets(self, batches, wanted):
        """The places that may hold what an anchor looks for: ``key``, ``place``, ``salts``."""
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                norm, angle = part.column("norm").to_numpy(), padded(part.column("angles"), self.count).astype(np.float32)
                low, high = bounds(norm, angle, *self.norms, *self.limits)
                anchor, place = np.nonzero(wanted(part, low, high))
                yield pa.RecordBatch.from_pydict({"key": pa.array(part.column("key").to_numpy()[anchor]),
                                                  "place": pa.array(self.place[place]), "salts": pa.array(self.salts[place])})

    def same_label(self, anchors, rows, limit):
        """Scores of other rows of the anchor's label: anchor, positions, scores, only where the interval reaches ``limit``."""
        for label in np.intersect1d(anchors.label, rows.label):
            own = np.flatnonzero(rows.label == label)
            asked = np.flatnonzero(anchors.label == label)
            for start in range(0, len(asked), CHUNK):
                chosen = asked[start:start + CHUNK]
                _, high = rows.bounds(anchors, chosen, own)
                open_ = (high >= limit[chosen][:, None]) & (rows.id[own] != anchors.id[chosen][:, None])
                used = np.flatnonzero(open_.any(axis=0))
                scores = products(anchors.x[chosen], rows.x[own[used]])
                for a, mask, score in zip(chosen, open_[:, used], scores):
                    yield a, own[used[mask]], score[mask]

    def offered(self, anchors, rows):
        """The lowest of the wanted number of positive scores within a block: ``key``, ``least``, where it has as many."""
        key, least = [], []
        for a, _, scores in self.same_label(anchors, rows, np.full(len(anchors.key), -np.inf, np.float32)):
            if len(scores) >= self.positives:
                key.append(anchors.key[a])
                least.append(np.partition(scores, len(scores) - self.positives)[len(scores) - self.positives])
        return {"key": pa.array(key, pa.int64()), "least": pa.array(least, pa.int64())}

    def best_positives(self, anchors, rows, least):
        out = {"key": [], "id": [], "score": []}
        for a, at, scores in self.same_label(anchors, rows, least):
            best = first(scores, rows.id[at], self.positives)
            out["key"].append(np.full(len(best), anchors.key[a]))
            out["id"].append(rows.id[at[best]])
            out["score"].append(scores[best])
        return _joined(out)

    def best_negatives(self, anchors, rows, low, high):
        """The first rows of other labels in each window of each anchor; ``low`` above ``high`` is no window."""
        out = {"key": [], "n": [], "id": [], "score": []}
        everything = np.arange(len(rows.id))
        for start in range(0, len(anchors.key), CHUNK):
            chosen = np.arange(start, min(start + CHUNK, len(anchors.key)))
            least, most = rows.bounds(anchors, chosen, everything)
            open_ = np.zeros(least.shape, bool)
            for k in range(low.shape[1]):
                from_, to = low[chosen, k, None], high[chosen, k, None]
                open_ |= (most >= from_) & (least <= to) & (from_ <= to)
            open_ &= rows.label != anchors.label[chosen][:, None]
            used = np.flatnonzero(open_.any(axis=0))
            scores = products(anchors.x[chosen], rows.x[used])
            for a, mask, score in zip(chosen, open_[:, used], scores):
                at, score = used[mask], score[mask]
                for k in range(low.shape[1]):
                    inside = np.flatnonzero((score >= low[a, k]) & (score <= high[a, k]))
                    best = inside[first(score[inside], rows.id[at[inside]], self.negatives)]
                    out["key"].append(np.full(len(best), anchors.key[a]))
                    out["n"].append(np.full(len(best), k + 1))
                    out["id"].append(rows.id[at[best]])
                    out["score"].append(score[best])
        return _joined(out)


def _joined(columns):
    return {c: pa.array(np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64)) for c, v in columns.items()}


def _prepared(rows, directions, size, scale):
    """Whole numbers, length, angles, and the number of the nearest reference."""
    def run(batches):
        for batch in batches:
            x = whole(padded(batch.column(3), size), scale)
            norms, angle = angles(x, directions)
            cell = angle.argmin(axis=1) if len(directions) else np.zeros(len(x), np.int64)
            own = angle.min(axis=1) if len(directions) else np.zeros(len(x), np.float32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], lists(x, np.int32), pa.array(norms), lists(angle, np.float32), pa.array(cell.astype(np.int32)), pa.array(own)],
                ["key", "id", "label", "x", "norm", "angles", "cell", "own"])

    return rows.mapInArrow(run, f"{_ROW}, cell int, own float")


def _dealt(rows):
    """Rows with ``place`` (reference and band) and ``salt`` (block of the place), and the limits of each place."""
    borders = F.percentile_approx("own", [k / BANDS for k in range(1, BANDS)], 10_000)
    # One row per reference, with the borders of as many bands as its rows fill blocks.
    bands = rows.groupBy("cell").agg(F.count("*").alias("n"), borders.alias("borders"))
    wanted = F.least(F.lit(BANDS), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int")
    picked = F.transform(F.sequence(F.lit(1), wanted), lambda k: F.get("borders", F.floor(k * BANDS / wanted).cast("int") - 1))
    bands = F.broadcast(bands.select("cell", F.when(wanted > 1, F.slice(picked, 1, wanted - 1)).alias("borders")))
    band = F.coalesce(F.size(F.filter("borders", lambda b: b <= F.col("own"))), F.lit(0))
    band = F.when(F.col("borders").isNull(), 0).otherwise(band)
    placed = rows.join(bands, "cell").withColumn("place", (F.col("cell") * BANDS + band).cast("int")).drop("borders", "cell", "own")
    return placed.checkpoint()


def _stats(placed, count):
    """A row per place, at most references times bands of them."""
    each = lambda fn: F.array(*[fn(F.get("angles", F.lit(k))) for k in range(count)]).cast("array<float>")
    return placed.groupBy("place").agg(
        F.count("*").alias("n"), F.min("norm").alias("low_norm"), F.max("norm").alias("high_norm"),
        each(F.min).alias("low"), each(F.max).alias("high")).orderBy("place").collect()


def _meet(placed, asked, fn, schema):
    """Run ``fn(anchors, rows)`` for every block that anchors are sent to: ``asked`` has ``place``, ``salt`` and the anchor's columns.

    Anchors of a place are dealt into groups of bounded size; a block meets every group.
    """
    groups = asked.groupBy("place").agg(F.ceil(F.count("*") / F.max("salts") / BLOCK_ANCHORS).cast("int").alias("groups"))
    groups = F.broadcast(groups)  # a row per place at most
    left = asked.join(groups, "place").withColumn("group", F.pmod(F.xxhash64("key"), F.col("groups")).cast("int"))
    right = placed.join(groups, "place").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    # Both sides come from the same rows; new names keep their columns apart.
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    by = "place", "salt", "group"
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(fn, schema)


def mine(vectors, every=100, positives=5, negatives=5, low_percent=80, high_percent=100, scale=256,
         id_col="vec_id", vector_col="embedding", label_col="label"):
    """Hard negatives of every row whose id is divisible by ``every``.

    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``. Positives are the best other rows of the anchor's label, negatives the
    best rows of other labels with low_percent * positive_score <= 100 * negative_score <=
    high_percent * positive_score; ties go to smaller ids. Rows without id, label or vector,
    or with null or non-finite components, take no part. A shorter vector ends in zeros,
    components are held within 2^24. Rows that repeat an id are rows of their own, but an
    anchor's positives have other ids than it. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = with_checkpoints(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                                            F.col(vector_col).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite("v"))
    size = longest(rows, "v")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v")
    if not len(sample):
        return spark.createDataFrame([], schema)
    directions = references(whole(padded(sample, size), scale))
    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "id", "label", "v")
    placed = _dealt(_prepared(keyed, directions, size, scale))
    search = Search(size, len(directions), positives, negatives)
    search.places(_stats(placed, len(directions)))
    salts = F.broadcast(spark.createDataFrame([(int(p), int(s)) for p, s in zip(search.place, search.salts)], "place int, salts int"))
    placed = placed.join(salts, "place").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    anchors = placed.where(F.col("id") % every == 0)
    placed = placed.drop("salts")
    side = lambda t: Side(t, size, len(directions))
    plain = anchors.drop("place", "salt", "salts")

    def sent(targets, carried):
        """An anchor with what it carries, for every block of the places it is sent to."""
        spread = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        return spread.join(carried, "key")

    def at_home(left, right):
        return pa.table(search.offered(side(left), side(right)))

    offered = _meet(placed, anchors, at_home, "key bigint, least bigint")
    limited = plain.join(offered, "key", "left").checkpoint()

    def positive_places(batches):
        def wanted(part, low, high):
            least = part.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
            return high >= np.where(np.isnan(least), -np.inf, least)[:, None]
        yield from search.targets(batches, wanted)

    def find_positives(left, right):
        least = left.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
        return pa.table(search.best_positives(side(left), side(right), np.where(np.isnan(least), -np.inf, least)))

    targets = limited.mapInArrow(positive_places, "key bigint, place int, salts int")
    found = _meet(placed, sent(targets, limited), find_positives, "key bigint, id bigint, score bigint")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).checkpoint()

    # The window in whole numbers: ceil(low * score / 100) and floor(high * score / 100), within 64 bits on the way.
    rest = F.pmod(F.col("score"), F.lit(100))
    hundreds = F.call_function("div", F.col("score") - rest, F.lit(100).cast("long"))
    low, high = hundreds * low_percent + F.ceil(rest * low_percent / 100), hundreds * high_percent + F.floor(rest * high_percent / 100)
    windows = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(
        "n", low.alias("low"), high.alias("high")))).alias("w"))
    fill = lambda name, value: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda k: F.coalesce(F.get(F.col(f"w.{name}"), k), F.lit(value).cast("long")))
    asking = plain.join(windows.select("key", fill("low", 1).alias("low"), fill("high", 0).alias("high")), "key").checkpoint()

    def negative_places(batches):
        def wanted(part, low, high):
            from_, to = (padded(part.column(c), positives) for c in ("low", "high"))
            return np.logical_or.reduce([(high >= f[:, None]) & (low <= t[:, None]) & (f <= t)[:, None] for f, t in zip(from_.T, to.T)])
        yield from search.targets(batches, wanted)

    def find_negatives(left, right):
        from_, to = (padded(left.column(c), positives) for c in ("low", "high"))
        return pa.table(search.best_negatives(side(left), side(right), from_, to))

    targets = asking.mapInArrow(negative_places, "key bigint, place int, salts int")
    negative = _meet(placed, sent(targets, asking), find_negatives, "key bigint, n bigint, id bigint, score bigint")
    order = Window.partitionBy("key", "n").orderBy(F.desc("score"), "id")
    negative = negative.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = found.join(plain.select("key", F.col("id").alias("anchor_id")), "key").select(
        "key", F.col("n").cast("long").alias("n"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negative.select("key", "n", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(
        named, ["key", "n"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
