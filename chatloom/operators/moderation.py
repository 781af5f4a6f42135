"""Moderation learned from labelled texts: hashed words and logistic regression.

Every distinct word of a text sets one of ``BUCKETS`` features. Features whose share among
the positive rows is no surprise (a chi-square below ``SURPRISE``) are left out: rare words of any kind
would explain the labels by chance. Weights of the others minimise the logistic
loss over all labelled rows plus a ridge term, by L-BFGS: a round is one job in which each task adds up its
rows and gives back one sum per feature, so the driver holds ``BUCKETS`` numbers at most however many
rows there are. Scores are turned into probabilities on rows that the weights have not seen,
from counts in bins of the score. Scoring is made of built-in expressions only.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chatloom.functions.rails import PROFANITY_CATEGORY
from chatloom.functions.text import bound, words
from chatloom.session import shared_folder

BUCKETS = 1 << 18
SURPRISE = 12.0      # chi-square of a feature and the label, one degree of freedom
RIDGE = 0.5          # weight of the squared weights in the sum of losses
ROUNDS, MEMORY = 25, 8
BINS, BIN = 400, 0.1  # bins of the score for the calibration, and their width: scores from -20 to 20


def features(text, buckets=BUCKETS):
    """The features that are set for a text; a missing text has none."""
    hashed = F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    return F.coalesce(F.array_distinct(hashed), F.array().cast("array<int>"))


def fold(key, folds=5):
    """The part a row belongs to, by its key."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(folds)).cast("int")


@dataclass(frozen=True)
class Moderator:
    """Weights of the features, and the line that turns scores into log odds."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def score(self, text):
        # One literal that the optimizer turns into an array of numbers once.
        table = F.split(F.lit(",".join(f"{w:.6g}" for w in self.weights)), ",").cast("array<double>")
        return F.aggregate(features(text, len(self.weights)), F.lit(float(self.bias)), lambda a, i: a + F.get(table, i))

    def confidence(self, text):
        """Probability that a text is to be blocked; NULL for no text."""
        odds = F.lit(float(self.slope)) * self.score(text) + F.lit(float(self.shift))
        return F.when(text.isNotNull(), F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))

    def categories(self, text):
        """The categories a rail asks for: one name and its confidence, none for no text."""
        def one(confidence):
            named = F.array(F.struct(F.lit(PROFANITY_CATEGORY).alias("name"), confidence.alias("confidence")))
            return F.when(confidence.isNotNull(), named).otherwise(F.array().cast("array<struct<name:string,confidence:double>>"))
        return bound(self.confidence(text), one)


def sums(batches, weights, place_of):
    """Loss, gradient and number of rows of (features, label) batches; the last gradient is that of the bias.

    ``place_of`` gives the place of a feature among the weights, or -1.
    """
    loss, count, gradient = 0.0, 0, np.zeros(len(weights))
    for batch in batches:
        if not batch.num_rows:
            continue
        lists, label = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        index = place_of[lists.flatten().to_numpy()]
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
        index, row = index[index >= 0], row[index >= 0]
        score = weights[-1] + np.bincount(row, weights[index], batch.num_rows)
        loss += np.logaddexp(0, np.where(label > 0, -score, score)).sum()
        off = 1 / (1 + np.exp(-np.clip(score, -500, 500))) - label
        gradient[:-1] += np.bincount(index, off[row], len(weights) - 1)
        gradient[-1] += off.sum()
        count += batch.num_rows
    return loss, gradient, count


def lbfgs(evaluate, start, rounds=ROUNDS, memory=MEMORY):
    """A minimum of a smooth function; ``evaluate`` gives value and gradient at a point."""
    x, (value, slope) = start, evaluate(start)
    steps = []
    for _ in range(rounds):
        direction, factors = slope.copy(), []
        for s, y in reversed(steps):
            a = s @ direction / (s @ y)
            factors.append(a)
            direction -= a * y
        if steps:
            s, y = steps[-1]
            direction *= s @ y / (y @ y)
        else:
            direction /= max(1.0, np.abs(slope).sum())
        for (s, y), a in zip(steps, reversed(factors)):
            direction += s * (a - y @ direction / (s @ y))
        fall, length = slope @ direction, 1.0
        while True:
            there = x - length * direction
            value_there, slope_there = evaluate(there)
            if value_there <= value - 1e-4 * length * fall or length < 1e-6:
                break
            length /= 2
        s, y = there - x, slope_there - slope
        done = value - value_there <= 1e-7 * max(1.0, abs(value))
        x, value, slope = there, value_there, slope_there
        if s @ y > 1e-12:
            steps = (steps + [(s, y)])[-memory:]
        if done:
            break
    return x


def _checkpointed(df):
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def telling(rows, surprise=SURPRISE):
    """The features of (features, label) rows that tell something about the label, in order."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).first()
    if not total.n or not 0 < total.k < total.n:
        return np.zeros(0, np.int64)
    share = total.k / total.n
    counts = rows.select(F.explode("features").alias("feature"), "label").groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
    off = F.greatest(F.lit(0.0), F.abs(F.col("k") - F.col("n") * share) - 0.5)
    spread = F.col("n") * share * (1 - share) * (1 - F.col("n") / total.n)
    found = counts.where((spread > 0) & (off * off >= surprise * spread)).select("feature")
    return np.sort(np.array([r.feature for r in found.collect()], np.int64))  # a row per feature at most


def fit(rows, buckets=BUCKETS, ridge=RIDGE, surprise=SURPRISE):
    """Weights from all rows of (features, label 0 or 1); null labels are left out."""
    rows = rows.where("label is not null").select("features", F.col("label").cast("double").alias("label"))
    kept = telling(rows, surprise)
    place_of = np.full(buckets, -1, np.int64)
    place_of[kept] = np.arange(len(kept))

    def evaluate(point):
        def run(batches):
            loss, gradient, count = sums(batches, point, place_of)
            if count:
                some = np.flatnonzero(gradient)
                yield pa.RecordBatch.from_pydict({"place": pa.array(np.append(some, -1)), "sum": pa.array(np.append(gradient[some], loss))})

        added = rows.mapInArrow(run, "place bigint, sum double").groupBy("place").agg(F.sum("sum")).collect()  # a row per feature at most
        gradient, loss = ridge * point, ridge * (point[:-1] @ point[:-1]) / 2
        gradient[-1] = 0
        for place, value in added:
            if place < 0:
                loss += value
            else:
                gradient[place] += value
        return loss, gradient

    point = lbfgs(evaluate, np.zeros(len(kept) + 1))
    weights = np.zeros(buckets)
    weights[kept] = point[:-1]
    return Moderator(weights, float(point[-1]))


def line(counts, steps=50):
    """Slope and shift of the log odds from (score, rows, positives) counts, by Newton's method; the slope is not negative."""
    counts = np.asarray(counts, float).reshape(-1, 3)
    z, n, k = counts.T
    if not n.sum() or k.sum() in (0, n.sum()):
        return 1.0, 0.0
    # Positives count as n+1 of n+2, negatives as 1 of m+2, so that perfect scores stay finite.
    high, low = (k.sum() + 1) / (k.sum() + 2), 1 / ((n - k).sum() + 2)
    target = k * high + (n - k) * low
    ab = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * z + ab[1], -500, 500)))
        gradient = np.array([((n * p - target) * z).sum(), (n * p - target).sum()])
        q = n * p * (1 - p)
        curve = np.array([[(q * z * z).sum(), (q * z).sum()], [(q * z).sum(), q.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        ab = ab - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < 1e-9:
            break
    return (max(0.0, float(ab[0])), float(ab[1]))


def calibrate(model, rows):
    """The model with its line fitted on (text, label) rows that it has not learned from."""
    place = F.greatest(F.lit(-BINS // 2), F.least(F.lit(BINS // 2), F.floor(model.score(F.col("text")) / BIN)))
    counts = rows.where("label is not null and text is not null").groupBy(place.alias("place")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("k")).orderBy("place").collect()  # a row per bin
    slope, shift = line([((r.place + 0.5) * BIN, r.n, r.k) for r in counts])
    return Moderator(model.weights, model.bias, slope, shift)


def learn(texts, labels, key, label):
    """A calibrated model from the rows of ``texts`` (key, text) that ``labels`` (key, label) names.

    Of five folds by key, three are learned from, one calibrates (3) and one stays out (4).
    """
    named = labels.where(F.col(label).isNotNull()).select(key, F.col(label).alias("label"))
    rows = texts.select(key, "text").join(named, key).withColumn("fold", fold(F.col(key)))
    learned = _checkpointed(rows.where("fold < 3").select(features(F.col("text")).alias("features"), "label"))
    return calibrate(fit(learned), rows.where("fold = 3"))


def quality(scored, threshold=0.5):
    """(rows, blocked, toxic, hits) of (confidence, label) rows; blocked is strictly above the threshold."""
    over = F.col("confidence") > threshold
    return scored.where("label is not null").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(over).alias("blocked"), F.count_if(F.col("label") == 1).alias("toxic"),
        F.count_if(over & (F.col("label") == 1)).alias("hits"))
