"""Language-model scoring: word unigrams as a base, and a causal self-attention model.

Word counts cover all training texts. They are added up per task, then over the corpus;
the most frequent words, a bounded number, are broadcast, and the others are joined by
word. The attention model learns subword ids. It stands on counts of neighbouring ids over
all training texts, a table of fixed size. Then every task trains a copy on all windows of its
training texts, which goes on learning from part to part, and the copies are averaged,
weighted by their windows, so that what is learned from grows with the corpus. Texts are
scored in overlapping windows, each subword once.
"""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chatloom.llm import attention, bpe
from chatloom.llm.columns import LOWER, slices, utf8
from chatloom.llm.shingles import word_hashes
from chatloom.session import shared_folder

#: Text bytes, and subword ids, that are worked on at a time.
BLOCK_BYTES, BLOCK_IDS = 2 << 20, 1 << 19
#: Most frequent words whose counts are broadcast: 16 bytes each.
HEAD_WORDS = 1 << 16
#: Added to each word count.
SMOOTHING = 0.1
#: Rounds of training and averaging.
ROUNDS = 2
#: Windows of a task that are put in random order together; a task goes on from one such part to the next.
PART_WINDOWS = 1 << 13

#: Hash that stands for the end of a text.
END_WORD = np.int64(int.from_bytes(hashlib.sha256(b"end of text").digest()[:8], "little", signed=True))


def is_held_out(id_col="doc_id"):
    """Rows that never train: crc32 of the id as text leaves 0 when divided by 10."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(True))


# ---- words

def word_counts(texts):
    """``word`` (a 64-bit hash) and ``n`` over all rows, the end of each counted."""
    def run(batches):
        for batch in batches:
            found, rows = [], 0
            for part in slices([batch], 0, BLOCK_BYTES):
                data, at = utf8(part.column(0))
                found.append(word_hashes(data, at[1:])[0].view(np.int64))
                rows += part.num_rows
            word, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": pa.array(np.append(word, END_WORD)), "n": pa.array(np.append(n, rows))})

    return texts.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Head:
    """Sorted hashes of the most frequent words and their log10 probabilities."""

    def __init__(self, words, counts, divisor):
        order = np.argsort(words)
        self.words, self.logs = words[order], np.log10((counts[order] + SMOOTHING) / divisor)

    def split(self, words, stops):
        """Per text the sum and number of its head words, and which words are none."""
        at = np.minimum(np.searchsorted(self.words, words), max(0, len(self.words) - 1))
        inside = self.words[at] == words if len(self.words) else np.zeros(len(words), bool)
        value = np.where(inside, self.logs[at], 0.0) if len(self.words) else np.zeros(len(words))
        rows = np.repeat(np.arange(len(stops)), np.diff(np.concatenate([[0], stops])))
        sums = np.bincount(rows, value, len(stops)).astype(np.float64)
        return sums, np.bincount(rows[inside], minlength=len(stops)).astype(np.int64), ~inside, rows


# ---- subword ids

def _prepared(docs, head, rank_file, pattern):
    """One row per text: ``doc_id``, ``held_out``, ``n_words``, head sums, other words and subword ids."""
    def run(batches):
        coder, known = bpe.encoding(rank_file, pattern), head.value
        for part in slices(batches, 1, BLOCK_BYTES):
            data, at = utf8(part.column(1))
            words, stops = word_hashes(data, at[1:])
            words = words.view(np.int64)
            sums, numbers, rare, rows = known.split(words, stops)
            ends = np.searchsorted(rows[rare], np.arange(part.num_rows), side="right")
            rare_words = words[rare]
            ids, lengths = bpe.encode_rows(coder, LOWER[data], at)
            ids, id_ends = ids.astype("<u4" if coder.n_vocab > 0xFFFF else "<u2"), np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(np.diff(np.concatenate([[0], stops]))), pa.array(sums), pa.array(numbers),
                 pa.array([rare_words[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)], pa.binary()),
                 pa.array([ids[a:b].tobytes() for a, b in zip(id_ends - lengths, id_ends)], pa.binary())],
                ["doc_id", "held_out", "n_words", "head_sum", "head_known", "rare", "ids"])

    return docs.mapInArrow(
        run, "doc_id bigint, held_out boolean, n_words bigint, head_sum double, head_known bigint, rare binary, ids binary")


def _lowered(text):
    """The text with A-Z in lower case; on bytes, where only these letters change."""
    return (text or "").encode().lower().decode()


def _blocks(batches, kind, columns):
    """Rows of Arrow batches in blocks of about ``BLOCK_IDS`` ids: the columns, all ids and their number per row."""
    for batch in batches:
        sizes = np.array([len(x) // np.dtype(kind).itemsize for x in batch.column(columns).to_pylist()], np.int64)
        group = np.cumsum(sizes) // BLOCK_IDS
        for start in np.unique(group, return_index=True)[1].tolist() if len(group) else []:
            stop = int(np.searchsorted(group, group[start], side="right"))
            part = batch.slice(start, stop - start)
            yield part, np.frombuffer(b"".join(part.column(columns).to_pylist()), kind), sizes[start:stop]


def _id_counts(rows, kind, size):
    """How often each id and the end occurs in training texts: an array, as long as the vocabulary."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for _, ids, lengths in _blocks(batches, kind, 0):
            total[:-1] += np.bincount(ids, minlength=size - 1)
            total[-1] += len(lengths)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(at), "n": pa.array(total[at])})

    counts = np.zeros(size, np.int64)
    for row in rows.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row.id] = row.n
    return counts


def _pair_counts(rows, kind, vocabulary):
    """How often each slot of ids comes after each input class in training texts: a table whose size the model fixes."""
    size = attention.IN_CLASSES * attention.SLOTS

    def run(batches):
        total, words = np.zeros(size, np.int64), vocabulary.value
        for _, ids, lengths in _blocks(batches, kind, 0):
            inputs, targets = attention.Laid(ids, lengths, words).steps()
            total += np.bincount(inputs.astype(np.int64) * attention.SLOTS + words.slot[targets], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    found = rows.select("ids").mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(size, np.float32)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return counts.reshape(attention.IN_CLASSES, attention.SLOTS)


def _parts(batches, kind, words):
    """All windows of the texts of a task as (inputs, targets, valid), at most ``PART_WINDOWS`` at a time."""
    held, n = [], 0
    for _, ids, lengths in _blocks(batches, kind, 0):
        text, first, scored = attention.windows_of(lengths)
        laid, start = attention.Laid(ids, lengths, words), 0
        while start < len(text):
            own = slice(start, start + PART_WINDOWS - n)
            inputs, targets, valid = laid.windows(text[own], first[own], scored[own] * 0)
            held.append((inputs, words.out_class(targets), valid))
            start, n = start + len(inputs), n + len(inputs)
            if n == PART_WINDOWS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def _trained(rows, kind, vocabulary, parameters):
    """One round over training texts: parameters averaged over tasks, weighted by their windows; None without texts."""
    shared = rows.sparkSession.sparkContext.broadcast(parameters)

    def run(batches):
        trainer, weight = attention.Trainer(shared.value, vocabulary.value), 0
        for inputs, targets, valid in _parts(batches, kind, vocabulary.value):
            trainer.learn(inputs, targets, valid)
            weight += len(inputs)
        if weight:
            values = np.append(attention.flat(trainer.p) * weight, weight)
            yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(values), dtype=np.int32)), "value": pa.array(values)})

    # A number of values that the model fixes, whatever the number of tasks.
    sums = rows.select("ids").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toArrow()
    values = sums.column("value").to_numpy()
    return attention.unflat(values[:-1] / values[-1], parameters) if len(values) else None


def _scores(rows, kind, vocabulary, parameters):
    """``row`` and the natural log probability ``logs`` of each text."""
    def run(batches):
        for part, ids, lengths in _blocks(batches, kind, 1):
            logs = attention.log_probabilities(parameters.value, vocabulary.value, ids, lengths)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(logs)], ["row", "logs"])

    return rows.select("row", "ids").mapInArrow(run, "row bigint, logs double")


def _rare_sums(rows, counts, divisor):
    """Per ``row`` the sum over its words outside the head and how many of them are known."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [np.unique(np.frombuffer(x, np.int64), return_counts=True) for x in part.column(1).to_pylist()]
                if texts:
                    yield pa.RecordBatch.from_pydict({
                        "row": pa.array(np.repeat(part.column(0).to_numpy(), [len(w) for w, _ in texts])),
                        "word": pa.array(np.concatenate([w for w, _ in texts])), "times": pa.array(np.concatenate([t for _, t in texts]).astype(np.int32))})

    found = rows.select("row", "rare").mapInArrow(run, "row bigint, word bigint, times int").join(counts, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + SMOOTHING) / F.lit(divisor))
    return found.groupBy("row").agg(
        F.sum(F.col("times") * log).alias("rare_sum"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))


def score(docs, rank_file, pattern, id_col="doc_id", text_col="text"):
    """Base and model scores of every row, learned from the rows that are not held out.

    ``doc_id``, ``held_out``, ``n_tokens`` (words and the end), ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` (log10 probabilities of the text by word unigrams and by the
    attention model), ``n_subwords``. A null text is empty and is only its end; a row
    without an id is held out; repeated rows train and are scored like others; other
    columns are not read. Without training rows nothing is known and
    the model is as drawn.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), is_held_out(id_col).alias("held_out"))
    folder = shared_folder(spark, "lm")
    word_counts(rows.where("not held_out").select("text")).write.parquet(f"{folder}/words")
    counts = spark.read.parquet(f"{folder}/words")
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, divisor = size.n or 0, (size.n or 0) + SMOOTHING * (size.v + 1)
    top = counts.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).toArrow()
    head = Head(top.column("word").to_numpy(), top.column("n").to_numpy(), divisor)
    coder = bpe.encoding(rank_file, pattern)
    kind, vocabulary_size = "<u4" if coder.n_vocab > 0xFFFF else "<u2", coder.n_vocab + 1

    _prepared(rows.select("doc_id", "text", "held_out"), spark.sparkContext.broadcast(head), rank_file, pattern).withColumn(
        "row", F.monotonically_increasing_id()).write.parquet(f"{folder}/texts")
    texts = spark.read.parquet(f"{folder}/texts")
    training = texts.where("not held_out")
    vocabulary = attention.Vocabulary(_id_counts(training, kind, vocabulary_size))
    vocabulary.pairs(_pair_counts(training, kind, spark.sparkContext.broadcast(vocabulary)))
    parameters, shared = attention.initial(), spark.sparkContext.broadcast(vocabulary)
    for _ in range(ROUNDS):
        parameters = _trained(training, kind, shared, parameters) or parameters

    logs = _scores(texts, kind, shared, spark.sparkContext.broadcast(parameters))
    ends = counts.where(F.col("word") == int(END_WORD)).first()
    end = math.log10(((ends.n if ends else 0) + SMOOTHING) / divisor)
    known_end = int(total > 0)
    out = texts.select("row", "doc_id", "held_out", "n_words", "head_sum", "head_known", F.octet_length("ids").alias("size")).join(
        logs, "row").join(_rare_sums(texts, counts, divisor), "row", "left")
    return out.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("head_known") + F.coalesce("rare_known", F.lit(0)) + known_end).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("rare_sum", F.lit(0.0)) + end).alias("base_score"),
        (F.col("logs") / math.log(10)).alias("score"), (F.col("size") / np.dtype(kind).itemsize).cast("long").alias("n_subwords"))
