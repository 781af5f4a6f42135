"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered over all labelled rows, per task first. The matrix of log
probabilities (languages x buckets) has a fixed number of buckets. It is broadcast in parts
of a bounded number of languages; texts meet one part after the other, in batches as
sparse rows of bucket numbers, and carry the best language so far.
"""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from chatloom.llm.columns import row_sums, slices

#: Lengths of the character n-grams.
ORDERS = (1, 2, 3)
#: Hash buckets for all n-grams together.
BUCKETS = 1 << 16
#: Added to each count.
SMOOTHING = 0.5
#: Languages of a part of the broadcast matrix: 512 x 65,536 single floats are 128 MB.
PART_LANGUAGES = 512
#: Text bytes that are worked on at a time.
BLOCK_BYTES = 2 << 20

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def has_letter(text):
    return bool(text) and _LETTER.search(text) is not None


def grams(texts):
    """Bucket numbers of all n-grams of lower-cased texts, one array per order, and their ends by text.

    A text is bracketed by spaces, and n-grams do not reach over its brackets.
    """
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, padded), np.int64, len(padded)))
    out = []
    for order in ORDERS:
        mixed = np.full(len(codes) - order + 1, order, np.uint64)
        for k in range(order):
            mixed += codes[k:len(codes) - order + 1 + k] * _MULTIPLIERS[k]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        found = (mixed >> np.uint64(48)).astype(np.int32)
        keep = np.ones(len(found), bool)
        for k in range(1, order):  # windows that would run on into the next text
            at = ends - k
            keep[at[at < len(found)]] = False
        sizes = np.diff(np.concatenate([[0], ends])) - (order - 1)
        out.append((found[keep], np.cumsum(sizes)))
    return out


def train(labelled, lang_col="lang", text_col="text"):
    """Counts per language and bucket: ``lang``, ``bucket``, ``n``; rows without a language or letters do not count.

    Every task adds up its own rows first, so what is shuffled is at most languages x
    buckets rows a task, whatever the length of the texts.
    """
    def run(batches):
        counts = {}
        for part in slices(batches, 1, BLOCK_BYTES):
            rows = [(g, t) for g, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if has_letter(t)]
            for lang in {g for g, _ in rows}:
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for found, _ in grams([t for g, t in rows if g == lang]):
                    own += np.bincount(found, minlength=BUCKETS)
        for lang, own in counts.items():
            bucket = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(own[bucket])],
                ["lang", "bucket", "n"])

    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(lang_col, text_col)
    partial = rows.mapInArrow(run, "lang string, bucket int, n bigint")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Part:
    """Sorted languages and the log probability of each bucket in each of them."""

    def __init__(self, counts):
        """``counts``: language -> array of bucket counts."""
        self.languages = sorted(counts)
        table = np.array([counts[g] for g in self.languages], float).reshape(len(self.languages), BUCKETS) + SMOOTHING
        self.logs = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)

    def scores(self, texts):
        """Log likelihood of each text in each language."""
        total = np.zeros((len(texts), len(self.languages)))
        for found, ends in grams(texts):
            for k in range(len(self.languages)):
                total[:, k] += row_sums(self.logs[k].take(found).astype(np.float64), ends)
        return total


class Model:
    """All languages, sorted, and the broadcast parts of the matrix in their order."""

    def __init__(self, languages, parts):
        self.languages, self.parts = languages, parts

    @classmethod
    def collect(cls, counts):
        """Bring the counts to the driver, ``PART_LANGUAGES`` languages at a time, and broadcast each part."""
        totals = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("own")).orderBy("lang")
        context = counts.sparkSession.sparkContext
        languages, parts, found = [], [], {}
        for row in totals.toLocalIterator():
            own = found.setdefault(row.lang, np.zeros(BUCKETS, np.int64))
            at = np.array([(x.bucket, x.n) for x in row.own], np.int64)
            own[at[:, 0]] = at[:, 1]
            languages.append(row.lang)
            if len(found) == PART_LANGUAGES:
                parts.append(context.broadcast(Part(found)))
                found = {}
        if found:
            parts.append(context.broadcast(Part(found)))
        return cls(languages, parts)


_TOP, _MASS, _LANG = "__top", "__mass", "__lang"


def _judged(docs, model, text_col, keep):
    """Columns ``keep`` of all rows with the best language so far, its log likelihood, and the sum of all likelihoods as a multiple of its own.

    A text without letters, and every text when no language was learned, gets nulls.
    """
    at, names = docs.columns.index(text_col), [*docs.columns, _LANG, _TOP, _MASS]
    none = {_LANG: F.lit(None).cast("string"), _TOP: F.lit(None).cast("double"), _MASS: F.lit(None).cast("double")}
    rows = docs.select("*", *[c.alias(n) for n, c in none.items()])
    if not model.parts:
        return rows.select(*keep, *none)

    def against(part, places):
        def run(batches):
            for batch in slices(batches, at, BLOCK_BYTES):
                texts = batch.column(at).to_pylist()
                own = [i for i, t in enumerate(texts) if has_letter(t)]
                langs = batch.column(len(names) - 3).to_pylist()
                tops, masses = (np.array(batch.column(len(names) - k).to_pylist(), float) for k in (2, 1))
                if own:
                    logs = part.value.scores([texts[i] for i in own])
                    best, new = logs.argmax(axis=1), logs.max(axis=1)
                    mass = np.exp(logs - new[:, None]).sum(axis=1)
                    old, before = tops[own], masses[own]
                    first = np.isnan(old)
                    top = np.where(first, new, np.fmax(old, new))
                    masses[own] = mass * np.exp(new - top) + np.where(first, 0.0, before * np.exp(np.where(first, top, old) - top))
                    tops[own] = top
                    for i, b, better in zip(own, best, first | (new > old)):
                        if better:
                            langs[i] = part.value.languages[b]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k) for k in places], pa.array(langs, pa.string()), pa.array(tops, from_pandas=True), pa.array(masses, from_pandas=True)],
                    [*[names[k] for k in places], *names[-3:]])
        return run

    for part in model.parts[:-1]:
        rows = rows.mapInArrow(against(part, range(len(names) - 3)), rows.schema)
    # Texts that nobody asked for stay behind in the last pass.
    return rows.mapInArrow(against(model.parts[-1], [docs.columns.index(c) for c in keep]), rows.select(*keep, *none).schema)


def predict(docs, model, id_col="doc_id", text_col="text"):
    """Language of each text: id column, ``lang_pred`` string, ``score`` double.

    The score is the posterior probability under equal priors; ties go to the language
    that sorts first. A text that is null or has no letter, and every text when no
    language was learned, gets ``und`` and score 0. Other columns are not read.
    """
    rows = _judged(docs.select(F.col(id_col), F.col(text_col)), model, text_col, [id_col])
    return rows.select(id_col, F.coalesce(_LANG, F.lit(UNDETERMINED)).alias("lang_pred"), F.coalesce(1 / F.col(_MASS), F.lit(0.0)).alias("score"))


def accepted(docs, model, least, text_col="text"):
    """The rows whose language is found with at least this score, all columns as they were.

    Undetermined texts are rejected; while no language was learned, texts with a letter stay.
    """
    if model.languages:
        return _judged(docs, model, text_col, docs.columns).where(1 / F.col(_MASS) >= least).select(*docs.columns)
    at = docs.columns.index(text_col)

    def run(batches):
        for part in slices(batches, at, BLOCK_BYTES):
            yield part.filter(pa.array([has_letter(t) for t in part.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def is_held_out(id_col="doc_id"):
    """Rows that never train: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs, id_col="doc_id", lang_col="lang", text_col="text"):
    """Learn from every row of ``docs`` that is not held out."""
    return Model.collect(train(docs.where(~is_held_out(id_col)), lang_col, text_col))
