"""Rails backed by a model: a vectorised scoring function over batches of texts."""

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from chatloom.functions.rails import PROFANITY_CATEGORY, PROFANITY_ERROR_REASON, PROFANITY_REASON, GuardRail, Outcome

POLICIES = ("open", "closed")
PIECE_BYTES = 2 << 20  # of texts that are held as Python strings at a time


def _pieces(texts):
    """Consecutive slices of an Arrow array of texts, of about ``PIECE_BYTES`` each; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(texts):
        held = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + PIECE_BYTES, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


def _results(texts, call, numeric, kind):
    """struct<value, error> of one piece. ``call`` gives (results, None) or (None, error); a part that fails is halved."""
    texts = texts.to_pylist()
    values, errors = [None] * len(texts), [None] * len(texts)
    wanted = [i for i, t in enumerate(texts) if t is not None]
    todo = [wanted] if wanted else []
    while todo:
        part = todo.pop()
        results, error = call([texts[i] for i in part])
        if error is None:
            for i, value in zip(part, results):
                values[i] = value
        elif len(part) == 1 or error == Breaker.OPEN:
            for i in part:
                errors[i] = error
        else:
            todo += [part[len(part) // 2:], part[:len(part) // 2]]
    found = pa.array(np.array(values, np.float64), from_pandas=True) if numeric else pa.array(values, kind, from_pandas=True)
    return pa.StructArray.from_arrays([found, pa.array(errors, pa.string())], ["value", "error"])


def _column(start, returns):
    """A function from a text column to struct<value, error>; ``start()`` gives a task its ``call``.

    Spark bounds the batches of a task in rows, and in bytes far above a piece. They stay in
    Arrow, and only a piece at a time is taken out as Python strings, which need up to four times the bytes.
    """
    def of(text):
        numeric, kind = returns in ("double", "float"), to_arrow_type(T.DataType.fromDDL(returns))

        @F.arrow_udf(f"value {returns}, error string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            call = start()
            for texts in batches:
                for piece in _pieces(texts):
                    yield _results(piece, call, numeric, kind)
                texts = piece = None  # not held while the next batch is read

        return run(text)

    return of


def model_column(fn, returns="double"):
    """A function from a text column to struct<value, error> of ``fn``.

    ``fn`` maps a list of texts to a list of results of the type ``returns``: a
    confidence, a language code, a translation. A batch that fails is halved until the
    texts that fail are alone, so one bad text does not decide over the others and costs
    about two calls per halving. Lists are bounded in rows and in bytes of text.
    """
    def call(texts):
        try:
            results = list(fn(texts))
            if len(results) != len(texts):
                raise ValueError("the model returned a different number of results")
            return results, None
        except Exception as error:
            return None, f"{type(error).__name__}: {error}"

    return _column(lambda: call, returns)


def _loaded(key, load):
    """The model of this worker process. Functions come to a task as copies with globals of their own, so a module made for it keeps the models."""
    models = sys.modules.setdefault("_models_of_worker", types.ModuleType("_models_of_worker")).__dict__
    if key not in models:
        models[key] = load()
    return models[key]


class Breaker:
    """Calls to a model with a budget of retries, stopped for a while after failures in a row.

    A call that fails is tried again while the task has retries left. After ``trip`` calls
    in a row that failed the breaker opens: the next ``rest`` texts are refused without
    a call. Then one call is let through; if it fails too, the breaker opens again.
    """

    OPEN = "BreakerOpen: the model failed too often"

    def __init__(self, fn, retries, trip, rest):
        self.fn, self.retries, self.trip, self.rest = fn, retries, trip, rest
        self.failed, self.resting = 0, 0

    def call(self, texts):
        """(results, None), or (None, error); an open breaker gives its own error."""
        if self.resting > 0:
            self.resting -= len(texts)
            return None, self.OPEN
        while True:
            try:
                results = list(self.fn(texts))
                if len(results) != len(texts):
                    raise ValueError("the model returned a different number of results")
                self.failed = 0
                return results, None
            except Exception as error:
                self.failed += 1
                if self.failed >= self.trip:
                    self.resting = self.rest
                    return None, f"{type(error).__name__}: {error}"
                if not self.retries:
                    return None, f"{type(error).__name__}: {error}"
                self.retries -= 1


def worker_model_column(load, returns="double", retries=100, trip=50, rest=10_000):
    """Like ``model_column`` for a model that is dear to load: ``load()`` gives the function over texts.

    It runs once per worker process, however many tasks and batches that process gets. A
    task has ``retries`` repeated calls and a ``Breaker`` of its own. A batch that fails is halved as
    in ``model_column``; halving one bad text out of a batch takes about as many failed
    calls as the batch has binary digits, each followed by one that works, so ``trip`` lies
    above that. Texts met while the breaker is open have its error. An error of ``load`` fails the task.
    """
    key = uuid.uuid4().hex
    return _column(lambda: Breaker(_loaded(key, load), retries, trip, rest).call, returns)


class ModelRail(GuardRail):
    """Blocks when the model's confidence is strictly above the threshold.

    Policy for texts the model fails on: ``open`` lets them pass as unscored,
    ``closed`` blocks them with the error reason.
    """

    name = "model"

    def __init__(self, fn, failure="open", threshold=0.5, reason=PROFANITY_REASON, error_reason=PROFANITY_ERROR_REASON):
        if failure not in POLICIES:
            raise ValueError(f"failure must be one of {POLICIES}")
        self.udf, self.failure, self.threshold = model_column(fn), failure, threshold
        self.reason, self.error_reason = reason, error_reason

    def process(self, text):
        return self.outcome(self.udf(text))

    def outcome(self, result):
        """Outcome of a result column computed before, e.g. to use it in several rails."""
        over = F.coalesce(result["value"] > self.threshold, F.lit(False))
        broken = result["error"].isNotNull() if self.failure == "closed" else F.lit(False)
        reason = F.when(broken, self.error_reason).otherwise(self.reason)
        return Outcome(broken | over, reason, F.lit(""))

    def categories(self, result, name=PROFANITY_CATEGORY):
        """The result as a categories array: empty without a score."""
        one = F.array(F.struct(F.lit(name).alias("name"), result["value"].alias("confidence")))
        return F.when(result["value"].isNotNull(), one).otherwise(F.array().cast("array<struct<name:string,confidence:double>>"))


def model_rail(fn, failure="open", threshold=0.5, reason=PROFANITY_REASON):
    return ModelRail(fn, failure, threshold, reason)
