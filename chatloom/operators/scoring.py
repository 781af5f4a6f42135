"""Confidence labels of question-answer rows."""

from pyspark.sql import functions as F

from chatloom.functions.confidence import confidence_label, third
from chatloom.functions.text import words


def confidence(df, question, answer, context):
    """Add ``confidence``: low, medium or high."""
    return df.withColumn("confidence", confidence_label(F.col(question), F.col(answer), F.col(context)))


def session_confidence(turns, pairs):
    """(session_id, turn, confidence) of answers, supported by everything said before them.

    A word of an answer is supported when its first use in the session is earlier. Work is
    keyed by session and word and linear in the words, so no context is ever written out
    and a long session stays spread.
    """
    said = turns.select("session_id", "turn", F.explode(F.array_distinct(words(F.concat("role", F.lit(" "), "text")))).alias("word"))
    first = said.groupBy(F.col("session_id").alias("__sid"), F.col("word").alias("__word")).agg(F.min("turn").alias("__first"))
    used = pairs.select("session_id", "turn", F.explode_outer(F.array_distinct(words(F.coalesce("answer", F.lit(""))))).alias("word"))
    supported = used.join(first, F.col("session_id").eqNullSafe(F.col("__sid")) & (F.col("word") == F.col("__word"))
                          & (F.col("__first") < F.col("turn")), "left")
    counts = supported.groupBy("session_id", "turn").agg(F.count("word").alias("__n"), F.count("__first").alias("__hit"))
    return counts.select("session_id", "turn", third(F.col("__hit"), F.col("__n")).alias("confidence"))
