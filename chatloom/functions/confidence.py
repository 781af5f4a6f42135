"""Confidence label of an answer."""

from pyspark.sql import functions as F

from chatloom.functions.text import bound, words

LABELS = ("low", "medium", "high")


def third(hit, n):
    """Label of ``hit`` words found out of ``n``."""
    return F.when((n == 0) | (hit * 3 < n), "low").when(hit * 3 < n * 2, "medium").otherwise("high")


def confidence_label(question, answer, context):
    """Share of distinct answer words found in question or context, in thirds."""
    support = words(F.concat_ws(" ", question, context))

    def counts(answer_words):
        return F.struct(F.size(F.array_intersect(answer_words, support)).alias("hit"), F.size(answer_words).alias("n"))

    answer_words = F.array_distinct(words(F.coalesce(answer, F.lit(""))))
    return bound(bound(answer_words, counts), lambda c: third(c["hit"], c["n"]))


def normalise_label(raw):
    """A scorer's raw output as one of the three labels, or NULL."""
    cleaned = F.lower(F.regexp_replace(raw, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    return F.when(cleaned.isin(*LABELS), cleaned)
