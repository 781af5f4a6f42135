"""Texts that repeat passages of protected texts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatloom.functions.text import ngrams, run_hashes, words


# The outer form of explode is used throughout: for the plain one the optimizer adds a
# size filter below that would build every array twice. Empty inputs give a NULL run,
# which joins with nothing.

def _grams(text_col, n):
    return ngrams(words(F.col(text_col)), n)


def _hashed(df, id_col, text_col, n):
    return df.select(id_col, F.explode_outer(run_hashes(words(F.col(text_col)), n)).alias("__hash"))


def _meeting(texts, items, n, text_id, item_id, text_col):
    """Pairs of ids that have a run hash in common, with both texts."""
    runs = _hashed(items, item_id, "__item_text", n).distinct()
    pairs = _hashed(texts, text_id, text_col, n).join(runs, "__hash").select(text_id, item_id).distinct()
    return pairs.join(texts.select(text_id, text_col), text_id).join(items, item_id)


def leakage(texts, protected, n=8, text_id="id", item_id="item_id", text_col="text"):
    """(text id, item id, n_shared): distinct runs of ``n`` words in both texts.

    Both sides meet on an 8-byte hash of a run; Spark broadcasts the protected hashes when
    their measured size allows. The pairs found are counted exactly from their texts. Rows
    that repeat an id count together.
    """
    items = protected.select(F.col(item_id), F.col(text_col).alias("__item_text"))
    shared = F.size(F.array_intersect(_grams(text_col, n), _grams("__item_text", n)))  # each run once
    return (_meeting(texts, items, n, text_id, item_id, text_col)
            .groupBy(text_id, item_id).agg(F.sum(shared).cast("bigint").alias("n_shared"))
            .filter("n_shared > 0"))


def passages(texts, protected, n=8, text_id="id", item_id="item_id", text_col="text"):
    """(text id, item id, first_word, last_word, n_words): the longest stretches of a text of which
    every run of ``n`` words is also in the protected text.

    Words are counted from 0, the last one included. Neighbouring and overlapping runs become one stretch; it
    need not be one stretch of the protected text. Ids of the texts must not repeat.
    """
    items = protected.select(F.col(item_id), F.col(text_col).alias("__item_text"))
    met = _meeting(texts, items, n, text_id, item_id, text_col)
    found = met.withColumn("__grams", _grams("__item_text", n)).select(
        text_id, item_id, "__grams", F.posexplode_outer(_grams(text_col, n)).alias("__at", "__gram"))
    hits = found.filter(F.array_contains("__grams", F.col("__gram"))).select(text_id, item_id, "__at")
    # Hits in a row have the same distance to their number; only hits of one pair are ordered.
    number = F.row_number().over(Window.partitionBy(text_id, item_id).orderBy("__at"))
    stretches = hits.withColumn("__group", F.col("__at") - number).groupBy(text_id, item_id, "__group").agg(
        F.min("__at").alias("__first"), F.max("__at").alias("__last"))
    first, last = F.col("__first").cast("bigint"), F.col("__last").cast("bigint") + (n - 1)
    return stretches.select(text_id, item_id, first.alias("first_word"), last.alias("last_word"), (last - first + 1).alias("n_words"))
