"""Nearest corpus rows of query vectors by cosine similarity."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 32 * 1024 * 1024  # of a block of vectors, as doubles
TILE_QUERIES = 256  # queries scored at a time at most
TILE_BYTES = 8 * 1024 * 1024  # of the scores of a tile
UNIT_ROWS = 4096  # vectors scaled at a time
DECIMALS = 6


def _unit_matrix(vectors):
    """Rows of a chunked list column scaled to length 1, as one matrix; a zero vector stays zero."""
    matrix, at = None, 0
    for chunk in vectors.iterchunks():
        for start in range(0, len(chunk), UNIT_ROWS):
            part = chunk.slice(start, UNIT_ROWS)
            rows = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            if matrix is None:
                matrix = np.zeros((len(vectors), rows.shape[1]))
            np.divide(rows, norms, out=matrix[at:at + len(rows)], where=norms > 0)
            at += len(rows)
    return matrix


def _best(scores, ids, k):
    """Positions of the ``k`` best of one query, higher score first, then lower id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        candidates = np.flatnonzero(scores >= floor)
    else:
        candidates = np.arange(len(scores))
    return candidates[np.lexsort((ids[candidates], -scores[candidates]))[:k]]


def _search_blocks(k):
    """A task function: a block of queries and a block of corpus rows in, the ``k`` best of each query out.

    Besides the rows themselves a task holds the corpus block as one matrix and the scores
    of a tile, whose size does not follow from that of the blocks.
    """
    def search(queries, corpus):
        query_ids, ids = queries.column("query_id").to_numpy(), corpus.column("doc_id").to_numpy()
        found_q, found_ids, found_scores = [query_ids[:0]], [ids[:0]], [np.empty(0)]
        if len(query_ids) and len(ids):
            unit_corpus = _unit_matrix(corpus.column("__vec")).T
            rows = max(1, min(TILE_QUERIES, len(query_ids), TILE_BYTES // (8 * len(ids))))
            tile = np.empty((rows, len(ids)))
            for at in range(0, len(query_ids), rows):
                own = query_ids[at:at + rows]
                scores = np.matmul(_unit_matrix(queries.column("__vec").slice(at, rows)), unit_corpus, out=tile[:len(own)])
                np.round(scores, DECIMALS, out=scores)
                scores += 0.0
                tops = [_best(row, ids, k) for row in scores]
                sizes = [len(top) for top in tops]
                found_q.append(np.repeat(own, sizes))
                found_ids.append(ids[np.concatenate(tops)])
                found_scores.append(scores[np.repeat(np.arange(len(own)), sizes), np.concatenate(tops)])
        return pa.table({"query_id": np.concatenate(found_q), "doc_id": np.concatenate(found_ids), "score": np.concatenate(found_scores)})
    return search


def _number_of_blocks(vectors, block_bytes):
    """How many blocks of at most about ``block_bytes`` the vectors make, found when the query runs."""
    return vectors.agg(F.greatest(F.lit(1), F.ceil(F.sum(F.size("__vec").cast("bigint") * 8 + 8) / block_bytes)).cast("int")).scalar()


def retrieve(queries, corpus, k, block_bytes=BLOCK_BYTES):
    """(query_id, rank, doc_id, score): the ``k`` most similar corpus rows per query.

    ``queries`` is (query_id, embedding) and ``corpus`` (doc_id, embedding). Scores
    are rounded to six places and ties go to the lower id. Both sides are dealt by key
    into blocks bounded in bytes; every pair of blocks is one matrix product in a task,
    and only the best ``k`` per query and block go on. Nothing runs while the plan is
    built, and nothing passes through the driver. The search is exact, so its work is
    queries times corpus.
    """
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("doc_id", corpus.schema["doc_id"].dataType),
        T.StructField("score", T.DoubleType())])
    asked = queries.filter("embedding IS NOT NULL").select("query_id", F.col("embedding").alias("__vec"))
    held = corpus.filter("embedding IS NOT NULL").select("doc_id", F.col("embedding").alias("__vec"))
    q_blocks, c_blocks = _number_of_blocks(asked, block_bytes), _number_of_blocks(held, block_bytes)

    def dealt(rows, key, own, own_blocks, other, other_blocks):
        placed = rows.withColumn(own, F.pmod(F.xxhash64(key), own_blocks).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), other_blocks - 1)))

    left = dealt(asked, "query_id", "__q", q_blocks, "__c", c_blocks).groupBy("__q", "__c")
    right = dealt(held, "doc_id", "__c", c_blocks, "__q", q_blocks).groupBy("__q", "__c")
    found = left.cogroup(right).applyInArrow(_search_blocks(k), schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return (found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "doc_id", "score"))
