"""Curves, and recall and ranks against brute force."""

import itertools

import numpy as np
import pytest

from chatloom.llm import ann
from chatloom.llm.catalog import QUERIES


def exact(rows, k=20, every=20):
    """query -> [(vec_id, score)] of the nearest by brute force."""
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], float)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = vectors @ vectors[i]
        order = [j for j in np.lexsort([ids, -scores.round(12)]) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("axes, bits", [(1, 4), (2, 3), (3, 3), (4, 2)])
def test_hilbert_curve_visits_all_neighbours_in_turn(axes, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    index = ann.hilbert_index(cells, bits)
    assert sorted(index.tolist()) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query_recall(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = exact(rows), found(QUERIES["op2_hilbert_neighbours"](spark, sf))
    assert set(got) == set(want)
    hits = total = 0
    for q, best in want.items():
        assert len(got[q]) == len(best)
        scores = dict(exact_scores(rows, q))
        assert all(abs(scores[i] - s) < 1e-9 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in got[q]} & {i for i, _ in best})
        total += len(best)
    assert hits >= 0.9 * total


def exact_scores(rows, q):
    own = np.array(dict(rows)[q], float)
    return [(i, float(np.array(v, float) @ own)) for i, v in rows]


def test_recall_with_narrow_windows_on_clustered_vectors_of_all_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAST_WINDOW", 16)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 12))
    rows = [(i, (rng.uniform(0.5, 2) * (centres[rng.integers(60)] + 0.1 * rng.normal(size=12))).tolist()) for i in range(3000)]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    want = exact(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in best}) for q, best in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(100)] + [(100 + i, [1.0, 2.0 - i / 100]) for i in range(30)]
    got = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in exact(rows).items()}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.5, 0.5], 1), (1, None, 1), (2, [0.0, 0.0], 1), (40, [nan, 1.0], 1), (60, [inf, 1.0], 1),
            (3, [None, 1.0], 1), (4, [1.0], 1), (5, [], 1), (None, [1.0, 1.0], 1), (7, [2.0, 1.0], 1), (7, [2.0, 1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    assert found(ann.nearest(table)) == {0: [(7, 2.0), (20, 0.5)], 20: [(7, 1.5), (0, 0.5)]}
    assert ann.nearest(table.limit(0)).count() == 0
    assert ann.nearest(table.where("vec_id = 7")).count() == 0
    assert ann.nearest(table.where("vec_id = 20")).count() == 0


def test_one_very_long_vector_and_small_blocks(spark, monkeypatch):
    """The window stays narrow beside one vector a thousand times as long, and no group exceeds a block of rows and one of queries."""
    monkeypatch.setattr(ann, "LEAST_WINDOW", 16)
    monkeypatch.setattr(ann, "BLOCK_BYTES", 8 * 12 * 64)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 12))
    rows = [(i, (centres[rng.integers(60)] + 0.1 * rng.normal(size=12)).tolist()) for i in range(3000)] + [(3001, [1000.0] + [0.0] * 11)]
    windows, measure, search, seen = [], ann._window, ann._finds, spark.sparkContext.accumulator(0)
    monkeypatch.setattr(ann, "_window", lambda *a: windows.append(measure(*a)) or windows[-1])

    def bounded(rows, query_ids, queries, k):
        if len(query_ids) != ann.SAMPLE and (len(rows[0]) > 64 or len(query_ids) > 64):
            seen.add(1)
        return search(rows, query_ids, queries, k)

    monkeypatch.setattr(ann, "_finds", bounded)
    got, want = found(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), exact(rows)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in best}) for q, best in want.items()) >= 0.9 * sum(map(len, want.values()))
    assert seen.value == 0 and windows[0] < 600
