"""Shingles, components and near duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatloom.llm import neardup
from chatloom.llm.catalog import QUERIES
from chatloom.llm.components import components
from chatloom.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def brute_set(text, width):
    words = words_of(text)
    if 0 < len(words) < width:
        return {tuple(words)}
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    """(id, set size, component) per row by comparing all pairs."""
    sets = [brute_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(key, least.get(root(i), key))
    return sorted((key, len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aAb \n\té", max_size=30), max_size=6), st.sampled_from([1, 2, 3, 5]))
def test_shingle_sets(texts, width):
    data = [t.encode() for t in texts]
    ends = np.cumsum([len(b) for b in data]).astype(np.int64)
    found = shingle_sets(np.frombuffer(b"".join(data), np.uint8), ends, width)
    known = {}
    for text, got in zip(texts, found):
        want = brute_set(text, width)
        assert len(got) == len(want)
        assert known.setdefault(frozenset(want), got.tobytes()) == got.tobytes()
    assert len(set(known.values())) == len(known)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)] + [(7, 7)]
    least = {n: n for e in edges for n in e}
    for _ in range(400):
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    linked = {n for u, v in edges if u != v for n in (u, v)}
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == sorted((n, least[n]) for n in linked)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def groups(rng, copies):
    """A group around one text whose copies differ in a few words, so that links are partly indirect."""
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10 ** 6)}"
        yield " ".join(text)


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_groups_of_near_copies_in_blocks(spark, monkeypatch, width, percent):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0 if width == 5 else 1 << 21)
    rng = random.Random(2)
    texts = [*groups(rng, 150), *groups(rng, 40), *groups(rng, 3), *[" ".join(f"q{rng.random()}" for _ in range(30)) for _ in range(20)]]
    texts += texts[:30]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, width, percent)


def test_edge_cases(spark):
    rows = [(5, None, 1), (4, "", 2), (3, " \n", 3), (9, "One two", 4), (8, "one TWO", 5), (8, "one TWO", 6), (7, "one", 7),
            (None, "one two", 8), (2, "z " * 100_000, 9), (1, "z " * 200_000 + "y", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(map(tuple, neardup.near_duplicates(docs, 3, 85).collect()), key=str)
    assert got == sorted([(5, 0, 5, True), (4, 0, 4, True), (3, 0, 3, True), (9, 1, 8, False), (8, 1, 8, True), (8, 1, 8, True),
                          (7, 1, 7, True), (None, 1, None, True), (2, 1, 2, True), (1, 2, 1, True)], key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op6_minhash_near_duplicates"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_repeated_ids_with_other_texts(spark):
    """Rows (5, A), (5, B) and (3, B with one more word): B is linked with its copy, A with nothing."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, a, 1), (5, b, 2), (3, b + " more", 3), (5, a, 4), (7, "", 5), (7, None, 6), (7, " ", 7), (None, a, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 3, 90).collect()), key=str)
    assert got == sorted([(5, 58, 5, True), (5, 58, 3, False), (3, 59, 3, True), (5, 58, 5, True), (7, 0, 7, True), (7, 0, 7, True),
                          (7, 0, 7, True), (None, 58, None, True)], key=str)
    kept = neardup.deduplicated(docs, 3, 90)
    assert kept.columns == docs.columns
    assert sorted({(r.doc_id, r.text) for r in kept.collect()}, key=str) == sorted(
        {(5, a), (3, b + " more"), (None, a), (7, " ")} | {(r.doc_id, r.text) for r in kept.collect() if r.doc_id == 7}, key=str)
    assert sum(r.doc_id == 5 for r in kept.collect()) == 1
    exact = spark.createDataFrame([(5, a), (5, b), (3, b)], "doc_id long, text string")
    assert sorted(map(tuple, neardup.deduplicated(exact, 3, 90).collect())) == [(3, b), (5, a)]
