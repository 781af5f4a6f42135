"""Held-out accuracy, a brute-force model, and edge cases."""

import zlib

import numpy as np

from chatloom.llm import langid
from chatloom.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def brute_grams(text):
    padded = [ord(c) for c in f" {text.lower()} "]
    mask = (1 << 64) - 1
    for order in langid.ORDERS:
        for i in range(len(padded) - order + 1):
            h = (order + sum(padded[i + k] * int(langid._MULTIPLIERS[k]) for k in range(order))) & mask
            h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & mask
            yield h >> 48


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    counts = {}
    for r in rows:
        if r.lang is not None and langid.has_letter(r.text) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            own = counts.setdefault(r.lang, np.zeros(langid.BUCKETS))
            for b in brute_grams(r.text):
                own[b] += 1
    logs = {g: np.log((c + langid.SMOOTHING) / (c + langid.SMOOTHING).sum()) for g, c in sorted(counts.items())}
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, SF).collect()}
    assert len(got) == len(rows)
    right = held = 0
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= g.score <= 1
        if not langid.has_letter(r.text):
            assert (g.lang_pred, g.score) == ("und", 0)
            continue
        own = list(brute_grams(r.text))
        assert g.lang_pred == max(logs, key=lambda k: logs[k][own].sum())
        held += g.held_out
        right += g.held_out and g.lang_pred == r.lang
    assert right >= 0.97 * held


def test_edge_cases(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "12 -- 34!", None, "c"), (4, "hello hello", "en", "d"),
            (4, "hello hello", "en", "d"), (5, "bonjour", "fr", None), (None, "hello", None, "e"), (6, "x" * 300_000, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = langid.Model.collect(langid.train(docs))
    assert model.languages == ["en", "fr"]
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.predict(docs, model).collect()), key=str)
    assert len(got) == 8
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")]
    assert got.count((4, "en")) == 2 and (5, "fr") in got and (None, "en") in got
    empty = langid.Model.collect(langid.train(docs.limit(0)))
    assert {r.lang_pred for r in langid.predict(docs, empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "abc", "b"), (2, "abc", "a")], "doc_id long, text string, lang string")
    model = langid.Model.collect(langid.train(docs))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, model).collect()} == {("a", 0.5)}


def test_parts_of_languages_give_what_one_matrix_gives(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    whole = langid.fit(docs)
    want = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, whole).collect()}
    kept = {r.doc_id for r in langid.accepted(docs, whole, 0.9).collect()}
    for size in (1, 2):
        monkeypatch.setattr(langid, "PART_LANGUAGES", size)
        model = langid.fit(docs)
        assert model.languages == whole.languages and len(model.parts) == -(-len(model.languages) // size) > 1
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
        assert {r.doc_id for r in langid.accepted(docs, model, 0.9).collect()} == kept
    monkeypatch.setattr(langid, "PART_LANGUAGES", 1)
    same = spark.createDataFrame([(1, "abc", "b"), (2, "abc", "a")], "doc_id long, text string, lang string")
    model = langid.Model.collect(langid.train(same))
    assert {(r.lang_pred, r.score) for r in langid.predict(same, model).collect()} == {("a", 0.5)}
