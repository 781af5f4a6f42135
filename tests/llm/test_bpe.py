"""Token ids against the library on whole texts, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chatloom.llm import bpe
from chatloom.llm.catalog import QUERIES, RANK_FILE

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    return bpe.encoding(RANK_FILE, PATTERN)


def texts():
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "7", "'s", " ", "  ", "\n", "\x1c", "!", " ", "漢", "😀", "it's", "\t", "<|endoftext|>"]
    return ["".join(rng.choices(alphabet, k=n)) for n in (1, 5, 40, 300, 3000, 3000, 9000)]


def test_pieces_encode_like_the_whole_text(coder):
    for text in texts():
        for limit in (4, 64, 1000):
            ids = [i for p, whole in bpe.pieces(text, limit) for i in (
                coder._encode_single_piece(p) if whole else coder.encode_ordinary(p))]
            assert ids == coder.encode_ordinary(text)
            assert "".join(p for p, _ in bpe.pieces(text, limit)) == text


@pytest.mark.parametrize("tail", ["", "x", " x", "\nx"])
@pytest.mark.parametrize("white", [" ", "\n", " "])
def test_long_white_space_as_one_match(coder, tail, white):
    text = "a b" + white * 3000 + tail
    assert bpe.encode_text(coder, text).tolist() == coder.encode_ordinary(text)
    # beyond what the library takes in one call
    assert coder.decode_bytes(bpe.encode_text(coder, "a" + white * 300_000 + tail).tolist()).decode() == "a" + white * 300_000 + tail


def test_long_texts_without_any_edge(coder):
    for unit in ("ab", "!?", "12"):
        text = unit * 100_000
        assert bpe.encode_text(coder, text).tolist() == coder.encode_ordinary(text)


def test_nulls_repeats_extra_columns_and_empty_tables(spark, coder):
    rows = [(1, None, "x"), (1, "Hello", "y"), (2, "", None), (2, "", None), (None, "Hello", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    ids = bpe.encode(docs, RANK_FILE, PATTERN)
    got = sorted(map(tuple, bpe.decode(ids, RANK_FILE, PATTERN).drop("ids").collect()), key=str)
    n = len(coder.encode_ordinary("Hello"))
    assert got == sorted([(1, 0, b""), (1, n, b"Hello"), (2, 0, b""), (2, 0, b""), (None, n, b"Hello")], key=str)
    at_once = bpe.round_trip(docs, RANK_FILE, PATTERN).select("doc_id", "n_tokens", "decoded")
    assert sorted(map(tuple, at_once.collect()), key=str) == got
    assert bpe.encode(docs.limit(0), RANK_FILE, PATTERN).count() == bpe.round_trip(docs.limit(0), RANK_FILE, PATTERN).count() == 0
    odd = ids.limit(1).select(F.lit(b"\xff\xff\xff\xff").alias("ids")).union(ids.limit(1).select(F.lit(b"abc")))
    assert [r.decoded for r in bpe.decode(odd, RANK_FILE, PATTERN).collect()] == [None, None]


def test_query_against_brute_force(spark, coder):
    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = coder.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op1_byte_bpe"](spark, sf).collect())) == sorted(want)


def test_stretches_that_occur_again_are_encoded_once(coder, monkeypatch):
    whites = "\x85\xa0\u1680\u2000\u200a\u2028\u202f\u205f\u3000\x1c\t\n "
    rng = random.Random(8)
    rows = ["", *texts(), " the", "the", "the ", "\n", "", "x" * 3000, "a" + " " * 2000 + "b", " \n" * 700, "a\u201c \u201d b", "日本 語",
            *["".join(rng.choices(whites + "ab\u2014é漢", k=60)) for _ in range(300)], "the cat sat on the mat " * 500, ""]
    given, whole = [], bpe.encode_text
    monkeypatch.setattr(bpe, "encode_text", lambda c, t: given.append(len(t)) or whole(c, t))
    for part in (rows, rows[-2:], rows[:1], ["é a"], []):
        data = [t.encode() for t in part]
        at = np.cumsum([0, *map(len, data)])
        ids, lengths = bpe.encode_rows(coder, np.frombuffer(b"".join(data), np.uint8), at)
        ends = np.cumsum(lengths)
        assert [ids[b - n:b].tolist() for b, n in zip(ends, lengths)] == [coder.encode_ordinary(t) for t in part]
        if part == rows[-2:]:
            assert sum(given) < 100
        given.clear()
