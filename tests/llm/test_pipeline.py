"""The pipeline stage by stage against brute-force versions of the stages."""

import math
from collections import Counter

import corpus_pipeline
from chatloom.llm import bpe, langid, mixing, secret_scan
from tests.llm import test_mixing, test_neardup, test_secret_scan

SF = "/root/testdata/sf0.001"


def brute(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rows = [r.asDict() for r in docs.collect()]
    (part,), rows = model.parts, [r for r in rows if langid.has_letter(r["text"])]
    logs = part.value.scores([r["text"] for r in rows])
    rows = [r for r, own in zip(rows, logs) if 1 / sum(math.exp(x - max(own)) for x in own) >= 0.5]
    component = {i: c for i, _, c in test_neardup.brute([(r["doc_id"], r["text"]) for r in rows], 5, 80)}
    rows = [r for r in rows if component[r["doc_id"]] == r["doc_id"]]
    for r in rows:
        if found := test_secret_scan.brute(r["text"]):
            r["text"] = secret_scan._masked(r["text"], found, "[SECRET]")
            r["n_chars"] = len(r["text"])
    copies = test_mixing.brute([(r["doc_id"], r["text"], r["source"]) for r in rows], mixing.COVER, None, 2.0)
    coder = bpe.encoding(corpus_pipeline.RANK_FILE, corpus_pipeline.public_tokenizers.PATTERN)
    out = Counter()
    for r, n in zip(rows, copies):
        out[r["doc_id"], len(coder.encode_ordinary(r["text"]))] += n
    return out


def test_pipeline_against_brute_force(spark):
    want = brute(spark)
    assert Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_stages_on_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (3, "hello there you all", "en", "s", None), (3, "hello there you all", "en", "s", None),
            (None, "hello there you all", None, None, 5), (4, "hello token=abcdef0123456789", "en", "t", 28)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table, least in ((docs, 1), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, table, SF)
            assert after.columns == docs.columns
            table = after.checkpoint()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF).count() >= least
