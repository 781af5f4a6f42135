"""Base measures against plain Python, the label model against plain Python, verdicts against labels."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from chatloom.llm import quality
from chatloom.llm.catalog import QUERIES

SPACES = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in many for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_measures(spark):
    rng = random.Random(4)
    pieces = ["a", "b", "é", "a b c", "\n", "  ", "\t", "#", "x|y", "😀", "a b c a b c", "\r\n", "\x1c", " "]
    texts = [None, "", " \n ", "a a a a", "a b c", "a b c d a b c"] + [
        "".join(x + rng.choice([" ", ""]) for x in rng.choices(pieces, k=rng.randrange(1, 60))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[1:]) for r in quality.judge(docs).select("doc_id", *BASE).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_query_on_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op3_quality_rules"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert tuple(got[r.doc_id][c] for c in BASE) == brute(r.text)
        assert not (got[r.doc_id].base_failed and got[r.doc_id].kept)


def test_verdicts_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op3_quality_rules"](spark, sf).where("not base_failed")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = found.join(labels, "doc_id").select("kept", "label").collect()
    good, bad = [r.kept for r in rows if r.label == 1], [r.kept for r in rows if r.label == 0]
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.05 * len(bad)


def chance_of_good(prior, good, bad, votes):
    odds = math.log(prior / (1 - prior)) + sum(math.log(g[v + 1] / b[v + 1]) for g, b, v in zip(good, bad, votes))
    return 1 / (1 + math.exp(-odds))


def plain_model(rows):
    """Expectation-maximisation over votes, written out."""
    k = len(rows[0])
    prior, good, bad = quality.GOOD, [quality.ON_GOOD] * k, [quality.ON_BAD] * k
    patterns = Counter(rows)
    for _ in range(quality.MOST_ROUNDS):
        weights = [quality.BELIEF * quality.GOOD, quality.BELIEF * (1 - quality.GOOD)]
        counts = [[[quality.BELIEF * p for p in on] for _ in range(k)] for on in (quality.ON_GOOD, quality.ON_BAD)]
        for votes, n in patterns.items():
            p = chance_of_good(prior, good, bad, votes)
            for side, share in ((0, n * p), (1, n * (1 - p))):
                weights[side] += share
                for rule, v in enumerate(votes):
                    counts[side][rule][v + 1] += share
        last = prior, good, bad
        prior = weights[0] / sum(weights)
        good, bad = ([[c / sum(row) for c in row] for row in side] for side in counts)
        moved = [abs(x - y) for a, b in zip((good, bad), last[1:]) for r, s in zip(a, b) for x, y in zip(r, s)]
        if max(abs(prior - last[0]), *moved) < quality.TOLERANCE:
            break
    return prior, good, bad


def test_verdicts_by_a_plain_model(spark):
    rows = QUERIES["op3_quality_rules"](spark, "/root/testdata/sf0.001")
    names = [f"vote_{r.name}" for r in quality.RULES]
    measured = quality.measures(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).withColumns(
        {n: quality.vote(r) for n, r in zip(names, quality.RULES)}).collect()
    model = plain_model([tuple(r[n] for n in names) for r in measured])
    want = {r.doc_id: chance_of_good(*model, [r[n] for n in names]) >= quality.KEEP_FROM and not (
        r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in measured}
    assert {r.doc_id: r.kept for r in rows.collect()} == want and len(set(want.values())) == 2


def test_label_model_recovers_planted_rates(spark):
    rng, rows = random.Random(9), []
    for _ in range(4000):
        good = rng.random() < 0.7
        rows.append(tuple((1 if rng.random() < 0.9 else -1 if rng.random() < 0.1 else 0) if good else
                          (-1 if rng.random() < 0.7 else rng.choice([0, 1])) for _ in range(5)))
    names = [f"r{k}" for k in range(5)]
    model = quality.fit(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)), names)
    prior, good, bad = plain_model(rows)
    assert abs(model.prior - prior) < 1e-9
    assert all(abs(x - y) < 1e-9 for a, b in ((model.good, good), (model.bad, bad)) for r, s in zip(a, b) for x, y in zip(r, s))
    assert abs(model.prior - 0.7) < 0.03
    assert all(abs(g[2] - 0.9) < 0.03 and abs(b[0] - 0.7) < 0.05 for g, b in zip(model.good, model.bad))
    sample = spark.createDataFrame(rows[:50], ", ".join(f"{n} int" for n in names))
    for r in sample.withColumn("p", quality.posterior(model, names)).collect():
        assert abs(r.p - chance_of_good(model.prior, model.good, model.bad, [r[n] for n in names])) < 1e-9


def test_edge_cases(spark):
    rows = [(1, None, "a"), (None, "word " * 60, "b"), (2, "x " * 100_000, "c"), (2, "x " * 100_000, "c"), (3, "y" * 300_000, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    got = quality.judge(docs)
    assert {(r.doc_id, r.n_words, r.n_repeat_words) for r in got.collect()} == {
        (1, 0, 0), (None, 60, 60), (2, 100_000, 100_000), (3, 1, 0)}
    assert got.count() == 5 and quality.judge(docs.limit(0)).count() == 0


def test_plan_is_native(spark):
    plan = quality.measures(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
