"""Mixes against plain Python and the query against its SQL twin."""

import hashlib
import math
import re
from collections import Counter

import pytest

from chatloom.llm import mixing
from chatloom.llm.catalog import ORACLES, QUERIES
from tests.compare import differences, duck


def number(*parts):
    return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def brute(rows, budget=None, most_entropy=None, most_repeats=4.0):
    """Copies of each (doc_id, text, source) by the definition, in plain Python."""
    docs = [(i, s or "", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    tokens = Counter()
    for _, s, n in docs:
        tokens[s] += n
    tokens = {s: n for s, n in sorted(tokens.items(), key=lambda x: (x[1], x[0])) if n}
    everything = sum(tokens.values())

    def mix(e):
        parts = {s: (n / everything) ** e for s, n in tokens.items()}
        norm = sum(parts.values())
        goal = max(tokens[s] / p for s, p in parts.items()) * norm if budget == mixing.COVER else budget or everything
        return {s: p / norm for s, p in parts.items()}, goal

    def fits(e):
        w, goal = mix(e)
        entropy = -sum(x * math.log(x) for x in w.values())
        return ((most_repeats is None or max(w[s] * goal / tokens[s] for s in w) <= most_repeats)
                and (most_entropy is None or entropy <= most_entropy * math.log(len(w))))

    if not tokens:
        return [1] * len(docs)
    low, high = 0.0, 1.0
    for _ in range(40):
        low, high = (low, (low + high) / 2) if fits((low + high) / 2) else ((low + high) / 2, high)
    w, goal = mix(0.0 if fits(0.0) else high)
    out = {}
    for s, n in tokens.items():
        own = [d for d in docs if d[1] == s]
        blocks = math.ceil(math.sqrt(len(own)))
        wanted = math.floor(round(w[s] * 1e9) * goal / 1e9)
        wanted = max(wanted, n) if budget == mixing.COVER else wanted
        at = 0
        for i, _, k in sorted(own, key=lambda d: (number(s, number(s, d[0]) % blocks), number(d[0], s), d[0], d[2])):
            out.setdefault((i, s, k), []).append(wanted // n + (at < wanted % n))
            at += k
    return [out[d].pop() if d in out else 1 for d in docs]


OPTIONS = [dict(), dict(budget=mixing.COVER, most_repeats=2.0), dict(budget=500, most_repeats=None, most_entropy=0.8),
           dict(most_repeats=1.0), dict(most_repeats=100.0)]


@pytest.mark.parametrize("options", OPTIONS)
def test_copies_against_brute_force(spark, options):
    rows = [(i, "w " * (i % 13), f"s{min(i % 7, 3)}" if i % 11 else None) for i in range(400)]
    rows += [(1000, None, "mute"), (1001, " ", "mute"), (1002, "a b", "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.copies for r in mixing.mix_sources(docs, **options).collect()}
    assert got == dict(zip([r[0] for r in rows], brute(rows, **options)))
    many = Counter(tuple(r) for r in mixing.mixed(docs, **options).collect())
    assert many == Counter({r: got[r[0]] for r in rows if got[r[0]]})


def test_query_equals_twin(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        found, rows = differences(QUERIES["op4_source_mixing"](spark, sf), duck(sf), ORACLES["op4_source_mixing"])
        assert found == [] and rows


def test_edge_cases(spark):
    rows = [(1, "a b", "s", 1.0), (1, "a b", "s", 1.0), (None, "c", "s", 2.0), (2, "z " * 200_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    out = mixing.mixed(docs, budget=mixing.COVER, most_repeats=2.0)
    assert out.columns == docs.columns
    counts = Counter(map(tuple, out.collect()))
    assert counts[rows[3]] == 1 and counts[rows[0]] == 4 and counts[rows[2]] == 2
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    plan = mixing.mix_sources(docs, carry=True)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "CartesianProduct", "NestedLoop"))
