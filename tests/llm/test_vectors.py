"""Hard negatives, near duplicates and part codes of vectors against brute force."""

import hashlib
import math
import sys

import numpy as np
import pyarrow as pa
import pytest

from chatloom.llm import negatives, part_codes, vector_dedup, vectors
from chatloom.llm.catalog import ORACLES, QUERIES

sys.path.insert(0, "tests")
from compare import differences, duck  # noqa: E402

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int"


def clustered(rng, n, size, centres, noise, labels=3):
    middle = rng.normal(size=(centres, size))
    return [(i, (middle[rng.integers(centres)] * rng.uniform(0.5, 2) + noise * rng.normal(size=size)).tolist(), int(rng.integers(labels)))
            for i in range(n)]


def odd_rows(start):
    """Rows that take no part, or only in some way."""
    return [(start, None, 1), (start + 1, [1.0, None], 1), (start + 2, [NAN, 1.0], 1), (start + 3, [INF, 1.0], 1), (start + 4, [0.0, 0.0], 1),
            (start + 5, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (start + 6, [], 1), (start + 7, [3.0], 1)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# -- shared helpers

def test_padded_lists_of_slices():
    column = pa.array([[9.0], [1.0, 2.0], [], [3.0]])
    assert vectors.padded(column.slice(1), 2).tolist() == [[1, 2], [0, 0], [3, 0]]
    assert vectors.padded(pa.chunked_array([column, column]), 2).shape == (8, 2)


@pytest.mark.parametrize("most", [3, 1 << 10, 1 << 23])
def test_products_are_exact(most):
    rng = np.random.default_rng(most)
    a, b = (rng.integers(-most, most, (n, 40)).astype(float) for n in (7, 9))
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert vectors.products(a, b).tolist() == want


# -- hard negatives

def brute_negatives(rows, every=100, k=5, scale=256):
    kept = [(i, np.array([math.floor(scale * x) for x in v] + [0] * (99 - len(v)), dtype=object), l)
            for i, v, l in rows if i is not None and l is not None and usable(v)]
    out = []
    for anchor, a, label in kept:
        if anchor % every:
            continue
        scored = [(int((a * v).sum()), i, l) for i, v, l in kept]
        same = sorted(((-s, i) for s, i, l in scored if l == label and i != anchor))[:k]
        for s, positive in same:
            fit = sorted((-t, i) for t, i, l in scored if l != label and 80 * -s <= 100 * t <= 100 * -s)[:k]
            out += [(anchor, positive, r + 1, i, -s, -t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("noise, block", [(0.02, 40), (0.3, 8192), (1.0, 64)])
def test_hard_negatives(spark, monkeypatch, noise, block):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 7)
    monkeypatch.setattr(negatives, "CHUNK", 3)
    rows = clustered(np.random.default_rng(4), 900, 10, 12, noise)
    rows += [(2000 + i, rows[0][1], rows[0][2]) for i in range(150)] + odd_rows(3000)
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), every=20)
    want = brute_negatives(rows, 20)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50


def test_bounds_hold_and_narrow(spark):
    """No score leaves its interval; near a reference most rows are ruled out."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.array([v for _, v, _ in clustered(rng, 400, 16, 6, 0.03)]))
    x[7] = 0
    norms, angle = negatives.angles(x, negatives.references(x, 8))
    low, high = negatives.bounds(norms, angle, norms, norms, angle, angle)
    scores = x @ x.T
    assert (low <= scores).all() and (scores <= high).all()
    limit = np.quantile(scores, 0.99, axis=1)[:, None]
    assert (high >= limit).mean() < 0.4
    some = rng.integers(0, 400, 50)
    low, high = negatives.bounds(norms, angle, norms[some].min(keepdims=True), norms[some].max(keepdims=True),
                                 angle[some].min(axis=0, keepdims=True), angle[some].max(axis=0, keepdims=True))
    assert (low <= scores[:, some]).all() and (scores[:, some] <= high).all()


def test_hard_negatives_ask_few_places(spark, monkeypatch):
    """With structure, anchors are sent to a part of the places only."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 100)
    rows = clustered(np.random.default_rng(9), 3000, 12, 16, 0.01, 2)
    sent, meet = [], negatives._meet

    def counting(placed, asked, fn, schema):
        sent.append((asked.count(), asked.select("key").distinct().count(), placed.select("place", "salt").distinct().count()))
        return meet(placed, asked, fn, schema)

    monkeypatch.setattr(negatives, "_meet", counting)
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), every=30).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, 30)
    (home, anchors, blocks), (positive, _, _), (negative, _, _) = sent
    assert home == anchors == 100 and blocks >= 30
    assert positive < 0.3 * anchors * blocks and negative < 0.8 * anchors * blocks


def test_hard_negatives_of_odd_tables(spark):
    rows = odd_rows(100) + [(200, [1e300, -1e300], 1), (7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (8, [0.9, 0.0], 2), (9, [0.9, 0.0], 2), (0, [1.0, 0.5], 1)]
    table = spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA + ", rank int, norm double")
    got = sorted(map(tuple, negatives.mine(table).collect()))
    assert (0, 7, 1, 8, 65536, 58880) in got and (0, 7, 2, 9, 65536, 58880) in got
    assert negatives.mine(table.limit(0)).count() == 0
    assert negatives.mine(table.where("vec_id = 0")).count() == 0
    assert negatives.mine(table.where("embedding is null")).count() == 0


# -- near duplicates

def brute_links(rows, least=0.93):
    part = [i for i, (key, v, l) in enumerate(rows) if key is not None and l is not None and usable(v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for n, i in enumerate(part):
        for j in part[:n]:
            (_, a, l), (_, b, m) = rows[i], rows[j]
            if l == m and len(a) == len(b):
                a, b = np.array(a), np.array(b)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i, (key, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        component = min(rows[j][0] for j in seen) if key is not None else None
        out.append((key, len(links[i]), component, component is None or key == component))
    return sorted(out, key=str)


@pytest.mark.parametrize("noise, crowd, size", [(0.05, 512, 24), (0.2, 40, 24), (0.25, 512, 33), (0.1, 20, 3)])
def test_vector_near_duplicates(spark, monkeypatch, noise, crowd, size):
    """Groups of near copies, in buckets and as crowds in blocks; cosines all around the limit."""
    monkeypatch.setattr(vector_dedup, "CROWD", crowd)
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 32)
    monkeypatch.setattr(vector_dedup, "BUCKET", 8)
    rng = np.random.default_rng(6)
    rows = clustered(rng, 700, size, 40, noise) + clustered(rng, 200, size, 1, 0.1, 1)
    rows = [(i, v, l) for i, (_, v, l) in enumerate(rows)]
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(30)] + [(2000 + i, (2 * np.array(rows[i][1])).tolist(), rows[i][2]) for i in range(20)]
    rows += odd_rows(3000)
    got = sorted((tuple(r) for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute_links(rows)


def test_repeated_ids_are_judged_by_their_own_vectors(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (3, [0.05, 1.0], 1), (4, [1.0, 0.0], 2), (4, [1.0, 0.0], 2)]
    table = spark.createDataFrame([(*r, 1, 1) for r in rows], SCHEMA + ", key int, n int")
    got = sorted(map(tuple, vector_dedup.near_duplicates(table).collect()))
    assert got == [(3, 1, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 0, 5, True), (5, 1, 3, False)]
    assert vector_dedup.near_duplicates(table.limit(0)).count() == 0
    only = vector_dedup.near_duplicates(spark.createDataFrame([(1, None, 2)], SCHEMA)).collect()
    assert list(map(tuple, only)) == [(1, 0, 1, True)]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    size, n = 64, 1500
    plan = vector_dedup.Plan(0.93, 5000)
    a = rng.normal(size=(n, size))
    b = a + 0.39 / math.sqrt(size) * np.linalg.norm(a, axis=1, keepdims=True) * rng.normal(size=(n, size))
    true = np.diag(vector_dedup.cosines(a, b))

    def codes(x, seed):
        code, factor, step, rounded = vector_dedup.coded(x, plan, seed)
        table = pa.table({"code": [c.tobytes() for c in code], "factor": factor, "step": step, "rounded": [r.tobytes() for r in rounded]})
        return vector_dedup.Codes(table, size, plan)

    x, y = codes(a, 1), codes(b, 2)
    estimate = (x.turned * y.signs).sum(axis=1) / (8 * y.factor)
    assert abs((estimate - true).mean()) < 0.005
    open_ = x.close(np.arange(n), np.arange(n), y)
    assert open_[true >= 0.93, :][:, true >= 0.93].diagonal().all()
    assert open_.mean() < 0.05


# -- part codes

def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, v, l) for i, v, l in rows if usable(v)]
    size = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    numbers = [[math.floor(scale * x) for x in v] + [0] * (size - len(v)) for _, v, _ in kept]
    width, out, books = size // parts, [], []
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    for p in range(parts):
        own = [tuple(x[p * width:(p + 1) * width]) for x in numbers]
        book = [own[k] for k in order]

        def assign():
            return [min((sum((s - t) ** 2 for s, t in zip(x, c)), e) for e, c in enumerate(book)) for x in own]

        for _ in range(rounds):
            found = assign()
            for e in range(len(book)):
                members = [x for x, (_, f) in zip(own, found) if f == e]
                if members:
                    book[e] = tuple(sum(c) // len(members) for c in zip(*members))
        out.append(assign())
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [sum(o[k][0] for o in out) for k in range(len(kept))]
    by_label = {}
    for (_, _, l), e in zip(kept, errors):
        by_label[l] = by_label.get(l, 0) + e
    return sorted([(i, "".join(f"{o[k][1]:02x}" for o in out), errors[k], by_label[l], digest) for k, (i, _, l) in enumerate(kept)], key=str)


@pytest.mark.parametrize("n, entries, size, together", [(300, 20, 10, 256), (150, 256, 8, 7), (40, 5, 3, 4)])
def test_part_codes(spark, monkeypatch, n, entries, size, together):
    monkeypatch.setattr(part_codes, "TOGETHER", together)
    monkeypatch.setattr(part_codes, "STEP", 2)
    rng = np.random.default_rng(n)
    rows = [(i + 1, np.round(v, 2).tolist() if i % 2 else v, l) for i, v, l in clustered(rng, n, size, 9, 0.2)]
    rows += [(5000 + i, rows[1][1], None) for i in range(10)] + odd_rows(6000)
    table = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", error int")
    books = part_codes.train(table, entries=entries)
    got = part_codes.digests(part_codes.encode(table, books), books).collect()
    assert sorted(map(tuple, got), key=str) == brute_codes(rows, entries=entries)


def test_part_codes_without_rows(spark):
    table = spark.createDataFrame([(1, None, 1)], SCHEMA)
    assert part_codes.train(table) == []
    assert part_codes.encode(table, []).count() == 0
    assert part_codes.digests(part_codes.encode(table, []), []).count() == 0


@pytest.mark.parametrize("most", [50, 1 << 24])
def test_equal_average_search_finds_the_first_nearest(most):
    rng = np.random.default_rng(2)
    entries = rng.integers(-most, most, (256, 16))
    entries[200:] = entries[:56]
    parts = np.concatenate([rng.integers(-most, most, (500, 16)), entries[::5] + rng.integers(0, 2, (52, 16))]).astype(float)
    index, best = part_codes.Codebook(entries).nearest(parts)
    whole = parts.astype(int).tolist()
    for x, k, d in zip(whole, index, best):
        assert (d, k) == min((sum((s - int(t)) ** 2 for s, t in zip(x, c)), e) for e, c in enumerate(entries))


def test_equal_average_search_skips_entries(monkeypatch):
    """Parts near an entry with a sum of its own are compared with few entries."""
    rng = np.random.default_rng(2)
    entries = np.arange(256)[:, None] * 1000 + rng.integers(0, 100, (256, 16))
    seen = []
    book, minimum = part_codes.Codebook(entries), np.minimum
    expand = part_codes.Codebook._expand

    def counted(self, x, xx, sums, sorted_, ee):
        class Counting(np.ndarray):
            def __getitem__(self, at):
                if isinstance(at, slice):
                    seen.append((at.stop - at.start) * len(x))
                return np.asarray(self)[at]
        return expand(self, x, xx, sums, sorted_.view(Counting), ee)

    monkeypatch.setattr(part_codes.Codebook, "_expand", counted)
    parts = (entries[rng.integers(0, 256, 5000)] + rng.integers(0, 30, (5000, 16))).astype(float)
    book.nearest(parts)
    assert sum(seen) < 0.25 * 5000 * 256


# -- the registered queries at another size than the SQL check

@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_vector_near_duplicates", "op13_part_codes"])
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert differences(QUERIES[name](spark, sf), duck(sf), ORACLES[name])[0] == []
