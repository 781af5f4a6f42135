"""Base scores against plain Python, the model against naive formulas, learning on held-out texts."""

import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa

from chatloom.llm import attention, bpe, lm
from chatloom.llm.catalog import QUERIES, RANK_FILE

SF = "/root/testdata/sf0.001"


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [None]


def base(rows):
    counts = Counter(w for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 for w in words_of(t))
    total, divisor = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    return [(i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, len(words_of(t)), sum(counts[w] > 0 for w in words_of(t)), total,
             sum(math.log10((counts[w] + 0.1) / divisor) for w in words_of(t))) for i, t in rows]


def same(got, want):
    got, want = sorted(map(tuple, got), key=str), sorted(want, key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) for g, w in zip(got, want))


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]


def test_query_on_all_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op5_attention_lm"](spark, SF).collect()
    same([[r[c] for c in COLUMNS] for r in got], base(rows))
    assert all(r.score < 0 for r in got)
    # On texts it has not seen the model beats an order-free model of its own subwords.
    held = [r for r in got if r.held_out]
    coder, texts = bpe.encoding(RANK_FILE, public_tokenizers.PATTERN), dict(rows)
    ids = {r.doc_id: coder.encode_ordinary(lm._lowered(texts[r.doc_id])) for r in got}
    counts = np.full(coder.n_vocab + 1, 0.5)
    for r in got:
        assert r.n_subwords == len(ids[r.doc_id])
        if not r.held_out:
            np.add.at(counts, ids[r.doc_id] + [coder.n_vocab], 1)
    logs = np.log10(counts / counts.sum())
    assert sum(r.score for r in held) > sum(logs[ids[r.doc_id] + [coder.n_vocab]].sum() for r in held)
    # It also beats pairs of subwords, interpolated with their counts at the best of several weights.
    pairs, firsts = Counter(), Counter()
    for r in got:
        if not r.held_out:
            line = [coder.n_vocab, *ids[r.doc_id], coder.n_vocab]
            pairs.update(zip(line, line[1:]))
            firsts.update(line[:-1])
    lines = [[coder.n_vocab, *ids[r.doc_id], coder.n_vocab] for r in held]
    assert sum(r.score for r in held) > max(
        sum(math.log10(w * pairs[a, b] / max(1, firsts[a]) + (1 - w) * 10 ** logs[b]) for line in lines for a, b in zip(line, line[1:]))
        for w in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95))


def test_edge_cases_with_a_small_head(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 3)
    monkeypatch.setattr(lm, "ROUNDS", 1)
    rows = [(1, None), (2, ""), (3, "A b a c"), (3, "A b a c"), (None, "a z"), (4, "word " * 30_000), (11, "b é b"), (12, "x" * 50_000)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, n_tokens string")
    got = lm.score(docs, RANK_FILE, public_tokenizers.PATTERN)
    same([[r[c] for c in COLUMNS] for r in got.collect()], base(rows))
    assert lm.score(docs.limit(0), RANK_FILE, public_tokenizers.PATTERN).count() == 0
    alone = lm.score(docs.where("doc_id is null"), RANK_FILE, public_tokenizers.PATTERN).collect()
    assert [(r.held_out, r.n_known, r.train_tokens) for r in alone] == [(True, 0, 0)] and alone[0].score < 0


def small():
    rng = np.random.default_rng(3)
    vocabulary = attention.Vocabulary(rng.integers(0, 50, 3000))
    vocabulary.pairs(rng.integers(0, 40, (attention.IN_CLASSES, attention.SLOTS)) * (rng.random((attention.IN_CLASSES, attention.SLOTS)) < 0.02))
    p = {n: x + 0.2 * rng.normal(size=x.shape).astype(np.float32) for n, x in attention.initial().items()}
    return rng, vocabulary, p


def test_each_id_is_scored_once_with_its_context():
    rng, vocabulary, p = small()
    lengths = np.array([0, 1, 31, 32, 33, 55, 56, 57, 200])
    ids = rng.integers(0, 2999, lengths.sum()).astype(np.uint16)
    got, at = attention.log_probabilities(p, vocabulary, ids, lengths, batch=5), 0
    for length, logs in zip(lengths, got):
        text = ids[at:at + length].tolist() + [vocabulary.end]
        at += length
        want, first = 0.0, 0
        for place in range(len(text)):
            if place >= first + attention.WINDOW:
                first += attention.WINDOW - attention.OVERLAP
            seen = [vocabulary.end if k == 0 else text[k - 1] for k in range(first, place + 1)]
            before = vocabulary.in_class[seen].astype(int)
            x = p["embed"][before] + p["place"][:len(seen)]
            wq, wk, wv = np.split(p["into"], 3, axis=1)
            scores = (x[-1] @ wq) @ (x @ wk).T / math.sqrt(attention.WIDTH)
            weights = np.exp(scores - scores.max())
            hidden = x[-1] + (weights / weights.sum()) @ (x @ wv) @ p["wo"]
            group, member = divmod(int(vocabulary.out_class(text[place])), attention.MEMBERS)
            for logits, own in ((hidden @ p["groups"] + vocabulary.group_logs[before[-1]], group),
                                (hidden @ p["members"][group] + vocabulary.member_logs[before[-1] * attention.GROUPS + group], member)):
                want += logits[own] - np.log(np.exp(logits.astype(np.float64)).sum())
            want += vocabulary.within(before[-1], text[place])
        assert abs(want - logs) < 1e-3 * max(1, abs(want))


def test_probabilities_sum_to_one():
    _, vocabulary, _ = small()
    ids, p = np.arange(3000), attention.initial()
    for before in (0, 7, attention.IN_CLASSES - 1):
        # The heads start at zero, so a new model is the table of neighbouring ids.
        logs = attention.class_logs(p, vocabulary, np.zeros((3000, attention.WIDTH), np.float32), np.full(3000, before), vocabulary.out_class(ids))
        assert abs(np.exp(logs + vocabulary.within(before, ids)).sum() - 1) < 1e-4


def test_table_of_neighbours_by_brute_force():
    rng = np.random.default_rng(9)
    counts, slots = rng.integers(0, 50, 3000), attention.SLOTS
    vocabulary = attention.Vocabulary(counts)
    texts = [rng.integers(0, 3000, n) for n in (0, 1, 40, 500)]
    laid = attention.Laid(np.concatenate(texts), np.array([len(t) for t in texts]), vocabulary)
    pairs = Counter((int(vocabulary.in_class[a]), int(vocabulary.slot[b]))
                    for t in texts for a, b in zip([vocabulary.end, *t], [*t, vocabulary.end]))
    inputs, targets = laid.steps()
    assert Counter(zip(inputs.tolist(), vocabulary.slot[targets].tolist())) == pairs
    table = np.zeros((attention.IN_CLASSES, slots))
    for (a, b), n in pairs.items():
        table[a, b] = n
    vocabulary.pairs(table)
    smoothed = counts + 0.05
    for before in (int(vocabulary.in_class[texts[3][5]]), int(vocabulary.in_class[vocabulary.end])):
        seen = {b: n for (a, b), n in pairs.items() if a == before}
        for i in (int(texts[3][6]), 11, 2998):
            slot = int(vocabulary.slot[i])
            mass = sum(smoothed[j] for j in range(3000) if vocabulary.slot[j] == slot)
            chance = (seen.get(slot, 0) + (len(seen) + 1) * mass / smoothed.sum()) / (sum(seen.values()) + len(seen) + 1)
            one = np.array([i])
            logs = attention.class_logs(attention.initial(), vocabulary, np.zeros((1, attention.WIDTH), np.float32), np.array([before]), vocabulary.out_class(one))
            assert abs(logs[0] + vocabulary.within(before, i) - math.log(chance * smoothed[i] / mass)) < 1e-4


def test_gradients_by_differences():
    rng, vocabulary, p = small()
    p = {n: x.astype(np.float64) for n, x in p.items()}
    inputs, targets = rng.integers(0, attention.IN_CLASSES, (3, attention.WINDOW)), rng.integers(0, attention.GROUPS * attention.MEMBERS, (3, attention.WINDOW))
    valid = rng.random(inputs.shape) < 0.8
    _, g = attention.gradients(p, vocabulary, inputs, targets, valid)
    for name in attention.NAMES:
        place = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        keep = p[name][place]
        sides = []
        for step in (1e-4, -1e-4):
            p[name][place] = keep + step
            sides.append(attention.gradients(p, vocabulary, inputs, targets, valid)[0])
        p[name][place] = keep
        assert abs((sides[0] - sides[1]) / 2e-4 - g[name][place]) < 1e-3 * max(0.01, abs(g[name][place])), name


def test_a_step_in_blocks_has_the_gradients_of_the_whole(monkeypatch):
    rng, vocabulary, p = small()
    p = {n: x.astype(np.float64) for n, x in p.items()}
    inputs, targets = rng.integers(0, attention.IN_CLASSES, (256, attention.WINDOW)), rng.integers(0, attention.GROUPS * attention.MEMBERS, (256, attention.WINDOW))
    valid = rng.random(inputs.shape) < 0.8
    found = []
    for block in (256, 100, 1):
        monkeypatch.setattr(attention, "BLOCK_WINDOWS", block)
        found.append(attention.gradients(p, vocabulary, inputs, targets, valid))
    for loss, g in found[1:]:
        assert abs(loss - found[0][0]) < 1e-9
        assert all(np.abs(g[n] - found[0][1][n]).max() < 1e-12 for n in attention.NAMES)


def test_a_step_holds_the_arrays_of_one_block():
    rng, vocabulary, p = small()
    inputs, targets = rng.integers(0, attention.IN_CLASSES, (1024, attention.WINDOW)), rng.integers(0, attention.GROUPS * attention.MEMBERS, (1024, attention.WINDOW))
    peaks = []
    for n in (256, 1024):
        tracemalloc.start()
        attention.gradients(p, vocabulary, inputs[:n], targets[:n], np.ones((n, attention.WINDOW), bool))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    # Four times the windows add the gradients of their inputs, sorted and unsorted, and not four times the rest.
    assert peaks[1] < 2.5 * peaks[0]


def test_repeated_positions_are_only_looked_back_at(monkeypatch):
    rng, vocabulary, p = small()
    lengths, made, forward = np.array([31, 55, 200]), [], attention.forward

    def counted(*args):
        out = forward(*args)
        made.append(len(out[0]))
        return out

    monkeypatch.setattr(attention, "forward", counted)
    attention.log_probabilities(p, vocabulary, rng.integers(0, 2999, lengths.sum()).astype(np.uint16), lengths)
    windows = len(attention.windows_of(lengths)[0])
    assert sum(made) == windows * attention.WINDOW - (windows - len(lengths)) * attention.OVERLAP


def test_every_window_of_the_training_texts_is_learned(spark, monkeypatch):
    _, vocabulary, _ = small()
    rng, lengths = np.random.default_rng(5), [0, 5, 31, 200, 7, 3000]
    texts = [rng.integers(0, 2999, n).astype("<u2") for n in lengths]
    monkeypatch.setattr(lm, "PART_WINDOWS", 50)
    batch = pa.RecordBatch.from_pydict({"ids": pa.array([x.tobytes() for x in texts], pa.binary())})
    parts = list(lm._parts([batch], "<u2", vocabulary))
    assert [len(x) for x, _, _ in parts[:-1]] == [50] * (len(parts) - 1)
    text, first, scored = attention.windows_of(np.array(lengths))
    want = attention.Laid(np.concatenate(texts), np.array(lengths), vocabulary).windows(text, first, scored * 0)
    for got, whole in zip(map(np.concatenate, zip(*parts)), (want[0], vocabulary.out_class(want[1]), want[2])):
        assert (got == whole).all()
    # One short text, whatever its place, trains the model.
    for k in range(4):
        docs = spark.createDataFrame([(1, "the birds of the garden " * 4 + str(k))], "doc_id long, text string")
        score = lm.score(docs, RANK_FILE, public_tokenizers.PATTERN).first().score
        with monkeypatch.context() as m:
            m.setattr(lm, "ROUNDS", 0)
            assert score > lm.score(docs, RANK_FILE, public_tokenizers.PATTERN).first().score
