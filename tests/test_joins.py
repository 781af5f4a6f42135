import datetime as dt
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chatloom.functions.globs import fixed_length, glob_regex, is_glob, literal_prefix
from chatloom.functions.text import ngrams, words
from chatloom.operators import leakage, presence, report, retrieval, routing

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def event_table(spark, rows):
    return spark.createDataFrame([(i, s, at(t), k) for i, s, t, k in rows], "event_id long, session_id string, ts timestamp_ntz, kind string")


def arrival_table(spark, rows):
    return spark.createDataFrame([(i, s, at(t)) for i, s, t in rows], "message_id long, session_id string, ts timestamp_ntz")


def online_by_hand(events, session, t, ttl):
    past = sorted((e[2], e[0], e[3]) for e in events if e[1] == session and e[2] <= t)
    return bool(past) and past[-1][2] == "connect" and t < past[-1][0] + ttl


def random_presence(seed, n_events=400, n_arrivals=600, span=40000):
    rng = random.Random(seed)
    sessions = ["hot"] * 6 + ["a", "b", "c"]
    events = [(i, rng.choice(sessions), rng.randrange(0, span, 50), rng.choice(["connect", "connect", "disconnect"])) for i in range(n_events)]
    arrivals = [(i, rng.choice(sessions + [None, "never"]), rng.randrange(0, span, 50)) for i in range(n_arrivals)]
    return events, arrivals


def test_interval_borders(spark):
    events = event_table(spark, [(0, "s", 0, "connect"), (1, "t", 0, "connect"), (2, "t", 100, "connect"), (3, "t", 200, "disconnect")])
    intervals = presence.presence_intervals(events)
    got = {(r.session_id, r.connection_id): ((r.start_ts - START).seconds, (r.end_ts - START).seconds) for r in intervals.collect()}
    assert got == {("s", 0): (0, 6000), ("t", 1): (0, 100), ("t", 2): (100, 200)}
    arrivals = arrival_table(spark, [(0, "s", 0), (1, "s", 5999), (2, "s", 6000), (3, "t", 200), (4, None, 5), (5, "u", 5)])
    online, offline = presence.presence_gate(arrivals, intervals)
    assert {r.message_id for r in online.collect()} == {0, 1}
    assert {r.message_id for r in offline.collect()} == {2, 3, 4, 5}


def test_gate_agrees_with_hand_count_for_any_slots(spark):
    for seed, slots, slot_s in ((1, 4, 6000), (2, 1, 700), (3, 2, 50000)):
        events, arrivals = random_presence(seed)
        intervals = presence.presence_intervals(event_table(spark, events), 900, slots)
        out = {r.message_id: r.online for r in presence.with_online(arrival_table(spark, arrivals), intervals, slot_s).collect()}
        assert out == {i: s is not None and online_by_hand(events, s, t, 900) for i, s, t in arrivals}


def test_presence_over_time_by_hand(spark):
    for seed, slot_s, span_slot in ((4, 3600, 24000), (5, 100, 500), (6, 50, 1)):
        rng = random.Random(seed)
        rows = [(rng.choice(["hot"] * 5 + ["a", None]), s := rng.randrange(0, 20000, 50), s + rng.randrange(-50, 900, 50)) for _ in range(300)]
        table = spark.createDataFrame(
            [(i, at(a), at(b)) for i, a, b in rows], "session_id string, start_ts timestamp_ntz, end_ts timestamp_ntz")
        want = []
        for session in ("hot", "a", None):
            own = []
            for a, b in sorted((a, b) for i, a, b in rows if i == session and a < b):
                if own and own[-1][1] >= a:
                    own[-1] = [own[-1][0], max(own[-1][1], b), own[-1][2] + 1]
                else:
                    own.append([a, b, 1])
            want += [(session, *x) for x in own]
        spans = presence.online_spans(table, span_slot)
        seconds = lambda t: (t - START).total_seconds()
        assert sorted(((r.session_id, seconds(r.start_ts), seconds(r.end_ts), r.n_intervals) for r in spans.collect()), key=str) == sorted(
            ((i, float(a), float(b), n) for i, a, b, n in want), key=str)
        got = {seconds(r.ts): (r.came, r.left, r.online) for r in presence.online_over_time(spans, slot_s).collect()}
        assert got == {t: (sum(a == t for _, a, _, _ in want), sum(b == t for _, _, b, _ in want), sum(a <= t < b for _, a, b, _ in want))
                       for t in {t for _, a, b, _ in want for t in (a, b)}}
        assert presence.online_over_time(presence.online_spans(table.limit(0))).count() == 0


def spans_by_hand(arrivals, gap):
    out = []
    for session in {s for _, s, _ in arrivals if s is not None}:
        times = sorted(t for _, s, t in arrivals if s == session)
        first = last = times[0]
        n = 1
        for t in times[1:]:
            if t - last < gap:
                n += 1
            else:
                out.append((session, first, last + gap, n))
                first, n = t, 1
            last = t
        out.append((session, first, last + gap, n))
    return sorted(out)


def test_gap_sessions_over_slot_borders(spark):
    for seed, slot_s in ((1, 300), (2, 301), (3, 5000)):
        _, arrivals = random_presence(seed, n_arrivals=800)
        out = presence.gap_sessions(arrival_table(spark, arrivals), 300, slot_s).collect()
        got = sorted((r.session_id, int((r.start_ts - START).total_seconds()), int((r.end_ts - START).total_seconds()), r.n_messages) for r in out)
        assert got == spans_by_hand(arrivals, 300)


GLOBS = {"user_*": ["user_", "user_x"], "user_1?": ["user_12"], "user_[24]*": ["user_2", "user_43"], "user_[^a]": ["user_b"],
         "user_[c-a]": ["user_b"], r"user_\*": ["user_*"], "u.er_1": ["u.er_1"], "user_[]x": [], r"user_[\]]": ["user_]"],
         "user_[a-": ["user_a", "user_-"], "*": ["user_a", ""], "user_[^]": ["user_q"]}
NO_MATCH = {"user_*": ["use_x"], "user_1?": ["user_1", "user_123"], "user_[24]*": ["user_3"], "user_[^a]": ["user_a"],
            r"user_\*": ["user_x"], "u.er_1": ["uxer_1"], "user_[]x": ["user_x"], "user_[c-a]": ["user_d"]}


def test_glob_dialect(spark):
    rows = [(p, c, True) for p, cs in GLOBS.items() for c in cs] + [(p, c, False) for p, cs in NO_MATCH.items() for c in cs]
    df = spark.createDataFrame(rows, "pattern string, channel string, expected boolean")
    out = df.withColumn("re", glob_regex(F.col("pattern"))).withColumn("got", F.expr("channel rlike re"))
    assert [tuple(r) for r in out.filter("got <> expected").select("pattern", "channel", "re").collect()] == []


def test_subscriptions_and_counts(spark):
    patterns = list(GLOBS)
    channels = sorted({c for cs in list(GLOBS.values()) + list(NO_MATCH.values()) for c in cs} | {"nobody else's"})
    subs = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "subscriber_id long, pattern string")
    frames = spark.createDataFrame([(i, c) for i, c in enumerate(channels * 2)], "message_id long, channel string")
    out = {(r.message_id, r.subscriber_id) for r in routing.match_subscriptions(frames, subs).collect()}
    every = frames.crossJoin(subs).withColumn("re", glob_regex(F.col("pattern"))).filter("channel rlike re")
    assert out == {(r.message_id, r.subscriber_id) for r in every.collect()}
    counts = {r.message_id: r.n_receivers for r in routing.receiver_counts(frames, subs).collect()}
    assert len(counts) == len(channels) * 2
    assert counts == {m: sum(1 for a, _ in out if a == m) for m in counts}


def test_glob_lookup_keys(spark):
    df = spark.createDataFrame([("user_1?",), ("user_*",), ("plain",), (r"a\*b",)], "p string")
    got = {r.p: (r.g, r.x, r.n) for r in df.select("p", is_glob(F.col("p")).alias("g"), literal_prefix(F.col("p")).alias("x"),
                                                   fixed_length(F.col("p")).alias("n")).collect()}
    assert got == {"user_1?": (True, "user_1", 7), "user_*": (True, "user_", -1), "plain": (False, "plain", 5), r"a\*b": (True, "a", 3)}


def test_direct_delivery(spark):
    events = event_table(spark, [(0, "a", 0, "connect"), (1, "a", 5, "connect"), (2, "b", 0, "connect"), (3, "b", 1, "disconnect")])
    messages = arrival_table(spark, [(0, "a", 10), (1, "a", 11), (2, "a", 12), (3, "b", 12), (4, None, 12)])
    plain = {r.message_id: r.status for r in routing.direct_delivery(messages, events).collect()}
    assert plain == {0: "delivered", 1: "delivered", 2: "delivered", 3: "no_connection", 4: "no_connection"}
    failing = messages.withColumn("send_failed", F.col("message_id") == 1)
    out = {r.message_id: (r.status, r.connection_id) for r in routing.direct_delivery(failing, events).collect()}
    assert out == {0: ("delivered", 1), 1: ("send_failed", 1), 2: ("no_connection", None), 3: ("no_connection", None), 4: ("no_connection", None)}


def test_direct_delivery_follows_the_time_of_the_message(spark):
    # No connection yet, still none, then one; a failure closes only the connection that it happened on.
    early = event_table(spark, [(0, "s", 10, "connect")])
    sends = arrival_table(spark, [(0, "s", 5), (1, "s", 6), (2, "s", 12)]).withColumn("send_failed", F.col("message_id") == 1)
    out = {r.message_id: r.status for r in routing.direct_delivery(sends, early).collect()}
    assert out == {0: "no_connection", 1: "no_connection", 2: "delivered"}


def delivered_by_hand(events, messages):
    """message id -> (status, connection) by replaying one session after the other in time order."""
    out, steps = {}, [(sec, 0, e, s, kind) for e, s, sec, kind in events] + [(sec, 1, m, s, failed) for m, s, sec, failed in messages]
    open_now = {}
    for sec, side, number, session, what in sorted(steps, key=lambda x: x[:3]):
        if not side:
            open_now[session] = number if what == "connect" else None
            continue
        conn = open_now.get(session) if session is not None else None
        out[number] = ("no_connection", None) if conn is None else ("send_failed" if what else "delivered", conn)
        if what and conn is not None:
            open_now[session] = None
    return out


def test_direct_delivery_equals_a_replay(spark):
    rng = random.Random(8)
    events = [(i, rng.choice("abc"), rng.randrange(400), rng.choice(["connect", "connect", "disconnect"])) for i in range(60)]
    messages = [(i, rng.choice(["a", "b", "c", "d", None]), rng.randrange(400), rng.random() < 0.2) for i in range(300)]
    table = arrival_table(spark, [m[:3] for m in messages]).withColumn(
        "send_failed", F.col("message_id").isin([m[0] for m in messages if m[3]]))
    for slot in (7, 100, 3600):
        out = {r.message_id: (r.status, r.connection_id) for r in routing.direct_delivery(table, event_table(spark, events), slot).collect()}
        assert out == delivered_by_hand(events, messages)


def test_leakage_agrees_with_hand_count(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    texts = [(i, line(rng.randint(0, 30))) for i in range(60)]
    items = [(i, line(rng.randint(0, 12))) for i in range(8)]
    a = spark.createDataFrame(texts, "id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    grams = lambda t: {tuple(t.split()[i:i + 4]) for i in range(len(t.split()) - 3)}
    expected = {(i, j): len(grams(t) & grams(u)) for i, t in texts for j, u in items if grams(t) & grams(u)}
    for limit in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        out = leakage.leakage(a, b, 4).collect()
        repeated = spark.createDataFrame([(1, "a b c"), (1, "x a b c d")], "id long, text string")
        twice = leakage.leakage(repeated, spark.createDataFrame([(9, "a b c d")], "item_id long, text string"), 3).collect()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {(r.id, r.item_id): r.n_shared for r in out} == expected
        assert [tuple(r) for r in twice] == [(1, 9, 3)]


def test_retrieval_agrees_with_numpy_in_any_blocks(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(150, 8)).astype("float32")
    vectors[10] = vectors[11] = vectors[12]
    vectors[20] = 0
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<float>").repartition(5)
    queries, corpus = table.withColumnRenamed("id", "query_id"), table.withColumnRenamed("id", "doc_id")
    norms = np.linalg.norm(vectors.astype("float64"), axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros((150, 8)), where=norms > 0)
    scores = np.round(unit @ unit.T, 6) + 0.0
    expected = {}
    for q in range(150):
        order = sorted(range(150), key=lambda d: (-scores[q, d], d))[:7]
        expected.update({(q, rank): d for rank, d in enumerate(order, 1)})
    for block_bytes in (1 << 20, 3000):
        out = retrieval.retrieve(queries, corpus, 7, block_bytes).collect()
        assert {(r.query_id, r["rank"]): r.doc_id for r in out} == expected


def test_retrieval_holds_little_beside_its_blocks():
    rng = np.random.default_rng(1)
    vectors, asked = rng.normal(size=(60_000, 4)), rng.normal(size=(300, 4))
    vectors[7] = asked[5] = 0
    ids = rng.permutation(60_000)

    def chunked(x):  # in pieces, as Spark sends them
        rows = pa.array(list(x.astype("float32")), pa.list_(pa.float32()))
        return pa.chunked_array([rows.slice(at, 17_001) for at in range(0, len(rows), 17_001)])

    corpus = pa.table({"doc_id": ids, "__vec": chunked(vectors)})
    queries = pa.table({"query_id": np.arange(300), "__vec": chunked(asked)})
    tracemalloc.start()
    out = retrieval._search_blocks(5)(queries, corpus)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20  # a score of each of 256 queries with each row takes 123 MB
    unit = [np.divide(x, n, out=np.zeros_like(x), where=n > 0)
            for x in (asked.astype("float32").astype(float), vectors.astype("float32").astype(float)) for n in [np.linalg.norm(x, axis=1, keepdims=True)]]
    for q, got in enumerate(np.asarray(out.column("doc_id")).reshape(300, 5)):
        scores = np.round(unit[0][q] @ unit[1].T, 6) + 0.0
        assert (got == ids[np.lexsort((ids, -scores))[:5]]).all()
    assert (np.asarray(out.column("query_id")) == np.repeat(np.arange(300), 5)).all()
    assert retrieval._search_blocks(5)(queries.slice(0, 0), corpus).num_rows == 0 == retrieval._search_blocks(5)(queries, corpus.slice(0, 0)).num_rows


def test_report_levels(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")], "stage string, reason string")
    out = {(r.stage, r.reason, r.level): r.n for r in report.outcome_report(rows).collect()}
    assert out == {("a", "x", 0): 2, ("a", "y", 0): 1, ("b", "x", 0): 1, ("a", None, 1): 3, ("b", None, 1): 1, (None, None, 3): 4}


def test_passages_by_hand(spark):
    items = spark.createDataFrame([(1, "a b c d e"), (2, "x y z"), (3, None), (4, "q")], "item_id long, text string")
    texts = [(1, "A b, c! d e f"), (2, "a b c - b c d"), (3, "x y z x y z"), (4, None), (5, "a b"), (6, "a b c q q c d e"), (7, "")]
    got = leakage.passages(spark.createDataFrame(texts, "id long, text string"), items, 3).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 0, 4, 5), (2, 1, 0, 2, 3), (2, 1, 3, 5, 3), (3, 2, 0, 2, 3), (3, 2, 3, 5, 3), (6, 1, 0, 2, 3), (6, 1, 5, 7, 3)]
    assert leakage.passages(spark.createDataFrame([], "id long, text string"), items, 3).count() == 0


def test_ngrams_of_words_are_used_for_leakage(spark):
    df = spark.createDataFrame([("A, b C d",)], "text string")
    assert df.select(ngrams(words(F.col("text")), 4).alias("g")).first().g == ["a b c d"]


def test_gate_is_written_once(spark, tmp_path):
    arrivals, events = arrival_table(spark, [(0, "a", 5), (1, "a", 9000), (2, None, 5)]), event_table(spark, [(0, "a", 0, "connect")])
    presence.write_gate(arrivals, presence.presence_intervals(events), str(tmp_path / "gate"))
    assert {(r.message_id, r.online) for r in spark.read.parquet(str(tmp_path / "gate")).collect()} == {(0, "true"), (1, "false"), (2, "false")}
