import random

from pyspark.sql import functions as F

from chatloom.operators import delivery, scoring, turns

TURN = "session_id string, turn long, role string, text string"


def random_turns(seed, sessions=7):
    """Sessions of 1 to 60 turns with gaps in the numbering."""
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        turn = 0
        for _ in range(rng.randint(1, 60)):
            rows.append((f"s{s}", turn, rng.choice(["user", "assistant", "system"]), f"t{turn}"))
            turn += rng.choice([1, 1, 1, 2, 9])
    return rows


def test_pairs_history_and_offsets_do_not_depend_on_chunks(spark):
    rows = random_turns(5)
    by_session = {}
    for r in sorted(rows):
        by_session.setdefault(r[0], []).append(r)
    pairs, history, offsets = set(), {}, {}
    for s, rs in by_session.items():
        for i, r in enumerate(rs):
            if i and r[2] == "assistant" and rs[i - 1][2] == "user":
                pairs.add((s, r[1], rs[i - 1][3], r[3]))
            history[s, r[1]] = "\n".join(f"{p[2]}: {p[3]}" for p in rs[max(0, i - 5):i])
            offsets[s, r[1]] = (i, sum(len(p[3]) for p in rs[:i]))
    df = spark.createDataFrame(rows, TURN).repartition(3)
    for chunk in (2, 7, 1000):
        assert {tuple(r) for r in turns.qa_pairs(df, chunk).collect()} == pairs
        assert {(r.session_id, r.turn): r.context for r in turns.history(df, 5, chunk).collect()} == history
        assert {(r.session_id, r.turn): (r.n_turns_before, r.n_chars_before) for r in turns.history_offsets(df, chunk).collect()} == offsets


def test_odd_sessions_do_not_depend_on_chunks(spark):
    """A NULL session, and negative, sparse and NULL ordinals."""
    roles = ["user", "assistant"]
    rows = [(None, i, roles[i % 2], f"n{i}") for i in range(10)] + [("s", i - 7, roles[i % 2], f"s{i}") for i in range(14)]
    rows += [("g", i * i * 11 - 300, roles[i % 2], f"g{i}") for i in range(12)] + [("z", None, "user", "first")]
    rows += [("z", i, roles[(i + 1) % 2], f"z{i}") for i in range(9)]
    df = spark.createDataFrame(rows, TURN).repartition(3)

    def all_of(chunk):
        return [sorted(map(tuple, d.collect()), key=str) for d in (
            turns.qa_pairs(df, chunk), turns.history(df, 3, chunk), turns.history_offsets(df, chunk))]

    whole = all_of(65536)
    assert len(whole[1]) == len(whole[2]) == len(rows)
    assert sorted(r[-2] for r in whole[2] if r[0] is None) == list(range(10))
    assert ("z", 0, "first", "z0") in whole[0] and len([r for r in whole[0] if r[0] is None]) == 5
    for chunk in (2, 4):
        assert all_of(chunk) == whole


def test_whole_history_and_its_pieces(spark):
    rows = random_turns(6)
    df = spark.createDataFrame(rows, TURN)
    transcripts = {}
    for s, turn, role, text in sorted(rows):
        transcripts.setdefault(s, []).append(f"{role}: {text}")
    for r in turns.history(df).collect():
        before = len([x for x in rows if x[0] == r.session_id and x[1] < r.turn])
        assert r.context == "\n".join(transcripts[r.session_id][:before])
    pieces = {}
    for r in turns.transcript_pieces(df, 10).orderBy("session_id", "piece").collect():
        pieces.setdefault(r.session_id, []).append(r.text)
    assert {s: "\n".join(p) for s, p in pieces.items()} == {s: "\n".join(t) for s, t in transcripts.items()}


def test_session_confidence_looks_at_the_whole_past(spark):
    rows = [("s", 0, "user", "red green blue")] + [("s", i, "system", f"filler {i}") for i in range(1, 40)]
    rows += [("s", 40, "user", "which"), ("s", 41, "assistant", "Red, green; BLUE"), ("t", 0, "user", "x"), ("t", 1, "assistant", "y y z x"),
             (None, 0, "user", "one"), (None, 1, "assistant", "one two"), ("u", 0, "user", "a"), ("u", 1, "assistant", "...")]
    df = spark.createDataFrame(rows, TURN)
    got = {(r.session_id, r.turn): r.confidence for r in scoring.session_confidence(df, turns.qa_pairs(df)).collect()}
    assert got == {("s", 41): "high", ("t", 1): "medium", (None, 1): "medium", ("u", 1): "low"}


def test_pending_is_the_last_turn_only(spark):
    df = spark.createDataFrame([("a", 0, "user", "x"), ("a", 1, "assistant", "y"), ("b", 0, "assistant", "x"), ("b", 1, "user", "z")], TURN)
    assert [tuple(r) for r in turns.pending_user_turns(df).collect()] == [("b", 1, "z")]


def attempts_by_hand(attempts, limit=5):
    out = {}
    for m in {a[0] for a in attempts}:
        oks = [ok for _, _, ok in sorted(a for a in attempts if a[0] == m)][:limit]
        if True in oks:
            out[m] = ("delivered", oks.index(True) + 1, None)
        elif len(oks) == limit:
            out[m] = ("dead_letter", limit, None)
        else:
            out[m] = ("pending", len(oks), min(300.0, 10.0 * 2 ** (len(oks) - 1)))
    return out


def test_delivery_outcomes(spark):
    rng = random.Random(2)
    attempts = [(rng.choice([0] * 5 + list(range(60))), t, rng.random() < 0.2) for t in range(400)]
    df = spark.createDataFrame(attempts, "message_id long, ts long, ok boolean").repartition(4)
    out = {r.message_id: (r.outcome, r.n_used, r.next_delay_s) for r in delivery.delivery_attempts(df, ["ts"]).collect()}
    assert out == attempts_by_hand(attempts)


def test_ranking_is_cut_before_the_shuffle(spark):
    df = spark.range(10).select((F.col("id") % 3).alias("message_id"), F.col("id").alias("ts"), F.lit(True).alias("ok"))
    plan = delivery.delivery_attempts(df, ["ts"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_retry_policies(spark):
    delays = spark.range(1, 9).orderBy("id").select(delivery.PUSH_RETRY.delay(F.col("id")).alias("push"), delivery.PUBLISH_RETRY.delay(F.col("id")).alias("publish")).collect()
    assert [r.push for r in delays] == [10, 20, 40, 80, 160, 300, 300, 300]
    assert all(abs(r.publish - 0.1 * 1.3 ** i) < 1e-9 for i, r in enumerate(delays))
