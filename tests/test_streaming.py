"""Streams over several files, some out of order, against their batch twins."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatloom.functions import rails
from chatloom.operators import delivery, presence as batch_presence, replies
from chatloom.operators.guards import apply_guards
from chatloom.plans import catalog, stream_catalog  # noqa: F401
from chatloom.streaming import messages, presence, redelivery, replay
from chatloom.streaming.runner import flush_ts, run_bounded, stream_session
from tests.test_joins import arrival_table, event_table, random_presence
from tests.test_messages import b64
from tests.test_sessions import attempts_by_hand


@pytest.fixture(scope="module")
def own(spark):
    return stream_session(spark)


def in_files(df, folder, n, order):
    """Write ``df`` as ``n`` files that follow ``order``; some rows land one file late."""
    place = F.ntile(n).over(Window.orderBy(order))
    late = F.when(F.pmod(F.hash(order), F.lit(5)) == 0, 1).otherwise(0)
    cut = df.withColumn("file", F.least(place + late, F.lit(n))).persist()
    for i in range(1, n + 1):
        cut.filter(F.col("file") == i).drop("file").coalesce(1).write.mode("append").parquet(folder)
    return df.schema


def stream_of(own, folder, schema):
    return own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def stamped(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_presence_stream_equals_batch(spark, own, tmp_path):
    events, arrivals = random_presence(11)
    e, a = event_table(spark, events), arrival_table(spark, arrivals).withColumn("payload", F.col("message_id").cast("string"))
    es, as_ = in_files(stamped(e), str(tmp_path / "e"), 3, "ts"), in_files(stamped(a), str(tmp_path / "a"), 3, "ts")

    busy = presence.busy_sessions(a, 20)
    assert busy.agg(F.max("parts")).first()[0] > 1

    def build(side):
        return presence.presence_stream(stream_of(own, str(tmp_path / "a"), as_), stream_of(own, str(tmp_path / "e"), es),
                                        900, "1 day", busy=busy, side=side)

    done = run_bounded(own, build, presence.presence_flush(flush_ts()))
    assert done.dropped_late == 0
    expected = batch_presence.with_online(a, batch_presence.presence_intervals(e, 900))
    got = {(r.message_id, r.payload): r.online for r in spark.read.parquet(done.path).collect()}
    assert got == {(r.message_id, r.payload): r.online for r in expected.collect()}
    assert sum(got.values()) > 50 and len(got) == len(arrivals)


def test_late_rows_are_counted(spark, own, tmp_path):
    first = [(1, "s", 0), (2, "s", 100000)]
    # The watermark of one batch decides what is late in the next.
    for part in (first, [(4, "s", 100001)], [(3, "s", 10)]):
        stamped(arrival_table(spark, part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    schema = stamped(arrival_table(spark, first)).schema
    read = lambda: stream_of(own, str(tmp_path / "a"), schema)

    def attempts(side):
        rows = read().select("message_id", "ts", F.lit("").alias("tie"), F.lit(True).alias("ok"))
        return redelivery.redelivery_stream(rows, delay="1 minute", side=side)

    done = run_bounded(own, attempts, redelivery.redelivery_flush(flush_ts()))
    assert done.dropped_late == 1
    assert {r.message_id for r in spark.read.parquet(done.path).collect()} == {1, 2, 4}

    def spans(side):
        return presence.presence_sliding(read().select("session_id", "ts").unionByName(side), delay="1 minute")

    # Session windows do not report late rows; the difference to the input shows them.
    done = run_bounded(own, spans, {"session_id": F.lit(""), "ts": flush_ts()})
    assert spark.read.parquet(done.path).agg(F.sum("n_messages")).first()[0] == 3


def test_sliding_stream_equals_batch(spark, own, tmp_path):
    _, arrivals = random_presence(12)
    a = arrival_table(spark, arrivals)
    schema = in_files(stamped(a), str(tmp_path / "a"), 3, "ts")

    def build(side):
        rows = stream_of(own, str(tmp_path / "a"), schema).filter("session_id IS NOT NULL").select("session_id", "ts")
        return presence.presence_sliding(rows.unionByName(side), 300, "1 day")

    done = run_bounded(own, build, {"session_id": F.lit(""), "ts": flush_ts()})
    got = sorted((r.session_id, r.n_messages) for r in spark.read.parquet(done.path).collect())
    assert got == sorted((r.session_id, r.n_messages) for r in batch_presence.gap_sessions(a, 300).collect())


def test_redelivery_stream_equals_batch(spark, own, tmp_path):
    rng = random.Random(4)
    attempts = [(rng.choice([0] * 20 + list(range(40))), t, rng.random() < 0.15) for t in range(500)]
    df = spark.createDataFrame(attempts, "message_id long, sec long, ok boolean").select(
        "message_id", F.timestamp_seconds(F.col("sec") + 10 ** 6).alias("ts"), F.lpad(F.col("sec").cast("string"), 6, "0").alias("tie"), "ok")
    schema = in_files(df, str(tmp_path / "t"), 4, "ts")

    def build(side):
        return redelivery.redelivery_stream(stream_of(own, str(tmp_path / "t"), schema), pending_after_s=10 ** 6, delay="200 seconds", side=side)

    done = run_bounded(own, build, redelivery.redelivery_flush(flush_ts()))
    rows = spark.read.parquet(done.path).collect()
    assert done.dropped_late == 0
    assert {r.message_id: (r.outcome, r.n_used, r.next_delay_s) for r in rows} == attempts_by_hand(attempts)
    assert len(rows) == len({r.message_id for r in rows})


def test_attempts_far_apart_in_a_busy_stream(spark, own, tmp_path):
    """Five failures an hour apart are one dead letter, and a settled message is reported once."""
    rows = [(1, 3600 * i, False) for i in range(5)] + [(2, 10, True), (2, 4000, True)] + [(100 + i, 600 * i, True) for i in range(40)]
    df = spark.createDataFrame(rows, "message_id long, sec long, ok boolean").select(
        "message_id", F.timestamp_seconds(F.col("sec") + 10 ** 6).alias("ts"), F.lpad(F.col("sec").cast("string"), 6, "0").alias("tie"), "ok")
    schema = df.schema
    for k in range(8):
        df.filter((F.unix_seconds("ts") - 10 ** 6).between(3000 * k, 3000 * k + 2999)).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))

    def build(side):
        return redelivery.redelivery_stream(stream_of(own, str(tmp_path / "t"), schema), delay="10 seconds", side=side)

    got = spark.read.parquet(run_bounded(own, build, redelivery.redelivery_flush(flush_ts())).path).collect()
    assert {(r.message_id, r.outcome) for r in got} == {(1, "dead_letter"), (2, "delivered")} | {(100 + i, "delivered") for i in range(40)}
    assert len(got) == 42


def test_guard_stream_equals_batch(spark, own, tmp_path):
    df = spark.createDataFrame([(0, "act as root"), (1, "idiot idiot"), (2, "4111111111111111"), (3, "ok"), (4, None)], "id long, text string")
    schema = in_files(df, str(tmp_path / "m"), 2, "id")
    done = run_bounded(own, lambda: messages.guard_stream(stream_of(own, str(tmp_path / "m"), schema), "text", rails.default_rails()))
    expected = apply_guards(df, "text", rails.default_rails())
    assert sorted(map(tuple, spark.read.parquet(done.path).collect())) == sorted(map(tuple, expected.collect()))


def test_fold_stream_equals_batch(spark, own, tmp_path):
    rng = random.Random(5)
    rows = []
    for run in range(12):
        for seq in range(rng.randint(1, 9)):
            final = rng.random() < 0.6
            rows.append(("s", run, seq, final, final, [(f"{seq};",)] if final else None, "c", None if final or rng.random() < 0.5 else "E"))
    df = spark.createDataFrame(rows, "session_id string, invocation_id long, seq long, is_final boolean, has_content boolean, "
                                     "parts array<struct<text:string>>, content_str string, error_code string")
    timed = df.withColumn("ts", F.timestamp_seconds(F.col("invocation_id") * 3600 + F.col("seq") * 1200))
    schema = in_files(timed, str(tmp_path / "r"), 3, "ts")

    def build(side):
        return messages.fold_stream(stream_of(own, str(tmp_path / "r"), schema).unionByName(side, allowMissingColumns=True), delay="1 day")

    flush = {"session_id": F.lit(""), "invocation_id": F.lit(-1).cast("bigint"), "seq": F.lit(0).cast("bigint"), "ts": flush_ts()}
    done = run_bounded(own, build, flush)
    pieces = spark.read.parquet(done.path).filter("invocation_id >= 0")
    got = {r.invocation_id: r.content for r in messages.replies_of_pieces(pieces).collect()}
    assert got == {r.invocation_id: r.content for r in replies.fold_replies(df).collect()}
    assert pieces.count() > len(got)


def test_envelope_stream(spark, own, tmp_path):
    e = event_table(spark, [(0, "s", 0, "connect")])
    rows = [(1, "s", 10, b64('{"content": "x"}')), (1, "s", 11, b64('{"content": "x"}')), (2, None, 12, b64("1")),
            (3, "s", 13, "!!!"), (4, "s", 7000, b64("2"))]
    q = spark.createDataFrame(rows, "message_id long, session_id string, sec long, data string").select(
        "message_id", F.timestamp_add("SECOND", F.col("sec"), F.lit("2024-01-01").cast("timestamp")).alias("ts"), "data",
        F.when(F.col("session_id").isNotNull(), F.create_map(F.lit("session_id"), F.col("session_id"))).otherwise(
            F.create_map().cast("map<string,string>")).alias("attributes"))
    es, qs = in_files(stamped(e), str(tmp_path / "e"), 1, "ts"), in_files(q, str(tmp_path / "q"), 1, "ts")

    def build(side):
        return messages.envelope_outcomes(stream_of(own, str(tmp_path / "q"), qs), stream_of(own, str(tmp_path / "e"), es),
                                          delay="1 day", side=side)

    done = run_bounded(own, build, presence.presence_flush(flush_ts()), messages.outcome_sink)
    out = [(r.message_id, r.outcome, r.reason) for r in spark.read.parquet(done.path).collect()]
    assert sorted(out, key=str) == sorted([(1, "delivered", None)] * 2 + [
        (2, "retry", "offline"), (3, "retry", "decode_error"), (4, "retry", "offline")], key=str)
    numbered = q.withColumns({"delivery_attempt": F.lit(5), "publish_failed": F.col("message_id") == 1})
    ns = in_files(numbered, str(tmp_path / "n"), 1, "ts")
    done = run_bounded(own, lambda side: messages.envelope_outcomes(
        stream_of(own, str(tmp_path / "n"), ns), stream_of(own, str(tmp_path / "e"), es), delay="1 day", side=side),
        presence.presence_flush(flush_ts()), messages.outcome_sink)
    out = [(r.message_id, r.outcome, r.reason, r.delivery_attempt) for r in spark.read.parquet(done.path).collect()]
    assert sorted(out, key=str) == sorted([(1, "dead_letter", "publish_error", 5)] * 2 + [
        (2, "dead_letter", "offline", 5), (3, "dead_letter", "decode_error", 5), (4, "dead_letter", "offline", 5)], key=str)
    once = run_bounded(own, lambda: messages.drop_repeats(stream_of(own, str(tmp_path / "q"), qs)))
    assert sorted(r.message_id for r in spark.read.parquet(once.path).collect()) == [1, 2, 3, 4]
    root = once.path.removeprefix("file:").rsplit("/", 1)[0]
    assert os.listdir(root) == ["out"]
    once.delete(spark)
    assert os.listdir(root) == []


@pytest.mark.parametrize("name, table, column", [
    ("t4_redelivery_stream", "lineitem", "l_shipdate"), ("t3_sliding_presence_stream", "events", "ts"), ("t6_reply_fold_stream", "conversations", "conv_id")])
def test_files_in_any_order_lose_nothing(spark, tmp_path, name, table, column):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/{table}.parquet").repartitionByRange(3, F.desc(column)).write.parquet(f"{tmp_path}/{table}.parquet")
    want = sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect()), key=str)
    assert sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()), key=str) == want


def test_gate_by_hand():
    c, d, a = presence.CONNECT, presence.DISCONNECT, presence.ARRIVAL
    rows = [(5, 1, a, "x"), (5, 9, c, None), (7, 2, d, None), (7, 3, a, "y"), (6, 4, a, "z"), (20, 5, c, None), (30, 6, a, "w"), (29, 7, a, None)]
    flags, connected = presence.gate(rows, None, 10)
    assert flags == [(1, 5, "x", True), (4, 6, "z", True), (3, 7, "y", False), (7, 29, None, True), (6, 30, "w", False)] and connected == 20
    assert presence.gate([(3, 1, a, "x")], 0, 10) == ([(1, 3, "x", True)], 0)


def shuffled_files(df, folder, n):
    df.repartition(n, F.hash("ts")).write.parquet(folder)


def test_replay_of_shuffled_files_holds_the_delay_not_the_table(spark, own, tmp_path, monkeypatch):
    """Each slice is a run that goes on from the checkpoint of the one before, as after a restart."""
    monkeypatch.setattr(replay, "LEAST_SLICES", 5)
    rows = [(i, f"s{i % 50}", 10 * i) for i in range(4000)]
    a = arrival_table(spark, rows).withColumn("payload", F.lit("p"))
    e = event_table(spark, [(i, f"s{i}", 500 * i, "connect") for i in range(50)] + [(100 + i, f"s{i}", 500 * i + 700, "disconnect") for i in range(0, 50, 2)])
    both = stamped(a.select("message_id", "session_id", "ts", "payload", F.lit("arrival").alias("kind")).unionByName(
        e.select(F.col("event_id").alias("message_id"), "session_id", "ts", F.lit(None).cast("string").alias("payload"), "kind")))
    shuffled_files(both, str(tmp_path / "b"), 5)

    def build(read, side):
        arrivals = read().filter("kind = 'arrival'").drop("kind")
        events = read().filter("kind <> 'arrival'").select(F.col("message_id").alias("event_id"), "session_id", "ts", "kind")
        return presence.presence_stream(arrivals, events, 900, "1 minute", side=side)

    done = replay.run_replayed(own, own.read.parquet(str(tmp_path / "b")), build, presence.presence_flush(flush_ts()))
    expected = batch_presence.with_online(a, batch_presence.presence_intervals(e, 900))
    got = {r.message_id: r.online for r in spark.read.parquet(done.path).collect()}
    assert got == {r.message_id: r.online for r in expected.collect()} and sum(got.values()) > 20
    assert done.dropped_late == 0
    # A slice is 800 rows; between the runs only connects that stand and the rows of the delay are held.
    assert 0 < done.state_rows < 1500


def test_replay_of_an_empty_table(spark, own, tmp_path):
    a = stamped(arrival_table(spark, [(1, "s", 0)]).limit(0)).withColumn("payload", F.lit("p"))
    e = stamped(event_table(spark, [(1, "s", 0, "connect")]).limit(0))

    def build(read, side):
        events = own.readStream.schema(e.schema).parquet(side_folder)
        return presence.presence_stream(read(), events, side=side)

    side_folder = str(tmp_path / "e")
    e.write.parquet(side_folder)
    done = replay.run_replayed(own, a, build, presence.presence_flush(flush_ts()))
    assert spark.read.schema("message_id long").parquet(done.path).count() == 0


def test_redelivery_state_is_forgotten_by_timers(spark, own, monkeypatch):
    """Settled messages go after the retention, pending ones after theirs; a repeat after that starts anew."""
    hour = 3600
    rows = [(1, 0, True), (1, hour, False), (1, 50 * hour, True), (2, 0, False), (2, 30 * hour, False)] + [(100 + i, i * hour, True) for i in range(80)]
    df = spark.createDataFrame(rows, "message_id long, sec long, ok boolean").select(
        "message_id", F.timestamp_seconds(F.col("sec") + 10 ** 6).alias("ts"), F.lpad(F.col("sec").cast("string"), 6, "0").alias("tie"), "ok")

    def build(read, side):
        return redelivery.redelivery_stream(read(), retention_s=5 * hour, pending_after_s=10 * hour, delay="0 seconds", side=side)

    monkeypatch.setattr(replay, "LEAST_SLICES", 7)
    done = replay.run_replayed(own, df, build, redelivery.redelivery_flush(flush_ts()))
    got = [tuple(r)[:3] for r in spark.read.parquet(done.path).collect() if r.message_id < 100]
    assert sorted(got) == [(1, 1, "delivered"), (1, 1, "delivered"), (2, 1, "pending"), (2, 1, "pending")]
    assert done.state_rows < 60


def held_by_hand(rows, waits=(10, 20, 40, 80, 160), most=5):
    out = {}
    for message in {r[0] for r in rows}:
        at, n, outcome = None, 0, "pending"
        for sec, ok in sorted((s, o) for m, s, o in rows if m == message)[:most]:
            at = sec if at is None else max(sec, at + waits[n - 1])
            n += 1
            if ok or n == most:
                outcome = "delivered" if ok else "dead_letter"
                break
        out[message] = (n, outcome, at, at + waits[n - 1] if outcome == "pending" else None)
    return out


def test_held_attempts_batch_and_stream(spark, own, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randrange(60), t, rng.random() < 0.2) for t in rng.sample(range(2000), 400)]
    want = held_by_hand(rows)
    table = spark.createDataFrame(rows, "message_id long, sec long, ok boolean")
    got = delivery.held_attempts(table, ["sec"], "sec").collect()
    assert {r.message_id: (r.n_used, r.outcome, r.at_s, r.next_at_s) for r in got} == want
    timed = table.select("message_id", F.timestamp_seconds("sec").alias("ts"), F.lpad(F.col("sec").cast("string"), 6, "0").alias("tie"), "ok")
    done = replay.run_replayed(own, timed, lambda read, side: redelivery.redelivery_stream(
        read(), hold=True, pending_after_s=10 ** 6, delay="0 seconds", side=side), redelivery.redelivery_flush(flush_ts()))
    got = spark.read.parquet(done.path).collect()
    assert {r.message_id: (r.n_used, r.outcome, r.at_us // 10 ** 6) for r in got} == {m: w[:3] for m, w in want.items()}
    assert done.dropped_late == 0 and len(got) == len(want)


def test_redelivery_state_is_shared_by_buckets(spark, own):
    """Thousands of open messages cost a state and a timer per bucket, not per message; no id is a message of its own."""
    rng = random.Random(9)
    rows = [(rng.randrange(1500), t, rng.random() < 0.2) for t in range(4000)] + [(None, 10, False), (None, 3000, True), (0, 11, None)]
    df = spark.createDataFrame(rows, "message_id long, sec long, ok boolean").select(
        "message_id", F.timestamp_seconds(F.col("sec") + 10 ** 6).alias("ts"), F.lpad(F.col("sec").cast("string"), 6, "0").alias("tie"), "ok")
    done = replay.run_replayed(own, df, lambda read, side: redelivery.redelivery_stream(
        read(), pending_after_s=10 ** 6, delay="0 seconds", side=side, buckets=4), redelivery.redelivery_flush(flush_ts()))
    got = spark.read.parquet(done.path).collect()
    want = attempts_by_hand([(-1 if m is None else m, t, bool(ok)) for m, t, ok in rows])
    assert {-1 if r.message_id is None else r.message_id: (r.outcome, r.n_used, r.next_delay_s) for r in got} == want
    assert len(got) == len(want) and done.dropped_late == 0
    # The state and the timer with its index, of four buckets and of that without an id.
    assert done.state_rows <= 15


def test_slices_are_cut_into_files(spark, monkeypatch):
    """A slice is read by as many tasks as it has files, also in a table smaller than a slice may be."""
    monkeypatch.setattr(replay, "FILE_BYTES", 1 << 10)
    rows = spark.range(4000).select("id", F.timestamp_seconds("id").alias("ts"))
    cut = replay.Replay(rows)
    assert cut.slices == replay.LEAST_SLICES and len(cut.ranges) >= 8 * cut.slices
    cut.delete()


def test_presence_state_is_shared_by_buckets(spark, own):
    """Many sessions cost a state and a timer per bucket, not per session; arrivals may lack an id."""
    rng = random.Random(21)
    arrivals = [(None if i % 50 == 0 else i, f"s{rng.randrange(600)}", rng.randrange(20000)) for i in range(3000)]
    events = [(i, f"s{rng.randrange(600)}", rng.randrange(20000), rng.choice(["connect", "connect", "disconnect"])) for i in range(3000)]
    a = arrival_table(spark, arrivals).withColumn("payload", F.concat_ws("/", "session_id", F.col("ts").cast("string")))
    e = event_table(spark, events)
    both = stamped(a.select("message_id", "session_id", "ts", "payload", F.lit("arrival").alias("kind")).unionByName(
        e.select(F.col("event_id").alias("message_id"), "session_id", "ts", F.lit(None).cast("string").alias("payload"), "kind")))

    def build(read, side):
        told = read().filter("kind <> 'arrival'").select(F.col("message_id").alias("event_id"), "session_id", "ts", "kind")
        return presence.presence_stream(read().filter("kind = 'arrival'").drop("kind"), told, 900, "1 minute", side=side, buckets=4)

    done = replay.run_replayed(own, both, build, presence.presence_flush(flush_ts()))
    rows = spark.read.parquet(done.path).collect()
    expected = batch_presence.with_online(a, batch_presence.presence_intervals(e, 900)).collect()
    got, want = (sorted((str(r.message_id), r.payload, r.online) for r in found) for found in (rows, expected))
    assert got == want and done.dropped_late == 0 and 100 < sum(r.online for r in rows) < 2900
    # The state and the timer with its index, of four buckets.
    assert done.state_rows <= 12


def test_small_slices_have_a_file_for_every_core(spark):
    """The estimate is of compressed bytes, and rows that are small there may cost much to decode."""
    cut = replay.Replay(spark.range(4000).select("id", F.timestamp_seconds("id").alias("ts")))
    assert len(cut.ranges) == cut.slices * spark.sparkContext.defaultParallelism
    cut.delete()
