import base64
import itertools
import json
import random

from pyspark.sql import functions as F

from chatloom.functions.frames import channel_name, frame_content, session_from_channel
from chatloom.operators import replies, sessions
from chatloom.schemas import CHAT_REQUEST, ENVELOPE
from chatloom.sources import envelopes, frames, requests


def b64(text):
    return base64.b64encode(text if isinstance(text, bytes) else text.encode()).decode()


def test_decode_accepts_and_rejects(spark):
    cases = {b64('{"a": 1}'): True, b64('{"a": 1}')[:4] + "\n!" + b64('{"a": 1}')[4:]: True, "!!!": False, "": False,
             b64("{bad"): False, b64(b"\xff\xfe"): False, "YWI": False, b64("null"): True, b64("3"): True, b64('"ü"'): True,
             b64('{"a":1} x'): False, b64("1],[2"): False, b64('1, "a": 2'): False, b64("1,2"): False, b64("1} x"): False,
             b64('{"a":1,"a":2}'): True, b64(" [1, {}] "): True, b64('{"a":[}'): False}
    df = spark.createDataFrame([(i, d, {}) for i, d in enumerate(cases)], "id long, data string, attributes map<string,string>")
    out = envelopes.decode_envelopes(df).orderBy("id").collect()
    assert [r.decode_ok for r in out] == list(cases.values())
    assert all(r.session_id is None for r in out)


def test_nested_envelope_without_attributes(spark):
    row = ((b64("1"), "7", "t", None), "sub")
    out = envelopes.decode_envelopes(envelopes.flatten_envelopes(spark.createDataFrame([row], ENVELOPE))).first()
    assert (out.decode_ok, out.session_id, out.messageId) == (True, None, "7")


def test_encode_then_decode_is_identity(spark):
    contents = ["", "plain", 'quote " and \\ back', "üñí\n\ttab", "x" * 500, None]
    df = spark.createDataFrame([(i, f"s{i}", c) for i, c in enumerate(contents)], "id long, session_id string, content string")
    encoded = envelopes.encode_replies(df).drop("session_id")
    assert encoded.filter("data rlike '[\\r\\n]'").count() == 0
    out = envelopes.decode_envelopes(encoded).orderBy("id").collect()
    assert [json.loads(r.payload) for r in out] == [{"sender": "system", "content": c} for c in contents]
    assert [r.session_id for r in out] == [f"s{i}" for i in range(len(contents))]


def test_frames_and_channels(spark):
    df = spark.createDataFrame([(0, 'a"b', '{"x": 1}'), (1, None, "null")], "id long, session_id string, payload string")
    out = envelopes.channel_frames(df).orderBy("id").collect()
    assert [r.channel for r in out] == ['user_a"b', "user_None"]
    assert [json.loads(r.value) for r in out] == [{"session_id": 'a"b', "data": {"x": 1}}, {"session_id": None, "data": None}]
    row = spark.range(1).select(session_from_channel(F.lit("user_user_7")).alias("s"), channel_name(F.lit("7")).alias("c")).first()
    assert (row.s, row.c) == ("7", "user_7")


def test_frame_content_default(spark):
    lines = ['{"data": {"a": 1}}', '{"data": null}', "{}", "nonsense", '{"data": 1} x']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id long, line string")
    out = [r.c for r in df.orderBy("id").select(frame_content(F.col("line")).alias("c")).collect()]
    assert out == ['{"a":1}', "null", "{}", None, None]


def read(spark, mode, lines):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "id long, line string")
    return {r.id: (r.kind, r.session_id, r.content) for r in frames.read_frames(df, mode).collect()}


def test_websocket_lines(spark):
    out = read(spark, "ws", ['{"session_id":"s","data":{"content":"hi"}}', '{"session_id":"s","data":{"content":null}}',
                             '{"session_id":"s"}', '{"session_id":null,"data":{}}', "raw text", "", "{broken", "[1]",
                             '{"session_id":"s","data":"text"}', '{"session_id":7,"data":{"content":{"a":1}}}'])
    assert out == {0: ("message", "s", "hi"), 1: ("message", "s", "null"), 2: ("message", "s", "null"),
                   4: ("raw", None, "raw text"), 7: ("raw", None, "[1]"), 9: ("message", "7", '{"a":1}')}


def test_event_stream_lines(spark):
    inner = json.dumps({"data": {"content": "hi"}})
    out = read(spark, "sse", [json.dumps({"msg": inner}), '{"msg": "[DONE]"}', "[DONE]", "", json.dumps({"msg": "{}"}),
                              json.dumps({"msg": '{"data": {"content": null}}'}), "text"])
    assert out == {0: ("message", None, "hi"), 1: ("done", None, None), 2: ("done", None, None)}


def test_outcomes_partition_the_input(spark):
    rows = list(itertools.product([True, False], [True, False, None], [True, False], [1, 4, 5, 6]))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "id long, decode_ok boolean, online boolean, publish_failed boolean, delivery_attempt int")
    delivered, retry, dead = [{r.id: r for r in part.collect()} for part in envelopes.split_outcomes(df)]
    assert sorted([*delivered, *retry, *dead]) == list(range(len(rows)))
    assert all(r.decode_ok and r.online and not r.publish_failed for r in delivered.values())
    assert {r.reason for r in dead.values()} == {"decode_error", "offline", "publish_error"}
    assert all(r.delivery_attempt >= 5 for r in dead.values()) and all(r.delivery_attempt < 5 for r in retry.values())


def test_outcome_folders(spark, tmp_path):
    df = spark.createDataFrame([(0, True, True), (1, True, False)], "id long, decode_ok boolean, online boolean")
    envelopes.write_outcomes(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.id, r.outcome) for r in back.collect()} == {(0, "delivered"), (1, "retry")}


def test_requests_and_sessions(spark, tmp_path):
    rows = [(0, "u", None, "hi"), (1, "u", "", "hi"), (2, "u", "unknown", ""), (3, None, "s", "hi"), (4, "u", "s", None)]
    folder = str(tmp_path / "in")
    spark.createDataFrame([(*r, None) for r in rows], CHAT_REQUEST).write.json(folder)
    accepted, rejected = requests.chat_requests(spark, folder)
    assert {r.request_id: r.reject_reason for r in rejected.collect()} == {3: "user_id", 4: "user_input"}
    out = {r.request_id: r for r in sessions.resolve_session(accepted).collect()}
    assert out[2].session_id == "unknown" and not out[2].is_new
    assert out[0].is_new and out[1].is_new and out[0].session_id != out[1].session_id
    again = {r.request_id: r.session_id for r in sessions.resolve_session(accepted).collect()}
    assert again == {k: r.session_id for k, r in out.items()}


EVENT = "session_id string, invocation_id long, seq long, is_final boolean, has_content boolean, " \
        "parts array<struct<text:string>>, content_str string, error_code string"


def fold_by_hand(events):
    out = ""
    for e in sorted(events, key=lambda e: e[2]):
        if e[3] and e[4]:
            out += e[5][0][0] if e[5] and e[5][0][0] is not None else e[6]
        elif e[7]:
            out = "error"
    return out


def test_fold_cases(spark):
    final = lambda i, s, t: ("s", i, s, True, True, [(t,)], "str", None)
    failure = lambda i, s: ("s", i, s, False, False, None, None, "E")
    quiet = lambda i, s: ("s", i, s, False, False, None, None, None)
    events = [final(1, 0, "a"), failure(1, 1), final(1, 2, "b"), quiet(2, 0), final(3, 1, "y"), final(3, 0, "x"),
              ("s", 4, 0, True, True, [(None,)], "whole", None), ("s", 5, 0, True, True, [], "empty", None),
              ("s", 6, 0, True, False, None, None, "E"), ("s", 7, 0, True, True, [("t",)], "", "E")]
    df = spark.createDataFrame(events, EVENT)
    out = {r.invocation_id: r.content for r in replies.fold_replies(df).collect()}
    assert out == {1: "errorb", 2: "", 3: "xy", 4: "whole", 5: "empty", 6: "error", 7: "t"}


def test_fold_is_the_same_for_any_chunk_size(spark):
    rng = random.Random(1)
    events = []
    for run in range(6):
        for seq in range(rng.randint(1, 40)):
            kind = rng.random()
            final, broken = kind < 0.5, 0.5 <= kind < 0.6
            events.append(("s", run, seq, final, final, [(f"{seq};",)] if final else None, "c", "E" if broken else None))
    by_hand = {run: fold_by_hand([e for e in events if e[1] == run]) for run in range(6)}
    df = spark.createDataFrame(events, EVENT).repartition(4)
    for chunk in (1, 3, 7, 1000):
        assert {r.invocation_id: r.content for r in replies.fold_replies(df, chunk=chunk).collect()} == by_hand


def test_failed_run_drops_its_text(spark):
    df = spark.createDataFrame([("s", 1, 0, True, True, [("a",)], "", None)], EVENT)
    failed = spark.createDataFrame([("s", 1), ("s", 2)], "session_id string, invocation_id long")
    out = {r.invocation_id: r.content for r in replies.fold_replies(df, failed).collect()}
    assert out == {1: "system_error", 2: "system_error"}


def test_file_sources_and_queue_rows(spark, tmp_path):
    folder = str(tmp_path / "envelopes")
    row = ((b64('{"a": 1}'), "7", "t", {"session_id": "s"}), "sub")
    spark.createDataFrame([row], ENVELOPE).write.json(folder)
    out = envelopes.decode_envelopes(envelopes.read_envelopes(spark, folder)).first()
    assert (out.messageId, out.session_id, out.payload) == ("7", "s", '{"a": 1}')
    assert envelopes.read_envelopes(spark, folder, streaming=True).isStreaming
    accepted, rejected = requests.chat_requests(spark, folder, streaming=True)
    assert accepted.isStreaming and rejected.isStreaming

    lines = str(tmp_path / "lines")
    spark.createDataFrame([("raw",), ("",)], "value string").write.text(lines)
    assert [r.kind for r in frames.read_frames(frames.client_lines(spark, lines)).collect()] == ["raw"]

    queued = envelopes.queue_rows(envelopes.encode_replies(spark.createDataFrame([("s", "ü")], "session_id string, content string"))).first()
    assert queued.key is None and json.loads(bytes(queued.value)) == {"sender": "system", "content": "ü"}
    assert [(h.key, bytes(h.value)) for h in queued.headers] == [("session_id", b"s")]
