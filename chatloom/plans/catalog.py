"""Every operator as a named query over the supplied tables."""

import re

from pyspark.sql import functions as F

from chatloom.functions import confidence as label_functions
from chatloom.functions import frames as frame_functions
from chatloom.functions import language, rails
from chatloom.functions.model_rail import model_column, model_rail, worker_model_column
from chatloom.functions.redaction import INFO_TYPES
from chatloom.functions.text import date_instruction, primary_text, render
from chatloom.operators import (
    delivery, guards, leakage, moderation, presence, replies, report, retrieval, routing, scoring, sessions, translation, turns,
)
from chatloom.plans import fixtures as fx
from chatloom.sources import envelopes as env
from chatloom.sources import frames as client
from chatloom.sources import requests

QUERIES = {}

ATTEMPT_ORDER = ("ts", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
# Ordinals of a chunk in the long sessions: many chunks each.
LONG_CHUNK = 300
PROMPT = "Rate the answer.\nQuestion: {question}\nAnswer: {answer}\nContext: {context}\nOne of low, medium, high."


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _messages(spark, d):
    return fx.view(spark, d, "messages")


def _pairs(spark, d):
    return turns.qa_pairs(fx.view(spark, d, "turns"))


def _parts(spark, d):
    return fx.message_parts(_messages(spark, d))


def _joined(parts):
    return F.array_join(F.transform(parts, lambda p: p["text"]), "\n")


def _guarded(spark, d):
    return guards.apply_guards(_messages(spark, d), "text", rails.default_rails())


def _intervals(spark, d):
    return presence.presence_intervals(fx.view(spark, d, "presence_events"))


def _frames(spark, d):
    arrivals = fx.view(spark, d, "posts")
    payload = F.to_json(F.struct(F.lit("system").alias("sender"), F.col("content")))
    return env.channel_frames(arrivals.withColumn("payload", payload))


def _events(spark, d):
    return fx.agent_events(fx.view(spark, d, "agent_rows"))


# Sources and sinks

@query
def s1_chat_requests(spark, d):
    return requests.with_reject_reason(fx.view(spark, d, "requests"))


@query
def s2_envelope_decode(spark, d):
    flat = env.flatten_envelopes(fx.envelopes(fx.table(spark, d, "conversations")))
    return env.decode_envelopes(flat).select(
        F.col("messageId").alias("message_id"), "session_id", "decode_ok",
        F.get_json_object("payload", "$.sender").alias("sender"),
        F.get_json_object("payload", "$.content").alias("content"))


@query
def s3_reply_encode(spark, d):
    encoded = env.encode_replies(replies.fold_replies(_events(spark, d)))
    decoded = env.decode_envelopes(encoded.select("invocation_id", "data", "attributes"))
    return decoded.select("invocation_id", "session_id", "decode_ok",
                          F.get_json_object("payload", "$.sender").alias("sender"),
                          F.get_json_object("payload", "$.content").alias("content"))


@query
def s4_channel_frames(spark, d):
    return _frames(spark, d).select(
        "message_id", "channel", F.get_json_object("value", "$.session_id").alias("session_id"),
        F.get_json_object("value", "$.data.sender").alias("sender"),
        F.get_json_object("value", "$.data.content").alias("content"))


@query
def s5_client_frames_ws(spark, d):
    return client.read_frames(fx.view(spark, d, "client_lines"), "ws").drop("line")


@query
def s5_client_frames_sse(spark, d):
    return client.read_frames(fx.view(spark, d, "client_lines"), "sse").drop("line", "session_id")


@query
def s6_outcome_split(spark, d):
    queued = fx.arrival_envelopes(fx.view(spark, d, "arrivals"))
    gated = presence.with_online(env.decode_envelopes(queued), _intervals(spark, d))
    judged = env.with_outcome(gated.withColumn("publish_failed", F.col("message_id") % 10 == 0))
    return judged.select("message_id", "session_id", "outcome", "reason", "delivery_attempt")


# Projections and scalar functions

@query
def p1_session_resolution(spark, d):
    accepted, _ = requests.split_requests(fx.view(spark, d, "requests"))
    return sessions.resolve_session(accepted).select("request_id", "user_id", "session_id", "is_new")


@query
def p2_session_from_channel(spark, d):
    return fx.view(spark, d, "channels").withColumn(
        "session_id", frame_functions.session_from_channel(F.col("channel")))


@query
def p3_frame_content(spark, d):
    return fx.view(spark, d, "client_lines").select(
        "line_id", frame_functions.frame_content(F.col("line")).alias("content"))


@query
def p4_primary_text(spark, d):
    return _parts(spark, d).select("msg_id", primary_text(F.col("parts")).alias("text"))


@query
def p5_prompt_rendering(spark, d):
    now = F.expr("TIMESTAMP_NTZ '2024-01-02 03:04:05'")
    with_context = turns.history(fx.view(spark, d, "turns")).select("session_id", "turn", "context")
    return _pairs(spark, d).join(with_context, ["session_id", "turn"]).select(
        "session_id", "turn", render(PROMPT, {c: F.col(c) for c in ("question", "answer", "context")}).alias("prompt"),
        date_instruction(now).alias("instruction"))


# Guardrails

@query
def g1_card_redaction(spark, d):
    return guards.redact_cards(_messages(spark, d), "text").select("msg_id", "redacted", "was_redacted")


@query
def g1_card_parts(spark, d):
    return guards.redact_card_parts(_parts(spark, d), "parts").select(
        "msg_id", "was_redacted", F.size("parts").cast("bigint").alias("n_parts"), _joined(F.col("parts")).alias("text"))


@query
def g2_deidentify(spark, d):
    return guards.deidentify(_messages(spark, d), "text", list(INFO_TYPES)).select("msg_id", "text")


@query
def g2_findings(spark, d):
    return guards.inspect(_messages(spark, d), "msg_id", "text", list(INFO_TYPES))


@query
def g3_moderation(spark, d):
    scored = guards.moderate(_messages(spark, d), "text", rails.LEXICON)
    return scored.select("msg_id", F.size("categories").alias("n_categories"), *[
        rails.category_confidence(F.col("categories"), name).alias(name.lower()) for name in rails.LEXICON])


@query
def g3_moderation_by_table(spark, d):
    rows = [(category, term) for category, terms in rails.LEXICON.items() for term in terms]
    lexicon = spark.createDataFrame(rows, "category string, term string")
    return guards.moderate_by_table(_messages(spark, d), "msg_id", "text", lexicon)


@query
def g3_profanity_guard(spark, d):
    outcome = rails.ProfanityRail().process(F.col("text")).struct()
    return _messages(spark, d).select("msg_id", outcome.alias("o")).select(
        "msg_id", "o.is_blocked", F.col("o.blocked_reason").alias("reason"))


@query
def g3_learned_moderation(spark, d):
    """The threshold rule on the confidence of a model learned from labelled documents."""
    docs = fx.table(spark, d, "documents")
    model = moderation.learn(docs, fx.table(spark, d, "labels"), "doc_id", "toxic")
    outcome = rails.ProfanityRail(categories=lambda text: F.col("categories")).process(F.col("text")).struct()
    scored = docs.select("doc_id", "text", model.categories(F.col("text")).alias("categories"))
    return scored.select(F.col("doc_id").alias("msg_id"), moderation.fold(F.col("doc_id")).alias("fold"),
                         F.round(rails.category_confidence(F.col("categories")), 4).alias("confidence"), outcome.alias("o")).select(
        "msg_id", "fold", "confidence", "o.is_blocked", F.col("o.blocked_reason").alias("reason"))


@query
def g4_jailbreak_screen(spark, d):
    return guards.jailbreak_screen(_messages(spark, d), "text", rails.JailbreakRail()).select("msg_id", "refused", "reply")


@query
def g5_tool_call_admission(spark, d):
    return guards.tool_call_guard(fx.tool_calls(fx.view(spark, d, "tool_queries"))).select(
        "call_id", "tool_name", "query", "allowed", "reason")


@query
def g6_guard_chain(spark, d):
    return _guarded(spark, d).select("msg_id", "is_blocked", "reason", "final_text")


@query
def g7_guard_message(spark, d):
    return guards.guard_message(_parts(spark, d), "parts", rails.default_rails()).select(
        "msg_id", "is_blocked", "reason", _joined(F.col("parts")).alias("text"))


@query
def g8_language(spark, d):
    return _messages(spark, d).select("msg_id", "lang", language.detect_language(F.col("text")).alias("detected"))


@query
def g9_translation_worklist(spark, d):
    return translation.translation_worklist(_pairs(spark, d)).select(
        "session_id", "turn", "needs_translation", "source", "target", "text")


@query
def g9_apply_translations(spark, d):
    worklist = translation.translation_worklist(_pairs(spark, d))
    return translation.apply_translations(worklist, fx.view(spark, d, "translations")).select(
        "session_id", "turn", "needs_translation", "text")


@query
def g10_confidence(spark, d):
    return scoring.session_confidence(fx.view(spark, d, "turns"), _pairs(spark, d))


@query
def g10_confidence_long(spark, d):
    said = fx.view(spark, d, "long_turns")
    return scoring.session_confidence(said, turns.qa_pairs(said, LONG_CHUNK))


@query
def g10_normalise_label(spark, d):
    return fx.view(spark, d, "raw_labels").select(
        "doc_id", "raw", label_functions.normalise_label(F.col("raw")).alias("label"))


@query
def g11_refusal_tags(spark, d):
    answered = guards.apply_guards(fx.view(spark, d, "replies"), "text", [rails.JailbreakRail()])
    return guards.tag_refusals(answered, "final_text").select("msg_id", "reply_kind")


@query
def g12_style_audit(spark, d):
    return guards.style_audit(_messages(spark, d), "text", 12).drop("text", "lang")


# Joins

@query
def j1_presence_gate(spark, d):
    return presence.with_online(fx.view(spark, d, "arrivals"), _intervals(spark, d))


@query
def j2_subscriptions(spark, d):
    return routing.match_subscriptions(_frames(spark, d), fx.view(spark, d, "subscriptions")).select(
        "message_id", "channel", "subscriber_id")


@query
def j3_direct_delivery(spark, d):
    arrivals = fx.view(spark, d, "arrivals").withColumn("send_failed", F.col("message_id") % 50 == 7)
    return routing.direct_delivery(arrivals, fx.view(spark, d, "presence_events")).select("message_id", "session_id", "status", "connection_id")


@query
def j4_leakage(spark, d):
    return leakage.leakage(_messages(spark, d), fx.table(spark, d, "benchmark"), 8, text_id="msg_id")


@query
def j4_protected_passages(spark, d):
    return leakage.passages(_messages(spark, d), fx.table(spark, d, "benchmark"), 8, text_id="msg_id")


@query
def j5_retrieval(spark, d):
    return retrieval.retrieve(fx.view(spark, d, "queries"), fx.view(spark, d, "corpus"), 5)


# Aggregations

@query
def a1_reply_fold(spark, d):
    return replies.fold_replies(_events(spark, d))


@query
def a1_reply_fold_failed(spark, d):
    return replies.fold_replies(_events(spark, d), fx.view(spark, d, "failed_runs"))


@query
def a1_reply_pieces(spark, d):
    return replies.fold_pieces(_events(spark, d), 4)


@query
def a2_receiver_counts(spark, d):
    return routing.receiver_counts(_frames(spark, d), fx.view(spark, d, "subscriptions")).select(
        "message_id", "channel", "n_receivers")


@query
def a3_outcome_report(spark, d):
    tools = guards.tool_call_guard(fx.tool_calls(fx.view(spark, d, "tool_queries")))
    happened = (report.guard_outcomes(_guarded(spark, d))
                .unionByName(report.tool_outcomes(tools))
                .unionByName(report.delivery_outcomes(s6_outcome_split(spark, d))))
    return report.outcome_report(happened)


# Windows

@query
def w1_pending_user_turns(spark, d):
    return turns.pending_user_turns(fx.view(spark, d, "turns"))


@query
def w2_qa_pairs(spark, d):
    return _pairs(spark, d)


@query
def w3_history(spark, d):
    return turns.history(fx.view(spark, d, "turns")).select("session_id", "turn", "context")


@query
def w3_history_long(spark, d):
    return turns.history(fx.view(spark, d, "long_turns"), 20, LONG_CHUNK).select("session_id", "turn", "context")


@query
def w3_history_offsets_long(spark, d):
    return turns.history_offsets(fx.view(spark, d, "long_turns"), LONG_CHUNK).select(
        "session_id", "turn", "n_turns_before", "n_chars_before")


@query
def w3_transcript_pieces(spark, d):
    return turns.transcript_pieces(fx.view(spark, d, "long_turns"), 8 * LONG_CHUNK)


@query
def w2_qa_pairs_long(spark, d):
    return turns.qa_pairs(fx.view(spark, d, "long_turns"), LONG_CHUNK)


@query
def w3_history_offsets(spark, d):
    return turns.history_offsets(fx.view(spark, d, "turns")).select(
        "session_id", "turn", "n_turns_before", "n_chars_before")


@query
def w4_delivery_attempts(spark, d):
    return delivery.delivery_attempts(fx.view(spark, d, "attempts"), ATTEMPT_ORDER)


@query
def w4_publish_retry(spark, d):
    tried = delivery.delivery_attempts(fx.view(spark, d, "attempts"), ATTEMPT_ORDER, 8, delivery.PUBLISH_RETRY)
    return tried.withColumn("next_delay_s", F.round("next_delay_s", 6))


@query
def w4_held_attempts(spark, d):
    """The delay policy at work on attempts that come within seconds of each other."""
    order = ["at_s", "l_linenumber", "l_partkey", "l_suppkey", "cents"]
    return delivery.held_attempts(fx.view(spark, d, "bursts"), order, "at_s")


@query
def w5_presence_intervals(spark, d):
    return _intervals(spark, d)


@query
def w5_online_spans(spark, d):
    return presence.online_spans(_intervals(spark, d))


@query
def w5_online_over_time(spark, d):
    return presence.online_over_time(presence.online_spans(_intervals(spark, d)))


@query
def t3_sliding_presence_batch(spark, d):
    return presence.gap_sessions(fx.view(spark, d, "posts"))


# Extension surface

class ShoutingRail(rails.GuardRail):
    """Example of a rail of one's own: calms down repeated exclamation marks."""

    name = "shouting"

    def process(self, text):
        return rails.modifies(text.contains("!!"), F.regexp_replace(text, "!{2,}", "!"))


@query
def u1_custom_rail(spark, d):
    shouted = _messages(spark, d).withColumn("text", F.concat("text", F.when(F.col("msg_id") % 7 == 0, "!!!").otherwise("")))
    return guards.apply_guards(shouted, "text", [ShoutingRail(), rails.JailbreakRail()]).select(
        "msg_id", "is_blocked", "reason", "final_text")


def example_model(texts):
    """Stands for a model: share of digits among the characters; fails on texts with pipes."""
    if any("|" in t for t in texts):
        raise ValueError("cannot read tables")
    return [len(re.findall("[0-9]", t)) / max(len(t), 1) for t in texts]


@query
def u2_model_rail(spark, d):
    opened = model_rail(example_model, "open", 0.01, "Digits detected")
    closed = model_rail(example_model, "closed", 0.01, "Digits detected")
    texts = _messages(spark, d).withColumn("scored", model_column(example_model)(F.col("text")))
    both = texts.withColumns({"o": opened.outcome(F.col("scored")).struct(), "c": closed.outcome(F.col("scored")).struct()})
    return both.select("msg_id", F.col("scored.error").isNotNull().alias("failed"),
                       F.col("o.is_blocked").alias("open_blocked"), F.col("o.blocked_reason").alias("open_reason"),
                       F.col("c.is_blocked").alias("closed_blocked"), F.col("c.blocked_reason").alias("closed_reason"))


class ColdModel:
    """Stands for a model in a process of its own, whose first call after loading fails."""

    def __init__(self):
        self.calls = 0

    def __call__(self, texts):
        self.calls += 1
        if self.calls == 1:
            raise ConnectionError("not ready")
        return example_model(texts)


@query
def u2_worker_model(spark, d):
    """A model loaded once per worker; its first failure costs a retry, texts it cannot read keep their error."""
    # Single texts are to blame here, not the model: their failures in a row never open the breaker.
    scored = _messages(spark, d).withColumn("scored", worker_model_column(ColdModel, trip=1 << 62)(F.col("text")))
    return scored.select("msg_id", F.round("scored.value", 6).alias("digit_share"), F.col("scored.error").alias("error"))
