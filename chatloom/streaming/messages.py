"""Envelopes, guards and reply folds on streams."""

from pyspark.sql import functions as F

from chatloom.operators.guards import apply_guards
from chatloom.operators.presence import TTL_S
from chatloom.operators.replies import SENDER, fold_expression, folded_steps, with_steps
from chatloom.sources.envelopes import channel_frames, decode_envelopes, with_outcome
from chatloom.streaming.presence import BUCKETS, presence_stream


def guard_stream(stream, col, rails):
    """The guard chain on a stream; it keeps no state."""
    return apply_guards(stream, col, rails)


def drop_repeats(envelopes, delay="1 hour"):
    """The first of envelopes with the same ``message_id`` that come within ``delay``."""
    return envelopes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["message_id"])


def envelope_outcomes(envelopes, events, ttl_s=TTL_S, delay="1 hour", busy=None, side=None, buckets=BUCKETS):
    """Decode, gate and frame a stream of envelopes (message_id, ts, data, attributes).

    Optional columns are ``delivery_attempt`` (1 for the first) and ``publish_failed``; a
    failure after the last attempt is a dead letter. Gives (message_id, session_id,
    channel, value, reason, outcome, delivery_attempt). The queue may deliver an envelope
    twice and repeats pass; put ``drop_repeats`` into a job before this one to remove them.
    """
    decoded = decode_envelopes(envelopes)
    attempt = F.coalesce("delivery_attempt", F.lit(1)) if "delivery_attempt" in envelopes.columns else F.lit(1)
    failed = F.coalesce("publish_failed", F.lit(False)) if "publish_failed" in envelopes.columns else F.lit(False)
    decoded = decoded.withColumns({"delivery_attempt": attempt.cast("long"), "publish_failed": failed})
    # What the outcome needs besides the payload waits together with it.
    carried = F.to_json(F.struct("payload", "delivery_attempt", "publish_failed"))
    gated = presence_stream(decoded.filter("decode_ok").select("message_id", "session_id", "ts", carried.alias("payload")),
                            events, ttl_s, delay, busy, side, buckets)
    opened = F.from_json("payload", "payload string, delivery_attempt long, publish_failed boolean")
    readable = gated.withColumn("__held", opened).select(
        "message_id", "session_id", "__held.payload", "online", F.lit(True).alias("decode_ok"), "__held.delivery_attempt", "__held.publish_failed")
    broken = decoded.filter("NOT decode_ok").select(
        "message_id", "session_id", F.lit(None).cast("string").alias("payload"), F.lit(False).alias("online"), "decode_ok",
        "delivery_attempt", "publish_failed")
    judged = with_outcome(channel_frames(readable.unionByName(broken)))
    sent = F.col("outcome") == "delivered"
    return judged.select("message_id", "session_id", F.when(sent, F.col("channel")).alias("channel"),
                         F.when(sent, F.col("value")).alias("value"), "reason", "outcome", "delivery_attempt")


def outcome_sink(path):
    """A batch writer: one folder per micro-batch and outcome.

    A repeated micro-batch replaces its folder, so a restart leaves no duplicates.
    """
    def write(batch, batch_id):
        batch.write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/batch={batch_id}")
    return write


def fold_stream(agent_events, window="10 minutes", delay="1 hour"):
    """Pieces of replies from a stream of agent events with ``ts``.

    The events of a run within a window are folded in the order of ``seq`` to one piece
    (``at`` its first ordinal, ``reset``, ``text``). A pause only means more pieces; the
    pieces of a run, in order, are its reply (``replies_of_pieces``). Ordinals of a run
    must follow its times, so that the windows of a run do not interleave.
    """
    runs = (with_steps(agent_events).withWatermark("ts", delay)
            .groupBy("session_id", "invocation_id", F.window("ts", window).alias("run"))
            .agg(F.min("seq").alias("at"), F.collect_list("__step").alias("__steps")))
    return runs.select("session_id", "invocation_id", "at", folded_steps(F.col("__steps")).alias("__piece")).select(
        "session_id", "invocation_id", "at", "__piece.*")


def replies_of_pieces(pieces):
    """One reply per run from all the pieces that a stream has written for it."""
    kept = F.when(F.col("reset") | (F.col("text") != ""), F.struct("at", "reset", "text"))
    steps = pieces.groupBy("session_id", "invocation_id").agg(F.collect_list(kept).alias("__steps"))
    return steps.select("session_id", "invocation_id", F.lit(SENDER).alias("sender"), fold_expression(F.col("__steps")).alias("content"))
