"""The streaming operators as named queries: each runs over its whole input, then is read back."""

from pyspark.sql import functions as F

from chatloom.functions import rails
from chatloom.operators import replies
from chatloom.operators.presence import from_epoch_us
from chatloom.plans import fixtures as fx
from chatloom.plans.catalog import query
from chatloom.session import shared_folder
from chatloom.sources import envelopes as env
from chatloom.sources import queue_log
from chatloom.streaming import messages, presence, redelivery
from chatloom.streaming.replay import run_replayed
from chatloom.streaming.runner import FLUSH_TIME, delete, flush_ts, run_available, run_bounded, stream_session

# A burst of attempts is over after this.
PENDING_AFTER_S = 86400


def _whole(done):
    """The path of a finished stream that has dropped no row as late."""
    if done.dropped_late:
        raise RuntimeError(f"{done.dropped_late} rows came too late to count")
    return done.path


def _span(rows):
    """Seconds from the first to the last ``ts``: a message of the table may wait so long for its next attempt."""
    row = rows.agg(*[F.unix_seconds(at) for at in (F.min("ts"), F.max("ts"), F.max(flush_ts()))]).first()
    span = 0 if row[0] is None else row[1] - row[0] + 1
    if row[0] is not None and row[1] + span > row[2]:
        raise ValueError(f"messages open for {span} seconds are not released by a row at {FLUSH_TIME}")
    return span


def _buckets(rows):
    return redelivery.buckets_for(rows.agg(F.approx_count_distinct("message_id")).first()[0])


# All streams get their rows in the order of time, so they wait no longer than a live source would need.
DELAY = "1 minute"


def _posts(own, d):
    """Every event with its time; arrivals and presence events are taken out of the same stream."""
    rows = fx.table(own, d, "events").select("event_id", "user_id", "ts", "event_type")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _of(read, name):
    """A derived input from the stream of posts."""
    rows = read()
    return rows.sparkSession.sql(fx.SQL[name], events=rows)


def _presence_run(own, d, build, foreach_batch=None):
    posts = _posts(own, d)
    arrivals = fx.view(own, d, "arrivals")
    # What the table tells of the stream to come: its busy sessions and how many buckets it needs.
    known = {"busy": presence.busy_sessions(arrivals), "buckets": presence.buckets_for(arrivals.count())}
    return run_replayed(own, posts, lambda read, side: build(_of(read, "arrivals"), _of(read, "presence_events"), known | {"side": side}),
                        presence.presence_flush(flush_ts()), foreach_batch)


@query
def s2_queue_log_stream(spark, d):
    """Envelopes published to a log by three writes, read from it as a stream and decoded."""
    queue_log.register(spark)
    log = shared_folder(spark, "queue")
    flat = env.flatten_envelopes(fx.envelopes(fx.table(spark, d, "conversations")))
    published = queue_log.log_rows(flat, F.col("messageId"), F.to_timestamp("publishTime"))
    for part in range(3):
        published.where(F.pmod(F.xxhash64("messageId"), F.lit(3)) == part).write.format("envelope_log").mode("append").save(log)
    done = run_bounded(spark, lambda: env.decode_envelopes(spark.readStream.format("envelope_log").load(log)))
    delete(spark, log)
    return spark.read.parquet(done.path).select(
        F.col("messageId").alias("message_id"), "session_id", "decode_ok",
        F.get_json_object("payload", "$.sender").alias("sender"), F.get_json_object("payload", "$.content").alias("content"))


@query
def s3_queue_log_sink(spark, d):
    """Replies published to a log, carried to a second log by a stream, and read from there."""
    queue_log.register(spark)
    first, second = shared_folder(spark, "queue"), shared_folder(spark, "queue")
    encoded = env.encode_replies(replies.fold_replies(fx.agent_events(fx.view(spark, d, "agent_rows"))))
    queue_log.log_rows(encoded, F.col("invocation_id")).write.format("envelope_log").mode("append").save(first)
    run_available(spark.readStream.format("envelope_log").load(first), second, shared_folder(spark, "stream"), fmt="envelope_log")
    decoded = env.decode_envelopes(spark.read.format("envelope_log").load(second))
    return decoded.select(F.col("messageId").cast("long").alias("invocation_id"), "session_id", "decode_ok",
                          F.get_json_object("payload", "$.sender").alias("sender"), F.get_json_object("payload", "$.content").alias("content"))


@query
def t1_envelope_stream(spark, d):
    own = stream_session(spark)

    def build(arrivals, events, more):
        queued = fx.arrival_envelopes(arrivals).withColumn("publish_failed", F.col("message_id") % 10 == 0)
        return messages.envelope_outcomes(queued, events, delay=DELAY, **more)

    done = _presence_run(own, d, build, messages.outcome_sink)
    out = spark.read.schema("message_id bigint, session_id string, channel string, value string, reason string, "
                            "delivery_attempt bigint, batch bigint, outcome string").parquet(_whole(done))
    return out.select("message_id", "session_id", "channel", "outcome", "reason", "delivery_attempt",
                      F.get_json_object("value", "$.data.content").alias("content"))


@query
def t2_presence_stream(spark, d):
    own = stream_session(spark)
    done = _presence_run(own, d, lambda arrivals, events, more: presence.presence_stream(
        arrivals.withColumnRenamed("content", "payload"), events, delay=DELAY, **more))
    return spark.read.parquet(_whole(done)).select(
        "message_id", "session_id", from_epoch_us(F.col("us")).alias("ts"), F.col("payload").alias("content"), "online")


@query
def t3_sliding_presence_stream(spark, d):
    own = stream_session(spark)

    def build(read, side):
        rows = _of(read, "posts").filter("session_id IS NOT NULL").select("session_id", "ts")
        return presence.presence_sliding(rows.unionByName(side), delay=DELAY)

    done = run_replayed(own, _posts(own, d), build, {"session_id": F.lit(""), "ts": flush_ts()})
    # Micro-seconds do not depend on the time zone of the reading session.
    return spark.read.parquet(_whole(done)).select(
        "session_id", from_epoch_us(F.unix_micros("start_ts")).alias("start_ts"),
        from_epoch_us(F.unix_micros("end_ts")).alias("end_ts"), "n_messages")


@query
def t4_redelivery_stream(spark, d):
    own = stream_session(spark)
    attempts = fx.view(own, d, "attempts")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    keys = [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), cents]
    tie = F.concat(*[F.lpad(k.cast("string"), 20, "0") for k in keys])
    rows = attempts.select("message_id", F.col("ts").cast("timestamp").alias("ts"), tie.alias("tie"), "ok")

    # What is open at the end of the table is pending; nothing is given up, and no settled message forgotten, before.
    span, buckets = _span(rows), _buckets(rows)

    def build(read, side):
        return redelivery.redelivery_stream(read(), retention_s=span, pending_after_s=span, delay=DELAY, side=side, buckets=buckets)

    done = run_replayed(own, rows, build, redelivery.redelivery_flush(flush_ts()))
    return spark.read.parquet(_whole(done)).drop("at_us")


@query
def t4_held_redelivery_stream(spark, d):
    """The delay policy at work: attempts of a message come within seconds of each other and are held."""
    own = stream_session(spark)
    bursts = fx.view(own, d, "bursts")
    tie = F.concat(*[F.lpad(F.col(c).cast("string"), 20, "0") for c in ("l_linenumber", "l_partkey", "l_suppkey", "cents")])
    rows = bursts.select("message_id", F.timestamp_seconds("at_s").alias("ts"), tie.alias("tie"), "ok")
    buckets = _buckets(rows)

    def build(read, side):
        return redelivery.redelivery_stream(read(), hold=True, pending_after_s=PENDING_AFTER_S, delay=DELAY, side=side, buckets=buckets)

    done = run_replayed(own, rows, build, redelivery.redelivery_flush(flush_ts()))
    at = F.call_function("div", F.col("at_us"), F.lit(1_000_000).cast("bigint"))
    return spark.read.parquet(_whole(done)).select(
        "message_id", "n_used", "outcome", at.alias("at_s"), (at + F.col("next_delay_s").cast("bigint")).alias("next_at_s"))


@query
def t5_guard_stream(spark, d):
    own = stream_session(spark)

    def build():
        guarded = messages.guard_stream(fx.view(own, d, "messages", fx.stream), "text", rails.default_rails())
        return guarded.select("msg_id", "is_blocked", "reason", "final_text")

    return spark.read.parquet(run_bounded(own, build).path)


@query
def t6_reply_fold_stream(spark, d):
    own = stream_session(spark)
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("invocation_id") * 60 + F.col("seq"))
    rows = fx.agent_events(fx.view(own, d, "agent_rows")).withColumn("ts", ts)
    flush = {"session_id": F.lit(""), "invocation_id": F.lit(-1).cast("bigint"), "seq": F.lit(0).cast("bigint"),
             "is_final": F.lit(False), "has_content": F.lit(False), "ts": flush_ts()}
    done = run_replayed(own, rows, lambda read, side: messages.fold_stream(read().unionByName(side, allowMissingColumns=True), delay=DELAY), flush)
    return messages.replies_of_pieces(spark.read.parquet(_whole(done)).filter("invocation_id <> -1"))
