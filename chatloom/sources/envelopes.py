"""Push envelopes: decode, encode, and the outcome of each envelope."""

from pyspark.sql import functions as F

from chatloom.functions.frames import channel_name, frame_value, valid_json
from chatloom.operators.delivery import MAX_ATTEMPTS
from chatloom.operators.replies import SENDER
from chatloom.schemas import ENVELOPE

OUTCOMES = ("delivered", "retry", "dead_letter")


def read_envelopes(spark, path, streaming=False, fmt="json"):
    """Push envelopes with their fixed schema, flattened."""
    reader = spark.readStream if streaming else spark.read
    return flatten_envelopes(reader.schema(ENVELOPE).format(fmt).load(path))


def flatten_envelopes(envelopes):
    """The message fields of nested envelopes as columns; missing attributes are empty."""
    return envelopes.select(
        "message.data", "message.messageId", "message.publishTime",
        F.coalesce("message.attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
        "subscription")


def payload_text(data):
    """UTF-8 text of lenient base64, or NULL.

    Characters outside the alphabet are dropped first. What is left must be whole
    groups of four with padding only at the end.
    """
    clean = F.regexp_replace(data, r"[^A-Za-z0-9+/=]", "")
    raw = F.when(F.length(clean) % 4 == 0, F.try_to_binary(clean, F.lit("base64")))
    return F.try_validate_utf8(raw.cast("string"))


def decode_envelopes(df):
    """Add ``payload`` (JSON text), ``session_id`` and ``decode_ok``.

    A payload that is not base64, not UTF-8 or not JSON is NULL with ``decode_ok`` false.
    """
    text = payload_text(F.col("data"))
    return (df.withColumn("payload", text)
            .withColumn("payload", F.when(valid_json(F.col("payload")), F.col("payload")))
            .withColumns({"session_id": F.try_element_at(F.col("attributes"), F.lit("session_id")),
                          "decode_ok": F.col("payload").isNotNull()}))


def encode_replies(df):
    """Add ``data`` (base64 of the reply JSON) and ``attributes`` to (session_id, content) rows."""
    body = F.to_json(F.struct(F.lit(SENDER).alias("sender"), F.col("content").alias("content")),
                     {"ignoreNullFields": "false"})
    # Spark breaks base64 into lines; the queue format has none.
    data = F.regexp_replace(F.base64(F.encode(body, "utf-8")), r"[\r\n]", "")
    attributes = F.create_map(F.lit("session_id"), F.col("session_id"))
    return df.withColumns({"data": data, "attributes": attributes})


def queue_rows(df):
    """Encoded replies in the shape of a Kafka sink: (key, value, headers).

    There is no key: replies are published without an ordering guarantee.
    """
    headers = F.transform(F.map_entries("attributes"), lambda e: F.struct(
        e["key"].alias("key"), F.encode(e["value"], "utf-8").alias("value")))
    return df.select(F.lit(None).cast("binary").alias("key"), F.unbase64("data").alias("value"), headers.alias("headers"))


def channel_frames(df):
    """Add ``channel`` and ``value`` to rows of (session_id, payload)."""
    return df.withColumns({"channel": channel_name(F.col("session_id")),
                           "value": frame_value(F.col("session_id"), F.col("payload"))})


def with_outcome(df, max_attempts=MAX_ATTEMPTS):
    """Add ``reason`` and ``outcome`` to rows of (decode_ok, online).

    Optional columns: ``publish_failed`` and ``delivery_attempt`` (1 for the first).
    An offline client is a failure like any other: the queue tries again until the
    attempts are used up.
    """
    failed = F.coalesce("publish_failed", F.lit(False)) if "publish_failed" in df.columns else F.lit(False)
    attempt = F.coalesce("delivery_attempt", F.lit(1)) if "delivery_attempt" in df.columns else F.lit(1)
    reason = (F.when(~F.col("decode_ok"), "decode_error")
              .when(~F.coalesce("online", F.lit(False)), "offline")
              .when(failed, "publish_error"))
    outcome = (F.when(reason.isNull(), "delivered")
               .when(attempt >= max_attempts, "dead_letter").otherwise("retry"))
    return df.withColumns({"reason": reason, "outcome": outcome})


def split_outcomes(df, max_attempts=MAX_ATTEMPTS):
    """(delivered, retry, dead_letter); together they are the input."""
    judged = with_outcome(df, max_attempts)
    return tuple(judged.filter(F.col("outcome") == o) for o in OUTCOMES)


def write_outcomes(df, path, max_attempts=MAX_ATTEMPTS, mode="append"):
    """Write all rows once, in one folder per outcome."""
    with_outcome(df, max_attempts).write.mode(mode).partitionBy("outcome").parquet(path)
