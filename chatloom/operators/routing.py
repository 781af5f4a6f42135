"""Which subscriber or connection gets a message."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatloom.functions.globs import fixed_length, glob_regex, is_glob, literal_prefix
from chatloom.operators.presence import epoch_us


SALTS = 16  # parts of the channels that share a prefix


def _channel_matches(channels, subscriptions):
    """(channel, subscriber_id) for distinct channels.

    Patterns are matched once each, whoever subscribes to them. Plain patterns are an
    equi-join on the channel. A glob is looked up by what all its matches share, its
    literal prefix and (without ``*``) its length, and then checked with a regular
    expression, so no pair outside these is ever looked at. Channels are cut only at
    prefix lengths that patterns have, and dealt over salts, for many may share a prefix.
    """
    patterns = subscriptions.select("pattern").where("pattern is not null").distinct()
    plain = patterns.filter(~is_glob(F.col("pattern")))
    direct = channels.join(plain.select("pattern", F.col("pattern").alias("channel")), "channel")

    pattern = F.col("pattern")
    globs = patterns.filter(is_glob(pattern)).select(
        pattern, literal_prefix(pattern).alias("__prefix"), fixed_length(pattern).alias("__len"), glob_regex(pattern).alias("__regex"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    # At most one number for each length that a literal prefix can have.
    cuts = globs.agg(F.collect_set(F.length("__prefix"))).scalar()
    n = F.length("channel")
    looked_up = (channels
                 .withColumn("__cuts", cuts)
                 .withColumn("__cut", F.explode(F.filter("__cuts", lambda c: c <= n)))
                 .withColumn("__len", F.explode(F.array(F.lit(-1), n)))
                 .withColumn("__prefix", F.col("channel").substr(F.lit(1), F.col("__cut")))
                 .withColumn("__salt", F.pmod(F.hash("channel"), F.lit(SALTS))))
    matched = (looked_up.join(globs, ["__prefix", "__len", "__salt"])
               .filter(F.expr("channel rlike __regex")))
    found = direct.select("channel", "pattern").unionByName(matched.select("channel", "pattern"))
    return found.join(subscriptions.select("pattern", "subscriber_id"), "pattern").select("channel", "subscriber_id")


def match_subscriptions(frames, subscriptions):
    """Frames times the subscribers whose pattern fits their channel.

    Patterns are matched against the distinct channels, not against every frame. A
    subscriber with several fitting patterns gets the frame once per pattern.
    """
    matches = _channel_matches(frames.select("channel").distinct(), subscriptions)
    return frames.join(matches, "channel")


def receiver_counts(frames, subscriptions):
    """Frames with the number of receivers; 0 is a valid count."""
    matches = _channel_matches(frames.select("channel").distinct(), subscriptions)
    counts = matches.groupBy("channel").agg(F.count(F.lit(1)).alias("n_receivers"))
    return (frames.join(counts, "channel", "left")
            .withColumn("n_receivers", F.coalesce("n_receivers", F.lit(0).cast("bigint"))))


SLOT_S = 3600  # messages and events of a session are ordered within slots of this many seconds


def _last_event(messages, events, slot_s):
    """Add ``__last``, the last event of the session at or before the time of each message.

    Within a slot messages and events are ordered together; what holds at the start of a
    slot is carried over from one row per slot and session.
    """
    def slot(ts):
        return F.floor(epoch_us(F.col(ts)) / (slot_s * 1_000_000))

    event = F.struct("ts", "event_id", "kind")
    happened = events.filter("session_id IS NOT NULL").select(
        "session_id", slot("ts").alias("__slot"), "ts", F.lit(0).alias("__side"), event.alias("__event"))
    sent = messages.select(
        "session_id", slot("ts").alias("__slot"), "ts", F.lit(1).alias("__side"),
        F.lit(None).cast(happened.schema["__event"].dataType).alias("__event"), F.struct(*messages.columns).alias("__message"))
    both = happened.unionByName(sent, allowMissingColumns=True)
    within = Window.partitionBy("session_id", "__slot").orderBy("ts", "__side", "__event.event_id")
    inside = both.withColumn("__last", F.last("__event", ignorenulls=True).over(within)).filter("__side = 1")

    slots = both.groupBy("session_id", "__slot").agg(F.max("__event").alias("__event"))
    earlier = Window.partitionBy("session_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("__carried", F.last("__event", ignorenulls=True).over(earlier)).filter("__carried is not null")
    known = inside.join(carried.select("session_id", "__slot", "__carried"), ["session_id", "__slot"], "left")
    return known.select("__message.*", F.coalesce("__last", "__carried").alias("__last"))


def direct_delivery(messages, events, slot_s=SLOT_S):
    """Send each message to the connection its session has at that time.

    ``events`` are the connects and disconnects of sessions (session_id, ts, event_id,
    kind); those at the time of a message come before it. ``messages`` (message_id,
    session_id, ts) may carry a boolean ``send_failed``: the first failed send of a
    connection closes it, and messages find none until the session connects again. Adds
    ``status`` (``delivered``, ``send_failed`` or ``no_connection``) and
    ``connection_id``. A missing session has no connection.
    """
    failed = F.coalesce(F.col("send_failed"), F.lit(False)) if "send_failed" in messages.columns else F.lit(False)
    placed = _last_event(messages.filter("session_id IS NOT NULL"), events, slot_s)
    tried = placed.withColumn("__conn", F.when(F.col("__last.kind") == "connect", F.col("__last.event_id"))).drop("__last")
    order = F.struct("ts", "message_id")
    # The first failure of a connection is one small row, combined before the shuffle.
    closed = tried.filter(failed & F.col("__conn").isNotNull()).groupBy(F.col("__conn").alias("__of")).agg(F.min(order).alias("__fail"))
    joined = tried.join(closed, F.col("__conn") == F.col("__of"), "left")
    status = (F.when(F.col("__conn").isNull() | F.coalesce(order > F.col("__fail"), F.lit(False)), "no_connection")
              .when(failed, "send_failed").otherwise("delivered"))
    sent = joined.withColumn("status", status).select(
        *messages.columns, "status", F.when(F.col("status") != "no_connection", F.col("__conn")).alias("connection_id"))
    nowhere = messages.filter("session_id IS NULL").select(
        *messages.columns, F.lit("no_connection").alias("status"), F.lit(None).cast(sent.schema["connection_id"].dataType).alias("connection_id"))
    return sent.unionByName(nowhere)
