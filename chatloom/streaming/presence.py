"""Presence of sessions on a stream: state and timers of buckets of sessions."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from chatloom.operators.presence import SLIDING_TTL_S, TTL_S
from chatloom.streaming.packed import packed, unpacked

DISCONNECT, CONNECT, ARRIVAL = 0, 1, 2
BUSY_ROWS = 200_000  # arrivals of a session that one state holds; a busier session gets several
BUCKETS = 8192  # of a stream whose number of arrivals is not known
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 64  # arrivals of a bucket, where their number is known; buckets for the tasks

_OUT_SCHEMA = "session_id string, message_id long, us long, payload string, online boolean"
_STANDING = pa.schema([("session", pa.string()), ("part", pa.int64()), ("us", pa.int64())])
_WAITING = pa.schema([*_STANDING, ("id", pa.int64()), ("nameless", pa.bool_()), ("kind", pa.int64()), ("payload", pa.string())])


def gates(rows, standing, ttl_us):
    """The arrivals among ``rows`` of many sessions with ``online``, and the connects that still stand.

    An arrival is online when the last event of its session and part before it is a connect within its lifetime.
    At the same time, connects and disconnects in id order come before arrivals. ``standing``
    (session, part, us) are the connects from before.
    """
    before = standing.assign(id=np.iinfo(np.int64).min, nameless=False, kind=CONNECT, payload=None)
    rows = pd.concat([before, rows], ignore_index=True) if len(before) else rows
    session, part = pd.factorize(rows["session"])[0], rows["part"].to_numpy()
    us, key, arrives = rows["us"].to_numpy(), rows["id"].to_numpy(), rows["kind"].to_numpy() == ARRIVAL
    order = np.lexsort((key, arrives, us, part, session))
    session, part, us, arrives = session[order], part[order], us[order], arrives[order]
    connects = rows["kind"].to_numpy()[order] == CONNECT
    at = np.arange(len(order))
    first = np.ones(len(order), bool)
    first[1:] = (session[1:] != session[:-1]) | (part[1:] != part[:-1])
    start = np.maximum.accumulate(np.where(first, at, 0))
    event = np.maximum.accumulate(np.where(arrives, -1, at))
    stands = (event >= start) & connects[event]
    online = stands & (us < us[event] + ttl_us)
    flagged = rows.iloc[order[arrives]].assign(online=online[arrives])
    last = np.append(first[1:], True)[:len(order)] & stands
    return flagged, rows.iloc[order[event[last]]][_STANDING.names]


def gate(rows, connected_us, ttl_us):
    """Online flags of (us, id, kind, payload) rows of one session, and the time of the connect that still stands."""
    one = pd.DataFrame(rows, columns=["us", "id", "kind", "payload"], dtype=object).astype({"us": int, "id": int, "kind": int})
    before = pd.DataFrame([] if connected_us is None else [("", 0, connected_us)], columns=_STANDING.names)
    flagged, standing = gates(one.assign(session="", part=0, nameless=False), before, ttl_us)
    flags = list(zip(*(flagged[c].tolist() for c in ("id", "us", "payload", "online"))))
    return flags, int(standing["us"].iloc[0]) if len(standing) else None


class PresenceGate(StatefulProcessor):
    """The state of one bucket of sessions, or of parts of busy ones.

    Rows wait until the watermark has passed them, because a micro-batch may bring
    them in any order; of the past only the connects that stand are kept. One timer wakes the
    bucket for its first waiting row, or to forget a connect whose lifetime is over.
    """

    def __init__(self, ttl_us):
        self.ttl_us = ttl_us

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("sessions", "wake_ms bigint, standing binary, waiting binary")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([r[_WAITING.names] for r in rows])
        wake_ms, standing, waiting = self.state.get() or (None, None, None)
        first_ms = int(new["us"].min()) // 1000 + 1
        if wake_ms is None or first_ms < wake_ms:
            if wake_ms is not None:
                self.handle.deleteTimer(wake_ms)
            wake_ms = first_ms
            self.handle.registerTimer(wake_ms)
        held = new if waiting is None else pd.concat([unpacked(waiting, _WAITING), new])
        self.state.update((wake_ms, standing, packed(held, _WAITING)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        wake_ms, standing, waiting = self.state.get() or (None, None, None)
        if wake_ms is None or wake_ms > watermark_ms:
            return
        passed_us = watermark_ms * 1000
        rows = unpacked(waiting, _WAITING)
        ready = rows["us"] <= passed_us
        later = rows[~ready]
        flagged, standing = gates(rows[ready], unpacked(standing, _STANDING), self.ttl_us)
        standing = standing[standing["us"] + self.ttl_us > passed_us]
        due_us = min([int(t) for t in (later["us"].min(), standing["us"].min() + self.ttl_us) if t == t], default=None)
        if due_us is None:
            self.state.clear()
        else:
            wake_ms = max(due_us, passed_us) // 1000 + 1
            self.handle.registerTimer(wake_ms)
            self.state.update((wake_ms, packed(standing, _STANDING), packed(later, _WAITING)))
        if len(flagged):
            named = flagged["id"].astype("Int64").mask(flagged["nameless"])
            yield pd.DataFrame({"session_id": flagged["session"], "message_id": named, "us": flagged["us"],
                                "payload": flagged["payload"], "online": flagged["online"]})

    def close(self):
        pass


def buckets_for(arrivals):
    """How many buckets a stream of about so many arrivals needs."""
    return max(LEAST_BUCKETS, -(-arrivals // BUCKET_ROWS))


def busy_sessions(arrivals, most=BUSY_ROWS):
    """(session, parts) of sessions with more than ``most`` arrivals in a table like the one to come."""
    counts = arrivals.filter("session_id IS NOT NULL").groupBy(F.col("session_id").alias("session")).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > most).select("session", F.ceil(F.col("n") / most).cast("int").alias("parts"))


def presence_rows(arrivals, events, busy=None):
    """Arrivals and presence events as one stream of rows by session and part."""
    us = F.unix_micros("ts")
    left = arrivals.select(
        F.col("session_id").alias("session"), "ts", us.alias("us"), F.col("message_id").alias("id"), F.lit(ARRIVAL).alias("kind"), "payload")
    right = events.select(
        F.col("session_id").alias("session"), "ts", us.alias("us"), F.col("event_id").alias("id"),
        F.when(F.col("kind") == "connect", CONNECT).otherwise(DISCONNECT).alias("kind"), F.lit(None).cast("string").alias("payload"))
    if busy is None:
        return left.withColumn("part", F.lit(0)).unionByName(right.withColumn("part", F.lit(0)))
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(busy, "session", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    right = right.join(busy, "session", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.drop("parts").unionByName(right.drop("parts"))


def presence_stream(arrivals, events, ttl_s=TTL_S, delay="1 hour", busy=None, side=None, buckets=BUCKETS):
    """Streaming gate: each arrival of (message_id, session_id, ts, payload) with ``online``.

    ``ts`` is a timestamp with time zone. Rows more than ``delay`` behind are dropped
    and counted by the query's progress. Arrivals without a session are offline and
    need no state. Sessions share state and timer by ``buckets``, a number that is fixed for the life of
    a checkpoint; ``busy`` names sessions whose arrivals are spread over several buckets (``busy_sessions``), to
    each of which their connects and disconnects go, few next to their arrivals. ``side`` is an
    optional stream of further rows.
    """
    rows = presence_rows(arrivals.filter("session_id IS NOT NULL"), events, busy)
    if side is not None:
        rows = rows.unionByName(side)
    rows = rows.withColumns({
        "bucket": F.pmod(F.xxhash64("session", "part"), F.lit(buckets)).cast("int"), "part": F.coalesce("part", F.lit(0)),
        "nameless": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0)).cast("long")})
    gated = (rows.withWatermark("ts", delay).groupBy("bucket")
             .transformWithStateInPandas(PresenceGate(ttl_s * 1_000_000), _OUT_SCHEMA, "append", "EventTime"))
    stateless = arrivals.filter("session_id IS NULL").select(
        "session_id", "message_id", F.unix_micros("ts").alias("us"), "payload", F.lit(False).alias("online"))
    return gated.unionByName(stateless)


def presence_flush(ts):
    """A row that moves the watermark and decides nothing."""
    return {"session": F.lit(""), "part": F.lit(0), "ts": ts, "us": F.unix_micros(ts), "id": F.lit(-1).cast("bigint"),
            "kind": F.lit(DISCONNECT), "payload": F.lit(None).cast("string")}


def presence_sliding(stream, gap_s=SLIDING_TTL_S, delay="1 hour"):
    """Online spans (session_id, start_ts, end_ts, n_messages) when each message extends presence.

    Session windows do not report the late rows they drop; their number is that of
    the input rows less the sum of ``n_messages``.
    """
    # Session windows also merge when they just touch, but presence has ended by then:
    # the window is one microsecond shorter.
    gap = f"{gap_s * 1_000_000 - 1} microseconds"
    spans = (stream.withWatermark("ts", delay)
             .groupBy("session_id", F.session_window("ts", gap).alias("span"))
             .agg(F.count(F.lit(1)).alias("n_messages")))
    end = F.timestamp_add("MICROSECOND", F.lit(1), F.col("span.end"))
    return spans.select("session_id", F.col("span.start").alias("start_ts"), end.alias("end_ts"), "n_messages")
