"""Delivery attempts on a stream: state and timers of buckets of messages."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from chatloom.operators.delivery import MAX_ATTEMPTS, PUSH_RETRY, outcome_columns
from chatloom.streaming.packed import packed, unpacked

RETENTION_S = 7 * 86400  # how long a settled message is remembered; far beyond the longest delay of a policy
BUCKETS = 8192  # of a stream whose number of messages is not known
BUCKET_MESSAGES, LEAST_BUCKETS = 8192, 64  # that one bucket remembers, where the number is known; buckets for the tasks
NO_ID = -1  # the bucket of messages without an id

_OUT_SCHEMA = "message_id long, n_seen long, ok boolean, at_us long"
_SEEN = pa.schema([("message_id", pa.int64()), ("n", pa.int64()), ("settled", pa.bool_()), ("at_us", pa.int64())])
_WAITING = pa.schema([("message_id", pa.int64()), ("us", pa.int64()), ("tie", pa.string()), ("ok", pa.bool_())])
_ORDER = ["message_id", "us", "tie", "ok"]


def first_attempts(max_attempts):
    """Keep the first attempts of each message within a batch; later ones cannot matter."""
    def combine(batches):
        for batch in batches:
            yield batch.sort_values(["us", "tie", "ok"]).groupby(["bucket", "message_id"], sort=False).head(max_attempts)
    return combine


def settle(seen, waiting, passed_us, max_attempts, delays_us, retention_us, pending_us):
    """Let the attempts that the watermark has passed take place, for many messages at once.

    ``seen`` (message_id, n, settled, at_us) are messages with attempts so far, ``waiting`` their attempts to
    come in the order of ``_ORDER``. With ``delays_us`` (the pause after each failure) an attempt that comes before the
    pause is over takes place when it is. Gives both tables as they are from now on, the messages to report,
    and the time at which something is due next, or None.
    """
    ids = np.union1d(seen["message_id"], waiting["message_id"])
    n, at, settled, good = (np.zeros(len(ids), t) for t in (np.int64, np.int64, bool, bool))
    place = np.searchsorted(ids, seen["message_id"])
    n[place], at[place], settled[place] = seen["n"], seen["at_us"], seen["settled"]
    was_settled = settled.copy()
    key, us, ok = (waiting[c].to_numpy() for c in ("message_id", "us", "ok"))
    pos, end = np.searchsorted(key, ids, "left"), np.searchsorted(key, ids, "right")
    pauses = None if delays_us is None else np.array(delays_us, np.int64)

    def next_us(which):
        at_least = us[pos[which]]
        if pauses is None:
            return at_least
        last = np.maximum(n[which], 1) - 1
        return np.where(n[which] > 0, np.maximum(at_least, at[which] + pauses[last]), at_least)

    for _ in range(max_attempts):
        open_now = np.flatnonzero(~settled & (pos < end))
        takes_place = next_us(open_now)
        due = takes_place <= passed_us
        now = open_now[due]
        if not len(now):
            break
        good[now] = ok[pos[now]]
        n[now] += 1
        at[now] = takes_place[due]
        pos[now] += 1
        settled[now] = good[now] | (n[now] >= max_attempts)

    later = ~settled & (pos < end)
    wake = np.full(len(ids), np.iinfo(np.int64).max)
    wake[settled] = at[settled] + retention_us
    wake[later] = next_us(np.flatnonzero(later))
    if pending_us is not None:
        wake[~settled & ~later] = at[~settled & ~later] + pending_us
    given_up = ~later & (wake <= passed_us)
    news = (settled & ~was_settled) | (given_up & ~settled)
    told = pd.DataFrame({"message_id": ids[news], "n_seen": n[news], "ok": settled[news] & good[news], "at_us": at[news]})

    kept = (n > 0) & ~given_up
    seen = pd.DataFrame({"message_id": ids[kept], "n": n[kept], "settled": settled[kept], "at_us": at[kept]})
    # Of what waits, only attempts that can still count are kept.
    owner, row = np.searchsorted(ids, key), np.arange(len(key))
    waiting = waiting[later[owner] & (row >= pos[owner]) & (row < pos[owner] + max_attempts - n[owner])]
    due_us = wake[kept | later].min(initial=np.iinfo(np.int64).max)
    return seen, waiting, told, None if due_us == np.iinfo(np.int64).max else int(due_us)


class Redelivery(StatefulProcessor):
    """The state of one bucket of messages: attempts so far, whether each is settled, and attempts that wait.

    An attempt waits until the watermark has passed it and, with ``delays_us``, until the pause
    after the failure before it is over. One timer wakes the bucket for whatever is due first: a waiting
    attempt, a settled message to forget, or one to give up as pending.
    """

    def __init__(self, max_attempts, delays_us, retention_us, pending_us):
        self.max_attempts, self.delays_us, self.retention_us, self.pending_us = max_attempts, delays_us, retention_us, pending_us

    def init(self, handle):
        self.handle = handle
        self.state = handle.getValueState("messages", "wake_ms bigint, seen binary, waiting binary")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([r[_ORDER] for r in rows])
        wake_ms, seen, waiting = self.state.get() or (None, None, None)
        known = unpacked(seen, _SEEN)
        new = new[~new["message_id"].isin(known["message_id"][known["settled"]])]  # no repeats of settled messages
        if len(new):
            first_ms = int(new["us"].min()) // 1000 + 1
            if wake_ms is None or first_ms < wake_ms:
                if wake_ms is not None:
                    self.handle.deleteTimer(wake_ms)
                wake_ms = first_ms
                self.handle.registerTimer(wake_ms)
            held = pd.concat([unpacked(waiting, _WAITING), new]) if waiting is not None else new
            held = held.sort_values(_ORDER).groupby("message_id", sort=False).head(self.max_attempts)
            self.state.update((wake_ms, seen, packed(held, _WAITING)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        wake_ms, seen, waiting = self.state.get() or (None, None, None)
        if wake_ms is None or wake_ms > watermark_ms:
            return
        passed_us = watermark_ms * 1000
        seen, waiting, told, due_us = settle(unpacked(seen, _SEEN), unpacked(waiting, _WAITING), passed_us,
                                             self.max_attempts, self.delays_us, self.retention_us, self.pending_us)
        if len(seen) or len(waiting):
            wake_ms = None if due_us is None else max(due_us, passed_us) // 1000 + 1
            if wake_ms is not None:
                self.handle.registerTimer(wake_ms)
            self.state.update((wake_ms, packed(seen, _SEEN) if len(seen) else None, packed(waiting, _WAITING) if len(waiting) else None))
        else:
            self.state.clear()
        if len(told):
            yield told if key[0] != NO_ID else told.assign(message_id=pd.array([None] * len(told), "Int64"))

    def close(self):
        pass


def buckets_for(messages):
    """How many buckets a stream needs that remembers about so many messages at a time."""
    return max(LEAST_BUCKETS, -(-messages // BUCKET_MESSAGES))


def redelivery_stream(attempts, max_attempts=MAX_ATTEMPTS, policy=PUSH_RETRY, hold=False, retention_s=RETENTION_S, pending_after_s=None,
                      delay="1 hour", side=None, buckets=BUCKETS):
    """Outcome of each message of a stream of attempts (message_id, ts, tie, ok), with its time ``at_us``.

    Attempts are taken in order of (``ts``, ``tie``) once the watermark has passed
    them; with ``hold`` the policy acts, and one that comes before the pause after a failure is
    over takes place when it is. A message is reported once, when it is delivered or has failed for good,
    however far apart its attempts are; for ``retention_s`` seconds after its last attempt
    a repeat of it is ignored. With ``pending_after_s`` a message without an attempt for
    so long is reported as pending and its count given up. Before the shuffle each task
    keeps only the first attempts of a message, so one with very many stays small.

    Messages share state and timer by ``buckets``, a number that is fixed for the life of a checkpoint: a bucket
    is read and written once per micro-batch that has something for it, about 25 bytes for each message it
    remembers. Messages without an id count as one message, in a bucket of its own.
    """
    rows = attempts.select("message_id", "ts", F.unix_micros("ts").alias("us"), "tie", F.coalesce("ok", F.lit(False)).alias("ok"))
    if side is not None:
        rows = rows.unionByName(side)
    own = F.pmod(F.xxhash64("message_id"), F.lit(buckets)).cast("int")
    rows = rows.select(F.when(F.col("message_id").isNull(), NO_ID).otherwise(own).alias("bucket"),
                       F.coalesce("message_id", F.lit(0)).cast("long").alias("message_id"), "ts", "us", "tie", "ok")
    combined = rows.mapInPandas(first_attempts(max_attempts), rows.schema)
    pauses = [int(s * 1_000_000) for s in policy.seconds(max_attempts)] if hold else None
    pending_us = None if pending_after_s is None else int(pending_after_s * 1_000_000)
    processor = Redelivery(max_attempts, pauses, int(retention_s * 1_000_000), pending_us)
    told = (combined.withWatermark("ts", delay).groupBy("bucket")
            .transformWithStateInPandas(processor, _OUT_SCHEMA, "append", "EventTime"))
    n_used, outcome, delay_s = outcome_columns(F.col("n_seen"), F.when(F.col("ok"), F.col("n_seen")), max_attempts, policy)
    return told.select("message_id", n_used.alias("n_used"), outcome.alias("outcome"), delay_s.alias("next_delay_s"), "at_us")


def redelivery_flush(ts):
    """A row that moves the watermark; its message stays open and is never reported."""
    return {"message_id": F.lit(-1).cast("bigint"), "ts": ts, "us": F.unix_micros(ts), "tie": F.lit(""), "ok": F.lit(False)}
