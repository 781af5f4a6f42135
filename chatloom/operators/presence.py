"""Presence of sessions: intervals, the online gate and sliding sessions.

Work is keyed by session and time slot, so that one busy session is spread over
many tasks. A connection lives at most ``ttl_s`` seconds, so a row needs to see at
most one slot further when a slot is as long as the lifetime.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatloom.operators.chunks import with_running_max, with_running_total

TTL_S = 6000          # fixed value: lifetime of a connection in seconds
SLIDING_TTL_S = 60    # fixed value: lifetime that each message refreshes
SLOTS_PER_WINDOW = 4  # lifetimes per slot of the interval job: 1.25 copies of each event

def _epoch():
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")


def epoch_us(ts):
    """Microseconds since 1970 of a timestamp without time zone, whatever the session zone."""
    seconds = (ts - _epoch()).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("bigint")


def from_epoch_us(us):
    return _epoch() + F.make_dt_interval(secs=us.cast("decimal(18,0)") / F.lit(1_000_000))


def plus_seconds(ts, seconds):
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def _slot(ts, seconds):
    return _floor_div(epoch_us(ts), seconds * 1_000_000)


def _floor_div(value, by):
    by = F.lit(by).cast("bigint")
    return F.call_function("div", value - F.pmod(value, by), by)


def presence_intervals(events, ttl_s=TTL_S, slots=SLOTS_PER_WINDOW):
    """Online intervals ``[start_ts, end_ts)`` per session.

    A connect opens ``ttl_s`` seconds; the next event of the session ends them early
    (a connect starts new ones, a disconnect none). Events with the same time are
    ordered by ``event_id``.
    """
    width = ttl_s * slots
    home = _slot(F.col("ts"), width)
    # An event also shows up in the slot before when it can cut an interval of that slot.
    reaches_back = _slot(plus_seconds(F.col("ts"), -ttl_s), width)
    spread = events.select(
        "session_id", "ts", "event_id", "kind", home.alias("__home"),
        F.explode(F.sequence(reaches_back, home)).alias("__slot"))
    w = Window.partitionBy("session_id", "__slot").orderBy("ts", "event_id")
    following = spread.withColumn("__next", F.lead("ts").over(w))
    own = following.filter((F.col("__slot") == F.col("__home")) & (F.col("kind") == "connect"))
    end = F.least(F.col("__next"), plus_seconds(F.col("ts"), ttl_s))
    return (own.select("session_id", F.col("event_id").alias("connection_id"),
                       F.col("ts").alias("start_ts"), end.alias("end_ts"))
            .filter("start_ts < end_ts"))


def online_spans(intervals, slot_s=TTL_S * SLOTS_PER_WINDOW):
    """Intervals of a session that meet or overlap as one: ``session_id``, ``start_ts``, ``end_ts``, ``n_intervals``.

    A session is cut into slots of time; only one row per slot takes part in the windows
    over the whole session. Intervals without a border or with nothing in them are left out;
    those without a session count as one session.
    """
    slot = slot_s * 1_000_000
    starts = (intervals.filter("start_ts < end_ts").groupBy("session_id", "start_ts")
              .agg(F.max("end_ts").alias("end_ts"), F.count("*").alias("n")).withColumn("__at", epoch_us(F.col("start_ts"))))
    reached = with_running_max(starts, "session_id", "__at", {"__reach": F.col("end_ts")}, slot)
    opens = reached.withColumn("__opens", F.when(F.col("__reach") >= F.col("start_ts"), 0).otherwise(1))
    numbered = with_running_total(opens, "session_id", "__at", {"__before": F.col("__opens")}, slot)
    return (numbered.groupBy("session_id", (F.col("__before") + F.col("__opens")).alias("__span"))
            .agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.sum("n").alias("n_intervals")).drop("__span"))


def online_over_time(spans, slot_s=3600):
    """How many sessions are online from each change on: ``ts``, ``came``, ``left``, ``online``.

    Spans of one session must not meet or overlap, as ``online_spans`` gives them. Time is cut into slots;
    a slot begins with the spans that reach over its begin, which are counted by themselves,
    so no window runs over all times. Shorter slots spread busy times and repeat long spans more often.
    """
    borders = spans.select("session_id", F.explode(F.array(
        F.struct(F.col("start_ts").alias("ts"), F.lit(1).alias("step")), F.struct(F.col("end_ts").alias("ts"), F.lit(-1).alias("step")))).alias("b"))
    changes = (borders.groupBy("b.ts").agg(F.count_if(F.col("b.step") > 0).alias("came"), F.count_if(F.col("b.step") < 0).alias("left"))
               .withColumn("__slot", _slot(F.col("ts"), slot_s)))
    # A span that ends with the begin of a slot stands before that slot and leaves in it.
    first, last = _slot(F.col("start_ts"), slot_s) + 1, _slot(F.col("end_ts"), slot_s)
    standing = (spans.filter(first <= last).select(F.explode(F.sequence(first, last)).alias("__slot"))
                .groupBy("__slot").agg(F.count("*").alias("__standing")))
    so_far = Window.partitionBy("__slot").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = changes.join(standing, "__slot", "left")
    online = F.coalesce("__standing", F.lit(0)) + F.sum(F.col("came") - F.col("left")).over(so_far)
    return opened.select("ts", "came", "left", online.alias("online"))


def with_online(arrivals, intervals, slot_s=TTL_S):
    """Add ``online``: whether an interval of the session holds the arrival time.

    Session and time slot form the join key, the interval borders are checked inside.
    Intervals of a session must not overlap, which ``presence_intervals`` guarantees.
    A missing session is offline.
    """
    first = _slot(F.col("start_ts"), slot_s)
    last = _slot(F.col("end_ts") - F.expr("INTERVAL '0.000001' SECOND"), slot_s)
    slotted = intervals.select(
        F.col("session_id").alias("__sid"), "start_ts", "end_ts",
        F.explode(F.sequence(first, last)).alias("__islot"))
    # Rows without a session go round the join: all of them would carry one key.
    keyed = arrivals.filter("session_id IS NOT NULL").withColumn("__slot", _slot(F.col("ts"), slot_s))
    joined = keyed.join(
        slotted,
        (F.col("session_id") == F.col("__sid")) & (F.col("__slot") == F.col("__islot"))
        & (F.col("ts") >= F.col("start_ts")) & (F.col("ts") < F.col("end_ts")), "left")
    found = joined.select(*arrivals.columns, F.col("__sid").isNotNull().alias("online"))
    return found.unionByName(arrivals.filter("session_id IS NULL").withColumn("online", F.lit(False)))


def presence_gate(arrivals, intervals, slot_s=TTL_S):
    """(online, offline) arrivals; together they are the input."""
    flagged = with_online(arrivals, intervals, slot_s)
    return flagged.filter("online").drop("online"), flagged.filter("NOT online").drop("online")


def write_gate(arrivals, intervals, path, slot_s=TTL_S, mode="append"):
    """Write all arrivals once, in one folder for ``online`` true and one for false."""
    with_online(arrivals, intervals, slot_s).write.mode(mode).partitionBy("online").parquet(path)


def gap_sessions(arrivals, gap_s=SLIDING_TTL_S, slot_s=3600):
    """Online spans when every message keeps its session online for ``gap_s`` seconds.

    Rows with less than the gap between them share a span; a span ends ``gap_s``
    after its last row. Rows in one bucket narrower than the gap always share a span, so
    they are counted per bucket first, before the shuffle. Spans are then built inside
    time slots; only those next to a slot border are merged over the whole session.
    """
    gap_us = gap_s * 1_000_000
    slot_us = slot_s * 1_000_000
    if slot_us < gap_us:
        raise ValueError("a slot must be at least as long as the gap")
    rows = (arrivals.filter("session_id IS NOT NULL")
            .select("session_id", epoch_us(F.col("ts")).alias("__us"))
            .groupBy("session_id", _floor_div(F.col("__us"), slot_us).alias("__slot"), _floor_div(F.col("__us"), gap_us).alias("__bucket"))
            .agg(F.min("__us").alias("__from"), F.max("__us").alias("__to"), F.count(F.lit(1)).alias("__n")))
    inner = Window.partitionBy("session_id", "__slot").orderBy("__from")
    starts = F.when(F.col("__from") - F.lag("__to").over(inner) < gap_us, 0).otherwise(1)
    spans = (rows.withColumn("__new", starts)
             .withColumn("__span", F.sum("__new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("session_id", "__slot", "__span")
             .agg(F.min("__from").alias("__first"), F.max("__to").alias("__last"), F.sum("__n").alias("n_messages")))

    slot_start, slot_end = F.col("__slot") * slot_us, (F.col("__slot") + 1) * slot_us
    at_border = (F.col("__first") - slot_start < gap_us) | (slot_end - F.col("__last") <= gap_us)
    columns = ["session_id", "__first", "__last", "n_messages"]
    inside = spans.filter(~at_border).select(*columns)
    outer = Window.partitionBy("session_id").orderBy("__first")
    joins_previous = F.col("__first") - F.lag("__last").over(outer) < gap_us
    merged = (spans.filter(at_border)
              .withColumn("__new", F.when(joins_previous, 0).otherwise(1))
              .withColumn("__span", F.sum("__new").over(outer.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("session_id", "__span")
              .agg(F.min("__first").alias("__first"), F.max("__last").alias("__last"),
                   F.sum("n_messages").alias("n_messages")))
    return (inside.unionByName(merged.select(*columns))
            .select("session_id", from_epoch_us(F.col("__first")).alias("start_ts"),
                    from_epoch_us(F.col("__last") + gap_us).alias("end_ts"), "n_messages"))
