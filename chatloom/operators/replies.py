"""Fold the events of an agent run into one reply.

Events come in order. A final event with content appends its text. Any other event
with an error code sets the reply to ``error``, dropping what was there. All other
events change nothing, and a run without finals still gives an empty reply.
"""

from pyspark.sql import functions as F

from chatloom.functions.text import bound

# Sender and special contents of a reply.
SENDER = "system"
ERROR_CONTENT = "error"
EXCEPTION_CONTENT = "system_error"

CHUNK_EVENTS = 4096


def event_text(parts, content_str):
    """Text a final event appends: that of its first part, else the whole content as text."""
    return F.coalesce(F.try_element_at(parts, F.lit(1))["text"], content_str, F.lit(""))


def _effects(events):
    """Reset flag and appended text of each event; both NULL when it changes nothing."""
    appends = F.col("is_final") & F.col("has_content")
    resets = ~F.coalesce(appends, F.lit(False)) & (F.col("error_code") != "")
    return events.withColumns({
        "__reset": F.coalesce(resets, F.lit(False)),
        "__text": F.when(appends, event_text(F.col("parts"), F.col("content_str"))),
    })


def folded_steps(steps):
    """Fold an array of (order, reset, text) structs, in any order, to (reset, text)."""
    start = F.struct(F.lit(False).alias("reset"), F.lit("").alias("text"))
    return F.aggregate(F.array_sort(steps), start, lambda acc, s: F.struct(
        (acc["reset"] | s["reset"]).alias("reset"),
        F.when(s["reset"], s["text"]).otherwise(F.concat(acc["text"], s["text"])).alias("text")))


def fold_expression(steps):
    """Reply content of an array of (order, reset, text) steps."""
    return bound(folded_steps(steps), lambda f: F.concat(F.when(f["reset"], ERROR_CONTENT).otherwise(""), f["text"]))


def step(order):
    """One event as a fold step, or NULL when it changes nothing."""
    return F.when(F.col("__reset") | F.col("__text").isNotNull(),
                  F.struct(order.alias("at"), F.col("__reset").alias("reset"),
                           F.coalesce(F.col("__text"), F.lit("")).alias("text")))


def with_steps(events, order="seq"):
    return _effects(events).withColumn("__step", step(F.col(order)))


def fold_pieces(events, chunk=CHUNK_EVENTS):
    """Fold per run and chunk of events.

    The pieces of a run in order, from its last reset on, are its reply. A run of
    any length stays spread over tasks.
    """
    keyed = with_steps(events).withColumn("chunk", F.floor(F.col("seq") / chunk))
    folded = keyed.groupBy("session_id", "invocation_id", "chunk").agg(F.collect_list("__step").alias("__steps"))
    return folded.select("session_id", "invocation_id", "chunk", folded_steps(F.col("__steps")).alias("__piece")).select(
        "session_id", "invocation_id", "chunk", "__piece.*")


def fold_replies(events, failed=None, chunk=CHUNK_EVENTS):
    """One reply row per run: (session_id, invocation_id, sender, content).

    ``failed`` holds the (session_id, invocation_id) of runs that raised; their reply
    is the fixed exception text instead of what they had so far.
    """
    run = ["session_id", "invocation_id"]

    def folded(steps):
        return steps.select(*run, F.lit(SENDER).alias("sender"), fold_expression(F.col("__steps")).alias("content"))

    # Runs of any length are folded per chunk first; pieces that change nothing stay behind.
    kept = F.when(F.col("reset") | (F.col("text") != ""), F.struct("chunk", "reset", "text"))
    replies = folded(fold_pieces(events, chunk).groupBy(*run).agg(F.collect_list(kept).alias("__steps")))
    if failed is None:
        return replies
    raised = failed.select("session_id", "invocation_id", F.lit(True).alias("__raised")).distinct()
    return (replies.join(raised, ["session_id", "invocation_id"], "full")
            .select("session_id", "invocation_id", F.lit(SENDER).alias("sender"),
                    F.when(F.col("__raised"), EXCEPTION_CONTENT).otherwise(F.col("content")).alias("content")))
