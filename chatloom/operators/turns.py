"""Conversation turns: latest user turn, question-answer pairs, history."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatloom.operators.chunks import CHUNK_ROWS, with_lookback, with_running_total

PIECE_TURNS = 1024


def pending_user_turns(turns):
    """The last turn of each session, kept only when a user wrote it."""
    last = turns.groupBy("session_id").agg(F.max_by(F.struct("turn", "role", "text"), "turn").alias("last"))
    return last.filter(F.col("last.role") == "user").select("session_id", "last.turn", "last.text")


def qa_pairs(turns, chunk=CHUNK_ROWS):
    """Assistant turns with the user turn right before them."""
    previous = {"__prev": lambda w: F.lag(F.struct("role", "text")).over(w)}
    paired = with_lookback(turns, "session_id", "turn", 1, previous, chunk)
    return (paired.filter((F.col("role") == "assistant") & (F.col("__prev.role") == "user"))
            .select("session_id", "turn", F.col("__prev.text").alias("question"), F.col("text").alias("answer")))


def history(turns, max_turns=None, chunk=CHUNK_ROWS):
    """Each turn with the texts of the turns before it, oldest first: all, or up to ``max_turns``.

    All of them are as much text as the square of a session; ``transcript_pieces`` with
    ``history_offsets`` holds the same in the size of the session.
    """
    if max_turns is not None and max_turns < 1:
        raise ValueError("max_turns must be at least 1")

    def context(w, first=Window.unboundedPreceding):
        return F.array_join(F.collect_list(F.concat("role", F.lit(": "), "text")).over(w.rowsBetween(first, -1)), "\n")

    if max_turns is None:
        return turns.withColumn("context", context(Window.partitionBy("session_id").orderBy("turn")))
    return with_lookback(turns, "session_id", "turn", max_turns, {"context": lambda w: context(w, -max_turns)}, chunk)


def transcript_pieces(turns, piece=PIECE_TURNS):
    """The transcript of each session in ordered pieces: ``piece``, ``first_turn``, ``n_turns``, ``text``.

    A piece holds the turns of ``piece`` consecutive ordinals, so a session of any length
    stays spread over tasks; the pieces in order, joined by newlines, are the transcript.
    """
    line = F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))
    cut = turns.groupBy("session_id", F.floor(F.col("turn") / piece).alias("piece")).agg(F.sort_array(F.collect_list(line)).alias("__lines"))
    return cut.select("session_id", "piece", F.get("__lines", F.lit(0))["turn"].alias("first_turn"),
                      F.size("__lines").cast("bigint").alias("n_turns"),
                      F.array_join(F.transform("__lines", lambda x: x["line"]), "\n").alias("text"))


def history_offsets(turns, chunk=CHUNK_ROWS):
    """The whole past of each turn as a position in the session's transcript.

    Writing every prefix out grows with the square of a session, so the past is
    given as its number of turns and characters: the context of a turn is the first
    ``n_turns_before`` rows of its session in turn order.
    """
    return with_running_total(turns, "session_id", "turn", {
        "n_turns_before": F.lit(1).cast("bigint"),
        "n_chars_before": F.length("text").cast("bigint"),
    }, chunk)
