"""Counts of what happened to messages."""

from pyspark.sql import functions as F


def guard_outcomes(guarded, col="text"):
    """(stage, reason) rows of a guarded table: the block reason, ``modified`` or ``passed``."""
    reason = (F.when(F.col("is_blocked"), F.col("reason"))
              .when(F.col("final_text") != F.col(col), "modified").otherwise("passed"))
    return guarded.select(F.lit("guard").alias("stage"), reason.alias("reason"))


def tool_outcomes(judged):
    """(stage, reason) rows of judged tool calls: the reason or ``allowed``."""
    return judged.select(F.lit("tool").alias("stage"), F.coalesce("reason", F.lit("allowed")).alias("reason"))


def delivery_outcomes(judged):
    """(stage, reason) rows of judged envelopes: the reason or ``delivered``."""
    return judged.select(F.lit("delivery").alias("stage"), F.coalesce("reason", F.lit("delivered")).alias("reason"))


def outcome_report(outcomes):
    """Counts per (stage, reason) with subtotals per stage and a grand total.

    ``level`` is 0 for a reason, 1 for a stage and 3 for the total. Counts are combined
    per reason first, so the subtotals are built from a handful of rows.
    """
    base = outcomes.groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("n"))
    return (base.rollup("stage", "reason")
            .agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level")))
