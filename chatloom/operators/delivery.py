"""Delivery attempts: outcome per message and the delay before the next attempt."""

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RetryPolicy:
    initial_s: float
    multiplier: float
    maximum_s: float

    def delay(self, n_failed):
        """Seconds to wait after ``n_failed`` failed attempts."""
        grown = F.lit(self.initial_s) * F.pow(F.lit(self.multiplier), n_failed - 1)
        return F.least(F.lit(float(self.maximum_s)), grown)

    def seconds(self, n):
        """The waits after the first ``n`` failures."""
        return [min(self.maximum_s, self.initial_s * self.multiplier ** k) for k in range(n)]


# Limits of the push subscription and of the publisher.
MAX_ATTEMPTS = 5
PUSH_RETRY = RetryPolicy(10.0, 2.0, 300.0)
PUBLISH_RETRY = RetryPolicy(0.1, 1.3, 60.0)


def outcome_columns(n_seen, first_ok, max_attempts, policy):
    """(n_used, outcome, next_delay_s) from the attempts seen and the first success among them."""
    outcome = (F.when(first_ok.isNotNull(), "delivered")
               .when(n_seen >= max_attempts, "dead_letter").otherwise("pending"))
    n_used = F.coalesce(first_ok, n_seen)
    return n_used, outcome, F.when(outcome == "pending", policy.delay(n_used))


def delivery_attempts(attempts, order, max_attempts=MAX_ATTEMPTS, policy=PUSH_RETRY):
    """Outcome of each message: delivered at its first success, dead letter after
    ``max_attempts`` failures, else pending.

    Only the first ``max_attempts`` attempts of a message can matter. Keeping those is
    a ranking that Spark cuts off before the shuffle, so a message with very many
    attempts sends only a few rows per task.
    """
    w = Window.partitionBy("message_id").orderBy(*order)
    first = attempts.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= max_attempts)
    seen = first.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("__seen"), F.min(F.when(F.col("ok"), F.col("__n"))).cast("bigint").alias("__ok"))
    n_used, outcome, delay = outcome_columns(F.col("__seen"), F.col("__ok"), max_attempts, policy)
    return seen.select("message_id", n_used.alias("n_used"), outcome.alias("outcome"), delay.alias("next_delay_s"))


def held_attempts(attempts, order, at_s, max_attempts=MAX_ATTEMPTS, policy=PUSH_RETRY):
    """Outcome of each message when the policy acts: an attempt that comes before the pause
    after the failure before it is over is held, and takes place when it is.

    ``at_s`` is the column with the time of an attempt in whole seconds. Gives (message_id, n_used, outcome,
    at_s, next_at_s): the time of the last attempt that counts, and the earliest time of
    the next one of a pending message. The k-th attempt takes place at the latest of all
    times t_j (j up to k) plus the pauses between j and k; a running maximum says the same.
    """
    w = Window.partitionBy("message_id").orderBy(*order)
    first = attempts.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= max_attempts)
    waits = [int(s) for s in policy.seconds(max_attempts)]
    ahead = F.element_at(F.array(*[F.lit(sum(waits[:k])).cast("bigint") for k in range(max_attempts)]), F.col("__n"))
    running = Window.partitionBy("message_id").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    held = first.withColumn("__at", F.max(F.col(at_s) - ahead).over(running) + ahead)
    seen = held.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("__seen"), F.min(F.when(F.col("ok"), F.col("__n"))).cast("bigint").alias("__ok"),
        F.sort_array(F.collect_list(F.struct("__n", "__at"))).alias("__times"))
    n_used, outcome, delay = outcome_columns(F.col("__seen"), F.col("__ok"), max_attempts, policy)
    at = F.element_at(F.col("__times.__at"), n_used.cast("int"))
    return seen.select("message_id", n_used.alias("n_used"), outcome.alias("outcome"), at.alias("at_s"),
                       (at + delay.cast("bigint")).alias("next_at_s"))
