"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores. Every query reads its tables
and computes all of its rows and columns into a sink that discards them.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatloom.plans.catalog import QUERIES  # noqa: E402
from chatloom.session import build_session  # noqa: E402

HEADLINE = [
    "g1_card_redaction", "g2_deidentify", "g3_moderation", "g3_profanity_guard", "g6_guard_chain", "g7_guard_message",
    "g8_language", "j1_presence_gate", "j2_subscriptions", "j3_direct_delivery", "j4_leakage", "j5_retrieval",
    "a1_reply_fold", "a2_receiver_counts", "a3_outcome_report", "s2_envelope_decode", "s6_outcome_split",
    "w2_qa_pairs", "w3_history", "w4_delivery_attempts", "w5_presence_intervals",
]


def run(spark, name, sf_dir):
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus, {"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "g1_card_redaction", sf_dir)  # starts the JVM compilers
    times = {name: round(min(run(spark, name, sf_dir) for _ in range(2)), 3) for name in names}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
