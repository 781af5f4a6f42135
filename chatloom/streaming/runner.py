"""Running a streaming job to the end of a bounded input."""

import threading
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from chatloom.session import shared_folder

# Later than any event, so that the watermark passes everything before it, and within
# the range of the nanosecond times (up to 2262) that Python workers read.
FLUSH_TIME = "2200-01-01 00:00:00"


def stream_session(spark):
    """A session of its own for streaming settings; data and cluster are shared.

    State lives in RocksDB, so it may exceed memory. The number of shuffle partitions
    is fixed for the life of a checkpoint and follows the cores of the cluster.
    """
    own = spark.newSession()
    cores = spark.sparkContext.defaultParallelism
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(min(partitions, max(8, 2 * cores))),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
    }.items():
        own.conf.set(key, value)
    return own


@dataclass(frozen=True)
class Finished:
    """Where a finished stream wrote its rows, how many came too late to count, and the most rows its state held after a batch."""

    path: str
    dropped_late: int
    state_rows: int = 0

    def delete(self, spark):
        """Remove the rows, once they have been read."""
        delete(spark, self.path)


@dataclass(frozen=True)
class Seen:
    """What the progress reports of one run add up to."""

    dropped: int
    state_rows: int


def delete(spark, path):
    """Remove a folder that a bounded run has made."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Reports(StreamingQueryListener):
    """Adds up the rows that a query's operators dropped as late, and the most they held, over all of its progress reports."""

    def __init__(self):
        self.seen, self.done = {}, {}

    def onQueryStarted(self, event):
        self.done.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event):
        run = str(event.progress.runId)
        operators, before = event.progress.stateOperators, self.seen.get(run, Seen(0, 0))
        self.seen[run] = Seen(before.dropped + sum(o.numRowsDroppedByWatermark for o in operators),
                              max(before.state_rows, sum(o.numRowsTotal for o in operators)))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.done.setdefault(str(event.runId), threading.Event()).set()

    def of(self, query):
        """What a query that has ended has reported; its end is reported after its last progress."""
        run = str(query.runId)
        if not self.done.setdefault(run, threading.Event()).wait(60):
            raise TimeoutError("the end of the query was not reported")
        return self.seen.get(run, Seen(0, 0))


def run_available(stream, path, checkpoint, foreach_batch=None, fmt="parquet"):
    """Process all input there is and stop; returns what was ``Seen``."""
    reports = Reports()
    streams = stream.sparkSession.streams
    streams.addListener(reports)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if foreach_batch is None:
        query = writer.format(fmt).outputMode("append").start(path)
    else:
        query = writer.outputMode("append").foreachBatch(foreach_batch).start()
    try:
        query.awaitTermination()
        return reports.of(query)
    finally:
        streams.removeListener(reports)


def run_bounded(spark, build, flush_row=None, foreach_batch=None):
    """Run the stream that ``build`` makes over a bounded input, to the very last row.

    Rows that wait for the watermark are released by one more row from the far
    future. It must not come before the end of the input, so it is put into a side
    folder of its own after the first run, and the same query is run once more.
    ``build`` gets the side stream, with the columns of ``flush_row``, to unite with
    its input; without a ``flush_row`` it gets nothing and runs once. Checkpoint and side
    folder are removed at the end; the rows stay until ``Finished.delete``.
    """
    root = shared_folder(spark, "stream")
    path, checkpoint, side = f"{root}/out", f"{root}/checkpoint", f"{root}/flush"
    sink = None if foreach_batch is None else foreach_batch(path)
    if flush_row is None:
        seen = run_available(build(), path, checkpoint, sink)
        delete(spark, checkpoint)
        return Finished(path, seen.dropped, seen.state_rows)
    row = spark.range(1).select(*[c.alias(n) for n, c in flush_row.items()])
    row.limit(0).write.parquet(side)

    def start():
        return run_available(build(spark.readStream.schema(row.schema).parquet(side)), path, checkpoint, sink)

    first = start()
    row.write.mode("append").parquet(side)
    last = start()
    delete(spark, checkpoint)
    delete(spark, side)
    return Finished(path, first.dropped + last.dropped, max(first.state_rows, last.state_rows))


def flush_ts():
    return F.lit(FLUSH_TIME).cast("timestamp")
