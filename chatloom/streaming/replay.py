"""Playing a table back as a stream, in the order of its times.

The files of a table lie in any order of time, and a stream that reads them as they lie must
wait for the whole table. Here the rows are first put into files by ranges of time, and the
stream is given one slice of these after the other. Nothing is late then, so the delay can
be as short as that of a live source, and state holds the delay instead of the table.
"""

import math

from pyspark.sql import functions as F

from chatloom.session import shared_folder
from chatloom.streaming.runner import Finished, delete, run_available

#: Bytes of a slice, and of a file of it, by Spark's estimate of the input; slices at least, also where there is no estimate.
#: A file is what one task reads and decodes, so files are small, and a slice has one for every core at least.
SLICE_BYTES, FILE_BYTES, LEAST_SLICES = 1 << 30, 8 << 20, 4
UNKNOWN = 1 << 62


def _filesystem(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


class Replay:
    """The rows of a table as a folder of slices by ``ts``, and the folder a stream reads them from."""

    def __init__(self, df, ts="ts"):
        self.spark, self.schema = df.sparkSession, df.schema
        self.root = shared_folder(self.spark, "replay")
        self.staged, self.input = f"{self.root}/staged", f"{self.root}/input"
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        self.slices = max(LEAST_SLICES, math.ceil(size / SLICE_BYTES)) if size < UNKNOWN else LEAST_SLICES
        cores = self.spark.sparkContext.defaultParallelism
        files = self.slices * max(cores, math.ceil(size / self.slices / FILE_BYTES) if size < UNKNOWN else 1)
        # One folder per range of time; equal times share one, so no slice reaches back.
        (df.repartitionByRange(files, ts).withColumn("__range", F.spark_partition_id())
         .write.partitionBy("__range").parquet(self.staged))
        system, folder = _filesystem(self.spark, self.staged)
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        self.ranges = sorted(int(n.split("=")[1]) for n in names if n.startswith("__range="))
        system.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(self.input))

    def read(self, session):
        """The stream of all rows given to it so far, without order within a slice."""
        return session.readStream.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.input)

    def give(self, number):
        """Move a slice into the folder that the stream reads; the next run of the stream takes it."""
        system, _ = _filesystem(self.spark, self.input)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        total = len(self.ranges)
        for place in self.ranges[number * total // self.slices:(number + 1) * total // self.slices]:
            if not system.rename(path(f"{self.staged}/__range={place}"), path(f"{self.input}/{place}")):
                raise OSError(f"{self.staged}/__range={place} could not be moved")

    def delete(self):
        delete(self.spark, self.root)


def run_replayed(spark, rows, build, flush_row, foreach_batch=None, ts="ts"):
    """Run the stream that ``build`` makes over the rows of a table in the order of ``ts``, to the very last one.

    ``build(read, side)`` gets a function that opens the stream of rows, and the stream of the one row
    that comes after all of them and releases what still waits. The query is stopped after every
    slice and goes on from its checkpoint. Staged rows and checkpoint are removed at the end;
    the output stays until ``Finished.delete``.
    """
    replay = Replay(rows, ts)
    root = shared_folder(spark, "stream")
    path, checkpoint, side = f"{root}/out", f"{root}/checkpoint", f"{root}/flush"
    sink = None if foreach_batch is None else foreach_batch(path)
    row = spark.range(1).select(*[c.alias(n) for n, c in flush_row.items()])
    row.limit(0).write.parquet(side)
    late = held = 0
    for number in range(replay.slices + 1):
        if number < replay.slices:
            replay.give(number)
        else:
            row.write.mode("append").parquet(side)
        stream = build(lambda: replay.read(spark), spark.readStream.schema(row.schema).parquet(side))
        seen = run_available(stream, path, checkpoint, sink)
        late, held = late + seen.dropped, max(held, seen.state_rows)
    delete(spark, checkpoint)
    delete(spark, side)
    replay.delete()
    return Finished(path, late, held)
