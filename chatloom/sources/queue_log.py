"""A queue kept as a log of envelopes: a Spark data source with offsets, and a sink with commits.

The log is a folder that all machines share. Tasks write segments (Parquet files) of their own;
nothing of them is seen before the driver has written a commit, one small file that names the
segments of a write in order. A commit never changes, so a range of commits always gives the
same rows: its number is the offset of the stream reader, and a replayed batch reads what it read before.

A stream writer names its commit by writer and batch. A batch that is run again after a
restart finds its commit and adds nothing, so every row is in the log exactly once. Segments of
failed or repeated tasks are in no commit and are removed when the write ends. One writer
writes to a log at a time; readers are free.

    register(spark)
    replies.write.format("envelope_log").mode("append").save(path)
    spark.readStream.format("envelope_log").load(path)
"""

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)

SCHEMA = "messageId string, data string, attributes map<string,string>, publishTime timestamp"
GROUP_ROWS = 65536  # rows of a row group, which a reading task takes at a time

_ARROW = pa.schema([("messageId", pa.string()), ("data", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())),
                    ("publishTime", pa.timestamp("us", tz="UTC"))])


@dataclass
class Segment(WriterCommitMessage):
    """A file that a task has written, with its number of row groups and rows; no name, no file."""

    name: str | None
    groups: int = 0
    rows: int = 0


@dataclass
class Groups(InputPartition):
    """Row groups of a segment for a reading task."""

    name: str
    first: int
    last: int


class Log:
    """The folder of a log."""

    def __init__(self, path):
        self.path = path

    def _open(self):
        found, root = fs.FileSystem.from_uri(self.path)
        return found, root.rstrip("/")

    def commits(self):
        """(number, file name, writer, batch) of all commits, in order."""
        system, root = self._open()
        files = system.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
        names = sorted(f.base_name for f in files if f.base_name.endswith(".json"))
        return [(int(number), name, writer, int(batch)) for name in names for number, writer, batch in [name.removesuffix(".json").split("~")]]

    def segments(self, after, to):
        """The segments of the commits behind ``after`` up to ``to``, in order."""
        system, root = self._open()
        found = []
        for number, name, _, _ in self.commits():
            if after < number <= to:
                with system.open_input_stream(f"{root}/commits/{name}") as f:
                    found += [Segment(**s) for s in json.loads(f.read())]
        return found

    def last(self):
        commits = self.commits()
        return commits[-1][0] if commits else -1

    def write(self, batches):
        """Write the rows of a task to a segment of its own."""
        system, root = self._open()
        name, writer, groups, rows = uuid.uuid4().hex, None, 0, 0
        stream = None
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP_ROWS):
                if writer is None:
                    system.create_dir(f"{root}/segments", recursive=True)
                    stream = system.open_output_stream(f"{root}/segments/{name}")
                    writer = pq.ParquetWriter(stream, _ARROW)
                part = pa.Table.from_batches([batch.slice(start, GROUP_ROWS)]).select(_ARROW.names).cast(_ARROW)
                writer.write_table(part, row_group_size=GROUP_ROWS)
                groups, rows = groups + 1, rows + part.num_rows
        if writer is None:
            return Segment(None)
        writer.close()
        stream.close()
        return Segment(name, groups, rows)

    def commit(self, segments, writer, batch):
        """Make segments part of the log, unless this batch of the writer is already; then they are removed."""
        system, root = self._open()
        commits = self.commits()
        if any((w, b) == (writer, batch) for _, _, w, b in commits):
            self.remove(segments)
            return
        number = commits[-1][0] + 1 if commits else 0
        body = json.dumps([vars(s) for s in segments if s and s.name]).encode()
        system.create_dir(f"{root}/commits", recursive=True)
        # Written aside and moved, so that a commit is there as a whole or not at all.
        aside = f"{root}/commits/.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as f:
            f.write(body)
        system.move(aside, f"{root}/commits/{number:012d}~{writer}~{batch}.json")

    def remove(self, segments):
        system, root = self._open()
        for s in segments:
            if s and s.name:
                system.delete_file(f"{root}/segments/{s.name}")

    def tasks(self, after, to):
        """A reading task per row group."""
        return [Groups(s.name, g, g + 1) for s in self.segments(after, to) for g in range(s.groups)]

    def read(self, groups):
        system, root = self._open()
        with system.open_input_file(f"{root}/segments/{groups.name}") as f:
            file = pq.ParquetFile(f)
            yield from file.iter_batches(8192, row_groups=list(range(groups.first, groups.last)))


class _Reader(DataSourceReader):
    def __init__(self, path):
        self.log = Log(path)

    def partitions(self):
        return self.log.tasks(-1, self.log.last()) or [Groups("", 0, 0)]

    def read(self, partition):
        return self.log.read(partition) if partition.name else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path):
        self.log = Log(path)

    def initialOffset(self):
        return {"commit": -1}

    def latestOffset(self):
        return {"commit": self.log.last()}

    def partitions(self, start, end):
        return self.log.tasks(start["commit"], end["commit"])

    def read(self, partition):
        return self.log.read(partition)

    def commit(self, end):
        """Nothing to release: a log keeps its commits."""


class _Writer(DataSourceArrowWriter):
    def __init__(self, path):
        self.log = Log(path)

    def write(self, iterator):
        return self.log.write(iterator)

    def commit(self, messages):
        self.log.commit(messages, uuid.uuid4().hex, 0)

    def abort(self, messages):
        self.log.remove(messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path, writer):
        self.log, self.writer = Log(path), writer

    def write(self, iterator):
        return self.log.write(iterator)

    def commit(self, messages, batchId):
        self.log.commit(messages, self.writer, batchId)

    def abort(self, messages, batchId):
        self.log.remove(messages)


class EnvelopeLog(DataSource):
    """Options: ``path``; ``writer``, a name of the stream that writes, kept over its restarts."""

    @classmethod
    def name(cls):
        return "envelope_log"

    def schema(self):
        return SCHEMA

    def _path(self):
        if not self.options.get("path"):
            raise ValueError("envelope_log needs a path")
        return self.options["path"]

    def reader(self, schema):
        return _Reader(self._path())

    def streamReader(self, schema):
        return _StreamReader(self._path())

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("an envelope log is only appended to")
        return _Writer(self._path())

    def streamWriter(self, schema, overwrite):
        writer = self.options.get("writer", "stream")
        if "~" in writer or "/" in writer:
            raise ValueError("the name of a writer holds no ~ and no /")
        return _StreamWriter(self._path(), writer)


def register(spark):
    """Make the log known to the session, once; streams of it need no session of their own, for they keep no state."""
    try:
        spark.dataSource.register(EnvelopeLog)
    except AnalysisException as error:
        if error.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def log_rows(encoded, message_id, published=None):
    """Encoded replies (data, attributes) in the columns of the log, in its order."""
    at = F.current_timestamp() if published is None else published
    return encoded.select(message_id.cast("string").alias("messageId"), "data", "attributes", at.cast("timestamp").alias("publishTime"))
