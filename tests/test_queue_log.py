"""The envelope log as a batch and a stream source and sink, over restarts and failures."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from chatloom.sources.queue_log import Log, log_rows, register
from chatloom.streaming.runner import run_available


@pytest.fixture(scope="module")
def own(spark):
    register(spark)
    register(spark)
    return spark


def envelopes(own, ids):
    df = own.createDataFrame([(i, f"data {i}") for i in ids], "id long, data string")
    attributes = F.when(F.col("id") % 2 == 0, F.create_map(F.lit("session_id"), F.col("id").cast("string")))
    return log_rows(df.withColumn("attributes", attributes), F.col("id"), F.timestamp_seconds(F.col("id")))


def publish(own, path, ids):
    envelopes(own, ids).write.format("envelope_log").mode("append").save(path)


def read(own, path):
    return sorted(int(r.messageId) for r in own.read.format("envelope_log").load(path).collect())


def carry(own, source, target, checkpoint):
    run_available(own.readStream.format("envelope_log").load(source), target, checkpoint, fmt="envelope_log")


def test_rows_come_back_as_they_went(own, tmp_path):
    path = str(tmp_path / "log")
    publish(own, path, range(10))
    publish(own, path, range(10, 15))
    publish(own, path, [])
    got = own.read.format("envelope_log").load(path).orderBy(F.col("messageId").cast("long")).collect()
    want = envelopes(own, range(15)).orderBy(F.col("messageId").cast("long")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    assert [n for n, *_ in Log(path).commits()] == [0, 1, 2]


def test_an_empty_log_and_a_missing_path(own, tmp_path):
    assert read(own, str(tmp_path / "none")) == []
    with pytest.raises(Exception, match="needs a path"):
        own.read.format("envelope_log").load().count()
    with pytest.raises(Exception, match="only appended"):
        envelopes(own, [1]).write.format("envelope_log").mode("overwrite").save(str(tmp_path / "log"))


def test_stream_goes_on_where_it_stopped(own, tmp_path):
    a, b, c = (str(tmp_path / n) for n in "abc")
    publish(own, a, range(5))
    carry(own, a, b, c)
    assert read(own, b) == list(range(5))
    publish(own, a, range(5, 9))
    publish(own, a, range(9, 12))
    carry(own, a, b, c)
    carry(own, a, b, c)
    assert read(own, b) == list(range(12))


def test_a_batch_that_is_run_again_adds_nothing(own, tmp_path):
    """The stream ends after the sink's commit and before its own record of it, and is started again."""
    a, b, c = (str(tmp_path / n) for n in "abc")
    publish(own, a, range(5))
    carry(own, a, b, c)
    publish(own, a, range(5, 9))
    carry(own, a, b, c)
    records = sorted(glob.glob(f"{c}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    os.remove(records[-1])
    for crc in glob.glob(f"{c}/commits/.{os.path.basename(records[-1])}.crc"):
        os.remove(crc)
    publish(own, a, [100])
    before = len(os.listdir(f"{b}/segments"))
    carry(own, a, b, c)
    assert read(own, b) == list(range(9)) and len(os.listdir(f"{b}/segments")) == before
    carry(own, a, b, c)
    assert read(own, b) == [*range(9), 100]


def test_a_failed_write_leaves_nothing(own, tmp_path):
    path = str(tmp_path / "log")
    publish(own, path, range(3))
    bad = envelopes(own, range(50)).withColumn("data", F.when(F.col("messageId") == "49", F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="broken"):
        bad.repartition(3).write.format("envelope_log").mode("append").save(path)
    assert read(own, path) == [0, 1, 2]


def test_offsets_name_the_same_rows_for_ever(own, tmp_path):
    path = str(tmp_path / "log")
    publish(own, path, range(4))
    publish(own, path, range(4, 6))
    before = [s.name for s in Log(path).segments(0, 1)]
    publish(own, path, range(6, 8))
    assert [s.name for s in Log(path).segments(0, 1)] == before
    assert sum(s.rows for s in Log(path).segments(-1, Log(path).last())) == 8
    log = Log(path)
    log.commit(log.segments(0, 0), "again", 7)
    log.commit([], "again", 7)
    assert [(w, b) for _, _, w, b in log.commits()][-1] == ("again", 7) and len(log.commits()) == 4
