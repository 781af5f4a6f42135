"""Round trips of records and packages, and the query against its SQL twin."""

import hashlib
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from chatloom.llm import warc
from chatloom.llm.catalog import ORACLES, QUERIES
from tests.compare import differences, duck


def test_query_equals_twin(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        found, rows = differences(QUERIES["op10_warc_packages"](spark, sf), duck(sf), ORACLES["op10_warc_packages"])
        assert found == [] and rows


def test_edge_cases(spark):
    big = "ä" * 400_000
    rows = [(5, "u5", "x" * 100, 1), (3, "u3\nb", "x" * 100, 2), (9, None, None, 3), (8, "u", "", 4), (3, "u3", "x" * 100, 5),
            (None, "n", "x" * 100, 6), (7, "u", "short", 7), (6, "u", "short", 8), (11, "u", big, 9), (10, "v", big, 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload) for r in
                  warc.read_packages(warc.archive(pages)).collect()), key=str)
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        first = {"x" * 100: 3, big: 10}.get(html, page)
        original = first == page
        want.append((page, "response" if original else "revisit", None if original else first, len(data),
                     hashlib.sha256(data).hexdigest(), data if original else None))
    assert got == sorted(want, key=str)
    urls = {r.url for r in warc.read_packages(warc.archive(pages)).collect()}
    assert None in urls and "u3%0Ab" in urls
    assert warc.read_packages(warc.archive(pages.limit(0))).count() == 0


def test_several_packages_and_ranges(spark, tmp_path):
    pages = warc.with_revisits(spark.range(500).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 50).alias("html")))
    packages = warc.write_packages(pages.coalesce(2), f"file://{tmp_path}/w", package_bytes=2000)
    assert packages.count() > 2
    assert packages.agg(F.sum("records")).first()[0] == 500
    assert sorted(r.page_id for r in warc.read_packages(packages).collect()) == list(range(500))


@pytest.mark.parametrize("wide", [False, True])
def test_members_of_foreign_packages(wide):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.comment = b"a comment PK"
        z.writestr("packed", b"p" * 1000, zipfile.ZIP_DEFLATED)
        with z.open("ünï", "w", force_zip64=wide) as m:
            m.write(b"stored")
    data = sink.getvalue()
    if wide:
        data = widened(data)
    packed, stored = warc.members(io.BytesIO(data), len(data))
    assert packed.method == 8 and stored.name == "ünï"
    assert data[stored.start:stored.start + stored.length] == b"stored"
    with pytest.raises(ValueError):
        warc._stored([packed], "packed")
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"no package"), 10)


def widened(data):
    """The same package with a ZIP64 end record, and sizes and offsets of the last entry in a ZIP64 field."""
    end = data.rfind(b"PK\5\6")
    count, length, offset = struct.unpack_from("<HII", data, end + 10)
    directory, p, out = data[offset:offset + length], 0, b""
    for n in range(count):
        names, extras, comments = struct.unpack_from("<HHH", directory, p + 28)
        size = 46 + names + extras + comments
        entry = bytearray(directory[p:p + size])
        if n == count - 1:
            packed, plain = struct.unpack_from("<II", entry, 20)
            header, = struct.unpack_from("<I", entry, 42)
            extra = struct.pack("<HHQQQ", 1, 24, plain, packed, header)
            struct.pack_into("<IIHHH", entry, 20, 0xFFFFFFFF, 0xFFFFFFFF, names, len(extra), 0)
            struct.pack_into("<I", entry, 42, 0xFFFFFFFF)
            entry = entry[:46 + names] + extra
        out += entry
        p += size
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, count, count, len(out), offset)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, offset + len(out), 1)
    tail = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return data[:offset] + out + wide + locator + tail
