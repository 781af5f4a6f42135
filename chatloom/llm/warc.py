"""WARC records in ZIP packages: writing them, and reading them back without extraction.

A task writes its pages as gzip-compressed WARC records into ZIP packages in the shared
folder: the records in one stored member, their offsets and lengths in an index member
behind it. The reader parses the end record and the central directory (ZIP64 forms too),
finds the stored members, and reads ranges of the record member by the index.
"""

import hashlib
import itertools
import json
import struct
import uuid
import zipfile
import zlib
from collections import namedtuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from chatloom.session import shared_folder

#: A package is closed, and the next one begun, beyond so many bytes of records.
PACKAGE_BYTES = 512 << 20
#: Records are read back in ranges of about this size.
RANGE_BYTES = 8 << 20
#: Payloads from this size on are written once; equal ones become revisits.
REVISIT_BYTES = 100
#: Output rows of about this many payload bytes go back to Spark together.
BLOCK_BYTES = 4 << 20

RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"


# ---- which record becomes what

def with_revisits(pages, id_col="page_id", payload_col="html"):
    """Add ``payload_digest`` (SHA-256, hex) and ``refers_to`` to pages.

    Of equal payloads of at least ``REVISIT_BYTES`` bytes the smallest id is the original
    and the others refer to it; rows that repeat the smallest id are originals too. Only
    digests that occur more than once are joined: one row for each, whatever the number
    of its pages, so that a frequent payload is split by Spark like any skewed join key.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    pages = pages.withColumn("payload_digest", F.sha2(payload, 256))
    first = (
        pages.where(F.octet_length(payload) >= REVISIT_BYTES)
        .groupBy("payload_digest").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1").drop("_n"))
    original = F.col("_first").isNull() | F.col(id_col).eqNullSafe(F.col("_first"))
    return (pages.join(first, "payload_digest", "left")
            .withColumn("refers_to", F.when(~original, F.col("_first"))).drop("_first"))


# ---- writing

def _line(value):
    """A header value on one line: white space and control characters are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id, url, payload, digest, refers_to, date):
    """The bytes of one WARC record, a response or (with ``refers_to``) a revisit without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
            f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data):
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Stream:
    """A sink for the ZIP writer that is only written in sequence."""

    def __init__(self, sink):
        self.sink = sink

    def write(self, data):
        self.sink.write(data)
        return len(data)

    def flush(self):
        pass


def _write_package(system, path, records, limit):
    """Write records until the limit and give their number."""
    index, offset = [], 0
    with system.open_output_stream(path) as sink, zipfile.ZipFile(_Stream(sink), "w", zipfile.ZIP_STORED) as package:
        with package.open(RECORDS, "w", force_zip64=True) as member:
            for key, data in records:
                member.write(data)
                index.append(json.dumps({"id": key, "offset": offset, "length": len(data)}))
                offset += len(data)
                if offset >= limit:
                    break
        with package.open(INDEX, "w", force_zip64=True) as member:
            for start in range(0, len(index), 4096):
                member.write(("\n".join(index[start:start + 4096]) + "\n").encode())
    return len(index)


def write_packages(pages, folder, id_col="page_id", url_col="url", payload_col="html",
                   date="1970-01-01T00:00:00Z", package_bytes=PACKAGE_BYTES):
    """Write pages that carry ``payload_digest`` and ``refers_to``; a table of ``path`` and ``records``.

    Every attempt of a task writes files of its own, and only those of finished attempts
    are in the table, so lost executors and repeated tasks leave no record twice.
    """
    def run(batches):
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = uuid.uuid4().hex

        def records():
            for batch in batches:
                for row in range(batch.num_rows):
                    page, url, html, digest, refers = (c[row].as_py() for c in batch.columns)
                    yield page, _gzip(record(page, url, (html or "").encode(), digest, refers, date))

        rest, number = records(), 0
        for first in rest:
            file = f"{name}-{number}.wacz"
            written = _write_package(system, f"{base}/{file}", itertools.chain([first], rest), package_bytes)
            number += 1
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{file}"], "records": [written]})

    columns = [id_col, url_col, payload_col, "payload_digest", "refers_to"]
    listed = f"{folder}/packages.parquet"
    pages.select(*columns).mapInArrow(run, "path string, records bigint").write.parquet(listed)
    return pages.sparkSession.read.parquet(listed)


# ---- reading

Member = namedtuple("Member", "name method start length")


def members(file, size):
    """The members of a ZIP package from its central directory, ZIP64 fields included."""
    def at(offset, length):
        file.seek(offset)
        return file.read(length)

    # The end record lies before a comment of at most 65,535 bytes.
    tail_at = max(0, size - 65_535 - 22 - 20)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, offset = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20:end - 16] == b"PK\6\7" and (count == 0xFFFF or 0xFFFFFFFF in (length, offset)):
        wide_at, = struct.unpack_from("<Q", tail, end - 12)
        wide = at(wide_at, 56)
        if wide[:4] != b"PK\6\6":
            raise ValueError("damaged ZIP64 end record")
        count, length, offset = struct.unpack_from("<QQQ", wide, 32)
    directory, found, p = at(offset, length), [], 0
    for _ in range(count):
        if directory[p:p + 4] != b"PK\1\2":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", directory, p + 8)
        packed, plain, names, extras, comments = struct.unpack_from("<IIHHH", directory, p + 20)
        header, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46:p + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + names:p + 46 + names + extras], 0
        while q + 4 <= len(extra):
            kind, room = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # holds those of the three that are too large for their fields, in this order
                wide = iter(struct.unpack_from(f"<{room // 8}Q", extra, q + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + room
        local = at(header, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError("damaged local header")
        start = header + 30 + sum(struct.unpack_from("<HH", local, 26))
        found.append(Member(name, method, start, packed))
        p += 46 + names + extras + comments
    return found


def _stored(found, name):
    for m in found:
        if m.name == name:
            if m.method:
                raise ValueError(f"{name} is compressed and cannot be read in ranges")
            return m
    raise ValueError(f"the package has no {name}")


def ranges(packages):
    """From a table with ``path``: consecutive records of about ``RANGE_BYTES``, as ``path``, ``start``, ``lengths``."""
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, base = fs.FileSystem.from_uri(path)
                with system.open_input_file(base) as file:
                    found = members(file, file.size())
                    data, index = _stored(found, RECORDS), _stored(found, INDEX)
                    for start, lengths in _grouped(_lines(file, index)):
                        yield pa.RecordBatch.from_pydict(
                            {"path": [path], "start": [data.start + start], "lengths": [lengths]})

    return packages.select("path").mapInArrow(run, "path string, start bigint, lengths array<bigint>")


def _lines(file, member):
    """The entries of the index, which is read piece by piece."""
    rest, at, stop = b"", member.start, member.start + member.length
    while at < stop:
        file.seek(at)
        piece = file.read(min(1 << 20, stop - at))
        at += len(piece)
        *lines, rest = (rest + piece).split(b"\n")
        yield from map(json.loads, lines)


def _grouped(entries):
    start, lengths, end = 0, [], 0
    for e in entries:
        if lengths and (e["offset"] != end or end - start >= RANGE_BYTES):
            yield start, lengths
            start, lengths = e["offset"], []
        lengths.append(e["length"])
        end = e["offset"] + e["length"]
    if lengths:
        yield start, lengths


def parse(data):
    """Headers (lower-case names) and block of one gzip-compressed record."""
    plain = zlib.decompress(data, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return headers, rest[:int(headers["content-length"])]


RECORD_SCHEMA = ("page_id bigint, record_type string, url string, refers_to bigint, payload_bytes bigint, "
                 "payload_digest string, payload binary")


def read_packages(packages):
    """All records of packages, read in ranges.

    ``payload`` is null for a revisit, whose ``payload_bytes`` and ``payload_digest`` come
    from its headers; for a response both are computed from the payload that was read.
    """
    def run(batches):
        names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        rows, size, path, file = [], 0, None, None

        def block():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for here, start, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                if here != path:
                    if file:
                        file.close()
                    system, base = fs.FileSystem.from_uri(here)
                    path, file = here, system.open_input_file(base)
                file.seek(start)
                data, at = memoryview(file.read(sum(lengths))), 0
                for length in lengths:
                    rows.append(_row(*parse(data[at:at + length])))
                    at += length
                    size += rows[-1][4] if rows[-1][6] is not None else 500
                    if size >= BLOCK_BYTES:
                        yield block()
                        rows, size = [], 0
        if rows:
            yield block()
        if file:
            file.close()

    # Rows of ranges are small but stand for much work, so their number of partitions is fixed.
    spark = packages.sparkSession
    spread = ranges(packages).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    return spread.mapInArrow(run, RECORD_SCHEMA)


def _row(headers, block):
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["warc-type"]
    if kind == "revisit":
        fields = dict(line.partition(": ")[::2] for line in http.decode().split("\r\n")[1:])
        size, digest, payload = int(fields["Content-Length"]), headers["warc-payload-digest"].partition(":")[2], None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return (_page(headers["warc-record-id"]), kind, headers.get("warc-target-uri"),
            _page(headers.get("warc-refers-to")), size, digest, payload)


def _page(value):
    number = (value or "").strip("<>").removeprefix(ID_PREFIX)
    return int(number) if number else None


def archive(pages, id_col="page_id", url_col="url", payload_col="html"):
    """Write all pages to new packages in the shared folder and give the table of packages.

    Null payloads are empty, a null url is left out of its record, a null id is an id of
    its own kind (never an original of others), repeated rows are written again, other
    columns are not read. An empty table has no packages.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    return write_packages(with_revisits(chosen), folder)
