"""Byte-level BPE encoding and decoding with a local rank file.

The tiktoken library merges the bytes. Long texts are cut before they reach it, at places
where no match of the split pattern can span the cut, so that the pieces encode to the same
ids as the whole text while the memory for a call stays bounded.
"""

import base64
import functools
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

from chatloom.llm.columns import slices, utf8

#: Texts up to this many characters go to the encoder in one call.
PIECE_CHARS = 1 << 16
#: Text bytes that are worked on at a time.
BLOCK_BYTES = 4 << 20

# White space as the split pattern's regex engine knows it.
_WHITE = r"[\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG_WHITE = re.compile(_WHITE + "{1024,}")
_EDGE = re.compile(r"(?<=\S)(?=[ \n])")
# White space of one byte, also by Python's rules.
_WHITE_BYTES = np.zeros(256, bool)
_WHITE_BYTES[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True


@functools.lru_cache(maxsize=4)
def encoding(rank_file, pattern):
    """The encoder of a rank file, loaded once per Python worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text, limit=PIECE_CHARS):
    """Cut a text into (piece, whole) pairs whose encodings, joined, are the encoding of the text.

    A cut lies before a space or newline that follows a character that is no white space:
    the split pattern takes white space only at the start of a match or in a match of its
    own, and its look-ahead only inspects what follows white space. A stretch without such
    a place is one piece, however long. A long run of white space overflows the stack of
    the library's regex engine; by the pattern all of the run but its last character (at
    the end of the text: all of it) is one match, so it is given as ``whole``, to be merged
    without splitting.
    """
    start = 0
    for run in _LONG_WHITE.finditer(text):
        yield from _stretch(text, start, run.start(), limit)
        start = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start():start], True
    yield from _stretch(text, start, len(text), limit)


def _stretch(text, start, end, limit):
    while end - start > limit:
        edge = _EDGE.search(text, start + limit // 2, end)
        if not edge:
            break
        yield text[start:edge.start()], False
        start = edge.start()
    if start < end:
        yield text[start:end], False


def encode_text(coder, text):
    """Ids of a whole text as an array of unsigned 32-bit integers."""
    if len(text) <= 1024:
        return coder.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([np.zeros(0, np.uint32)] + [
        np.array(coder._encode_single_piece(p), np.uint32) if whole else coder.encode_to_numpy(p, disallowed_special=())
        for p, whole in pieces(text)])


def _edges(data):
    """Which bytes of UTF-8 data begin a stretch: a space or newline after a character that is surely no white space."""
    edge = np.zeros(len(data), bool)
    white = _WHITE_BYTES[data]
    edge[1:] = ((data == 0x20) | (data == 0x0A))[1:] & ~white[:-1]
    # White space of several bytes ends like other characters; no cut is made behind characters with the same first bytes.
    at = np.flatnonzero(edge)
    at = at[data[at - 1] >= 0x80]
    before = data[at - 2].astype(np.uint16)
    edge[at[before == 0xC2]] = False
    at, before = at[at >= 3], before[at >= 3]
    edge[at[np.isin(data[at - 3].astype(np.uint16) << 8 | before, (0xE19A, 0xE280, 0xE281, 0xE380))]] = False
    return edge


@functools.lru_cache(maxsize=4)
def _token_bytes(coder):
    """How many bytes each id stands for."""
    out = np.zeros(coder.n_vocab, np.int64)
    for token in coder.token_byte_values():
        out[coder.encode_single_token(token)] = len(token)
    return out


def encode_rows(coder, data, at):
    """Ids of many texts, behind one another, and how many each has; ``data`` is their UTF-8, ``at`` its n + 1 offsets.

    The texts are cut at all places where no match of the split pattern can span the cut, so
    that a stretch which occurs again, as most words do, is encoded once.
    """
    if not len(data):
        return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
    inner = np.append(_edges(data), False)
    edge = inner[:-1].copy()
    edge[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge)
    offsets = np.append(starts, len(data))
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    which, stretches = found.indices.to_numpy(), found.dictionary
    first = np.empty(len(stretches), np.int64)
    first[which[::-1]] = np.arange(len(starts))[::-1]
    # Stretches that were cut at both ends within a text are given to the encoder in one call.
    joint = inner[starts[first]] & inner[offsets[first + 1]] & ~np.isin(offsets[first + 1], at)
    body, ends = utf8(stretches.filter(pa.array(joint)).cast(pa.large_string()))
    together = encode_text(coder, body.tobytes().decode())
    ends = np.searchsorted(np.cumsum(_token_bytes(coder)[together]), ends[1:], side="right")
    alone = [encode_text(coder, x.decode()) for x in stretches.filter(pa.array(~joint)).to_pylist()]
    pool, counts = np.concatenate([together, *alone]), np.empty(len(stretches), np.int64)
    counts[joint], counts[~joint] = np.diff(ends, prepend=0), [len(x) for x in alone]
    begin = np.empty(len(stretches), np.int64)
    begin[joint], begin[~joint] = ends - counts[joint], len(together) + np.cumsum(counts[~joint]) - counts[~joint]
    total = np.append(0, np.cumsum(counts[which]))
    ids = pool[np.repeat(begin[which] - total[:-1], counts[which]) + np.arange(total[-1])]
    return ids, np.diff(total[np.searchsorted(starts, at)])


def encode(docs, rank_file, pattern, id_col="doc_id", text_col="text"):
    """Token ids of every text: id column, ``n_tokens`` long, ``ids`` binary.

    ``ids`` holds unsigned 32-bit little-endian integers, four bytes a token. A null text
    counts as empty and has no tokens; repeated ids give repeated rows; other columns are
    not read. The rank file must be readable under the same path on every machine.
    """
    def run(batches):
        coder = encoding(rank_file, pattern)
        for part in slices(batches, 1, BLOCK_BYTES):
            found = [encode_text(coder, t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) for x in found], pa.int64()),
                 pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())],
                [id_col, "n_tokens", "ids"])

    source = docs.select(F.col(id_col), F.col(text_col))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary")


def decode(tokens, rank_file, pattern, ids_col="ids", out_col="decoded"):
    """Append the raw bytes that the ids stand for.

    Bytes, not text: a part of a token sequence need not be valid UTF-8. Null ids stay
    null; ids outside the vocabulary, or a length that is no multiple of four, give null.
    """
    names = [c for c in tokens.columns if c != out_col]

    def run(batches):
        coder = encoding(rank_file, pattern)
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                texts = [_bytes(coder, x) for x in part.column(names.index(ids_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*names, out_col])

    source = tokens.select(*[F.col(f"`{c}`") for c in names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(run, f"{fields}, `{out_col}` binary")


def _bytes(coder, ids):
    if ids is None or len(ids) % 4:
        return None
    try:
        return coder.decode_bytes(np.frombuffer(ids, "<u4").tolist())
    except KeyError:
        return None


def round_trip(docs, rank_file, pattern, id_col="doc_id", text_col="text"):
    """``encode`` and ``decode`` in one pass: id column, ``n_tokens``, ``ids``, ``decoded``.

    One worker holds the vocabulary for both, where the two in a row need a worker each.
    """
    def run(batches):
        coder = encoding(rank_file, pattern)
        for part in slices(batches, 1, BLOCK_BYTES // 2):
            found = [encode_text(coder, t or "").astype("<u4").tobytes() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary()),
                 pa.array([_bytes(coder, x) for x in found], pa.binary())], [id_col, "n_tokens", "ids", "decoded"])

    source = docs.select(F.col(id_col), F.col(text_col))
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids binary, decoded binary")


def digests(tokens):
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of encoded and decoded rows."""
    return tokens.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
