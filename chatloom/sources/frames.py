"""Lines that a chat client receives."""

from pyspark.sql import functions as F

from chatloom.functions.frames import valid_json

DONE_MARK = "[DONE]"  # fixed value: end of an answer in the event stream


def client_lines(spark, path, streaming=False):
    """Lines of text files as a column ``line``."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).withColumnRenamed("value", "line")


def _json_type(value):
    return F.schema_of_variant(value)


def _field_text(value):
    """A JSON value the way a client prints it: strings bare, null as ``null``."""
    kind = _json_type(value)
    return (F.when(value.isNull() | (kind == "VOID"), F.lit("null"))
            .when(kind == "STRING", F.try_variant_get(value, "$", "string"))
            .otherwise(F.to_json(value)))


def _content(frame):
    """(readable, content) of ``data.content``: a scalar or list as data is an error."""
    data = F.try_variant_get(frame, "$.data", "variant")
    kind = _json_type(data)
    readable = data.isNull() | (kind == "VOID") | kind.startswith("OBJECT")
    return readable, _field_text(F.try_variant_get(data, "$.content", "variant"))


def read_frames(lines, mode="ws", col="line"):
    """Add ``kind``, ``session_id`` and ``content`` to client lines; drop what a client ignores.

    ``ws``: a frame with a session is a ``message``; any other line is ``raw`` unless it
    starts with ``{``. ``sse``: a line with the end mark is ``done``; otherwise ``msg`` is
    JSON inside JSON and its content is the ``message``.
    """
    text = F.regexp_replace(F.col(col), r"^[ \t]+|[ \t\r\n]+$", "")
    if mode == "ws":
        frame = F.try_parse_json(text)
        session = F.try_variant_get(frame, "$.session_id", "variant")
        readable, content = _content(frame)
        is_message = session.isNotNull() & (_json_type(session) != "VOID") & readable
        kind = F.when(is_message, "message").when(~text.startswith("{"), "raw")
        fields = {"kind": kind, "session_id": F.when(is_message, _field_text(session)),
                  "content": F.when(is_message, content).otherwise(text)}
    elif mode == "sse":
        quoted = F.try_variant_get(F.try_parse_json(text), "$.msg", "string")
        inner = F.when(valid_json(quoted), F.try_parse_json(quoted))
        readable, content = _content(inner)
        shown = inner.isNotNull() & readable & ~content.isin("null", "false", "")
        kind = F.when(text.contains(DONE_MARK), "done").when(shown, "message")
        fields = {"kind": kind, "session_id": F.lit(None).cast("string"),
                  "content": F.when(kind == "message", content)}
    else:
        raise ValueError(f"unknown mode: {mode}")
    return lines.filter(text != "").withColumns(fields).filter("kind IS NOT NULL")
