"""Channel names, channel frames and client lines."""

from pyspark.sql import functions as F

CHANNEL_PREFIX = "user_"


def channel_name(session_id):
    """Channel of a session; a missing session renders as ``None``."""
    return F.concat(F.lit(CHANNEL_PREFIX), F.coalesce(session_id, F.lit("None")))


def session_from_channel(channel):
    """Session of a channel: every occurrence of the prefix is removed."""
    return F.replace(channel, F.lit(CHANNEL_PREFIX), F.lit(""))


def valid_json(text):
    """Whether the whole text is one JSON value, with nothing before or after it.

    Spark's JSON readers stop after the first value. What is a value inside an object
    and also the only one inside an array has no room for anything else.
    """
    in_object = F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))
    in_array = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce((F.size(in_object) == 1) & (in_array == 1), F.lit(False))


def frame_value(session_id, payload_json):
    """``{"session_id": .., "data": ..}`` around a payload that is JSON already.

    The payload text is spliced in as it is, so it is neither parsed again nor
    re-written.
    """
    head = F.to_json(F.struct(session_id.alias("session_id")), {"ignoreNullFields": "false"})
    return F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"data":'), payload_json, F.lit("}"))


def frame_content(frame_json):
    """``data`` of a frame as JSON text: ``{}`` when the key is absent, ``null`` when null."""
    frame = F.try_parse_json(frame_json)
    data = F.try_variant_get(frame, "$.data", "variant")
    return (F.when(frame.isNull() | ~valid_json(frame_json), F.lit(None).cast("string"))
            .when(data.isNull(), F.lit("{}"))
            .otherwise(F.to_json(data)))
