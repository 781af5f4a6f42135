"""Session ids of chat requests."""

from pyspark.sql import functions as F


def resolve_session(requests):
    """Give requests without a session header a new id; a header is kept as it is.

    The new id is a hash of user and request, so running a job again gives the same
    ids. A given header is not checked against known sessions.
    """
    header = F.nullif(F.col("header_session_id"), F.lit(""))
    new_id = F.concat(F.lit("s_"), F.md5(F.concat_ws(":", "user_id", F.col("request_id").cast("string"))))
    return requests.withColumns({"session_id": F.coalesce(header, new_id), "is_new": header.isNull()})
