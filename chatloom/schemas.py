"""Record schemas shared by the batch and the streaming jobs."""

from pyspark.sql import types as T

CHAT_REQUEST = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("header_session_id", T.StringType()),
    T.StructField("user_input", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
])

# Push envelope as the queue delivers it.
ENVELOPE = T.StructType([
    T.StructField("message", T.StructType([
        T.StructField("data", T.StringType()),
        T.StructField("messageId", T.StringType()),
        T.StructField("publishTime", T.StringType()),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    ])),
    T.StructField("subscription", T.StringType()),
])
