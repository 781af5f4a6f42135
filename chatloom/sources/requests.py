"""Chat requests."""

from pyspark.sql import functions as F

from chatloom.schemas import CHAT_REQUEST


def split_requests(requests):
    """(accepted, rejected): user id and input are required, the session is optional."""
    flagged = with_reject_reason(requests)
    return (flagged.filter("reject_reason IS NULL").drop("reject_reason"),
            flagged.filter("reject_reason IS NOT NULL"))


def with_reject_reason(requests):
    reason = (F.when(F.col("user_id").isNull(), "user_id")
              .when(F.col("user_input").isNull(), "user_input"))
    return requests.withColumn("reject_reason", reason)


def chat_requests(spark, path, streaming=False, fmt="json", schema=CHAT_REQUEST):
    """Read requests with a fixed schema and split them into (accepted, rejected)."""
    reader = spark.readStream if streaming else spark.read
    return split_requests(reader.schema(schema).format(fmt).load(path))
