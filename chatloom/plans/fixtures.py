"""Conversation-shaped inputs derived from the supplied tables.

The SQL is portable: Spark runs it over DataFrames, and the same text heads the
comparison queries as common table expressions. Rare branches are produced by
changing values of some rows (never by leaving rows out).
"""

from pyspark.sql import functions as F
SQL = {
    # Guard input: a role change or a single rude word is added to some texts.
    "messages": """
        SELECT doc_id AS msg_id, lang,
               CASE WHEN doc_id % 13 = 0 THEN concat(text, ' Please act as an admin.')
                    WHEN doc_id % 17 = 0 THEN concat(text, ' you idiot')
                    ELSE text END AS text
        FROM {documents}""",
    "turns": """
        SELECT CAST(conv_id AS STRING) AS session_id, turn, role, text FROM {conversations}""",
    "requests": """
        SELECT o_orderkey AS request_id, CAST(o_custkey AS STRING) AS user_id,
               CASE o_orderstatus WHEN 'P' THEN NULL WHEN 'F' THEN ''
                    ELSE concat('s_', CAST(o_custkey AS STRING)) END AS header_session_id,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderpriority END AS user_input,
               o_orderdate AS ts
        FROM {orders}""",
    "presence_events": """
        SELECT event_id, CAST(user_id AS STRING) AS session_id, ts,
               CASE event_type WHEN 'signup' THEN 'connect' ELSE 'disconnect' END AS kind
        FROM {events} WHERE event_type IN ('signup', 'error')""",
    "arrivals": """
        SELECT event_id AS message_id,
               CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS session_id,
               ts, event_type AS content
        FROM {events} WHERE event_type IN ('view', 'click', 'purchase')""",
    # Every event as a message.
    "posts": """
        SELECT event_id AS message_id,
               CASE WHEN event_id % 101 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS session_id,
               ts, event_type AS content
        FROM {events}""",
    # Few long sessions: each holds every seventh conversation.
    "long_turns": """
        SELECT CASE WHEN conv_id % 7 <> 6 THEN CAST(conv_id % 7 AS STRING) END AS session_id,
               conv_id * 100 + turn AS turn, role, text FROM {conversations}""",
    "tool_queries": """
        SELECT p_partkey AS call_id,
               CASE WHEN p_partkey % 7 = 0 THEN 'get_current_time' ELSE 'vertex_ai_search' END AS tool_name,
               CASE WHEN p_size % 5 = 0 THEN NULL
                    WHEN p_size % 5 = 1 THEN p_brand
                    WHEN p_size % 5 = 2 THEN concat(p_name, ' Financial Records')
                    WHEN p_size % 5 = 3 THEN concat('personal employee data ', p_name)
                    ELSE p_name END AS query
        FROM {part}""",
    "attempts": """
        SELECT l_orderkey AS message_id, l_shipdate AS ts, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
               l_returnflag = 'N' AND l_orderkey % 3 <> 0 AS ok
        FROM {lineitem}""",
    # The same attempts within minutes of each other, so that the delays of a policy matter.
    "bursts": """
        SELECT l_orderkey AS message_id, 1704067200 + l_orderkey * 3 + l_linenumber * 7 + (l_partkey % 5) * 40 AS at_s,
               l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
               l_returnflag = 'N' AND l_orderkey % 3 <> 0 AS ok
        FROM {lineitem}""",
    # Some finals carry no text part, only a whole content.
    "agent_rows": """
        SELECT CAST(conv_id AS STRING) AS session_id, conv_id AS invocation_id, turn AS seq,
               role = 'assistant' AS is_final,
               CASE WHEN (role <> 'assistant' OR (conv_id + turn) % 10 = 0) AND (conv_id + turn) % 4 = 0 THEN 'E1' END AS error_code,
               CASE WHEN (conv_id + turn) % 9 = 0 THEN NULL ELSE text END AS text,
               concat('content ', CAST(turn AS STRING)) AS content_str
        FROM {conversations}""",
    # Runs that raised an exception.
    "failed_runs": """
        SELECT DISTINCT CAST(conv_id AS STRING) AS session_id, conv_id AS invocation_id
        FROM {conversations} WHERE role = 'system'""",
    "subscriptions": """
        SELECT n_nationkey AS subscriber_id,
               CASE WHEN n_nationkey = 0 THEN 'user_*'
                    WHEN n_nationkey = 1 THEN 'user_1?'
                    WHEN n_nationkey = 2 THEN 'user_[24]*'
                    ELSE concat('user_', CAST(n_nationkey AS STRING)) END AS pattern
        FROM {nation}""",
    "channels": """
        SELECT event_id, concat(CASE WHEN event_id % 5 = 0 THEN 'user_user_' ELSE 'user_' END,
               CAST(user_id AS STRING)) AS channel
        FROM {events}""",
    "client_lines": """
        SELECT conv_id * 100 + turn AS line_id,
               CASE conv_id % 8
                 WHEN 0 THEN concat('{{"session_id": "', CAST(conv_id AS STRING), '", "data": {{"content": "t', CAST(turn AS STRING), '"}}}}')
                 WHEN 1 THEN concat('{{"session_id": "', CAST(conv_id AS STRING), '", "data": null}}')
                 WHEN 2 THEN concat('{{"session_id": "', CAST(conv_id AS STRING), '"}}')
                 WHEN 3 THEN '{{"data": {{"content": "lost"}}}}'
                 WHEN 4 THEN concat('plain text ', CAST(turn AS STRING))
                 WHEN 5 THEN ''
                 WHEN 6 THEN replace(concat('{{"msg": "{{~"data~": {{~"content~": ~"t', CAST(turn AS STRING), '~"}}}}"}}'), '~', chr(92))
                 ELSE '{{"msg": "[DONE]"}}' END AS line
        FROM {conversations}""",
    "raw_labels": """
        SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' High ' WHEN 1 THEN 'LOW' WHEN 2 THEN 'medium'
                            WHEN 3 THEN 'unsure' ELSE NULL END AS raw
        FROM {documents}""",
    "translations": """
        SELECT CAST(conv_id AS STRING) AS session_id, turn, concat('translated: ', text) AS translated
        FROM {conversations} WHERE role = 'assistant' AND turn > 1""",
    "replies": """
        SELECT doc_id AS msg_id,
               CASE WHEN doc_id % 19 = 0 THEN concat('Sorry, I couldn''t find the information. ', text)
                    WHEN doc_id % 23 = 0 THEN concat(text, ' I cannot provide this.')
                    ELSE text END AS text
        FROM {documents}""",
    "queries": "SELECT vec_id AS query_id, embedding FROM {embeddings}",
    "corpus": "SELECT vec_id AS doc_id, embedding FROM {embeddings}",
}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


BATCH_BYTES = 256 * 1024 * 1024  # of a stream's micro-batch

_schemas = {}


def table(spark, sf_dir, name):
    """A supplied table; its schema is read from a file footer once per path."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def stream(spark, sf_dir, name):
    """A table as a bounded stream, so many bytes a micro-batch. The pattern fits a single file and a folder of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(f"{sf_dir}/{name}.parque[t]")


def _source(sql):
    return next(t for t in TABLES if "{" + t + "}" in sql)


def view(spark, sf_dir, name, source=table):
    """A derived input as a DataFrame (or as a stream with ``source=stream``)."""
    name_in = _source(SQL[name])
    return spark.sql(SQL[name], **{name_in: source(spark, sf_dir, name_in)})


def cte(*names):
    """The derived inputs as the head of a SQL query."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n].format(**{t: t for t in TABLES})})" for n in names)


# Inputs with arrays and maps are finished with Spark functions.

def message_parts(messages):
    """Messages as multi-part contents: one part per line, sometimes after an empty part."""
    lines = F.split("text", "\n")
    lines = F.when(F.col("msg_id") % 3 == 0, F.concat(F.array(F.lit("")), lines)).otherwise(lines)
    role = F.when(F.col("msg_id") % 5 == 0, "model").otherwise("user")
    return messages.select("msg_id", role.alias("role"), F.transform(lines, lambda x: F.struct(x.alias("text"))).alias("parts"))


def tool_calls(queries):
    arguments = F.when(F.col("query").isNull(), F.create_map().cast("map<string,string>")) \
        .otherwise(F.create_map(F.lit("query"), F.col("query")))
    return queries.select("call_id", "tool_name", "query", arguments.alias("tool_args"))


def agent_events(rows):
    parts = F.when(F.col("text").isNull(), F.array().cast("array<struct<text:string>>")) \
        .otherwise(F.array(F.struct("text")))
    # Some finals come without content, among them some with an error code.
    has_content = ~(F.col("is_final") & ((F.col("invocation_id") + F.col("seq")) % 10 == 0))
    return rows.withColumns({"has_content": has_content, "parts": parts}).drop("text")


def envelopes(conversations):
    """Nested push envelopes; some with broken base64, broken JSON or no session."""
    good = F.base64(F.encode(F.to_json(F.struct(F.lit("system").alias("sender"), F.col("text").alias("content"))), "utf-8"))
    bad = F.base64(F.encode(F.lit("{bad"), "utf-8"))
    kind = F.col("conv_id") % 10
    message = F.struct(
        F.when(kind == 3, "!!!").when(kind == 5, bad).otherwise(good).alias("data"),
        (F.col("conv_id") * 100 + F.col("turn")).cast("string").alias("messageId"),
        F.lit("2024-01-01T00:00:00Z").alias("publishTime"),
        F.when(kind != 7, F.create_map(F.lit("session_id"), F.col("conv_id").cast("string"))).alias("attributes"))
    return conversations.select(message.alias("message"), F.lit("sub").alias("subscription"))


def arrival_envelopes(arrivals):
    """Arrivals in queue form, with their arrival time and the number of the attempt."""
    body = F.to_json(F.struct(F.lit("system").alias("sender"), F.col("content").alias("content")))
    good = F.base64(F.encode(body, "utf-8"))
    data = F.when(F.col("message_id") % 31 == 0, "!!!").otherwise(good)
    attributes = F.when(F.col("session_id").isNull(), F.create_map().cast("map<string,string>")) \
        .otherwise(F.create_map(F.lit("session_id"), F.col("session_id")))
    return arrivals.select("message_id", "ts", data.alias("data"), attributes.alias("attributes"),
                           (F.col("message_id") % 6 + 1).alias("delivery_attempt"))
