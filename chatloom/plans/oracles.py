"""The same questions in plain SQL, for comparison on another engine."""

from chatloom.functions.language import STOP_WORDS
from chatloom.functions.rails import JAILBREAK_RULES, LEXICON, PROFANITY_ERROR_REASON, PROFANITY_REASON, REFUSAL_TEXT
from chatloom.functions.redaction import CARD_PATTERN, CARD_REPLACEMENT, DEFAULT_REPLACEMENT, INFO_TYPES
from chatloom.functions.text import WORD, phrase_pattern
from chatloom.operators.guards import REPLY_PHRASES
from chatloom.plans.catalog import LONG_CHUNK, PROMPT
from chatloom.plans.fixtures import cte


def lit(text):
    return "'" + text.replace("'", "''") + "'"


def words(expr):
    return f"regexp_extract_all(lower({expr}), {lit(WORD)})"


def term_list(terms):
    return "[" + ", ".join(lit(t) for t in sorted(set(terms))) + "]"


def hits(expr, terms):
    return f"len(list_filter({words(expr)}, lambda w: list_contains({term_list(terms)}, w)))"


def redact(expr):
    return f"regexp_replace({expr}, {lit(CARD_PATTERN)}, {lit(CARD_REPLACEMENT)}, 'g')"


def jailbreak(expr):
    return f"regexp_matches({expr}, {lit(phrase_pattern(JAILBREAK_RULES))})"


def profane(expr):
    return f"{hits(expr, LEXICON['Profanity'])} > 1"


def guarded(expr):
    """(is_blocked, reason, final) of the default chain: card, profanity, jailbreak."""
    blocked = f"({profane(expr)} OR {jailbreak(expr)})"
    reason = f"CASE WHEN {profane(expr)} THEN {lit(PROFANITY_REASON)} WHEN {jailbreak(expr)} THEN {lit(REFUSAL_TEXT)} END"
    return blocked, reason, redact(expr)


def language(expr):
    counts = {lang: hits(expr, ws.split()) for lang, ws in STOP_WORDS.items()}
    best = f"greatest({', '.join(counts.values())})"
    cases = " ".join(f"WHEN {n} = {best} AND {n} > 0 THEN {lit(lang)}" for lang, n in counts.items())
    return f"CASE {cases} ELSE 'und' END"


PAIRS = """pairs AS (SELECT session_id, turn, question, answer FROM (
    SELECT session_id, turn, role, text AS answer,
           lag(role) OVER w AS before_role, lag(text) OVER w AS question
    FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn))
  WHERE role = 'assistant' AND before_role = 'user')"""
LONG_PAIRS = PAIRS.replace("FROM turns", "FROM long_turns")


def past(n="UNBOUNDED", turns="turns"):
    return f"""past AS (SELECT session_id, turn, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) OVER (
    PARTITION BY session_id ORDER BY turn ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), '') AS context FROM {turns})"""


INTERVALS = """intervals AS (SELECT * FROM (
    SELECT session_id, event_id AS connection_id, ts AS start_ts, kind,
           least(ts + INTERVAL 6000 SECOND,
                 coalesce(lead(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id), ts + INTERVAL 6000 SECOND)) AS end_ts
    FROM presence_events) WHERE kind = 'connect' AND start_ts < end_ts)"""

SPANS = """reached AS (SELECT *, max(end_ts) OVER (PARTITION BY session_id ORDER BY start_ts, connection_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM intervals),
  numbered AS (SELECT *, sum(CASE WHEN reach >= start_ts THEN 0 ELSE 1 END)
    OVER (PARTITION BY session_id ORDER BY start_ts, connection_id) AS span FROM reached),
  spans AS (SELECT session_id, min(start_ts) AS start_ts, max(end_ts) AS end_ts, count(*) AS n_intervals
    FROM numbered GROUP BY session_id, span)"""

ONLINE = """EXISTS (SELECT 1 FROM intervals i WHERE i.session_id = a.session_id
    AND a.ts >= i.start_ts AND a.ts < i.end_ts)"""

PARTS = """parts AS (SELECT msg_id, CASE WHEN msg_id % 5 = 0 THEN 'model' ELSE 'user' END AS role,
    CASE WHEN msg_id % 3 = 0 THEN list_concat([''], string_split(text, chr(10)))
         ELSE string_split(text, chr(10)) END AS parts FROM messages)"""

PRIMARY = "coalesce(list_filter(parts, lambda p: p <> '')[1], '')"

APPENDS = "(is_final AND NOT (is_final AND (invocation_id + seq) % 10 = 0))"

LAST_ERROR = f"""marked AS (SELECT *, {APPENDS} AS appends, max(CASE WHEN NOT {APPENDS} AND error_code IS NOT NULL THEN seq END)
    OVER (PARTITION BY session_id, invocation_id) AS error_at FROM agent_rows),
  folded AS (SELECT session_id, invocation_id, 'system' AS sender,
    CASE WHEN max(error_at) IS NULL THEN '' ELSE 'error' END || coalesce(
      string_agg(coalesce(text, content_str), '' ORDER BY seq)
        FILTER (WHERE appends AND (error_at IS NULL OR seq > error_at)), '') AS content
  FROM marked GROUP BY session_id, invocation_id)"""


def _deidentified(expr):
    for pattern in INFO_TYPES.values():
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(DEFAULT_REPLACEMENT)}, 'g')"
    return expr


def _findings():
    parts, rest = [], "text"
    for name, pattern in INFO_TYPES.items():
        parts.append(f"SELECT msg_id, {lit(name)} AS info_type, len(regexp_extract_all({rest}, {lit(pattern)})) AS n FROM messages")
        rest = f"regexp_replace({rest}, {lit(pattern)}, {lit(DEFAULT_REPLACEMENT)}, 'g')"
    return f"{cte('messages')} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


def _moderation():
    parts = [f"SELECT msg_id, {lit(name)} AS name, {hits('text', terms)} AS h FROM messages" for name, terms in LEXICON.items()]
    return f"{cte('messages')} SELECT msg_id, name, h / (h + 1) AS confidence FROM ({' UNION ALL '.join(parts)}) WHERE h > 0"


def _prompt():
    pieces = PROMPT
    out = lit(pieces)
    # Bindings go in through marks, so that a value is not searched for the next name.
    for i, name in enumerate(("question", "answer", "context")):
        out = f"replace({out}, {lit('{' + name + '}')}, chr({57344 + i}))"
    for i, name in enumerate(("question", "answer", "context")):
        out = f"replace({out}, chr({57344 + i}), {name})"
    return out


def _guard_sql():
    blocked, reason, final = guarded("text")
    return f"SELECT msg_id, text, {blocked} AS is_blocked, {reason} AS reason, {final} AS redacted FROM messages"


def _guard_parts():
    blocked, reason, final = guarded("line")
    return f"""{cte('messages')}, {PARTS},
      lines AS (SELECT msg_id, role, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM parts),
      checked AS (SELECT msg_id, role, pos, line, role = 'user' AND line <> '' AND {blocked} AS hit,
                         CASE WHEN line <> '' THEN {reason} END AS reason, {final} AS final FROM lines),
      firsts AS (SELECT msg_id, min(pos) FILTER (WHERE hit) AS first_hit,
                        arg_min(reason, pos) FILTER (WHERE hit) AS reason FROM checked GROUP BY msg_id)
      SELECT msg_id, any_value(first_hit) IS NOT NULL AS is_blocked, any_value(f.reason) AS reason,
             string_agg(CASE WHEN role = 'user' AND pos < coalesce(first_hit, 1000000000) THEN final ELSE line END,
                        chr(10) ORDER BY pos) AS text
      FROM checked c JOIN firsts f USING (msg_id) GROUP BY msg_id"""


def _style(limit):
    return f"""{cte('messages')}, counted AS (SELECT msg_id,
        len(regexp_extract_all(text, {lit(WORD)})) AS n_words,
        length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) AS n_chars,
        len(regexp_extract_all(text, '[^.!?\\p{{L}}\\p{{N}}]*[\\p{{L}}\\p{{N}}][^.!?]*')) AS n_sentences FROM messages)
      SELECT msg_id, n_words, n_sentences,
             CASE WHEN n_words > 0 THEN n_chars / n_words END AS mean_word_length,
             CASE WHEN n_sentences > 0 THEN n_words / n_sentences END AS words_per_sentence,
             n_words > n_sentences * {limit} AS too_long FROM counted"""


def _reply_kind(expr):
    cases = " ".join(f"WHEN regexp_matches({expr}, {lit(phrase_pattern(p))}) THEN {lit(k)}" for k, p in REPLY_PHRASES.items())
    return f"CASE {cases} ELSE 'answer' END"


def _grams(id_col, text_col, table):
    return f"""SELECT DISTINCT {id_col}, gram FROM (
        SELECT {id_col}, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS gram
        FROM (SELECT {id_col}, {words(text_col)} AS w FROM {table}) WHERE len(w) >= 8)"""


SOURCE_KIND = "CASE WHEN tool_name <> 'vertex_ai_search' THEN 'unknown_tool'"

GATED = f"{cte('arrivals', 'presence_events')}, {INTERVALS}, gated AS (SELECT a.*, {ONLINE} AS online FROM arrivals a)"

GAPS = f"""{cte('posts')}, marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 60 SECOND THEN 0 ELSE 1 END AS fresh
      FROM posts WHERE session_id IS NOT NULL WINDOW w AS (PARTITION BY session_id ORDER BY ts)),
    spans AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS span FROM marked)
    SELECT session_id, min(ts) AS start_ts, max(ts) + INTERVAL 60 SECOND AS end_ts, count(*) AS n_messages
    FROM spans GROUP BY session_id, span"""

ATTEMPTS = f"""{cte('attempts')}, ranked AS (SELECT message_id, ok, row_number() OVER (PARTITION BY message_id
        ORDER BY ts, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS attempt_no FROM attempts),
      tallied AS (SELECT message_id, count(*) AS n, min(CASE WHEN ok THEN attempt_no END) AS first_ok
                  FROM ranked WHERE attempt_no <= 5 GROUP BY message_id)
      SELECT message_id, coalesce(first_ok, n) AS n_used,
             CASE WHEN first_ok IS NOT NULL THEN 'delivered' WHEN n >= 5 THEN 'dead_letter' ELSE 'pending' END AS outcome,
             CASE WHEN first_ok IS NULL AND n < 5 THEN least(300.0::DOUBLE, 10.0 * pow(2.0, n - 1)) END AS next_delay_s
      FROM tallied"""

HELD = f"""{cte('bursts')}, ranked AS (SELECT message_id, ok, at_s, row_number() OVER (PARTITION BY message_id
        ORDER BY at_s, l_linenumber, l_partkey, l_suppkey, cents) AS n FROM bursts),
      ahead AS (SELECT *, [0, 10, 30, 70, 150][n] AS waits FROM ranked WHERE n <= 5),
      held AS (SELECT *, max(at_s - waits) OVER (PARTITION BY message_id ORDER BY n) + waits AS takes_place FROM ahead),
      tallied AS (SELECT message_id, count(*) AS n, min(CASE WHEN ok THEN n END) AS first_ok,
                  list(takes_place ORDER BY n) AS times FROM held GROUP BY message_id)
      SELECT message_id, coalesce(first_ok, n) AS n_used,
             CASE WHEN first_ok IS NOT NULL THEN 'delivered' WHEN n >= 5 THEN 'dead_letter' ELSE 'pending' END AS outcome,
             CAST(times[coalesce(first_ok, n)] AS BIGINT) AS at_s,
             CASE WHEN first_ok IS NULL AND n < 5 THEN CAST(times[n] + [10, 20, 40, 80, 160][n] AS BIGINT) END AS next_at_s
      FROM tallied"""

CHANNEL = "'user_' || coalesce(session_id, 'None')"

OUTCOMES = f"""{GATED}, queued AS (SELECT *, message_id % 6 + 1 AS delivery_attempt FROM gated),
      judged AS (SELECT *, CASE WHEN message_id % 31 = 0 THEN 'decode_error' WHEN NOT online THEN 'offline'
                        WHEN {{failed}} THEN 'publish_error' END AS reason FROM queued)
      SELECT message_id, session_id, reason, delivery_attempt,
             CASE WHEN reason IS NULL THEN 'delivered' WHEN delivery_attempt >= 5 THEN 'dead_letter' ELSE 'retry' END AS outcome
      FROM judged"""


def oracle_sql():
    sql = {}
    sql["s1_chat_requests"] = f"""{cte('requests')} SELECT *, CASE WHEN user_id IS NULL THEN 'user_id'
        WHEN user_input IS NULL THEN 'user_input' END AS reject_reason FROM requests"""
    sql["s2_envelope_decode"] = """SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS message_id,
        CASE WHEN conv_id % 10 <> 7 THEN CAST(conv_id AS VARCHAR) END AS session_id,
        conv_id % 10 NOT IN (3, 5) AS decode_ok,
        CASE WHEN conv_id % 10 NOT IN (3, 5) THEN 'system' END AS sender,
        CASE WHEN conv_id % 10 NOT IN (3, 5) THEN text END AS content FROM conversations"""
    sql["s3_reply_encode"] = f"""{cte('agent_rows')}, {LAST_ERROR}
        SELECT invocation_id, session_id, true AS decode_ok, sender, content FROM folded"""
    sql["s4_channel_frames"] = f"""{cte('posts')} SELECT message_id, {CHANNEL} AS channel, session_id,
        'system' AS sender, content FROM posts"""
    sql["s5_client_frames_ws"] = f"""{cte('client_lines')} SELECT line_id,
        CASE WHEN json_valid(line) THEN 'message' ELSE 'raw' END AS kind,
        CASE WHEN json_valid(line) THEN line ->> '$.session_id' END AS session_id,
        CASE WHEN json_valid(line) THEN coalesce(line ->> '$.data.content', 'null') ELSE line END AS content
        FROM client_lines WHERE line <> '' AND (NOT starts_with(line, '{{')
          OR CASE WHEN json_valid(line) THEN line ->> '$.session_id' END IS NOT NULL)"""
    sql["s5_client_frames_sse"] = f"""{cte('client_lines')}, read AS (SELECT line_id, contains(line, '[DONE]') AS done,
        CASE WHEN json_valid(line) THEN line ->> '$.msg' END AS msg FROM client_lines),
      shown AS (SELECT line_id, done, CASE WHEN NOT done AND json_valid(msg) THEN msg ->> '$.data.content' END AS content FROM read)
      SELECT line_id, CASE WHEN done THEN 'done' ELSE 'message' END AS kind, content
      FROM shown WHERE done OR content IS NOT NULL"""
    sql["s6_outcome_split"] = OUTCOMES.format(failed="message_id % 10 = 0")
    sql["p1_session_resolution"] = f"""{cte('requests')} SELECT request_id, user_id,
        coalesce(nullif(header_session_id, ''), 's_' || md5(user_id || ':' || CAST(request_id AS VARCHAR))) AS session_id,
        nullif(header_session_id, '') IS NULL AS is_new
        FROM requests WHERE user_id IS NOT NULL AND user_input IS NOT NULL"""
    sql["p2_session_from_channel"] = f"{cte('channels')} SELECT *, replace(channel, 'user_', '') AS session_id FROM channels"
    sql["p3_frame_content"] = f"""{cte('client_lines')} SELECT line_id, CASE WHEN json_valid(line) THEN
        coalesce(CAST(json_extract(line, '$.data') AS VARCHAR), '{{}}') END AS content FROM client_lines"""
    sql["p4_primary_text"] = f"{cte('messages')}, {PARTS} SELECT msg_id, {PRIMARY} AS text FROM parts"
    sql["p5_prompt_rendering"] = f"""{cte('turns')}, {PAIRS}, {past()}
        SELECT session_id, turn, {_prompt()} AS prompt,
               'Todays date and time is: 2024-01-02 03:04:05' AS instruction
        FROM pairs JOIN past USING (session_id, turn)"""
    sql["g1_card_redaction"] = f"""{cte('messages')} SELECT msg_id, {redact('text')} AS redacted,
        {redact('text')} <> text AS was_redacted FROM messages"""
    sql["g1_card_parts"] = f"""{cte('messages')}, {PARTS}, chosen AS (SELECT *, {PRIMARY} AS p FROM parts)
        SELECT msg_id, {redact('p')} <> p AS was_redacted, CASE WHEN {redact('p')} <> p THEN 1 ELSE len(parts) END AS n_parts,
               CASE WHEN {redact('p')} <> p THEN {redact('p')} ELSE array_to_string(parts, chr(10)) END AS text FROM chosen"""
    sql["g2_deidentify"] = f"{cte('messages')} SELECT msg_id, {_deidentified('text')} AS text FROM messages"
    sql["g2_findings"] = _findings()
    counted = ", ".join(f"{hits('text', terms)} AS {name.lower()}" for name, terms in LEXICON.items())
    present = " + ".join(f"CASE WHEN {name.lower()} > 0 THEN 1 ELSE 0 END" for name in LEXICON)
    levels = ", ".join(f"CASE WHEN {n} > 0 THEN {n} / ({n} + 1) END AS {n}" for n in (name.lower() for name in LEXICON))
    sql["g3_moderation"] = f"""{cte('messages')}, h AS (SELECT msg_id, {counted} FROM messages)
        SELECT msg_id, CAST({present} AS INTEGER) AS n_categories, {levels} FROM h"""
    sql["g3_moderation_by_table"] = _moderation()
    sql["g3_profanity_guard"] = f"""{cte('messages')} SELECT msg_id, {profane('text')} AS is_blocked,
        CASE WHEN {profane('text')} THEN {lit(PROFANITY_REASON)} ELSE '' END AS reason FROM messages"""
    sql["g4_jailbreak_screen"] = f"""{cte('messages')} SELECT msg_id, {jailbreak('text')} AS refused,
        CASE WHEN {jailbreak('text')} THEN {lit(REFUSAL_TEXT)} END AS reply FROM messages"""
    sql["g5_tool_call_admission"] = f"""{cte('tool_queries')}, judged AS (SELECT *, {SOURCE_KIND}
        WHEN query IS NOT NULL AND len(regexp_extract_all(query, '[^ \\t\\r\\n]+')) < 2 THEN 'single_word'
        WHEN lower(query) LIKE '%financial records%' OR lower(query) LIKE '%personal employee data%' THEN 'sensitive'
        END AS reason FROM tool_queries) SELECT *, reason IS NULL AS allowed FROM judged"""
    sql["g6_guard_chain"] = f"""{cte('messages')}, g AS ({_guard_sql()})
        SELECT msg_id, is_blocked, reason, CASE WHEN is_blocked THEN reason ELSE redacted END AS final_text FROM g"""
    sql["g7_guard_message"] = _guard_parts()
    sql["g8_language"] = f"{cte('messages')} SELECT msg_id, lang, {language('text')} AS detected FROM messages"
    sql["g9_translation_worklist"] = f"""{cte('turns')}, {PAIRS}, d AS (SELECT session_id, turn, answer AS text,
        {language('question')} AS target, {language('answer')} AS source FROM pairs)
        SELECT *, target <> source AS needs_translation FROM d"""
    sql["g9_apply_translations"] = f"""{cte('turns', 'translations')}, {PAIRS}, d AS (SELECT session_id, turn, answer,
        {language('question')} <> {language('answer')} AS needs_translation FROM pairs)
        SELECT session_id, turn, needs_translation, CASE WHEN needs_translation THEN coalesce(translated, answer) ELSE answer END AS text
        FROM d LEFT JOIN translations USING (session_id, turn)"""
    sql["g10_confidence"] = f"""{cte('turns')}, {PAIRS}, {past()}, sets AS (SELECT session_id, turn,
        list_distinct({words('answer')}) AS a, {words("question || ' ' || context")} AS s
        FROM pairs JOIN past USING (session_id, turn)),
      n AS (SELECT session_id, turn, len(a) AS n, len(list_intersect(a, s)) AS hit FROM sets)
      SELECT session_id, turn, CASE WHEN n = 0 OR hit * 3 < n THEN 'low' WHEN hit * 3 < n * 2 THEN 'medium' ELSE 'high' END AS confidence FROM n"""
    sql["g10_confidence_long"] = sql["g10_confidence"].replace(cte("turns"), cte("long_turns")).replace(PAIRS, LONG_PAIRS).replace(
        past(), past(turns="long_turns")).replace("JOIN past USING (session_id, turn)",
                                                  "JOIN past ON pairs.turn = past.turn AND pairs.session_id IS NOT DISTINCT FROM past.session_id").replace(
        "sets AS (SELECT session_id, turn,", "sets AS (SELECT pairs.session_id, pairs.turn,")
    sql["g10_normalise_label"] = f"""{cte('raw_labels')} SELECT doc_id, raw,
        CASE WHEN lower(trim(raw)) IN ('low', 'medium', 'high') THEN lower(trim(raw)) END AS label FROM raw_labels"""
    sql["g11_refusal_tags"] = f"""{cte('replies')}, r AS (SELECT msg_id,
        CASE WHEN {jailbreak('text')} THEN {lit(REFUSAL_TEXT)} ELSE text END AS text FROM replies)
        SELECT msg_id, {_reply_kind('text')} AS reply_kind FROM r"""
    sql["g12_style_audit"] = _style(12)
    sql["j1_presence_gate"] = f"{GATED} SELECT * FROM gated"
    sql["j2_subscriptions"] = f"""{cte('posts', 'subscriptions')} SELECT message_id, {CHANNEL} AS channel, subscriber_id
        FROM posts JOIN subscriptions ON {CHANNEL} GLOB pattern"""
    sql["j3_direct_delivery"] = f"""{cte('arrivals', 'presence_events')},
      last AS (SELECT session_id, ts, arg_max(kind, event_id) AS kind, max(event_id) AS event_id
               FROM presence_events GROUP BY session_id, ts),
      tried AS (SELECT a.*, CASE WHEN e.kind = 'connect' THEN e.event_id END AS conn
                FROM arrivals a ASOF LEFT JOIN last e ON a.session_id = e.session_id AND a.ts >= e.ts),
      fails AS (SELECT *, min(CASE WHEN message_id % 50 = 7 THEN (ts, message_id) END) OVER (PARTITION BY conn) AS first_fail FROM tried),
      judged AS (SELECT *, CASE WHEN conn IS NULL OR (first_fail IS NOT NULL AND (ts, message_id) > first_fail) THEN 'no_connection'
                 WHEN message_id % 50 = 7 THEN 'send_failed' ELSE 'delivered' END AS status FROM fails)
      SELECT message_id, session_id, status, CASE WHEN status <> 'no_connection' THEN conn END AS connection_id FROM judged"""
    sql["j4_leakage"] = f"""{cte('messages')}, t AS ({_grams('msg_id', 'text', 'messages')}),
        p AS ({_grams('item_id', 'text', 'benchmark')})
        SELECT msg_id, item_id, count(*) AS n_shared FROM t JOIN p USING (gram) GROUP BY msg_id, item_id"""

    sql["j4_protected_passages"] = f"""{cte('messages')}, p AS ({_grams('item_id', 'text', 'benchmark')}),
      w AS (SELECT msg_id, {words("text")} AS ws FROM messages),
      g AS (SELECT msg_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (
            SELECT msg_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
      h AS (SELECT msg_id, item_id, i, i - row_number() OVER (PARTITION BY msg_id, item_id ORDER BY i) AS island FROM g JOIN p USING (gram))
      SELECT msg_id, item_id, min(i) - 1 AS first_word, max(i) + 6 AS last_word, max(i) - min(i) + 8 AS n_words
      FROM h GROUP BY msg_id, item_id, island"""
    sql["j5_retrieval"] = f"""{cte('queries', 'corpus')}, s AS (SELECT query_id, doc_id,
        round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score FROM queries q, corpus c),
      r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s)
      SELECT * FROM r WHERE rank <= 5"""
    sql["a1_reply_fold"] = f"{cte('agent_rows')}, {LAST_ERROR} SELECT * FROM folded"
    sql["a1_reply_pieces"] = f"""{cte('agent_rows')}, marked AS (SELECT *, {APPENDS} AS appends, CAST(floor(seq / 4) AS BIGINT) AS chunk,
        max(CASE WHEN NOT {APPENDS} AND error_code IS NOT NULL THEN seq END)
          OVER (PARTITION BY session_id, invocation_id, CAST(floor(seq / 4) AS BIGINT)) AS error_at FROM agent_rows)
      SELECT session_id, invocation_id, chunk, max(error_at) IS NOT NULL AS reset, coalesce(
        string_agg(coalesce(text, content_str), '' ORDER BY seq) FILTER (WHERE appends AND (error_at IS NULL OR seq > error_at)), '') AS text
      FROM marked GROUP BY ALL"""
    sql["a1_reply_fold_failed"] = f"""{cte('agent_rows', 'failed_runs')}, {LAST_ERROR} SELECT session_id, invocation_id, sender,
        CASE WHEN invocation_id IN (SELECT invocation_id FROM failed_runs) THEN 'system_error' ELSE content END AS content FROM folded"""
    sql["a2_receiver_counts"] = f"""{cte('posts', 'subscriptions')} SELECT message_id, {CHANNEL} AS channel,
        count(subscriber_id) AS n_receivers FROM posts LEFT JOIN subscriptions ON {CHANNEL} GLOB pattern GROUP BY ALL"""
    sql["a3_outcome_report"] = f"""WITH g AS ({sql['g6_guard_chain']}), t AS ({sql['g5_tool_call_admission']}),
      d AS ({sql['s6_outcome_split']}), m AS ({cte('messages')} SELECT msg_id, text FROM messages),
      o AS (SELECT 'guard' AS stage, CASE WHEN is_blocked THEN reason WHEN final_text <> text THEN 'modified' ELSE 'passed' END AS reason
              FROM g JOIN m USING (msg_id)
            UNION ALL SELECT 'tool', coalesce(reason, 'allowed') FROM t
            UNION ALL SELECT 'delivery', coalesce(reason, 'delivered') FROM d)
      SELECT stage, reason, count(*) AS n, CAST(grouping(stage, reason) AS INTEGER) AS level FROM o GROUP BY ROLLUP (stage, reason)"""
    sql["w1_pending_user_turns"] = f"""{cte('turns')} SELECT session_id, turn, text FROM (SELECT *, row_number() OVER (
        PARTITION BY session_id ORDER BY turn DESC) AS n FROM turns) WHERE n = 1 AND role = 'user'"""
    sql["w2_qa_pairs"] = f"{cte('turns')}, {PAIRS} SELECT * FROM pairs"
    sql["w3_history"] = f"{cte('turns')}, {past()} SELECT * FROM past"
    sql["w3_history_offsets"] = f"""{cte('turns')} SELECT session_id, turn, count(*) OVER w AS n_turns_before,
        CAST(coalesce(sum(length(text)) OVER w, 0) AS BIGINT) AS n_chars_before FROM turns
        WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
    sql["w2_qa_pairs_long"] = f"{cte('long_turns')}, {LONG_PAIRS} SELECT * FROM pairs"
    sql["w3_history_long"] = f"{cte('long_turns')}, {past(20, 'long_turns')} SELECT * FROM past"
    sql["w3_history_offsets_long"] = sql["w3_history_offsets"].replace(cte("turns"), cte("long_turns")).replace("FROM turns", "FROM long_turns")
    sql["w3_transcript_pieces"] = f"""{cte('long_turns')} SELECT session_id, CAST(floor(turn / {8 * LONG_CHUNK}) AS BIGINT) AS piece,
        min(turn) AS first_turn, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text
        FROM long_turns GROUP BY ALL"""
    sql["w4_delivery_attempts"] = ATTEMPTS
    sql["w4_publish_retry"] = ATTEMPTS.replace("attempt_no <= 5", "attempt_no <= 8").replace("n >= 5", "n >= 8").replace(
        "n < 5 THEN least(300.0::DOUBLE, 10.0 * pow(2.0, n - 1))", "n < 8 THEN round(least(60.0::DOUBLE, 0.1 * pow(1.3, n - 1)), 6)")
    sql["w4_held_attempts"] = sql["t4_held_redelivery_stream"] = HELD
    sql["w5_presence_intervals"] = f"""{cte('presence_events')}, {INTERVALS}
        SELECT session_id, connection_id, start_ts, end_ts FROM intervals"""
    sql["w5_online_spans"] = f"""{cte('presence_events')}, {INTERVALS}, {SPANS}
        SELECT session_id, start_ts, end_ts, n_intervals FROM spans"""
    sql["w5_online_over_time"] = f"""{cte('presence_events')}, {INTERVALS}, {SPANS},
        borders AS (SELECT start_ts AS ts, 1 AS step FROM spans UNION ALL SELECT end_ts, -1 FROM spans),
        changes AS (SELECT ts, count(*) FILTER (WHERE step > 0) AS came, count(*) FILTER (WHERE step < 0) AS "left" FROM borders GROUP BY ts)
        SELECT ts, came, "left", CAST(sum(came - "left") OVER (ORDER BY ts) AS BIGINT) AS online FROM changes"""
    sql["t3_sliding_presence_batch"] = GAPS
    sql["u1_custom_rail"] = f"""{cte('messages')}, s AS (SELECT msg_id,
        text || CASE WHEN msg_id % 7 = 0 THEN '!!!' ELSE '' END AS text FROM messages)
        SELECT msg_id, {jailbreak('text')} AS is_blocked, CASE WHEN {jailbreak('text')} THEN {lit(REFUSAL_TEXT)} END AS reason,
        CASE WHEN {jailbreak('text')} THEN {lit(REFUSAL_TEXT)} ELSE regexp_replace(text, '!{{2,}}', '!', 'g') END AS final_text FROM s"""
    sql["u2_model_rail"] = f"""{cte('messages')}, s AS (SELECT msg_id, contains(text, '|') AS failed,
        len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1) > 0.01 AS over FROM messages),
      j AS (SELECT msg_id, failed, over AND NOT failed AS open_blocked, failed OR over AS closed_blocked FROM s)
      SELECT msg_id, failed, open_blocked, CASE WHEN open_blocked THEN 'Digits detected' ELSE '' END AS open_reason,
             closed_blocked, CASE WHEN failed THEN {lit(PROFANITY_ERROR_REASON)} WHEN closed_blocked THEN 'Digits detected' ELSE '' END AS closed_reason
      FROM j"""
    sql["u2_worker_model"] = f"""{cte('messages')} SELECT msg_id,
        CASE WHEN NOT contains(text, '|') THEN round(len(regexp_extract_all(text, '[0-9]')) / greatest(length(text), 1), 6) END AS digit_share,
        CASE WHEN contains(text, '|') THEN 'ValueError: cannot read tables' END AS error FROM messages"""
    # A stream over the whole input answers the same question as its batch twin.
    sql["t1_envelope_stream"] = f"""WITH judged AS ({OUTCOMES.format(failed="message_id % 10 = 0")})
      SELECT message_id, judged.session_id, reason, outcome, delivery_attempt,
             CASE WHEN reason IS NULL THEN 'user_' || coalesce(judged.session_id, 'None') END AS channel,
             CASE WHEN reason IS NULL THEN event_type END AS content FROM judged JOIN events ON message_id = event_id"""
    sql["s2_queue_log_stream"] = sql["s2_envelope_decode"]
    sql["s3_queue_log_sink"] = sql["s3_reply_encode"]
    sql["t2_presence_stream"] = sql["j1_presence_gate"]
    sql["t3_sliding_presence_stream"] = GAPS
    sql["t4_redelivery_stream"] = ATTEMPTS
    sql["t5_guard_stream"] = sql["g6_guard_chain"]
    sql["t6_reply_fold_stream"] = sql["a1_reply_fold"]
    return sql
