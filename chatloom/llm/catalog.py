"""The operators as named queries over their whole tables, with production parameters."""

import public_tokenizers
from pyspark.sql import functions as F

from chatloom.llm import ann, bpe, html_text, langid, lm, mixing, neardup, negatives, part_codes, quality, secret_scan, vector_dedup, vector_sql, warc
from chatloom.llm.columns import table

QUERIES = {}
ORACLES = {}

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_byte_bpe(spark, d):
    """Encode every document, decode the ids, and give digests of both."""
    return bpe.digests(bpe.round_trip(table(spark, d, "documents"), RANK_FILE, public_tokenizers.PATTERN))


@query
def op2_hilbert_neighbours(spark, d):
    """The 20 nearest found by inner product, for every vector whose id is divisible by 20."""
    return ann.nearest(table(spark, d, "embeddings"), k=20, every=20)


@query
def op3_quality_rules(spark, d):
    """Base measures of every document and the verdict of the label model."""
    return quality.judge(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@query
def op4_source_mixing(spark, d):
    """Copies of every document when sources are mixed at the tokens of the corpus, none repeated over four times."""
    return mixing.mix_sources(table(spark, d, "documents"), most_repeats=4.0)


@query
def op5_attention_lm(spark, d):
    """Base and model scores of every document."""
    return lm.score(table(spark, d, "documents"), RANK_FILE, public_tokenizers.PATTERN)


@query
def op6_minhash_near_duplicates(spark, d):
    """Component of every document by links of at least 85 per cent of 3-word shingles."""
    return neardup.near_duplicates(table(spark, d, "documents"), width=3, percent=85)


@query
def op7_html_text(spark, d):
    """Main text of every page."""
    return html_text.extract(table(spark, d, "pages"))


@query
def op8_language_id(spark, d):
    """Language of every document by a model of those that are not held out."""
    docs = table(spark, d, "documents")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score")


@query
def op9_secret_scan(spark, d):
    """Counts, positions and a digest of the secrets in every document."""
    return secret_scan.digests(secret_scan.scan(table(spark, d, "documents")))


@query
def op10_warc_packages(spark, d):
    """Write every page to packages of WARC records and read all records back."""
    records = warc.read_packages(warc.archive(table(spark, d, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_hard_negatives(spark, d):
    """Rows of other labels that score just below an anchor's positives; every seventh row has a wrong label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.mine(table(spark, d, "embeddings").withColumn("label", label))


@query
def op12_vector_near_duplicates(spark, d):
    """Links and component of every vector by cosines of at least 0.93 within a label."""
    return vector_dedup.near_duplicates(table(spark, d, "embeddings"), least=0.93)


@query
def op13_part_codes(spark, d):
    """Four bytes for every vector, by codebooks of 256 entries for each quarter."""
    vectors = table(spark, d, "embeddings")
    books = part_codes.train(vectors)
    return part_codes.digests(part_codes.encode(vectors, books), books)


ORACLES["op11_hard_negatives"] = vector_sql.HARD_NEGATIVES
ORACLES["op12_vector_near_duplicates"] = vector_sql.NEAR_DUPLICATES
ORACLES["op13_part_codes"] = vector_sql.part_codes()
ORACLES["op10_warc_packages"] = """
WITH p AS (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


ORACLES["op4_source_mixing"] = r"""
WITH RECURSIVE counted AS (
    SELECT doc_id, coalesce(source, '') AS source,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
    FROM documents
), totals AS (
    SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM counted GROUP BY source HAVING sum(n_tokens) > 0
), everything AS (
    SELECT CAST(sum(tokens) AS BIGINT) AS all_tokens FROM totals
), halving(step, low, high, done) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE,
           (SELECT max(1.0 / tokens) * all_tokens / count(*) <= 4.0 FROM totals, everything GROUP BY all_tokens)
    UNION ALL
    SELECT step + 1, CASE WHEN ok THEN low ELSE middle END, CASE WHEN ok THEN middle ELSE high END, done
    FROM (
        SELECT step, low, high, done, (low + high) / 2 AS middle,
               (SELECT max(pow(tokens / all_tokens, (low + high) / 2) / tokens) * all_tokens / sum(pow(tokens / all_tokens, (low + high) / 2))
                FROM totals, everything GROUP BY all_tokens) <= 4.0 AS ok
        FROM halving WHERE step < 40
    )
), chosen AS (
    SELECT CASE WHEN done THEN 0.0 ELSE high END AS exponent FROM halving WHERE step = 40
), mix AS (
    SELECT source, tokens, docs, exponent,
           CAST(round(pow(tokens / all_tokens, exponent) / sum(pow(tokens / all_tokens, exponent)) OVER () * 1000000000) AS BIGINT) AS n,
           all_tokens
    FROM totals, everything, chosen
), wanted AS (
    SELECT *, CAST(floor(n * CAST(all_tokens AS DOUBLE) / 1000000000) AS BIGINT) AS wanted FROM mix
), rows AS (
    SELECT doc_id, source, n_tokens, tokens, exponent, n, wanted,
           CAST(('0x' || substr(md5(source || '/' || CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) % CAST(ceil(sqrt(docs)) AS BIGINT) AS block,
           CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/' || source), 1, 15)) AS BIGINT) AS place
    FROM counted JOIN wanted USING (source)
), ordered AS (
    SELECT *, CAST(coalesce(sum(n_tokens) OVER (
        PARTITION BY source
        ORDER BY CAST(('0x' || substr(md5(source || '/' || CAST(block AS VARCHAR)), 1, 15)) AS BIGINT), block, place, doc_id, n_tokens
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts_at
    FROM rows
)
SELECT doc_id, source, n_tokens, round(exponent, 9) AS exponent, n / 1000000000 AS weight, wanted, block,
       wanted // tokens + CASE WHEN starts_at < wanted % tokens THEN 1 ELSE 0 END AS copies
FROM ordered
"""
