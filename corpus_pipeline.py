"""A corpus pipeline of five operators over the documents table.

Each stage works on all rows that the stage before it kept and is written as Parquet
before the next one reads it. All stages but the last keep the columns of the documents.
"""

import public_tokenizers

from chatloom.llm import bpe, langid, mixing, neardup, secret_scan
from chatloom.session import shared_folder

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A language must be this probable for a document to stay.
LEAST_LANGUAGE_SCORE = 0.5
#: Passes over a source at most; the largest source is passed over once.
MOST_REPEATS = 2.0


def language_id(spark, docs, sf_dir):
    """Documents whose language is found; a document without letters, or of no clear language, goes.

    The model learns from the labelled documents of this stage. The language column stays
    as it is. A null id is kept or rejected by its text like any other; repeated rows alike.
    """
    learned = langid.fit(docs)
    return langid.accepted(docs, learned, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark, docs, sf_dir):
    """One document, that with the smallest id, of each group of near duplicates.

    Links need 80 per cent of the five-word shingles. Documents without words are linked
    with nothing and stay, as do rows without an id; rows that repeat an id and its text
    are copies of one document, of which one stays.
    """
    return neardup.deduplicated(docs, width=5, percent=80)


def secrets(spark, docs, sf_dir):
    """All documents, with secrets replaced by a mark and ``n_chars`` counted anew where text changed."""
    return secret_scan.redact(docs, length_col="n_chars")


def source_mix(spark, docs, sf_dir):
    """Documents as often as the mix has them: the largest source once, smaller ones up to twice."""
    return mixing.mixed(docs, budget=mixing.COVER, most_repeats=MOST_REPEATS)


def token_ids(spark, docs, sf_dir):
    """Token ids of every row: ``doc_id``, ``n_tokens``, digests of the ids and of the decoded bytes."""
    return bpe.digests(bpe.round_trip(docs, RANK_FILE, public_tokenizers.PATTERN))


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE", token_ids),
]

#: Language identification and token ids cannot be written in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents; each is written to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_folder(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
