"""Answers whose language differs from that of their question."""

from pyspark.sql import functions as F

from chatloom.functions.language import detect_language


def translation_worklist(pairs):
    """Add ``needs_translation``, ``target``, ``source`` and ``text`` (still the answer)."""
    return pairs.withColumns({
        "target": detect_language(F.col("question")),
        "source": detect_language(F.col("answer")),
    }).withColumns({"needs_translation": F.col("target") != F.col("source"), "text": F.col("answer")})


def apply_translations(worklist, translations, keys=("session_id", "turn")):
    """Put supplied translations into ``text``; one that is missing leaves the answer.

    ``translations`` has the keys and ``translated``. The flag stays true either way.
    """
    keys = list(keys)
    supplied = translations.select(*keys, F.col("translated").alias("__translated"))
    joined = worklist.join(supplied, keys, "left")
    text = F.when(F.col("needs_translation"), F.coalesce("__translated", "text")).otherwise(F.col("text"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in worklist.columns])
