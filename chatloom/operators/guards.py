"""Guard operators over message tables."""

from pyspark.sql import functions as F

from chatloom.functions.rails import Outcome, chain, lexicon_categories
from chatloom.functions.redaction import CARD_REPLACEMENT, DEFAULT_REPLACEMENT, deidentified, findings, redact_card_text
from chatloom.functions.text import WORD, bound, has_phrase, primary_text, style, words

__all__ = ["redact_cards", "redact_card_parts", "deidentify", "inspect", "moderate", "moderate_by_table",
           "jailbreak_screen", "tool_call_guard", "apply_guards", "guard_message", "tag_refusals", "style_audit",
           "CARD_REPLACEMENT"]


_OUTCOME_PARTS = ("is_blocked", "blocked_reason", "modified_text")


def redact_cards(df, col):
    """Add ``redacted`` and ``was_redacted``."""
    redacted = redact_card_text(F.col(col))
    return df.withColumns({"redacted": redacted, "was_redacted": F.coalesce(redacted != F.col(col), F.lit(False))})


def redact_card_parts(df, parts_col):
    """Redact the primary text of a parts array.

    When it changes, that one part becomes the whole array; otherwise all parts stay.
    """
    text = primary_text(F.col(parts_col))
    redacted = redact_card_text(text)
    changed = redacted != text
    one = F.array(F.struct(redacted.alias("text")))
    return df.withColumns({"was_redacted": changed, parts_col: F.when(changed, one).otherwise(F.col(parts_col))})


def deidentify(df, col, info_types, replacement=DEFAULT_REPLACEMENT):
    """Replace every finding of the given info types in ``col`` by one string."""
    return df.withColumn(col, deidentified(F.col(col), info_types, replacement))


def inspect(df, id_col, col, info_types):
    """(id, info_type, n) for every type found in a text."""
    pairs = findings(F.col(col), info_types)
    counted = df.select(id_col, *[n.alias(t) for t, n in pairs])
    return counted.unpivot(id_col, [t for t, _ in pairs], "info_type", "n").filter("n > 0")


def moderate(df, col, lexicon):
    """Add ``categories`` from a lexicon that is small enough to be part of the plan."""
    return df.withColumn("categories", lexicon_categories(F.col(col), lexicon))


def moderate_by_table(df, id_col, col, lexicon):
    """(id, name, confidence) rows from a lexicon table (category, term) of any size.

    Texts and lexicon meet on single words; a term that is not one word fails the job,
    for it could never be found this way. Spark broadcasts the lexicon when its measured
    size allows, and then only words that are in it ever leave their task.
    """
    tokens = df.select(id_col, F.explode_outer(words(F.col(col))).alias("term"))
    term = F.lower("term")
    one_word = F.when(term.rlike(f"^{WORD}$"), term).otherwise(
        F.raise_error(F.concat(F.lit("not a single word: "), F.col("term"))).cast("string"))
    terms = lexicon.where("term is not null").select("category", one_word.alias("term")).distinct()
    hits = tokens.join(terms, "term").groupBy(id_col, F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("__n"))
    return hits.select(id_col, "name", (F.col("__n") / (F.col("__n") + 1)).alias("confidence"))


def jailbreak_screen(df, col, rail):
    """Add ``refused`` and ``reply`` (the refusal text, NULL where the text may go on)."""
    outcome = rail.process(F.col(col))
    return df.withColumns({"refused": outcome.is_blocked,
                           "reply": F.when(outcome.is_blocked, outcome.blocked_reason)})


# The one allowed tool, its argument, and the phrases it must not search.
ALLOWED_TOOL = "vertex_ai_search"
QUERY_ARGUMENT = "query"
SENSITIVE_PHRASES = ["financial records", "personal employee data"]


def tool_call_guard(df):
    """Add ``allowed`` and ``reason`` to rows of (tool_name, tool_args map)."""
    query = F.lower(F.try_element_at(F.col("tool_args"), F.lit(QUERY_ARGUMENT)))
    has_query = F.map_contains_key(F.col("tool_args"), QUERY_ARGUMENT)
    n_words = F.regexp_count(query, F.lit(r"(?U)\S+"))
    sensitive = F.lit(False)
    for phrase in SENSITIVE_PHRASES:
        sensitive = sensitive | query.contains(phrase)
    reason = (F.when(~F.col("tool_name").eqNullSafe(ALLOWED_TOOL), "unknown_tool")
              .when(has_query & query.isNull(), "invalid_query")
              .when(has_query & (n_words < 2), "single_word")
              .when(has_query & sensitive, "sensitive"))
    return df.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def apply_guards(df, col, rails):
    """Add ``is_blocked``, ``reason`` and ``final_text``; every rail sees the original text.

    Each rail is evaluated once, in a projection of its own below the merge.
    """
    outcomes = [r.process(F.col(col)) for r in rails]
    evaluated = df.withColumns({
        f"__{part}_{i}": getattr(o, part) for i, o in enumerate(outcomes) for part in _OUTCOME_PARTS})
    named = [Outcome(*[F.col(f"__{part}_{i}") for part in _OUTCOME_PARTS]) for i in range(len(outcomes))]
    blocked, reason, final = chain(F.col(col), named)
    merged = evaluated.withColumns({"is_blocked": blocked, "reason": reason, "final_text": final})
    return merged.drop(*[c for c in evaluated.columns if c not in df.columns])


def guard_message(df, parts_col, rails, role_col="role"):
    """Run the chain over the parts of a message and add ``is_blocked`` and ``reason``.

    Only user messages are checked and empty parts are skipped. The first blocked
    part ends the check: parts before it keep their changes, it and the parts after
    it stay as they came.
    """
    def checked(part):
        outcomes = [r.process(part["text"]) for r in rails]
        evaluated = F.struct(*[F.struct(*[getattr(o, p).alias(p) for p in _OUTCOME_PARTS]).alias(f"r{i}")
                               for i, o in enumerate(outcomes)])

        def merged(outcomes):
            named = [Outcome(*[outcomes[f"r{i}"][p] for p in _OUTCOME_PARTS]) for i in range(len(rails))]
            blocked, reason, final = chain(part["text"], named)
            return F.struct(blocked.alias("blocked"), reason.alias("reason"),
                            F.when(blocked, part["text"]).otherwise(final).alias("text"))

        unchecked = F.struct(F.lit(False).alias("blocked"), F.lit(None).cast("string").alias("reason"), part["text"].alias("text"))
        return F.when(part["text"] != "", bound(evaluated, merged)).otherwise(unchecked)

    is_user = F.col(role_col) == "user"
    outcomes = df.withColumn("__outcomes", F.when(is_user, F.transform(F.col(parts_col), checked)))
    first = F.array_position(F.transform("__outcomes", lambda o: o["blocked"]), True)
    located = outcomes.withColumn("__first", F.coalesce(first, F.lit(0)))
    before = F.when(F.col("__first") > 0, F.col("__first") - 1).otherwise(F.size("__outcomes"))
    merged = F.zip_with(
        F.col(parts_col), F.slice(F.col("__outcomes"), F.lit(1), F.greatest(before, F.lit(0)).cast("int")),
        lambda part, done: F.struct(F.when(done.isNull(), part["text"]).otherwise(done["text"]).alias("text")))
    return located.withColumns({
        "is_blocked": F.col("__first") > 0,
        "reason": F.try_element_at(F.col("__outcomes"), F.nullif(F.col("__first"), F.lit(0)).cast("int"))["reason"],
        parts_col: F.when(is_user, merged).otherwise(F.col(parts_col)),
    }).drop("__outcomes", "__first")


REPLY_PHRASES = {
    "refusal": ["i'm designed to follow my instructions carefully", "i cannot provide", "i can't help with",
                "i am unable to"],
    "not_found": ["couldn't find", "could not find", "wasn't able to find"],
}


def tag_refusals(df, col, phrases=None):
    """Add ``reply_kind``: the first category with a matching phrase, else ``answer``."""
    kind = F.lit("answer")
    for category, listed in reversed(list((phrases or REPLY_PHRASES).items())):
        kind = F.when(has_phrase(F.col(col), listed), category).otherwise(kind)
    return df.withColumn("reply_kind", kind)


def style_audit(df, col, max_words_per_sentence=12):
    """Add word and sentence counts, their ratios and a flag for long sentences."""
    return df.withColumns(style(F.col(col), max_words_per_sentence))
