"""Text expressions: tokens, n-grams, primary text, prompts, style and phrases."""

import re
from functools import reduce

from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(col):
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0))


def bound(value, body):
    """``body`` of a value that is computed once, however often the body uses it.

    Inside a lambda the optimizer does not share repeated parts, so a costly value
    goes through a one-element array.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ngrams(tokens, n):
    """All runs of ``n`` tokens joined by a blank; empty for shorter inputs."""
    def of(ws):
        starts = F.sequence(F.lit(1), F.size(ws) - (n - 1))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(ws, i, n), " "))
        return F.when(F.size(ws) >= n, grams).otherwise(F.array().cast("array<string>"))

    return bound(tokens, of)


def phrase_pattern(phrases):
    """A regular expression that finds any phrase as whole words, ignoring case.

    The word borders are consumed instead of looked at, so that engines without
    look-around read the same pattern. ``*`` stands for one arbitrary word.
    """
    def one(phrase):
        parts = [WORD if w == "*" else re.escape(w) for w in phrase.lower().split()]
        return r"[ \t\r\n]+".join(parts)

    body = "|".join(one(p) for p in phrases)
    return rf"(?i)(^|[^\p{{L}}\p{{N}}])({body})($|[^\p{{L}}\p{{N}}])"


def holds_any(text, terms):
    """Whether the lower-cased text holds any term as a substring.

    A byte search, many times faster than a regular expression; used to skip the
    expression on texts it cannot match.
    """
    terms = list(dict.fromkeys(terms))
    return bound(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.contains(t) for t in terms]))


def has_phrase(text, phrases):
    """Whether the text holds any of the phrases as whole words, ignoring case."""
    longest = [max((w for w in p.lower().split() if w != "*"), key=len) for p in phrases]
    return holds_any(text, longest) & text.rlike(phrase_pattern(phrases))


def run_hashes(tokens, n):
    """A hash of every run of ``n`` tokens, in order and with repeats; empty for shorter inputs.

    Each token is hashed once, and a run is the hash of its tokens' hashes, so no run is written out.
    """
    def of(hashes):
        runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))
        return F.when(F.size(hashes) >= n, runs).otherwise(F.array().cast("array<bigint>"))

    return bound(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def primary_text(parts):
    """First non-empty ``text`` of a parts array, ``''`` when there is none."""
    non_empty = F.filter(parts, lambda p: p["text"] != "")
    return F.coalesce(F.try_element_at(non_empty, F.lit(1))["text"], F.lit(""))


def render(template, bindings):
    """Replace every ``{name}`` of a template by its binding (a column or a string).

    All bindings are applied in one pass: text that a value brings in is never read
    as a placeholder of another one. A missing value renders as the empty string.
    """
    bound = {n: F.coalesce(F.lit(v) if isinstance(v, str) else v, F.lit("")) for n, v in bindings.items()}
    if not bound:
        return F.lit(template)
    hole = r"\{(" + "|".join(map(re.escape, bound)) + r")\}"
    pieces = re.split(hole, template)
    return F.concat(*[bound[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


# Fixed value: the wording of the date instruction.
DATE_INSTRUCTION = "Todays date and time is: "


def date_instruction(now=None):
    """The extra instruction that tells the model the time."""
    now = F.current_timestamp() if now is None else now
    return F.concat(F.lit(DATE_INSTRUCTION), F.date_format(now, "yyyy-MM-dd HH:mm:ss"))


def style(col, max_words_per_sentence):
    """Readability counts of a text as a dict of named columns."""
    n_words = F.regexp_count(col, F.lit(WORD)).cast("bigint")
    n_chars = F.length(F.regexp_replace(col, r"[^\p{L}\p{N}]+", "")).cast("bigint")
    # A sentence is a stretch between end marks that holds a letter or digit.
    n_sentences = F.regexp_count(
        col, F.lit(r"[^.!?\p{L}\p{N}]*[\p{L}\p{N}][^.!?]*")).cast("bigint")
    per_sentence = F.when(n_sentences > 0, n_words / n_sentences)
    return {
        "n_words": n_words,
        "n_sentences": n_sentences,
        "mean_word_length": F.when(n_words > 0, n_chars / n_words),
        "words_per_sentence": per_sentence,
        "too_long": F.coalesce(n_words > n_sentences * max_words_per_sentence, F.lit(False)),
    }
