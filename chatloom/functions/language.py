"""Language of a text from stop-word evidence."""

from pyspark.sql import functions as F

from chatloom.functions.text import bound, words

UNDETERMINED = "und"

# Frequent function words; the order of the languages decides ties.
STOP_WORDS = {
    "en": "the and of to in is that for it with as was are this be by from on which or",
    "fr": "le la les des et est une un du que qui dans pour sur pas avec ce au par plus",
    "de": "der die das und ist nicht ein eine zu den mit von auf dem sich des im für auch als",
    "es": "el la los las de que y en una es por con para del se su al no como más",
}


def evidence(col, stop_words=None):
    """Number of stop-word occurrences per language, in the order of ``stop_words``."""
    lists = [sorted(set(text.split())) for text in (stop_words or STOP_WORDS).values()]
    all_words = sorted(set().union(*lists))

    def occurrences(listed):
        return lambda known: F.size(F.filter(known, lambda t: t.isin(listed)))

    known = F.filter(words(col), lambda t: t.isin(all_words))
    return bound(known, lambda k: F.array(*[occurrences(listed)(k) for listed in lists]))


def detect_language(col, stop_words=None):
    """Code of the language with most evidence, the first one on a tie; ``und`` without any."""
    codes = F.array(*[F.lit(lang) for lang in (stop_words or STOP_WORDS)])

    def best(counts):
        at = F.array_position(counts, F.array_max(counts)).cast("int")
        return F.when(F.array_max(counts) > 0, F.element_at(codes, at)).otherwise(UNDETERMINED)

    return F.coalesce(bound(evidence(col, stop_words), best), F.lit(UNDETERMINED))
