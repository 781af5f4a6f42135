"""Card redaction and de-identification by info type."""

from functools import reduce

from pyspark.sql import functions as F

# The card pattern, its replacement and the default replacement.
CARD_PATTERN = r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"
CARD_REPLACEMENT = "[REDACTED_CARD_NUMBER]"
DEFAULT_REPLACEMENT = "[REDACTED]"

# Patterns per info type, in the order in which they are applied: a card number
# would also match as a phone number, so it goes first.
INFO_TYPES = {
    "CREDIT_CARD_NUMBER": CARD_PATTERN,
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
    "PHONE_NUMBER": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\b\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}\b",
}

# Stands for a finding until all types are done, so that a replacement text that
# looks like an address or a number is not found again.
_MARK = "\ue000\ue001\ue000"


def redact_card_text(col):
    return F.regexp_replace(col, CARD_PATTERN, CARD_REPLACEMENT)


def _ordered(info_types):
    unknown = set(info_types) - set(INFO_TYPES)
    if unknown:
        raise ValueError(f"unknown info types: {sorted(unknown)}")
    return [t for t in INFO_TYPES if t in set(info_types)]


# Every match holds an at sign (mail) or a run like this (cards, addresses, phones).
# Looking for these first is cheaper than the patterns themselves.
_NUMBER_RUN = r"[0-9][0-9 .()-]{5}"


def may_hold(col, info_types):
    """False only for texts that hold no finding of the given types."""
    wanted = _ordered(info_types)
    tests = [col.contains("@")] if "EMAIL_ADDRESS" in wanted else []
    if set(wanted) - {"EMAIL_ADDRESS"}:
        tests.append(col.rlike(_NUMBER_RUN))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def deidentified(col, info_types, replacement=DEFAULT_REPLACEMENT):
    """``col`` with every finding of the given types replaced by one string."""
    out = col
    for info_type in _ordered(info_types):
        out = F.regexp_replace(out, INFO_TYPES[info_type], _MARK)
    replaced = F.replace(out, F.lit(_MARK), F.lit(replacement))
    return F.when(may_hold(col, info_types), replaced).otherwise(col)


def findings(col, info_types):
    """Number of findings per type, as (type, count) column pairs in applied order."""
    pairs, rest, possible = [], col, may_hold(col, info_types)
    for info_type in _ordered(info_types):
        pattern = INFO_TYPES[info_type]
        n = F.when(possible, F.regexp_count(rest, F.lit(pattern))).otherwise(0)
        pairs.append((info_type, n.cast("bigint")))
        rest = F.regexp_replace(rest, pattern, _MARK)
    return pairs
