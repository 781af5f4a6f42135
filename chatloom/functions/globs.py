"""Glob patterns of channel subscriptions as column expressions."""

from pyspark.sql import functions as F

# An escaped character, a bracket set (closed or not), or one character.
_PIECE = r"(?s)\\.|\[(?:\\.|[^\]\\])*\]?|."
_SET_PIECE = r"(?s)(?:\\.|[^\\])-(?:\\.|[^\\])|\\.|."
_META = r"[*?\[\\]"


def _code(char):
    """The character as a hexadecimal escape, which is literal everywhere in a pattern."""
    return F.concat(F.lit("\\x{"), F.hex(F.ascii(char)), F.lit("}"))


def _unescaped(piece):
    return F.when((F.length(piece) > 1) & piece.startswith("\\"), piece.substr(2, 1)).otherwise(piece)


def _set_regex(piece):
    inner = F.regexp_replace(piece.substr(F.lit(2), F.length(piece)), r"(?s)(?<!\\)\]$", "")
    negated = inner.startswith("^")
    body = F.when(negated, inner.substr(F.lit(2), F.length(inner))).otherwise(inner)

    def element(e):
        ends = F.regexp_extract_all(e, F.lit(r"(?s)\\.|."), F.lit(0))
        first, last = _unescaped(F.get(ends, F.lit(0))), _unescaped(F.get(ends, F.lit(2)))
        swap = F.ascii(first) > F.ascii(last)
        span = F.concat(_code(F.when(swap, last).otherwise(first)), F.lit("-"),
                        _code(F.when(swap, first).otherwise(last)))
        return F.when(F.size(ends) == 3, span).otherwise(_code(_unescaped(e)))

    elements = F.transform(F.regexp_extract_all(body, F.lit(_SET_PIECE), F.lit(0)), element)
    return (F.when((body == "") & negated, F.lit("."))
            .when(body == "", F.lit("(?!)"))
            .otherwise(F.concat(F.when(negated, "[^").otherwise("["), F.array_join(elements, ""), F.lit("]"))))


def glob_regex(pattern):
    """An anchored regular expression equal to a glob (``*``, ``?``, ``[set]``, ``\\`` escape)."""
    pieces = F.regexp_extract_all(pattern, F.lit(_PIECE), F.lit(0))
    translated = F.transform(pieces, lambda p: (
        F.when(p == "*", ".*")
        .when(p == "?", ".")
        .when(p.startswith("["), _set_regex(p))
        .otherwise(_code(_unescaped(p)))))
    return F.concat(F.lit("(?s)^"), F.array_join(translated, ""), F.lit("$"))


def is_glob(pattern):
    return pattern.rlike(_META)


def literal_prefix(pattern):
    """The characters before the first special one; every match starts with them."""
    return F.regexp_extract(pattern, r"(?s)^[^*?\[\\]*", 0)


def fixed_length(pattern):
    """Length of every match, or -1 for patterns with a ``*``."""
    pieces = F.regexp_extract_all(pattern, F.lit(_PIECE), F.lit(0))
    return F.when(F.exists(pieces, lambda p: p == "*"), F.lit(-1)).otherwise(F.size(pieces))
