"""Quality by weak supervision: rules vote or abstain, a label model weighs the votes.

Everything is made of built-in Spark expressions. Each rule looks at a few measures of a
text and votes good (1), bad (-1) or abstains (0). Expectation-maximisation estimates from
the votes alone, without labels, how often each rule is right and how common good texts
are; a text is kept when its posterior probability of being good is high enough. The
estimation only needs how often each combination of votes occurs, which is at most
3 to the number of rules, whatever the number of texts.
"""

import math
from collections import namedtuple

import numpy as np
from pyspark.sql import functions as F

from chatloom.llm.columns import with_checkpoints

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Words of letters, with marks around them.
_PLAIN = r"""(?<![^\x20\x09-\x0D])[("'¿¡]?\p{L}[\p{L}'-]*[.,;:!?)"']*(?![^\x20\x09-\x0D])"""
#: Rows with a posterior from here on are kept.
KEEP_FROM = 0.5
#: Rounds of expectation-maximisation, and the change of the parameters that ends them.
MOST_ROUNDS, TOLERANCE = 200, 1e-9
#: Belief before any text is seen: how often a rule votes (bad, abstain, good) on a good and on a bad
#: text. A bad vote is rare on good texts; a good vote says little, for most faults concern few rules.
ON_GOOD, ON_BAD = (0.02, 0.13, 0.85), (0.30, 0.20, 0.50)
#: The belief weighs as much as so many texts.
BELIEF = 10.0
#: Share of good texts before any text is seen.
GOOD = 0.8


Rule = namedtuple("Rule", "name good bad")


#: Conditions for a vote. Rules with overlapping evidence look at different measures.
RULES = (
    Rule("length", lambda: F.col("n_words") >= 80, lambda: F.col("n_words") < 50),
    Rule("word_length",
         lambda: F.col("word_chars").between(3.5 * F.col("n_words"), 8 * F.col("n_words")),
         lambda: ~F.col("word_chars").between(2.5 * F.col("n_words"), 12 * F.col("n_words"))),
    Rule("symbols", lambda: 50 * F.col("n_symbols") <= F.col("n_words"), lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("symbol_runs",
         lambda: 50 * F.col("n_symbol_runs") <= F.col("n_words"), lambda: 10 * F.col("n_symbol_runs") > F.col("n_words")),
    Rule("plain_words", lambda: 10 * F.col("n_plain") >= 9 * F.col("n_words"), lambda: 10 * F.col("n_plain") < 6 * F.col("n_words")),
    Rule("repeated_words",
         lambda: 10 * F.col("n_repeat_words") <= F.col("n_words"), lambda: 10 * F.col("n_repeat_words") > 3 * F.col("n_words")),
    Rule("repeated_lines",
         lambda: (F.col("n_dup_lines") == 0) & (F.col("n_lines") >= 3), lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule("capitals",
         lambda: 10 * F.col("n_capitals") <= F.col("word_chars"), lambda: 10 * F.col("n_capitals") > 3 * F.col("word_chars")),
    Rule("distinct_words",
         lambda: 10 * F.col("n_distinct") >= 3 * F.least("n_words", F.lit(400)),
         lambda: 10 * F.col("n_distinct") < F.least("n_words", F.lit(400))),
    Rule("marks",
         lambda: F.col("n_stops").between(1, F.col("n_words") / 3) & (20 * F.col("n_marks") <= F.col("n_words")),
         lambda: (F.col("n_stops") == 0) | (3 * F.col("n_marks") > F.col("n_words"))),
)


def _without(text, characters):
    return F.char_length(F.translate(text, characters, ""))


def repeated_word_count(words):
    """Number of words covered by 3-word windows that occur twice or more, the first included.

    Windows stand as (64-bit hash, position), sorted; those with an equal neighbour are
    repeated. Their positions in order then say how many words each of them newly covers.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    hashes = F.sort_array(F.transform(windows, lambda w: w["h"]))
    any_twice = F.size(F.array_distinct(hashes)) < F.size(hashes)

    def covered(ordered):
        twice = F.filter(ordered, lambda w, k: (w["h"] == F.get(ordered, k - 1)["h"]) | (w["h"] == F.get(ordered, k + 1)["h"]))
        places = F.sort_array(F.transform(twice, lambda w: w["i"]))
        return F.aggregate(
            places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])

    ordered = F.sort_array(windows)
    bound = F.get(F.transform(F.array(ordered), covered), F.lit(0))
    return F.when(F.size(words) < 4, 0).when(any_twice, bound).otherwise(0)


def measures(docs, id_col="doc_id", text_col="text"):
    """The measures of each text: id column, ``n_words``, the base measures and those of further rules.

    A null text has no words. Other columns are not read.
    """
    text = F.coalesce(F.col("_t"), F.lit(""))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_t"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    rows = rows.withColumns({"_w": words, "_l": lines, "_x": F.translate(text, SPACES, "")})

    def number(column, name):
        return column.cast("long").alias(name)

    inner = F.char_length("_x")
    return rows.select(
        id_col, number(F.size("_w"), "n_words"), number(inner, "word_chars"),
        number(inner - _without("_x", SYMBOLS), "n_symbols"),
        number(F.size("_l") - F.size(F.array_distinct("_l")), "n_dup_lines"),
        number(repeated_word_count(F.col("_w")), "n_repeat_words"),
        number(F.size("_l"), "n_lines"),
        number(F.length(F.regexp_replace("_x", r"[^A-Z]+", "")), "n_capitals"),
        number(F.size(F.array_distinct("_w")), "n_distinct"),
        number(F.regexp_count(text, F.lit(f"[{SYMBOLS}]+")), "n_symbol_runs"),
        number(F.regexp_count(text, F.lit(_PLAIN)), "n_plain"),
        number(F.regexp_count(text, F.lit(r"[.?!](?=\s|$)")), "n_stops"),
        number(F.regexp_count(text, F.lit(r"[!?]{2,}")), "n_marks"))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vote(rule):
    return F.when(rule.bad(), -1).when(rule.good(), 1).otherwise(0)


#: ``good`` and ``bad`` hold, for each rule, the probabilities of the votes -1, 0 and 1.
LabelModel = namedtuple("LabelModel", "prior good bad rounds")


def fit(voted, names):
    """How each rule votes on good and on bad texts, and the share of good texts, from the votes alone.

    Votes are taken as independent given the label. The combinations that occur, at most
    3^rules of them, come to the driver with their frequencies. Without any rows the model
    is its prior belief.
    """
    found = sorted(map(tuple, voted.groupBy(*names).agg(F.count("*")).collect()))
    votes = np.array([row[:-1] for row in found], np.int64).reshape(-1, len(names)) + 1
    times = np.array([row[-1] for row in found], np.float64)
    rules, beliefs = np.arange(len(names)), BELIEF * np.array([[ON_GOOD], [ON_BAD]], np.float64).repeat(len(names), axis=1)
    prior, sides = GOOD, beliefs / beliefs.sum(axis=2, keepdims=True)
    for rounds in range(1, MOST_ROUNDS + 1):
        ratio = np.log(sides[0] / sides[1])
        odds = math.log(prior / (1 - prior)) + ratio[rules, votes].sum(axis=1)
        good = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        shares = np.stack([times * good, times * (1 - good)])
        weights = BELIEF * np.array([GOOD, 1 - GOOD]) + shares.sum(axis=1)
        counts = beliefs + np.stack([[[share[column == v].sum() for v in range(3)] for column in votes.T] for share in shares])
        after = weights[0] / weights.sum(), counts / counts.sum(axis=2, keepdims=True)
        change = max(abs(after[0] - prior), np.abs(after[1] - sides).max())
        prior, sides = float(after[0]), after[1]
        if change < TOLERANCE:
            break
    return LabelModel(prior, *[[tuple(row) for row in side] for side in sides.tolist()], rounds)


def posterior(model, names):
    """The probability that a text is good, as an expression over its votes."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for name, g, b in zip(names, model.good, model.bad):
        low, none, high = (math.log(x / y) for x, y in zip(g, b))
        odds = odds + F.when(F.col(name) < 0, low).when(F.col(name) > 0, high).otherwise(none)
    return 1 / (1 + F.exp(-odds))


def judge(docs, id_col="doc_id", text_col="text", rules=RULES):
    """Measures, votes and verdict of every row: adds ``base_failed``, ``quality`` and ``kept``.

    The measures are written once to the shared folder, for the model needs them before
    the verdict. Rows that fail the base conditions are not kept, vote like the others and
    may differ from the model's verdict. Repeated rows are judged alike; an empty table
    gives an empty result.
    """
    names = [f"vote_{r.name}" for r in rules]
    rows = measures(with_checkpoints(docs), id_col, text_col).withColumns(
        {"base_failed": base_failed(), **{n: vote(r) for n, r in zip(names, rules)}}).checkpoint()
    model = fit(rows, names)
    return rows.withColumn("quality", posterior(model, names)).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))
