"""Mixing sources by temperature, realised as budgeted block permutations.

The share of a source in the mix is its share of all tokens raised to an exponent and
normalised. The exponent is bisected between 0 (all sources alike) and 1 (as they are) to
the flattest mix that keeps a limit: an entropy that must not be exceeded, or a number of
times that no source may be repeated. The mix then becomes a number of copies for every
document: each source is a sequence of passes over its documents, a pass is a permutation
of blocks, and the sequence is cut where the source's token budget ends.

Everything is made of built-in Spark expressions. Per source there is one row of totals,
and per block one of sums; these are joined back, so a large source is never gathered.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatloom.llm.columns import with_checkpoints

#: Halvings of the exponent's interval.
BISECTIONS = 40
#: Weights are rounded to this many parts, so that equal inputs give equal budgets anywhere.
PARTS = 10 ** 9
#: A budget with which no source loses a document: the largest is taken once, others as often as the mix says.
COVER = "cover"


def token_count(text_col="text"):
    """Words of a text; a null text has none."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return words.cast("long")


def source_totals(counted):
    """Tokens and documents of each source with tokens: ``source``, ``tokens``, ``docs``."""
    return counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0")


def _total(values):
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def weights(totals, budget=None, most_entropy=None, most_repeats=None):
    """The mix: adds ``exponent``, ``weight`` and ``wanted`` tokens to the totals of the sources.

    ``budget``: tokens of the whole mix; None: all tokens of the sources; ``COVER``: see
    there. ``most_entropy`` is a limit as a part of the largest possible entropy,
    ``most_repeats`` one for the budget of a source over its tokens. The bisection is one
    expression over the list of all sources, an entry for each.
    """
    listed = totals.agg(F.sort_array(F.collect_list(F.struct("tokens", "source", "docs"))).alias("rows"))
    listed = listed.withColumn("all", F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["tokens"]))

    def powers(exponent):
        return F.transform("rows", lambda r: F.pow(r["tokens"] / F.col("all"), exponent))

    def target(parts):
        if budget == COVER:
            return F.array_max(F.zip_with("rows", parts, lambda r, p: r["tokens"] / p)) * _total(parts)
        return F.col("all").cast("double") if budget is None else F.lit(float(budget))

    def fits(exponent):
        parts, limits = powers(exponent), F.lit(True)
        if most_repeats is not None:
            worst = F.array_max(F.zip_with("rows", parts, lambda r, p: p / r["tokens"])) * target(parts) / _total(parts)
            limits = limits & (worst <= most_repeats)
        if most_entropy is not None:
            norm = _total(parts)
            entropy = _total(F.transform(parts, lambda p: -(p / norm) * F.ln(p / norm)))
            limits = limits & (entropy <= most_entropy * F.ln(F.size("rows").cast("double")))
        return limits

    # Repeats and entropy fall as the exponent grows; ``high`` always fits or is 1.
    def halved(a, _):
        middle = (a["low"] + a["high"]) / 2
        return F.when(fits(middle), F.struct(a["low"].alias("low"), middle.alias("high"))).otherwise(
            F.struct(middle.alias("low"), a["high"].alias("high")))

    interval = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)),
                           F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high")), halved, lambda a: a["high"])
    chosen = listed.withColumn("exponent", F.when(fits(F.lit(0.0)), F.lit(0.0)).otherwise(interval))
    chosen = chosen.withColumn("parts", powers(F.col("exponent")))
    chosen = chosen.select("exponent", target(F.col("parts")).alias("target"), F.explode(F.arrays_zip(
        "rows", F.transform("parts", lambda p: F.round(p / _total(F.col("parts")) * PARTS).cast("long")).alias("n"))).alias("x"))
    wanted = F.floor(F.col("x.n") * F.col("target") / PARTS).cast("long")
    if budget == COVER:
        wanted = F.greatest(wanted, F.col("x.rows.tokens"))
    return chosen.select(
        "x.rows.source", "x.rows.tokens", "x.rows.docs", F.round("exponent", 9).alias("exponent"),
        (F.col("x.n") / PARTS).alias("weight"), wanted.alias("wanted"))


def _number(*columns):
    """A number that permutes: the first 15 hexadecimal digits of a digest, as SQL engines agree on it."""
    text = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _block():
    """A source has about as many blocks as a block has documents; a source without tokens has one."""
    return F.coalesce(_number("source", "doc_id") % F.ceil(F.sqrt("docs")), F.lit(0)).cast("long")


def realised(rows, counted, mix):
    """How often each row is in the mix: adds ``exponent``, ``weight``, ``wanted``, ``block`` and ``copies``.

    A source's budget is so many whole passes over it plus a rest. In the last pass its
    blocks come in a permuted order and a block's documents in theirs; documents are taken
    while their tokens begin before the end of the rest. Sums per block are found first, so
    that only blocks, and the documents of a block in which the rest ends, are ordered.
    """
    sums = counted.join(mix, "source").withColumn("block", _block()).groupBy("source", "block").agg(F.sum("n_tokens").alias("held"))
    ahead = Window.partitionBy("source").orderBy(_number("source", "block"), "block")
    starts = sums.withColumn("before", F.sum("held").over(ahead) - F.col("held"))
    rest, passes = F.col("wanted") % F.col("tokens"), F.floor(F.col("wanted") / F.col("tokens")).cast("long")
    placed = rows.join(mix, "source", "left").withColumn("block", _block()).join(starts, ["source", "block"], "left")
    placed = placed.withColumn("cut", F.coalesce((F.col("before") < rest) & (F.col("before") + F.col("held") >= rest), F.lit(False)))
    whole = placed.where("not cut").withColumn(
        "copies", F.coalesce(passes + F.when(F.col("before") < rest, 1).otherwise(0), F.lit(1)))
    inside = Window.partitionBy("source", "block").orderBy(_number("doc_id", "source"), "doc_id", "n_tokens").rowsBetween(
        Window.unboundedPreceding, -1)
    at = F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    split = placed.where("cut").withColumn("copies", passes + F.when(at < rest, 1).otherwise(0))
    return whole.unionByName(split).select(
        *rows.columns, "exponent", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("wanted", F.lit(0)).cast("long").alias("wanted"), "block", F.col("copies").cast("long").alias("copies"))


def mix_sources(docs, budget=None, most_entropy=None, most_repeats=4.0, carry=False,
                id_col="doc_id", source_col="source", text_col="text"):
    """Every row with its share in the mix.

    Columns: ``doc_id``, ``source``, ``n_tokens``, ``exponent``, ``weight``, ``wanted`` (the
    source's token budget), ``block`` and ``copies``; with ``carry`` also ``row``, a struct
    of all columns of the input. A null source is a source of its own, named by the empty
    string; a null text has no tokens, costs nothing and comes as often as passes begin
    before its place; a source without tokens has weight 0, a null exponent, and one copy
    of each document. Ties in the order go by id; an empty table gives an empty result.
    """
    def counted(*more):
        return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
                           token_count(text_col).alias("n_tokens"), *more)

    light = with_checkpoints(counted()).checkpoint()
    mix = weights(source_totals(light), budget, most_entropy, most_repeats).checkpoint()
    rows = counted(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")) if carry else light
    return realised(rows, light, mix)


def mixed(docs, **options):
    """The rows of ``docs`` as often as the mix has them, with the columns of ``docs``."""
    rows = mix_sources(docs, carry=True, **options).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
