from pyspark.sql import functions as F

from chatloom.functions import confidence, language, text
from chatloom.operators import translation


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("x")).first().x


def test_words_and_ngrams(spark):
    assert one(spark, text.words(F.col("t")), t="Été, 12 x-Y") == ["été", "12", "x", "y"]
    assert one(spark, text.ngrams(text.words(F.col("t")), 2), t="a b c") == ["a b", "b c"]
    assert one(spark, text.ngrams(text.words(F.col("t")), 4), t="a b c") == []


def test_render_is_one_pass(spark):
    out = text.render("{a}-{b}-{a}-{c}", {"a": F.col("t"), "b": "2"})
    assert one(spark, out, t="{b}") == "{b}-2-{b}-{c}"


def test_date_instruction(spark):
    out = text.date_instruction(F.expr("TIMESTAMP_NTZ '2024-05-06 07:08:09'"))
    assert one(spark, out) == "Todays date and time is: 2024-05-06 07:08:09"


def test_language_and_ties(spark):
    cases = {"the cat and the dog": "en", "le chat et la souris": "fr", "der Hund und die Katze": "de",
             "el perro y los gatos": "es", "": "und", "xyz": "und", "la": "fr"}
    for sample, code in cases.items():
        assert one(spark, language.detect_language(F.col("t")), t=sample) == code
    assert one(spark, language.detect_language(F.lit(None).cast("string"))) == "und"


def test_language_accuracy_floor(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    right = docs.select(F.avg((language.detect_language(F.col("text")) == F.col("lang")).cast("int")).alias("a")).first().a
    assert right >= 0.97


def test_confidence_thirds(spark):
    label = confidence.confidence_label(F.col("q"), F.col("a"), F.col("c"))
    assert one(spark, label, q="", a="", c="") == "low"
    assert one(spark, label, q="a", a="a b c", c="") == "medium"
    assert one(spark, label, q="a", a="A b c", c="b") == "high"
    assert one(spark, label, q="z", a="a b c", c="") == "low"


def test_normalise_label(spark):
    for raw, expected in ((" High\n", "high"), ("LOW", "low"), ("maybe", None)):
        assert one(spark, confidence.normalise_label(F.col("r")), r=raw) == expected


def test_translation_falls_back_and_keeps_the_flag(spark):
    pairs = spark.createDataFrame([("s", 1, "the and of", "le la et"), ("s", 3, "the and", "le des est"), ("s", 5, "the", "of")],
                                  "session_id string, turn long, question string, answer string")
    work = translation.translation_worklist(pairs)
    done = spark.createDataFrame([("s", 1, "T"), ("s", 5, "never")], "session_id string, turn long, translated string")
    out = translation.apply_translations(work, done).orderBy("turn").collect()
    assert [(r.needs_translation, r.text) for r in out] == [(True, "T"), (True, "le des est"), (False, "of")]
    assert (out[0].source, out[0].target) == ("fr", "en")
