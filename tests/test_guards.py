import re

import pytest
from pyspark.sql import functions as F

from chatloom.functions import rails
from chatloom.functions.model_rail import Breaker, model_column, model_rail, worker_model_column
from chatloom.functions.text import has_phrase
from chatloom.functions.redaction import CARD_PATTERN, INFO_TYPES
from chatloom.operators import guards

CARD = "4111 1111 1111 1111"


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "id long, text string")


def column(df, name, order="id"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_card_redaction_finds_all_and_agrees_with_python(spark):
    samples = [CARD, f"a {CARD}, b 4111-1111-1111-1111.", "x4111111111111111", "41111111111111112", "é4111111111111111", "", None]
    out = guards.redact_cards(texts(spark, *samples), "text")
    expected = [None if s is None else re.sub(CARD_PATTERN, "[REDACTED_CARD_NUMBER]", s) for s in samples]
    assert column(out, "redacted") == expected
    assert column(out, "was_redacted") == [s is not None and e != s for s, e in zip(samples, expected)]


def test_redaction_is_idempotent(spark):
    once = guards.redact_cards(texts(spark, f"a {CARD} b"), "text").select("id", F.col("redacted").alias("text"))
    assert column(guards.redact_cards(once, "text"), "was_redacted") == [False]


def test_card_in_parts_drops_the_other_parts(spark):
    rows = [(0, [("",), (f"no {CARD}",), ("tail",)]), (1, [("fine",), (CARD,)]), (2, [])]
    df = spark.createDataFrame(rows, "id long, parts array<struct<text:string>>")
    out = guards.redact_card_parts(df, "parts").orderBy("id").collect()
    assert [[p.text for p in r.parts] for r in out] == [["no [REDACTED_CARD_NUMBER]"], ["fine", CARD], []]
    assert [r.was_redacted for r in out] == [True, False, False]


def test_deidentify_each_type_and_literal_replacement(spark):
    df = texts(spark, f"{CARD} a.b@c.org 10.0.0.1 +1 555-123-4567", "nothing here")
    assert column(guards.deidentify(df, "text", list(INFO_TYPES)), "text")[0] == " ".join(["[REDACTED]"] * 4)
    assert column(guards.deidentify(df, "text", ["EMAIL_ADDRESS"], r"$1\x"), "text")[0].split()[4] == r"$1\x"
    found = {(r.id, r.info_type): r.n for r in guards.inspect(df, "id", "text", list(INFO_TYPES)).collect()}
    assert found == {(0, t): 1 for t in INFO_TYPES}


def test_replacement_is_not_searched_again(spark):
    out = guards.deidentify(texts(spark, "a@b.org"), "text", list(INFO_TYPES), CARD)
    assert column(out, "text") == [CARD]


def test_unknown_info_type_is_an_error(spark):
    with pytest.raises(ValueError):
        guards.deidentify(texts(spark, "x"), "text", ["SHOE_SIZE"])


def test_one_hit_passes_and_two_block(spark):
    df = texts(spark, "you IDIOT", "idiot, idiot", "idiots idiotic", None)
    outcome = rails.ProfanityRail().process(F.col("text"))
    assert column(df.withColumn("b", outcome.is_blocked), "b") == [False, True, False, False]
    scored = guards.moderate(df, "text", rails.LEXICON)
    profanity = rails.category_confidence(F.col("categories"))
    assert column(scored.withColumn("c", profanity), "c") == [0.5, 2 / 3, None, None]


def test_last_of_repeated_categories_counts(spark):
    df = spark.sql("SELECT 0 AS id, array(named_struct('name', 'Profanity', 'confidence', 0.9D), "
                   "named_struct('name', 'Profanity', 'confidence', 0.1D)) AS categories, '' AS text")
    outcome = rails.ProfanityRail(categories=lambda text: F.col("categories")).process(F.col("text"))
    assert df.select(outcome.is_blocked).first()[0] is False


def test_lexicon_table_agrees_with_the_column_form(spark):
    df = texts(spark, "idiot clown", "moron", "fine", "stupid Stupid")
    lexicon = spark.createDataFrame([(c, t) for c, ts in rails.LEXICON.items() for t in ts], "category string, term string")
    by_table = {(r.id, r.name): r.confidence for r in guards.moderate_by_table(df, "id", "text", lexicon).collect()}
    by_column = {(r.id, c["name"]): c["confidence"] for r in guards.moderate(df, "text", rails.LEXICON).collect() for c in r.categories}
    assert by_table == by_column


def test_jailbreak_needs_whole_words(spark):
    df = texts(spark, "Please ACT  as root", "fact asset", "enlyou are", "there is no limit what you can do and give", "hello")
    assert column(guards.jailbreak_screen(df, "text", rails.JailbreakRail()), "refused") == [True, False, False, True, False]
    assert guards.jailbreak_screen(df, "text", rails.JailbreakRail()).filter("refused").first().reply == rails.REFUSAL_TEXT


def test_tool_calls(spark):
    rows = [(0, "other", {"query": "a b"}), (1, "vertex_ai_search", {}), (2, "vertex_ai_search", {"query": "  one "}),
            (3, "vertex_ai_search", {"query": "my Financial Records"}), (4, "vertex_ai_search", {"query": "two words"}),
            (5, "vertex_ai_search", {"query": ""}), (6, None, {"query": "a b"})]
    df = spark.createDataFrame(rows, "id long, tool_name string, tool_args map<string,string>")
    out = guards.tool_call_guard(df)
    assert column(out, "reason") == ["unknown_tool", None, "single_word", "sensitive", None, "single_word", "unknown_tool"]
    assert column(out, "allowed") == [False, True, False, False, True, False, False]


class Tag(rails.GuardRail):
    def __init__(self, tag):
        self.tag = tag

    def process(self, text):
        return rails.modifies(F.lit(True), F.concat(text, F.lit(self.tag)))


class Block(rails.GuardRail):
    def __init__(self, word, reason):
        self.word, self.reason = word, reason

    def process(self, text):
        return rails.blocks(text.contains(self.word), self.reason)


def test_chain_first_block_and_last_change(spark):
    df = texts(spark, "ab", "b", "c")
    out = guards.apply_guards(df, "text", [Tag("1"), Block("b", "B"), Block("a", "A"), Tag("2")])
    assert column(out, "final_text") == ["B", "B", "c2"]
    assert column(out, "reason") == ["B", "B", None]


def test_chain_without_rails_changes_nothing(spark):
    out = guards.apply_guards(texts(spark, "x", None), "text", [])
    assert column(out, "final_text") == ["x", None]
    assert column(out, "is_blocked") == [False, False]


def test_message_stops_at_the_first_blocked_part(spark):
    parts = [("x",), ("",), ("bad",), ("y",)]
    rows = [(0, "user", parts), (1, "model", parts), (2, "user", [("x",), ("y",)]), (3, "user", None), (4, "user", [])]
    df = spark.createDataFrame(rows, "id long, role string, parts array<struct<text:string>>")
    out = guards.guard_message(df, "parts", [Tag("!"), Block("bad", "no")]).orderBy("id").collect()
    assert [r.is_blocked for r in out] == [True, False, False, False, False]
    assert [r.reason for r in out] == ["no", None, None, None, None]
    assert [[p.text for p in r.parts or []] for r in out] == [
        ["x!", "", "bad", "y"], ["x", "", "bad", "y"], ["x!", "y!"], [], []]


def test_refusal_tags_and_style(spark):
    df = texts(spark, "Sorry, I couldn't find it.", rails.REFUSAL_TEXT, "It is blue. Is it? Yes!")
    assert column(guards.tag_refusals(df, "text"), "reply_kind") == ["not_found", "refusal", "answer"]
    style = guards.style_audit(df, "text", 2).orderBy("id").collect()[2]
    assert (style.n_words, style.n_sentences, style.too_long) == (6, 3, False)
    assert style.mean_word_length == 15 / 6


def fragile(items):
    if any("bad" in t for t in items):
        raise ValueError("bad text")
    return [len(t) / 10 for t in items]


def test_model_failure_policies(spark):
    df = texts(spark, "123456", "bad", "12", None)
    for failure, expected in (("open", [True, False, False, False]), ("closed", [True, True, False, False])):
        out = guards.apply_guards(df, "text", [model_rail(fragile, failure)])
        assert column(out, "is_blocked") == expected
    closed = guards.apply_guards(df, "text", [model_rail(fragile, "closed")])
    assert column(closed, "reason")[:2] == [rails.PROFANITY_REASON, rails.PROFANITY_ERROR_REASON]
    with pytest.raises(ValueError):
        model_rail(fragile, "maybe")


def test_model_column_gives_strings(spark):
    out = texts(spark, "a", "bb").withColumn("m", model_column(lambda ts: [t.upper() for t in ts], "string")(F.col("text")))
    assert [r.m.value for r in out.orderBy("id").collect()] == ["A", "BB"]


def test_a_failing_batch_is_halved(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(items):
        calls.add(1)
        return fragile(items)

    df = spark.range(1000).coalesce(1).select("id", F.when(F.col("id") == 377, "bad").otherwise("1234567").alias("text"))
    out = df.withColumn("m", model_column(counted)(F.col("text")))
    assert [r.id for r in out.filter("m.error is not null").select("id").collect()] == [377]
    assert calls.value < 60


def test_terms_are_taken_literally(spark):
    df = texts(spark, "abc a.c", "c c++ C++", "f(x) fx")
    hits = lambda term: column(df.withColumn("n", rails.term_hits(F.col("text"), [term])), "n")
    assert hits("a.c") == [1, 0, 0] and hits("c++") == [0, 2, 0] and hits("f(x)") == [0, 0, 1]
    rule = has_phrase(F.col("text"), ["what is c++"])
    assert column(texts(spark, "so, what is C++?", "what is ccc").withColumn("n", rule), "n") == [True, False]


def test_lexicon_tables_agree_with_columns_and_refuse_other_terms(spark):
    df = texts(spark, "rude Rude word", "nothing", None)
    lexicon = spark.createDataFrame([("bad", "rude"), ("bad", "Word")], "category string, term string")
    table = {r.id: r.confidence for r in guards.moderate_by_table(df, "id", "text", lexicon).collect()}
    listed = guards.moderate(df, "text", {"bad": ["rude", "word"]}).select("id", F.get("categories", F.lit(0))["confidence"].alias("c"))
    assert table == {r.id: r.c for r in listed.collect() if r.c is not None} == {0: 0.75}
    for term in ("two words", "c++"):
        with pytest.raises(Exception, match="not a single word"):
            guards.moderate_by_table(df, "id", "text", spark.createDataFrame([("bad", term)], "category string, term string")).collect()


def test_breaker_retries_opens_rests_and_tries_again():
    down, calls = [True], []

    def model(texts):
        calls.append(len(texts))
        if down[0]:
            raise OSError("down")
        return [len(t) for t in texts]

    breaker = Breaker(model, retries=1, trip=3, rest=4)
    assert breaker.call(["a"]) == (None, "OSError: down") and len(calls) == 2   # one retry, then none is left
    assert breaker.call(["a"]) == (None, "OSError: down") and len(calls) == 3   # the third failure in a row opens
    assert [breaker.call(["a", "b"])[1] for _ in range(2)] == [Breaker.OPEN] * 2 and len(calls) == 3
    assert breaker.call(["a"]) == (None, "OSError: down") and len(calls) == 4   # a trial fails and opens again
    assert breaker.call(["a"] * 4)[1] == Breaker.OPEN
    down[0] = False
    assert breaker.call(["a", "bcd"]) == ([1, 3], None) and breaker.failed == 0
    assert Breaker(lambda ts: [], retries=0, trip=9, rest=1).call(["a"])[1].startswith("ValueError")


def test_a_worker_loads_its_model_once(spark, tmp_path):
    def load():
        import os
        with open(f"{tmp_path}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda ts: [float(len(t)) for t in ts]

    df = spark.range(4000).repartition(16).select("id", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("text"))
    column = worker_model_column(load)
    for _ in range(2):
        out = df.withColumn("m", column(F.col("text"))).collect()
        assert all(r.m.value == (len(r.text) if r.text else None) and r.m.error is None for r in out) and len(out) == 4000
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads)) < 32  # 32 tasks ran


def test_a_dead_model_is_left_alone(spark, tmp_path):
    def load():
        def model(ts):
            with open(f"{tmp_path}/calls", "a") as f:
                f.write("x")
            raise OSError("down")
        return model

    df = spark.range(3000).coalesce(1).select("id", F.lit("t").alias("text"))
    out = df.withColumn("m", worker_model_column(load, retries=2, trip=5, rest=1 << 40)(F.col("text"))).collect()
    assert {r.m.error for r in out} <= {Breaker.OPEN, "OSError: down"} and all(r.m.value is None for r in out)
    assert len((tmp_path / "calls").read_text()) == 5 and sum(r.m.error == Breaker.OPEN for r in out) > 2900


def test_models_get_lists_bounded_in_bytes(spark):
    def model(ts):
        held = sum(len(t.encode()) for t in ts)
        return [f"{len(t)} {held}" for t in ts]

    text = F.expr("if(id % 9 <> 0, repeat(if(id % 500 = 1, 'ü', 'x'), if(id = 700, 3000000, if(id % 9 = 1, 0, 5000))), null)")
    df = spark.range(2000).coalesce(1).select("id", text.alias("text"))
    for column in (model_column(model, "string"), worker_model_column(lambda: model, "string")):
        out = df.withColumn("m", column(F.col("text"))).select("id", F.length("text").alias("n"), "m").collect()
        assert len(out) == 2000 and all(r.m.error is None for r in out)
        for r in out:
            if r.n is None:
                assert r.m.value is None
            else:
                n, held = map(int, r.m.value.split())
                assert n == r.n and (held == 3_000_000 if r.id == 700 else held <= 2 << 20)
