import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from akin.functions import text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def strings(*values):
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


@pytest.mark.parametrize(
    "raw, clean",
    [
        (None, ""),
        ("", ""),
        ("<div>Two <i>old</i> boats on <a href='/lake'>a lake</a>!</div>", "Two old boats on a lake!"),
        ("<p>a</p><p>b</p>", "ab"),
        ("  much \t\n  space  here ", "much space here"),
        ("a < b", "a < b"),
        ("<>x<br/>", "<>x"),
        ("Tom &amp; Jerry", "Tom &amp; Jerry"),
        ("<p>line\nbreak\x1cin</p\n>tag", "line break intag"),
    ],
)
def test_clean_html(spark, raw, clean):
    assert one(spark, text.clean_html(F.lit(raw).cast("string"))) == clean
    assert one(spark, text.clean_html(F.lit(clean))) == clean


def test_clean_texts_keeps_one_entry_per_input(spark):
    assert one(spark, text.clean_texts(strings("<p>A</p>", None, ""))) == ["A", "", ""]


@pytest.mark.parametrize(
    "summary, children, joined",
    [
        ("A harbour town", ("Storms", None, "Spring"), "A harbour town Storms Spring"),
        ("<p>Main</p>", ("<b>S1</b>", ""), "Main S1"),
        ("Main", (), "Main"),
        (None, ("S1",), " S1"),
        ("Main", ("<br>", "S2"), "Main  S2"),
    ],
)
def test_combine_text(spark, summary, children, joined):
    column = text.combine_text(F.lit(summary).cast("string"), strings(*children))
    assert one(spark, column) == joined


def test_combine_text_without_a_list(spark):
    assert one(spark, text.combine_text(F.lit("Main"), F.lit(None).cast("array<string>"))) == "Main"


def test_tokens_drop_case_accents_short_and_stop_words(spark):
    words = one(spark, text.tokens(F.lit("The Café, à Zürich: a NAÏVE x œuvre_1 straße 42!")))
    assert words == ["cafe", "zurich", "naive", "œuvre_1", "straße", "42"]


def test_a_single_hangul_syllable_is_a_token(spark):
    assert one(spark, text.tokens(F.lit("한 한국 x"), ())) == ["한", "한국"]


def test_pairs_span_a_removed_stop_word(spark):
    words = spark.range(1).select(text.tokens(F.lit("quick and the dead end")).alias("w"))
    assert words.select(text.bigrams(F.col("w")).alias("b")).first().b == ["quick dead", "dead end"]


@pytest.mark.parametrize("words", [[], ["one"]])
def test_no_pairs_in_short_texts(spark, words):
    df = spark.createDataFrame([(words,)], "w array<string>")
    assert df.select(text.bigrams(F.col("w")).alias("b")).first().b == []


def test_fold_agrees_with_decomposition(spark):
    sample = "ÀÉÎõü Ñandú Đ ø ﬀ ² ｆｕｌｌ ё й Ω ά é ế कि"
    expected = "".join(
        c for c in unicodedata.normalize("NFKD", sample.lower()) if not unicodedata.combining(c)
    )
    assert one(spark, text.fold(F.lit(sample))) == expected


def test_letters_that_stand_for_several_are_spelled_out(spark):
    samples = [*text.spelled_out(), "ﬁre at 5㎏, ½ ﬂask 🄀 😀 𝟙", "plain", "", "ＡﬀÉ ﷺ"]
    frame = spark.createDataFrame(list(enumerate(samples)), "i int, t string")
    found = {r.i: r.f for r in frame.select("i", text.fold(F.col("t")).alias("f")).collect()}
    for i, sample in enumerate(samples):
        plain = unicodedata.normalize("NFKD", sample.lower())
        assert found[i] == "".join(c for c in plain if not unicodedata.combining(c)), sample
    assert one(spark, text.fold(F.lit(None).cast("string"))) is None
    assert one(spark, text.tokens(F.lit("ﬁre at 5㎏ ½"), ())) == ["fire", "at", "5kg"]
    assert one(spark, text.fold(F.lit("한국"))) == "한국"


def test_stop_words_can_be_tokens():
    assert all(re.fullmatch(r"\w\w+", w) for w in text.STOP_WORDS)
    assert {"the", "couldn", "ll", "would"} <= set(text.STOP_WORDS)


def test_letters_that_stand_for_several_do_not_take_a_text_apart(spark):
    """One lookup per different letter: a long text with one of them is not looked up character by character."""
    long = "straße ﬁn été " * 20_000 + "㎏ ½"
    frame = spark.createDataFrame([(long,), (None,), ("",)], "s string").select(text.fold(F.col("s")).alias("f"))
    assert "split(" not in frame._jdf.queryExecution().optimizedPlan().toString()
    found = [r.f for r in frame.collect()]
    assert found == ["straße fin ete " * 20_000 + "kg 1⁄2", None, ""]
