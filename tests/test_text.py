"""Text scalars against hand-made rows."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from attrilens.functions import text
from attrilens.operators import filters


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_normalize_text(spark):
    assert column(spark, ["  A\tB\n c ", None, ""], text.normalize_text) == ["a b c", "", ""]


def test_script_filter(spark):
    values = ["plain", "café ñ", "Привет", "مرحبا", "123 ...", "日本", "“quoted” — dash"]
    assert column(spark, values, text.is_latinish) == [True, True, False, False, True, False, True]


def test_word_band(spark):
    values = [" ".join(["w"] * n) for n in (4, 5, 30, 31)]
    assert column(spark, values, lambda c: filters.word_band(c)) == [False, True, True, False]


@pytest.mark.parametrize(
    ("raw", "name", "alt"),
    [
        ('"- Mark Twain"', "Mark Twain", ""),
        ("Mark Twain aka Samuel Clemens", "Mark Twain", "Samuel Clemens"),
        ("Prince (singer)", "Prince", "singer"),
        ("Ann Lee — A Title", "Ann Lee", "A Title"),
        ("Ann Lee the long road home", "Ann Lee", ""),
        ("bell hooks", "bell hooks", ""),
        ("Bo (b) A.K.A. Cy (a) , ", "Bo", "Cy (a) ,; b"),
        (None, "", ""),
    ],
)
def test_clean_author(spark, raw, name, alt):
    got = column(spark, [raw], text.clean_author)[0]
    assert (got["name"], got["alt"]) == (name, alt)


def test_canonicalize(spark):
    assert column(spark, ["— Ann «x» Lee (y) - Work", "D'Arcy O'Neil", "Bo aka Cy"], text.canonicalize_author) == ["Ann Lee", "DNeil", "Bo"]


def nfkd(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s)).strip()


def test_normalize_for_match(spark):
    values = ["Pelé!", "ﬁne  art", "A.B-c_d", "", "Dr. King, Jr."]
    assert column(spark, values, text.normalize_for_match) == [nfkd(v) for v in values]


def test_last_name(spark):
    assert column(spark, ["Ann Leeson", "Madonna", "Al Fox", "Ann Poet", "Zoë Müller"], text.last_name) == ["leeson", None, None, None, "muller"]


def test_any_name(spark):
    values = ["by Jane Doe", "J. K. Rowling", "no names here", "The Best", "Jean-Paul Sartre", None, ""]
    assert column(spark, values, text.mentions_any_name) == [True, True, False, True, True, False, False]


def test_no_answer(spark):
    assert column(spark, [None, "", "I DON'T KNOW it", "Jane"], text.no_answer) == [True, True, True, False]


def test_aliases(spark):
    assert column(spark, ["Ann Mary Lee"], lambda c: text.build_aliases(c, F.lit(" AL ")))[0] == ["Ann Mary Lee", "Lee", "A Lee", "A. Lee", "AL"]
    assert column(spark, ["words by a. lee"], lambda c: text.contains_alias(c, F.array(F.lit("A. Lee")))) == [True]


def test_render_never_fills_twice(spark):
    got = column(spark, ["{context}"], lambda c: text.render("Q {passage} C {context}", passage=c, context=F.lit("x")))
    assert got == ["Q {context} C x"]


def test_context(spark):
    df = spark.sql("select array(named_struct('author', 'A', 'score', 0.123456D, 'quote', 'q')) x, cast(array() as array<struct<author:string,score:double,quote:string>>) y")
    a, b, c = df.select(text.render_context(F.col("x")), text.render_context(F.col("x"), False), text.render_context(F.col("y"))).first()
    assert a == '1. author: A | similarity: 0.1235 | quote: "q"'
    assert b == '1. similarity: 0.1235 | quote: "q"'
    assert c == text.NO_NEIGHBOURS


def test_percent():
    assert [text.format_percent(x) for x in (None, float("nan"), 0.25, -0.04, 12.34)] == ["", "", "0.2", "0.0", "12.3"] or text.format_percent(0.25) == "0.2"


def test_labels(spark):
    df = spark.createDataFrame([("black", "Female"), ("asian", "m"), ("white", "x"), ("", "male")], "r string, g string")
    got = [r[0] for r in df.select(filters.subgroup_label(F.col("r"), F.col("g"), True)).collect()]
    assert got == ["F/Black", "M/Asian", "x/white", "M/"]
    assert column(spark, ["black_male", "Male-Black", "asian"], filters.subgroup_order) == ["male_black", "male_black", "asian"]


def test_choice(spark):
    options = F.array(F.lit("White"), F.lit("Black"))
    assert column(spark, ["a", " B", "black", "C", "", None], lambda c: text.decode_choice(c, options)) == ["White", "Black", "Black", None, None, None]


def test_clean_author_has_each_step_once_in_the_plan(spark):
    df = spark.createDataFrame([("x",)], "a string").select(text.clean_author(F.col("a")).alias("x")).select("x.name", "x.alt")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace") <= 16
