"""Edge cases of the text functions."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlake.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("value,shown", [
    ("007", "7"), ("0", "0"), ("-0.5", "-0.50"), ("0.125", "0.12"), ("2.675", "2.67"), ("1", "1"), ("1000", "1000"),
    ("1234.5", "1234.50"), ("inf", "inf"), ("nan", "nan"), ("", ""), ("N/A", "N/A"), ("[A]", "[A]"), ("a\\b", "a\\b"),
    ("$1", "$1"), ("1e3", "1000"), (None, "NULL"), ("-0.0", "0"), ("12x", "12x")])
def test_format_value(spark, value, shown):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(T.format_value("amount", F.col("v"))).first()[0] == shown


@pytest.mark.parametrize("style,value,shown", [
    ("render", "0.5", "50.0%"), ("render", "1", "100.0%"), ("render", "0", "0.0%"), ("render", "12.25", "12.2%"),
    ("render", "-0.5", "-0.50"), ("render", "n/a", "n/a"), ("raw", "0.5", "50%"), ("raw", "0.125", "12.50%"),
    ("sentence", "0.5", "50.00%")])
def test_percent_styles(spark, style, value, shown):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(T.format_value("Percent used", F.col("v"), style)).first()[0] == shown


def test_leading_zeros_stay_in_column_values(spark):
    df = spark.createDataFrame([("007",), ("none",), ("0.50",)], "v string")
    out = [r[0] for r in df.select(T.format_column_value("code", F.col("v"), "implicit")).collect()]
    assert out == ["007", "not specified", "0.50"]


@pytest.mark.parametrize("text,spoken", [
    ("201309", "September 2013"), ("2012-08-24", "August 24, 2012"), ("1981-11-", "November 1981"),
    ("1996-01", "January 1996"), ("2012-13-01", "2012-13-01"), ("plain", "plain")])
def test_humanize_date(spark, text, spoken):
    assert one(spark, T.humanize_date(F.col("t")), t=text) == spoken


@pytest.mark.parametrize("op,v1,v2,words", [
    ("IS NULL", "", "", "The ship date is absent"), ("IS NOT NULL", "", "", "The ship date has a value"),
    ("BETWEEN", "201309", "5", "The ship date is between September 2013 and 5"),
    ("NOT BETWEEN", "1", "2", "The ship date is not between 1 and 2"),
    ("LIKE", "%abc%", "", "The ship date mentions abc"), ("NOT LIKE", "%abc%", "", "The ship date does not mention abc"),
    ("LIKE", "1981-11-%", "", "The ship date is in November 1981"), ("LIKE", "ab%", "", "The ship date starts with ab"),
    ("LIKE", "%ab", "", "The ship date ends with ab"), ("LIKE", "ab", "", "The ship date is like ab"),
    ("IN", "1, 2", "", "The ship date is in (1, 2)"), ("NOT IN", "1", "", "The ship date is not in (1)"),
    (">=", "3", "", "The ship date is greater than or equal to 3"), ("<>", "3", "", "The ship date is not 3")])
def test_predicate_text(spark, op, v1, v2, words):
    out = one(spark, T.predicate_text(F.col("op"), F.lit("t1.ship_date"), F.col("a"), F.col("b")), op=op, a=v1, b=v2)
    assert out == words


@pytest.mark.parametrize("got,want,same", [
    ([], [], True), ([], ["1"], False), (["x"], [], False), (["b a"], ["A", "b"], True), (["1.009"], ["1.00"], True), (["1.01"], ["1.00"], False),
    (["1.0111"], ["1.00"], False), (["1e2"], ["100"], True), (["5", "7"], ["7"], True), (["abc"], ["abd"], False)])
def test_answers_match(spark, got, want, same):
    df = spark.createDataFrame([(got, want)], "g array<string>, w array<string>")
    assert df.select(T.answers_match(F.col("g"), F.col("w"))).first()[0] is same


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab c.!?1", max_size=40), min_size=1, max_size=20))
def test_clean_sentence_ends_and_is_stable(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = T.clean_sentence(F.col("t"))
    for row in df.select(c.alias("x")).withColumn("y", T.clean_sentence(F.col("x"))).collect():
        assert row.x == "" or row.x[-1] in ".!?"
        assert "  " not in row.x


def test_split_sentences_keeps_decimals(spark):
    out = one(spark, T.split_sentences(F.col("t")), t="It costs 3.50 in total. Then it ends here! Short.")
    assert out == ["It costs 3.50 in total", "Then it ends here"]


def test_sql_functions(spark):
    T.register(spark)
    row = spark.sql("select tl_normalize_answer(array('B a', '2')) as n, tl_count_placeholders('[A] [b]') as c").first()
    assert (row.n, row.c) == ("2 a b", 2)
