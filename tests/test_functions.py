"""Hand-derived cases of the text functions."""

import pytest
from pageloom.functions import text as X
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("line, want", [("  Page 12 ", "page #"), ("A٣B", "a#b"), ("", "")])
def test_signature(spark, line, want):
    assert one(spark, X.signature(F.col("t")), t=line) == want


def test_tokens(spark):
    assert one(spark, X.search_tokens(F.col("t")), t="FY2018 revenue") == ["fy2018", "fy", "2018", "revenue"]
    assert one(spark, X.word_tokens(F.col("t")), t=None) == []


@pytest.mark.parametrize("text, want", [("", []), ("a b", ["a b"]), ("a b c", ["a b c"]), ("a b c a b c", ["a b c", "b c a", "c a b"])])
def test_grams(spark, text, want):
    rows = spark.createDataFrame([(text,)], "t string").select(X.word_tokens(F.col("t")).alias("w"))
    assert rows.select(X.distinct_grams(F.col("w")).alias("g")).first().g == want


@pytest.mark.parametrize("text, want", [
    ("$1,577.00", 1577.0), ("$8.2B", 8.2e9), ("n/a", None), ("12 basis points", 12e9), ("5 months", 5e6), ("(5.2)", -5.2), ("see (a) 7 (b)", -7.0), (None, None),
])
def test_parse_number(spark, text, want):
    assert one(spark, X.parse_number(F.col("t")), t=text) == (pytest.approx(want) if want is not None else None)


@pytest.mark.parametrize("gold, answer, want", [
    ("$1577.00", "$1,577 million", False), ("100", "101", True), ("100", "102", False), ("(5.2)", "(5.2)", False), ("Yes", "5", None), ("3", None, False),
])
def test_numeric_match(spark, gold, answer, want):
    assert one(spark, X.numeric_match(F.col("g"), F.col("a")), g=gold, a=answer) is want


def test_citations_refusals_words(spark):
    assert one(spark, X.citations(F.col("t")), t="x [1][2], y [1, 3] [a]") == [1, 2, 3]
    assert one(spark, X.is_refusal(F.col("t")), t=X.REFUSAL.upper() + " Sorry") is True
    assert one(spark, X.word_count(F.col("t")), t=" a b \n c ") == 3
    assert one(spark, X.word_count(F.col("t")), t=" \n") == 0
    assert one(spark, X.weight_tag(F.lit(0.9))) == "d0p90"


@pytest.mark.parametrize("reply, want", [('{"verdict": "Correct"}', "correct"), ('{"verdict": "maybe"}', "incorrect"), ('{"verd', "incorrect"), (None, "incorrect")])
def test_verdict(spark, reply, want):
    assert one(spark, X.verdict_of(F.col("r"), "verdict", ("correct", "partial", "incorrect"), "incorrect"), r=reply) == want
