"""Two generators compared by a judge, blind and in both orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import first_of_pair, word_count

from .stats import sign_test

CHOICES = ("7b", "3b", "tie")


def preferred(winner: Column, seven_is_a: Column) -> Column:
    """A winner of A, B (in any case) or tie as the model's name."""
    side = F.lower(F.trim(winner))
    return F.when(~side.isin("a", "b") | side.isNull(), F.lit("tie")).when((side == "a") == seven_is_a, F.lit("7b")).otherwise(F.lit("3b"))


def orders(pairs: DataFrame, key: str, swap: bool = False) -> DataFrame:
    """pairs with seven_is_a; swapping turns it round."""
    even = first_of_pair(F.col(key))
    return pairs.withColumn("seven_is_a", ~even if swap else even)


def preferences(judged: DataFrame) -> DataFrame:
    """judged(judge, preferred) -> counts, rates and the sign test, one row a judge."""
    n = lambda v: F.count_if(F.col("preferred") == v)
    out = judged.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), n("7b").alias("prefers_7b"), n("3b").alias("prefers_3b"), n("tie").alias("ties"))
    rates = {f"{c}_rate": F.col(c) / F.col("n") for c in ("prefers_7b", "prefers_3b", "ties")}
    return out.withColumns(rates).withColumn("sign_test_p", F.round(sign_test(F.col("prefers_7b"), F.col("prefers_3b")), 9))


def crosstab(judged: DataFrame, by: str = "question_type") -> DataFrame:
    return judged.groupBy(by).pivot("preferred", list(CHOICES)).count().na.fill(0)


def order_robust(judged: DataFrame, swapped: DataFrame) -> DataFrame:
    """(judge, id, robust): the preference if both orders agree, else unstable."""
    both = judged.select("judge", "id", "preferred").join(swapped.select("judge", "id", F.col("preferred").alias("other")), ["judge", "id"])
    return both.select("judge", "id", F.when(F.col("preferred") == F.col("other"), F.col("preferred")).otherwise(F.lit("unstable")).alias("robust"))


def robust_summary(robust: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("robust") == v)
    out = robust.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), n("7b").alias("robust_7b"), n("3b").alias("robust_3b"), n("tie").alias("robust_tie"), n("unstable").alias("order_unstable"))
    return out.withColumn("order_unstable_rate", F.col("order_unstable") / F.col("n"))


def both_judges(robust: DataFrame, first: str, second: str) -> DataFrame:
    """Where two judges agree robustly: counts by their common preference, else not_agree."""
    a = robust.where(F.col("judge") == first).select("id", F.col("robust").alias("x"))
    b = robust.where(F.col("judge") == second).select("id", F.col("robust").alias("y"))
    return a.join(b, "id").select(F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.lit("not_agree")).alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def operational(answers: DataFrame) -> DataFrame:
    """answers(model, refused, cited, cited_pages_valid, answer) -> rates and answer lengths, one row a model."""
    return answers.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("refused").cast("int")).alias("refusal_rate"), F.avg((F.size("cited") > 0).cast("int")).alias("citation_rate"),
        F.avg(F.col("cited_pages_valid").cast("int")).alias("gold_page_citation_rate"), F.avg(word_count(F.col("answer"))).alias("mean_answer_words"),
        F.median(word_count(F.col("answer"))).alias("median_answer_words"),
    )
