"""Judges: prompts for grading one answer and for comparing two, the call of a provider, and what its reply says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import verdict_of

from .answers import Provider, generate
from .pairwise import orders, preferred
from .sampling import last_by

VERDICTS = ("correct", "partial", "incorrect")
GRADE = (
    "Grade an answer against the reference. It is correct if it gives the same key fact or figure, after units and rounding; partial if it goes the right way without the "
    "exact fact; incorrect if the fact is missing, wrong or refused. Reply with JSON only: "
    '{"verdict": "correct|partial|incorrect", "reason": "<short>"}'
)
COMPARE = (
    "Compare two answers to a question with the reference. Prefer the one with the right fact or figure, then the better supported, then the shorter; a refusal loses to a "
    "right answer; equally right or equally wrong is a tie. Which is called A or B must not matter. Reply with JSON only: "
    '{"winner": "A|B|tie", "reason": "<short>"}'
)


def grade_prompt(question: Column, gold: Column, answer: Column) -> Column:
    return F.concat_ws("\n", F.lit(GRADE), F.lit(""), *_said(("Question", question), ("Reference answer", gold), ("Candidate answer", answer)))


def pair_prompt(question: Column, gold: Column, a: Column, b: Column) -> Column:
    return F.concat_ws("\n", F.lit(COMPARE), F.lit(""), *_said(("Question", question), ("Reference answer", gold), ("Candidate A", a), ("Candidate B", b)))


def _said(*parts: tuple[str, Column]) -> list[Column]:
    return [F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(""))) for name, c in parts]


def reason_of(reply: Column, most: int = 200) -> Column:
    """The reply's reason, cut for display; what is no JSON says so."""
    return F.coalesce(F.left(F.coalesce(F.get_json_object(reply, "$.reason"), F.when(F.get_json_object(reply, "$").isNotNull(), F.lit(""))), F.lit(most)), F.lit("unparseable judge output"))


def judged(answers: DataFrame, make_judge: Callable[[], Provider]) -> DataFrame:
    """answers(query_id, question, gold_answer, answer, ...) with judge_reply, verdict and reason; no or a broken reply is incorrect."""
    asked = answers.select("query_id", grade_prompt(F.col("question"), F.col("gold_answer"), F.col("answer")).alias("prompt"))
    replies = generate(asked, make_judge).select("query_id", F.col("answer").alias("judge_reply"))
    out = answers.join(replies, "query_id", "left")
    return out.withColumns({"verdict": verdict_of(F.col("judge_reply"), "verdict", VERDICTS, "incorrect"), "reason": reason_of(F.col("judge_reply"))})


def winner_of(reply: Column) -> Column:
    """A, B or tie of a reply, in whatever case it says so; anything else is a tie."""
    said = F.upper(F.trim(F.get_json_object(reply, "$.winner")))
    return F.when(said.isin("A", "B"), said).otherwise(F.lit("tie"))


def matched(first: DataFrame, second: DataFrame, order: str, page_hit_only: bool = True) -> DataFrame:
    """Questions that two answer sets (query_id, answer, page_hit, ..., a column of order) share, the last record of each counting; first's columns and other_answer."""
    a, b = last_by(first, ["query_id"], order), last_by(second, ["query_id"], order)
    both = a.join(b.select("query_id", F.col("answer").alias("other_answer")), "query_id")
    return both.where("page_hit") if page_hit_only else both


def compared(pairs: DataFrame, make_judge: Callable[[], Provider], judge: str, swap: bool = False) -> DataFrame:
    """pairs(query_id, question, gold_answer, answer of the small, other_answer of the large model, question_type, page_hit) -> (query_id, question_type, page_hit, judge, seven_is_a, preferred, reason)."""
    rows = orders(pairs, "query_id", swap)
    a = F.when(F.col("seven_is_a"), F.col("other_answer")).otherwise(F.col("answer"))
    b = F.when(F.col("seven_is_a"), F.col("answer")).otherwise(F.col("other_answer"))
    replies = generate(rows.select("query_id", pair_prompt(F.col("question"), F.col("gold_answer"), a, b).alias("prompt")), make_judge).select("query_id", F.col("answer").alias("judge_reply"))
    out = rows.join(replies, "query_id", "left").withColumn("preferred", preferred(winner_of(F.col("judge_reply")), F.col("seven_is_a")))
    return out.select("query_id", "question_type", "page_hit", F.lit(judge).alias("judge"), "seven_is_a", "preferred", reason_of(F.col("judge_reply"), 250).alias("reason"))


class MostlyDigits:
    """A judge without a model: grades by shared figures, prefers the answer with more of the reference's figures, and says so in JSON."""

    def complete(self, prompts: list[str]) -> list[str]:
        import json
        import re

        numbers = lambda t: set(re.findall(r"\d+", t))
        out = []
        for p in prompts:
            said = dict(x.split(": ", 1) for x in p.split("\n") if re.match(r"(Reference answer|Candidate answer|Candidate [AB]): ", x))
            want = numbers(said.get("Reference answer", ""))
            if "Candidate answer" in said:
                share = len(want & numbers(said["Candidate answer"])) / len(want) if want else 0.0
                out.append(json.dumps({"verdict": "Correct" if share == 1 else "partial" if share else "incorrect", "reason": f"{share:.2f}"}))
            else:
                a, b = (len(want & numbers(said.get(f"Candidate {x}", ""))) for x in "AB")
                out.append(json.dumps({"winner": "a" if a > b else "b" if b > a else "tie", "reason": f"{a} to {b}"}))
        return out
