"""Answers: prompts, pluggable generators, citation checks, grading and its summary."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import REFUSAL, citations, context_block, is_refusal, numeric_match, verdict_of
from pageloom.store import stash

from .chunking import ruler_tokens
from .evaluation import gold_pages

INSTRUCTIONS = f"Answer from the numbered passages alone and cite them as [n]. If they do not hold the answer, say: {REFUSAL}"


class Provider(Protocol):
    """Anything that completes prompts: a model server, a library, or a rule."""

    def complete(self, prompts: list[str]) -> list[str]: ...


class Extractive:
    """A provider without a model: the first sentence of the first passage, cited; refuses where there is no passage."""

    def complete(self, prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            first = next((x for x in p.split("\n") if x.startswith("[1] (")), None)
            out.append(REFUSAL if first is None else first.split(") ", 1)[-1].split(". ")[0][:200] + " [1]")
        return out


def within_budget(questions: DataFrame, hits: DataFrame, budget: int, answer_tokens: int = 0) -> DataFrame:
    """The hits of each question, best first, that fit into a prompt of ``budget`` tokens beside instructions, question and ``answer_tokens`` for the answer; with ``tokens``, what each takes.

    They are the first of their ranks, so those that stay keep their numbers; the question is never cut. A first hit that is too long by itself is cut to the tokens that are left; where nothing is left,
    no hit stays. A question has at most its k hits, so a window holds those.
    """
    size = lambda text: F.size(ruler_tokens(text))
    room = F.lit(budget - answer_tokens) - size(F.lit(INSTRUCTIONS)) - size(F.concat(F.lit("Question: "), F.coalesce("question", F.lit(""))))
    rows = hits.join(questions.select("query_id", room.alias("__room")), "query_id").withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    label = size(F.concat(F.lit("["), F.col("__n").cast("string"), F.lit("] ("), F.coalesce("doc_name", F.lit("")), F.lit(" p."), F.coalesce(F.col("page_number").cast("string"), F.lit("")), F.lit(")")))
    rows = rows.withColumn("__label", label).withColumn("tokens", F.col("__label") + size(F.col("text")))
    rows = rows.withColumn("__used", F.sum("tokens").over(Window.partitionBy("query_id").orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)))
    cut = (F.col("__n") == 1) & (F.col("tokens") > F.col("__room"))
    rows = rows.where((F.col("__used") <= F.col("__room")) | (cut & (F.col("__room") > F.col("__label"))))
    left = F.col("__room") - F.col("__label")
    rows = rows.withColumn("text", F.when(cut, F.array_join(F.slice(ruler_tokens(F.col("text")), F.lit(1), left), " ")).otherwise(F.col("text")))
    return rows.withColumn("tokens", F.when(cut, F.col("__room")).otherwise(F.col("tokens"))).drop("__room", "__n", "__label", "__used")


def prompts(questions: DataFrame, hits: DataFrame, budget: int | None = None, answer_tokens: int = 0) -> DataFrame:
    """(query_id, question, contexts, prompt): hits in rank order, numbered from 1; with a budget those that fit."""
    if budget is not None:
        hits = within_budget(questions, hits, budget, answer_tokens)
    per = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_name", "page_number", "chunk_id", "score", "text"))).alias("contexts"))
    rows = questions.select("query_id", "question").join(per, "query_id", "left")
    return rows.withColumn("prompt", _prompt(F.col("contexts"), F.col("question")))


def _prompt(contexts: Column, question: Column) -> Column:
    return F.concat(F.lit(INSTRUCTIONS + "\n\n"), F.coalesce(context_block(contexts), F.lit("")), F.lit("\n\nQuestion: "), question)


def generate(rows: DataFrame, make_provider: Callable[[], Provider] = Extractive) -> DataFrame:
    """rows(query_id, prompt) -> (query_id, answer, error): a provider for each worker, a batch for each call; a failing batch gives its error, not a failed job."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make_provider()
        for f in frames:
            try:
                answers, error = provider.complete(f["prompt"].tolist()), None
            except Exception as e:  # noqa: BLE001 - a row's own failure is data here
                answers, error = [None] * len(f), str(e)[:200]
            yield pd.DataFrame({"query_id": f["query_id"], "answer": answers, "error": error})

    kind = rows.schema["query_id"].dataType.simpleString()
    return rows.select("query_id", "prompt").mapInPandas(work, f"query_id {kind}, answer string, error string")


def with_answers(asked: DataFrame, make_provider: Callable[[], Provider] = Extractive) -> DataFrame:
    """asked(query_id, question, contexts, prompt) with answer, error, cited and refused. asked is written first, so that the search behind it runs once."""
    asked = stash(asked.sparkSession, asked, "asked")
    out = asked.join(generate(asked, make_provider), "query_id", "left")
    return out.withColumns({"cited": citations(F.col("answer")), "refused": is_refusal(F.col("answer"))})


def answer_run(questions: DataFrame, evidence: DataFrame, hits: DataFrame, make_provider: Callable[[], Provider] = Extractive, done: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The record of a run: a row for each of questions(query_id, question_type, doc_name, question, gold_answer), resumable by ``done``(query_id).

    ``limit`` takes the first questions by query_id, as a trial does. doc_hit compares the contexts with the question's own document.
    """
    if limit is not None:
        questions = questions.orderBy("query_id").limit(limit)
    if done is not None:
        questions = questions.join(done.select("query_id"), "query_id", "left_anti")
    page = F.struct("doc_name", "page_number")
    gold = gold_pages(evidence).groupBy("query_id").agg(F.sort_array(F.collect_set(page)).alias("gold_pages"))
    rows = with_answers(prompts(questions, hits), make_provider).drop("question").join(questions, "query_id").join(gold, "query_id", "left")
    rows = rows.withColumn("gold_pages", F.coalesce("gold_pages", F.array().cast("array<struct<doc_name:string,page_number:int>>")))
    rows = rows.withColumn("contexts", F.coalesce("contexts", F.array().cast(rows.schema["contexts"].dataType)))
    out = answered(rows).withColumn("doc_hit", F.coalesce(F.exists("contexts", lambda c: c["doc_name"] == F.col("doc_name")), F.lit(False)))
    return out.select("query_id", "question_type", "doc_name", "question", "gold_answer", "gold_pages", "answer", "error", "cited", "refused", "page_hit", "first_hit_rank", "doc_hit", "cited_pages_valid", "contexts")


def regenerated(run: DataFrame, make_provider: Callable[[], Provider], page_hit_only: bool = False) -> DataFrame:
    """Another generator's answers to a run's questions from the contexts that the run kept; with page_hit_only just where a gold page was found."""
    rows = run.where("page_hit") if page_hit_only else run
    asked = rows.select("query_id", "question", "contexts", _prompt(F.col("contexts"), F.col("question")).alias("prompt"))
    made = with_answers(asked, make_provider).select("query_id", "answer", "error", "cited", "refused")
    out = rows.drop("answer", "error", "cited", "refused", "cited_pages_valid").join(made, "query_id")
    return out.withColumn("cited_pages_valid", F.coalesce(cited_valid(F.col("cited"), F.col("contexts"), F.col("gold_pages")), F.lit(False))).select(run.columns)


def cited_valid(cited: Column, contexts: Column, gold: Column) -> Column:
    """Whether some cited number within 1..len(contexts) stands at a gold page; gold is array<struct<doc_name, page_number>>."""
    at = lambda i: F.get(contexts, i - 1)
    page = lambda i: F.struct(at(i)["doc_name"].alias("doc_name"), at(i)["page_number"].alias("page_number"))
    return F.exists(cited, lambda i: (i >= 1) & (i <= F.size(contexts)) & F.coalesce(F.array_contains(gold, page(i)), F.lit(False)))


def answered(rows: DataFrame) -> DataFrame:
    """rows(answer, contexts, gold_pages) with cited, refused, page_hit, first_hit_rank, cited_pages_valid."""
    hit = lambda c: F.array_contains(F.col("gold_pages"), F.struct(c["doc_name"].alias("doc_name"), c["page_number"].alias("page_number")))
    first = F.array_min(F.transform(F.filter("contexts", hit), lambda c: c["rank"]))
    out = rows.withColumns({"cited": citations(F.col("answer")), "refused": is_refusal(F.col("answer")), "first_hit_rank": first})
    return out.withColumns({"page_hit": F.col("first_hit_rank").isNotNull(), "cited_pages_valid": cited_valid(F.col("cited"), F.col("contexts"), F.col("gold_pages"))})


def grades(answers: DataFrame) -> DataFrame:
    """answers(gold_answer, answer, judge_reply, cited, ...) with numeric_match, verdict and what follows from it."""
    verdict = verdict_of(F.col("judge_reply"), "verdict", ("correct", "partial", "incorrect"), "incorrect")
    out = answers.withColumns({"numeric_match": numeric_match(F.col("gold_answer"), F.col("answer")), "verdict": verdict, "has_citation": F.size("cited") > 0})
    return out.withColumns({"correct": F.col("verdict") == "correct", "correct_or_partial": F.col("verdict").isin("correct", "partial")})


def grade_summary(graded: DataFrame, digits: int = 6) -> DataFrame:
    """One row overall, one for each question_type, one for each page_hit: rates; citation_rate over answers that do not refuse, numeric accuracy over numeric gold."""
    rate = lambda c: F.round(F.avg(c.cast("int")), digits)
    label = F.when(F.grouping("question_type") == 0, F.col("question_type")).when(F.grouping("page_hit") == 0, F.concat(F.lit("page_hit="), F.col("page_hit").cast("string"))).otherwise(F.lit("overall"))
    return graded.groupingSets([[], ["question_type"], ["page_hit"]], "question_type", "page_hit").agg(
        label.alias("label"), F.count(F.lit(1)).alias("n"), rate(F.col("correct")).alias("accuracy"), rate(F.col("correct_or_partial")).alias("acc_or_partial"),
        rate(F.col("refused")).alias("refusal_rate"), rate(F.when(~F.col("refused"), F.col("has_citation"))).alias("citation_rate"),
        rate(F.col("cited_pages_valid")).alias("cited_valid_rate"), rate(F.col("numeric_match")).alias("numeric_match_acc"),
    ).drop("question_type", "page_hit")


def agreement(graded: DataFrame) -> DataFrame:
    """How often the numeric check and the judge agree where the gold answer is numeric."""
    return graded.where(F.col("numeric_match").isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("numeric_match") == F.col("correct")).cast("double")).alias("agreement"))
