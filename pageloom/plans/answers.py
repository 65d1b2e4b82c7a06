"""Queries on answers: prompts, citations, grading, pairwise comparison, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import REFUSAL, citations, context_block, first_of_pair, is_refusal, numeric_match, parse_number, verdict_of, word_count
from pageloom.operators import answers, lexical, pairwise, stats
from pageloom.operators.evaluation import gold_pages

from .retrieval import _chunks, _evidence, _hits, _queries, _read


def citation_extract(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations")
    said = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("] and ["), (F.col("turn") + 9).cast("string"), F.lit(", 3]"))
    return rows.select("conv_id", "turn", F.array_join(citations(said).cast("array<string>"), ",").alias("cited"))


def refusal_flag(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations")
    said = F.when(F.col("role") == "assistant", F.concat("text", F.lit(" " + REFUSAL.upper() + " Sorry."))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", is_refusal(said).alias("refused"))


def answer_word_count(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", word_count(F.col("text")).cast("long").alias("words"))


def cited_pages_valid(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations")
    page = lambda n: F.struct(F.col("role").alias("doc_name"), (F.col("turn") + n).cast("int").alias("page_number"))
    cited = citations(F.concat(F.lit("[0] ["), (F.col("turn") % 3 + 1).cast("string"), F.lit(", 11]")))
    return rows.select("conv_id", "turn", answers.cited_valid(cited, F.array(page(0), page(1), page(2)), F.array(page(1), page(7))).alias("cited_pages_valid"))


def _priced(spark, sf_dir) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    money = F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))
    kind = F.col("l_linenumber") % 4
    gold = F.when(kind == 0, F.concat(money, F.lit(" million"))).when(kind == 1, F.concat(F.lit("loss of ("), money, F.lit(")"))).when(kind == 2, F.concat(F.lit("about "), money, F.lit(" basis points"))).otherwise(F.lit("n/a"))
    off = F.when(F.col("l_quantity") < 25, F.lit(1.005)).otherwise(F.lit(1.02))
    answer = F.concat(F.lit("In 1999 it was $"), F.format_number(F.col("l_extendedprice") * off, 2), F.when(kind == 0, F.lit(" million.")).when(kind == 2, F.lit(" bn.")).otherwise(F.lit(".")))
    return rows.select("l_orderkey", "l_linenumber", gold.alias("gold"), answer.alias("answer"))


def parse_number_query(spark, sf_dir):
    return _priced(spark, sf_dir).select("l_orderkey", "l_linenumber", parse_number(F.col("gold")).alias("value"))


def numeric_match_query(spark, sf_dir):
    return _priced(spark, sf_dir).select("l_orderkey", "l_linenumber", numeric_match(F.col("gold"), F.col("answer")).alias("numeric_match"))


def _graded(spark, sf_dir) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    n = F.col("n_chars")
    return docs.join(labels, "doc_id").select(
        "doc_id", F.col("lang").alias("question_type"), (n % 2 == 0).alias("page_hit"), (n % 5 == 0).alias("refused"), (n % 3 == 0).alias("has_citation"), (n % 7 == 0).alias("cited_pages_valid"),
        F.when(n % 4 != 0, n % 4 == 1).alias("numeric_match"), (F.col("quality") == 1).alias("correct"), ((F.col("quality") == 1) | (F.col("toxic") == 1)).alias("correct_or_partial"),
    )


def answer_block_summary(spark, sf_dir):
    return answers.grade_summary(_graded(spark, sf_dir))


def signal_agreement(spark, sf_dir):
    return answers.agreement(_graded(spark, sf_dir)).select("n", F.round("agreement", 6).alias("agreement"))


def verdict_by_page_hit(spark, sf_dir):
    verdict = F.when(F.col("correct"), "correct").when(F.col("correct_or_partial"), "partial").otherwise("incorrect")
    table = _graded(spark, sf_dir).withColumn("verdict", verdict).groupBy("page_hit").pivot("verdict", ["correct", "partial", "incorrect"]).count().na.fill(0)
    whole = F.col("correct") + F.col("partial") + F.col("incorrect")
    return table.withColumns({f"{v}_share": F.round(F.col(v) / whole, 6) for v in ("correct", "partial", "incorrect")})


def ab_order_sha256(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", first_of_pair(F.col("doc_id")).alias("seven_is_a"))


def _judged(spark, sf_dir, swap: bool) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    pick = F.col("o_custkey") % 3 if not swap else F.when(F.col("o_orderkey") % 5 == 0, (F.col("o_custkey") + 1) % 3).otherwise(F.col("o_custkey") % 3)
    name = lambda p: F.when(p == 0, "7b").when(p == 1, "3b").otherwise("tie")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("judge"), name(pick).alias("preferred"), F.col("o_orderpriority").alias("question_type"))


def preference_crosstab(spark, sf_dir):
    return pairwise.crosstab(_judged(spark, sf_dir, False))


def preference_summary(spark, sf_dir):
    p = pairwise.preferences(_judged(spark, sf_dir, False))
    return p.select("judge", "n", "prefers_7b", "prefers_3b", "ties", *[F.round(f"{c}_rate", 6).alias(f"{c}_rate") for c in ("prefers_7b", "prefers_3b", "ties")], F.round("sign_test_p", 6).alias("sign_test_p"))


def winner_to_model(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "A").when(F.col("o_custkey") % 3 == 1, "B").alias("winner"))
    return pairwise.orders(o, "o_orderkey").select("o_orderkey", "seven_is_a", pairwise.preferred(F.col("winner"), F.col("seven_is_a")).alias("preferred"))


def _robust(spark, sf_dir):
    return pairwise.order_robust(_judged(spark, sf_dir, False), _judged(spark, sf_dir, True))


def order_robust_preferences(spark, sf_dir):
    r = pairwise.robust_summary(_robust(spark, sf_dir))
    return r.withColumn("order_unstable_rate", F.round("order_unstable_rate", 6))


def both_judges_agree(spark, sf_dir):
    one = _robust(spark, sf_dir).select("id", F.lit("first").alias("judge"), "robust")
    other = _judged(spark, sf_dir, True).select("id", F.lit("second").alias("judge"), F.col("preferred").alias("robust"))
    return pairwise.both_judges(one.unionByName(other), "first", "second")


def sign_test(spark, sf_dir):
    fixed = spark.createDataFrame([(14, 11), (25, 14), (0, 0), (4, 0), (3, 0), (2000, 1900)], "a long, b long")
    counted = _judged(spark, sf_dir, False).groupBy("judge").agg(F.count_if(F.col("preferred") == "7b").alias("a"), F.count_if(F.col("preferred") == "3b").alias("b")).select("a", "b")
    return fixed.unionByName(counted).select("a", "b", F.round(stats.sign_test(F.col("a"), F.col("b")), 6).alias("p"))


def context_prompt(spark, sf_dir):
    hits = _hits(spark, sf_dir).where("rank <= 5")
    per = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_name", "page_number", "text"))).alias("c"))
    return per.select("query_id", F.md5(context_block(F.col("c")).cast("binary")).alias("context_md5"))


def budgeted_contexts(spark, sf_dir):
    """The first hits of each item that fit into 2,048 tokens beside instructions, question and 256 tokens of answer."""
    questions = _queries(spark, sf_dir).withColumnRenamed("text", "question")
    kept = answers.within_budget(questions, _hits(spark, sf_dir).where("rank <= 10"), 2048, 256)
    return kept.select("query_id", "rank", "chunk_id", F.col("tokens").cast("long").alias("tokens"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def generated_answers(spark, sf_dir):
    questions = _queries(spark, sf_dir).withColumnRenamed("text", "question")
    gold = gold_pages(_evidence(spark, sf_dir)).groupBy("query_id").agg(F.collect_list(F.struct("doc_name", "page_number")).alias("gold_pages"))
    rows = answers.with_answers(answers.prompts(questions, _hits(spark, sf_dir).where("rank <= 10"))).join(gold, "query_id", "left")
    rows = rows.withColumn("gold_pages", F.coalesce("gold_pages", F.array().cast("array<struct<doc_name:string,page_number:int>>")))
    return answers.answered(rows).select("query_id", "answer", F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"), "refused", "page_hit", "first_hit_rank", F.coalesce("cited_pages_valid", F.lit(False)).alias("cited_pages_valid"))


def json_judge_parse(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    reply = F.when(F.col("event_type") == "click", F.concat(F.lit('{"verdict": "Correct", "x": '), F.coalesce("props", F.lit("null")), F.lit("}"))).when(F.col("event_type") == "view", F.lit('{"verdict": "maybe"}')).otherwise(F.lit('{"verdict": "part'))
    return e.select("event_id", verdict_of(reply, "verdict", ("correct", "partial", "incorrect"), "incorrect").alias("verdict"))


def generator_operational_summary(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations")
    cited = F.when(F.col("turn") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    out = pairwise.operational(rows.select(F.col("role").alias("model"), (F.col("turn") == 1).alias("refused"), cited.alias("cited"), (F.col("turn") == 2).alias("cited_pages_valid"), F.col("text").alias("answer")))
    rates = ("refusal_rate", "citation_rate", "gold_page_citation_rate", "mean_answer_words", "median_answer_words")
    return out.select("model", "n", *[F.round(c, 6).alias(c) for c in rates])


QUERIES = {f.__name__.removesuffix("_query"): f for f in (
    citation_extract, refusal_flag, answer_word_count, cited_pages_valid, parse_number_query, numeric_match_query, answer_block_summary, signal_agreement, verdict_by_page_hit, ab_order_sha256,
    preference_crosstab, preference_summary, winner_to_model, order_robust_preferences, both_judges_agree, sign_test, context_prompt, budgeted_contexts, generated_answers, json_judge_parse, generator_operational_summary,
)}

from .corpus import _RULER  # noqa: E402
from .retrieval import _INDEX, _bm25  # noqa: E402


def _ruled(x: str) -> str:
    return f"regexp_extract_all({x}, '{_RULER}')"


_WORDS = r"len(list_filter(string_split_regex(text, '[\s\x{85}\p{Z}]+'), lambda w: w <> ''))"
_MONEY = "'$' || format('{:,.2f}', l_extendedprice)"
_PRICED = f"""
priced AS (SELECT l_orderkey, l_linenumber,
  CASE l_linenumber % 4 WHEN 0 THEN {_MONEY} || ' million' WHEN 1 THEN 'loss of (' || {_MONEY} || ')' WHEN 2 THEN 'about ' || {_MONEY} || ' basis points' ELSE 'n/a' END AS gold,
  l_extendedprice * CASE WHEN l_quantity < 25 THEN 1.005::DOUBLE ELSE 1.02::DOUBLE END AS said, l_extendedprice AS x FROM lineitem),
valued AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN x * 1e6 WHEN 1 THEN -x WHEN 2 THEN x * 1e9 END AS value FROM priced)"""
_N = "CAST(n_chars AS BIGINT)"
_GRADED = f"""
g AS (SELECT doc_id, lang AS question_type, {_N} % 2 = 0 AS page_hit, {_N} % 5 = 0 AS refused, {_N} % 3 = 0 AS has_citation, {_N} % 7 = 0 AS cited_pages_valid,
  CASE WHEN {_N} % 4 <> 0 THEN {_N} % 4 = 1 END AS numeric_match, quality = 1 AS correct, quality = 1 OR toxic = 1 AS correct_or_partial FROM documents JOIN labels USING (doc_id))"""
_RATES = ", ".join(f"round(avg(CAST({c} AS INTEGER)), 6) AS {n}" for c, n in (
    ("correct", "accuracy"), ("correct_or_partial", "acc_or_partial"), ("refused", "refusal_rate"), ("CASE WHEN NOT refused THEN has_citation END", "citation_rate"), ("cited_pages_valid", "cited_valid_rate"), ("numeric_match", "numeric_match_acc")))
_PICK = "CASE {p} WHEN 0 THEN '7b' WHEN 1 THEN '3b' ELSE 'tie' END"
_JUDGED = f"""
j AS (SELECT o_orderkey AS id, o_orderstatus AS judge, o_orderpriority AS question_type, {_PICK.format(p="o_custkey % 3")} AS preferred,
  {_PICK.format(p="CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey + 1) % 3 ELSE o_custkey % 3 END")} AS swapped FROM orders)"""
_P = "CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a, b) + 1), lambda k: exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) - (a + b) * ln(2))))) END"
_ROBUST = "CASE WHEN preferred = swapped THEN preferred ELSE 'unstable' END"

SQL = {
    "citation_extract": "SELECT conv_id, turn, array_to_string(list_sort(list_distinct([turn, turn + 9, 3])), ',') AS cited FROM conversations",
    "refusal_flag": "SELECT conv_id, turn, role = 'assistant' OR contains(lower(text), 'i cannot answer from the provided context.') AS refused FROM conversations",
    "answer_word_count": f"SELECT conv_id, turn, CAST({_WORDS} AS BIGINT) AS words FROM conversations",
    "cited_pages_valid": "SELECT conv_id, turn, turn % 3 + 1 = 2 AS cited_pages_valid FROM conversations",
    "parse_number": f"WITH {_PRICED} SELECT l_orderkey, l_linenumber, value FROM valued",
    "numeric_match": f"""WITH {_PRICED},
a AS (SELECT *, round(said, 2) * CASE l_linenumber % 4 WHEN 0 THEN 1e6 WHEN 2 THEN 1e9 ELSE 1 END AS n FROM valued)
SELECT l_orderkey, l_linenumber, CASE WHEN value IS NOT NULL THEN abs(n - value) <= greatest(0.01 * abs(value), 1e-6) OR abs(1999 - value) <= greatest(0.01 * abs(value), 1e-6) END AS numeric_match FROM a""",
    "answer_block_summary": f"""WITH {_GRADED} SELECT CASE WHEN grouping(question_type) = 0 THEN question_type WHEN grouping(page_hit) = 0 THEN 'page_hit=' || page_hit ELSE 'overall' END AS label, count(*) AS n, {_RATES}
FROM g GROUP BY GROUPING SETS ((), (question_type), (page_hit))""",
    "signal_agreement": f"WITH {_GRADED} SELECT count(*) AS n, round(avg(CAST(numeric_match = correct AS INTEGER)), 6) AS agreement FROM g WHERE numeric_match IS NOT NULL",
    "verdict_by_page_hit": f"WITH {_GRADED} SELECT page_hit, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct AND correct_or_partial) AS partial, count(*) FILTER (NOT correct_or_partial) AS incorrect, {", ".join(f"round(count(*) FILTER ({c}) / count(*), 6) AS {n}_share" for c, n in (("correct", "correct"), ("NOT correct AND correct_or_partial", "partial"), ("NOT correct_or_partial", "incorrect")))} FROM g GROUP BY page_hit",
    "ab_order_sha256": "SELECT doc_id, right(sha256(CAST(doc_id AS VARCHAR)), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS seven_is_a FROM documents",
    "preference_crosstab": f"WITH {_JUDGED} SELECT question_type, count(*) FILTER (preferred = '7b') AS \"7b\", count(*) FILTER (preferred = '3b') AS \"3b\", count(*) FILTER (preferred = 'tie') AS tie FROM j GROUP BY question_type",
    "preference_summary": f"""WITH {_JUDGED}, c AS (SELECT judge, count(*) AS n, count(*) FILTER (preferred = '7b') AS a, count(*) FILTER (preferred = '3b') AS b, count(*) FILTER (preferred = 'tie') AS t FROM j GROUP BY judge)
SELECT judge, n, a AS prefers_7b, b AS prefers_3b, t AS ties, round(a / n, 6) AS prefers_7b_rate, round(b / n, 6) AS prefers_3b_rate, round(t / n, 6) AS ties_rate, round({_P}, 6) AS sign_test_p FROM c""",
    "winner_to_model": """WITH s AS (SELECT o_orderkey, o_custkey % 3 AS w, right(sha256(CAST(o_orderkey AS VARCHAR)), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS seven_is_a FROM orders)
SELECT o_orderkey, seven_is_a, CASE WHEN w = 2 THEN 'tie' WHEN (w = 0) = seven_is_a THEN '7b' ELSE '3b' END AS preferred FROM s""",
    "order_robust_preferences": f"""WITH {_JUDGED}, r AS (SELECT judge, {_ROBUST} AS robust FROM j)
SELECT judge, count(*) AS n, count(*) FILTER (robust = '7b') AS robust_7b, count(*) FILTER (robust = '3b') AS robust_3b, count(*) FILTER (robust = 'tie') AS robust_tie, count(*) FILTER (robust = 'unstable') AS order_unstable,
  round(count(*) FILTER (robust = 'unstable') / count(*), 6) AS order_unstable_rate FROM r GROUP BY judge""",
    "both_judges_agree": f"WITH {_JUDGED}, r AS (SELECT {_ROBUST} AS x, swapped AS y FROM j) SELECT CASE WHEN x = y THEN x ELSE 'not_agree' END AS outcome, count(*) AS n FROM r GROUP BY 1",
    "sign_test": f"""WITH {_JUDGED}, c AS (SELECT * FROM (VALUES (14::BIGINT, 11::BIGINT), (25, 14), (0, 0), (4, 0), (3, 0), (2000, 1900)) v(a, b)
  UNION ALL SELECT count(*) FILTER (preferred = '7b'), count(*) FILTER (preferred = '3b') FROM j GROUP BY judge) SELECT a, b, round({_P}, 6) AS p FROM c""",
    "budgeted_contexts": f"""WITH {_INDEX}, {_bm25(10)},
h AS (SELECT f.query_id, f.rank, f.chunk_id, d.text, {_ruled("d.text")} AS t, len({_ruled("'[' || rank || '] (' || source || ' p.' || (doc_id + 1) || ')'")}) AS label,
  2048 - 256 - len({_ruled(f"'{answers.INSTRUCTIONS}'")}) - len({_ruled("'Question: ' || coalesce(b.text, '')")}) AS room
  FROM hits f JOIN documents d ON chunk_id = doc_id JOIN benchmark b ON item_id = f.query_id),
u AS (SELECT *, label + len(t) AS n, sum(label + len(t)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM h),
k AS (SELECT *, rank = 1 AND n > room AS cut FROM u WHERE used <= room OR (rank = 1 AND n > room AND room > label))
SELECT query_id, rank, chunk_id, CAST(CASE WHEN cut THEN room ELSE n END AS BIGINT) AS tokens, md5(CASE WHEN cut THEN array_to_string(list_slice(t, 1, room - label), ' ') ELSE text END) AS text_md5 FROM k""",
    "context_prompt": rf"""WITH {_INDEX}, {_bm25(5)}
SELECT query_id, md5(string_agg('[' || rank || '] (' || source || ' p.' || (doc_id + 1) || ') ' || regexp_replace(regexp_replace(text, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g'), chr(10) ORDER BY rank)) AS context_md5
FROM hits JOIN documents ON chunk_id = doc_id GROUP BY query_id""",
    "json_judge_parse": "SELECT event_id, CASE WHEN event_type = 'click' THEN 'correct' ELSE 'incorrect' END AS verdict FROM events",
    "generator_operational_summary": f"""SELECT role AS model, count(*) AS n, round(avg(CAST(turn = 1 AS INTEGER)), 6) AS refusal_rate, round(avg(CAST(turn % 2 = 0 AS INTEGER)), 6) AS citation_rate,
  round(avg(CAST(turn = 2 AS INTEGER)), 6) AS gold_page_citation_rate, round(avg({_WORDS}), 6) AS mean_answer_words, round(CAST(median({_WORDS}) AS DOUBLE), 6) AS median_answer_words FROM conversations GROUP BY role""",
}
