"""Queries on sources, sinks, indexes, runs and judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import REFUSAL
from pageloom.operators import answers, configured, evaluation, judging, lexical, pairwise, retriever, sampling
from pageloom.sources import config, files
from pageloom.store import scratch, stash
from pageloom.streaming.ingest import append_new

from .corpus import _RULER
from .retrieval import KS, SQL as RETRIEVAL_SQL, _EVIDENCE, _INDEX, _OVERLAP, _PAGES, _bm25, _evidence, _hits, _pages_as_chunks, _queries, _questions, _read, _rrf, overlap_top_k


def _text_md5():
    return F.md5(F.col("text").cast("binary")).alias("text_md5")


def jsonl_round_trip(spark, sf_dir):
    path, schema = scratch(spark, "jsonl"), "doc_id long, text string, lang string, tags array<struct<name:string,n:int>>"
    rows = _read(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), F.array(F.struct(F.col("source").alias("name"), F.lit(1).alias("n"))).alias("tags"))
    files.write_jsonl(rows, path)
    return files.read_jsonl(spark, path, schema).select("doc_id", _text_md5(), "lang", F.col("tags")[0]["name"].alias("source"))


def jsonl_tolerant(spark, sf_dir):
    """A third of the lines is cut off, as the last line of a run that was killed is."""
    path = scratch(spark, "jsonl")
    line = F.to_json(F.struct("event_id", "event_type"))
    rows = _read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.left(line, F.lit(9))).otherwise(line).alias("value"))
    rows.write.text(path)
    return files.read_jsonl(spark, path, "event_id long, event_type string", tolerant=True)


def jsonl_rejected(spark, sf_dir):
    """How many lines of each kind a tolerant reader leaves out."""
    path = scratch(spark, "jsonl")
    line = F.to_json(F.struct("event_id", "event_type"))
    _read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 3 == 0, F.left(line, F.lit(9))).otherwise(line).alias("value")).write.text(path)
    return files.jsonl_report(spark, path, "event_id long, event_type string")


def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    files.write_csv(_read(spark, sf_dir, "nation"), path)
    return files.read_csv(spark, path, "n_nationkey long, n_name string, n_regionkey long")


def parquet_written_once(spark, sf_dir):
    """The second write finds the table there and leaves it alone."""
    path, nation = scratch(spark, "table"), _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    files.write_once(nation, path)
    files.write_once(nation.limit(1), path)
    return spark.read.parquet(path)


def resumed_append(spark, sf_dir):
    """A run that was stopped after the labelled documents goes on with the others."""
    path, docs = scratch(spark, "out"), _read(spark, sf_dir, "documents").select("doc_id", "lang")
    first = docs.join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    first.select("doc_id", "lang", F.lit(1).alias("run")).write.parquet(path)
    rest = sampling.not_done(docs, spark.read.parquet(path), "doc_id")
    rest.select("doc_id", "lang", F.lit(2).alias("run")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def stream_append_new(spark, sf_dir):
    """Events land twice, the second time with more; each comes out once."""
    landing, out, checkpoint = (scratch(spark, t) for t in ("landing", "out", "checkpoint"))
    events = _read(spark, sf_dir, "events").select("event_id", "event_type")
    events.where("event_id % 2 = 0").write.mode("append").parquet(landing)
    append_new(spark, landing, events.schema, out, checkpoint, "event_id").awaitTermination()
    events.where("event_id % 2 = 1 OR event_id % 4 = 0").write.mode("append").parquet(landing)
    append_new(spark, landing, events.schema, out, checkpoint, "event_id").awaitTermination()
    return spark.read.parquet(out)


def _strict(content: bytes) -> list[str]:
    text = content.decode()
    if len(text) % 3 == 0:
        raise ValueError("a length that this parser cannot take")
    return [text[:100], "", text[100:]]


def parse_isolation(spark, sf_dir):
    """Two parsers on all pages; one fails on a third of them, which costs neither the other pages nor the other parser."""
    raw = _read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_name"), F.col("html").cast("binary").alias("content"))
    manifest = files.parse_manifest(files.parse_pages(raw, {"strict": _strict, "whole": lambda b: [b.decode()]}))
    return manifest.select("parser", F.col("doc_name").cast("long").alias("page_id"), "status", "pages", F.col("chars").cast("long").alias("chars"), "error_message")


def mirror_todo(spark, sf_dir):
    listing = _read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, F.lit(".txt")).otherwise(F.lit(".pdf"))).alias("name"))
    present = _read(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"))
    return files.mirror_manifest(listing.withColumn("download_url", F.concat(F.lit("https://files.test/"), F.col("name"))), present)


def evidence_own_document(spark, sf_dir):
    """Evidence without a document, or with an empty one, has its question's."""
    e = lambda doc, n: F.struct(doc.alias("doc_name"), (F.col("o_orderkey") % 7 + n).cast("int").alias("evidence_page_num"), F.col("o_orderpriority").alias("evidence_text"))
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("doc_name"), F.array(e(F.lit(None).cast("string"), 0), e(F.lit(""), 1), e(F.lit("other"), 2)).alias("evidence"))
    return evaluation.evidence_rows(rows)


def point_lookup(spark, sf_dir):
    return sampling.lookup(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 7)


def preview_rows(spark, sf_dir):
    return sampling.preview(_read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], 20)


def head_rows(spark, sf_dir):
    return sampling.head(_read(spark, sf_dir, "documents").select("doc_id", "lang"), 25, "doc_id")


def index_saved_and_extended(spark, sf_dir):
    """bm25_topk over an index that was built for two thirds of the documents, saved, read again and extended by all."""
    path, docs = scratch(spark, "index"), _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    lexical.LexicalIndex.build(docs.where("chunk_id % 3 <> 1")).save(path)
    return lexical.LexicalIndex.load(spark, path).extended(docs).top_k(_queries(spark, sf_dir), 10)


class _Overlap:
    """The overlap lists of the fusion queries as a retriever."""

    name = "overlap"

    def __init__(self, index: lexical.LexicalIndex):
        self.index = index

    def ranked(self, queries: DataFrame, k: int) -> DataFrame:
        return overlap_top_k(queries, self.index, k)


def hybrid_search(spark, sf_dir):
    index = lexical.LexicalIndex.build(_pages_as_chunks(spark, sf_dir))
    both = retriever.Hybrid(_Overlap(index), retriever.Lexical(index), 0.9)
    return both.search(_queries(spark, sf_dir), 5).select("query_id", "chunk_id", "doc_name", "page_number", F.col("score").alias("rrf"), "rank", _text_md5())


def retrieval_comparison(spark, sf_dir):
    """page_hit, evidence hit and gram recall of two retrievers, a row each."""
    chunks, queries = _pages_as_chunks(spark, sf_dir), _queries(spark, sf_dir)
    bm25 = retriever.Lexical(lexical.LexicalIndex.build(chunks))
    found = {"bm25": bm25.search(queries, 20), "overlap": retriever.with_chunks(_Overlap(bm25.index).ranked(queries, 20), chunks)}
    found = {name: stash(spark, hits, "hits") for name, hits in found.items()}  # few, read several times below
    out = evaluation.comparison(_questions(spark, sf_dir), _evidence(spark, sf_dir), found, KS)
    return out.select("configuration", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def _run(spark, sf_dir) -> DataFrame:
    questions = _queries(spark, sf_dir).select("query_id", F.concat(F.lit("type"), F.col("query_id") % 3).alias("question_type"), F.concat(F.lit("src"), F.col("query_id") % 4).alias("doc_name"), F.col("text").alias("question"), F.lit("7").alias("gold_answer"))
    return answers.answer_run(questions, _evidence(spark, sf_dir), _hits(spark, sf_dir).where("rank <= 10"))


_RUN = ("query_id", "question_type", "doc_name", "page_hit", "first_hit_rank", "doc_hit", "cited_pages_valid", "refused")


def answer_run_record(spark, sf_dir):
    return _run(spark, sf_dir).select(*_RUN, F.md5(F.col("answer").cast("binary")).alias("answer_md5"), F.array_join(F.col("cited").cast("array<string>"), ",").alias("cited"))


class _Refusing:
    def complete(self, prompts: list[str]) -> list[str]:
        return [REFUSAL for _ in prompts]


def regenerated_from_contexts(spark, sf_dir):
    """Another generator over the kept contexts of the questions whose gold page was found."""
    return answers.regenerated(_run(spark, sf_dir), _Refusing, page_hit_only=True).select(*_RUN, "answer")


def judge_prompt(spark, sf_dir):
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", judging.grade_prompt(F.col("text"), F.col("role"), F.lit("7")).alias("p"))
    return rows.select("conv_id", "turn", F.md5(F.col("p").cast("binary")).alias("prompt_md5"))


def pair_judge_parse(spark, sf_dir):
    """Replies as judges give them: either letter in either case, ties, other words, broken JSON."""
    k = F.col("event_id") % 7
    reply = F.when(k < 6, F.concat(F.lit('{"winner": "'), F.get(F.array(*map(F.lit, ("A", "a", " B ", "b", "Tie", "C"))), k.cast("int")), F.lit('", "reason": "r'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise(F.lit('{"winner": "A'))
    rows = pairwise.orders(_read(spark, sf_dir, "events").select("event_id", reply.alias("reply")), "event_id")
    return rows.select("event_id", judging.winner_of(F.col("reply")).alias("winner"), pairwise.preferred(judging.winner_of(F.col("reply")), F.col("seven_is_a")).alias("preferred"), judging.reason_of(F.col("reply")).alias("reason"))


def _answer_sets(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    said = lambda n: F.concat(F.lit("about "), F.floor(F.col("value") / n).cast("string"))
    first = events.where("event_type <> 'error'").select(F.col("user_id").alias("query_id"), "event_id", said(10).alias("answer"), (F.col("event_id") % 2 == 0).alias("page_hit"))
    return first, events.where("event_type <> 'view'").select(F.col("user_id").alias("query_id"), "event_id", said(20).alias("answer"))


def answers_joined(spark, sf_dir):
    return judging.matched(*_answer_sets(spark, sf_dir), order="event_id", page_hit_only=False).select("query_id", "event_id", "answer", "other_answer", "page_hit")


def pair_judged(spark, sf_dir):
    pairs = judging.matched(*_answer_sets(spark, sf_dir), order="event_id").withColumns({"question": F.lit("How much?"), "gold_answer": F.concat(F.lit("it was "), (F.col("query_id") % 25).cast("string")), "question_type": F.lit("t")})
    return judging.compared(pairs, judging.MostlyDigits, "digits").select("query_id", "page_hit", "judge", "seven_is_a", "preferred", "reason")


def judged_answers(spark, sf_dir):
    rows = _answer_sets(spark, sf_dir)[0].select(F.col("event_id").alias("query_id"), F.lit("How much?").alias("question"), F.concat(F.lit("it was "), (F.col("query_id") % 25).cast("string")).alias("gold_answer"), "answer")
    return judging.judged(rows, judging.MostlyDigits).select("query_id", "verdict", "reason")


def configured_chunks(spark, sf_dir):
    """Chunks by a configuration, of the documents with labels alone."""
    pages = _read(spark, sf_dir, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string")).alias("doc_name"), (F.col("doc_id") + 1).cast("int").alias("page_number"), "text")
    wanted = _read(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string")).alias("doc_name"))
    cfg = config.ChunkConfig("f128", "fixed", 128, 32, eval_docs_only=True)
    return configured.chunks_of(pages, cfg, wanted).select("chunk_id", "n_tokens", "n_chars", _text_md5())


QUERIES = {f.__name__: f for f in (
    jsonl_round_trip, jsonl_tolerant, jsonl_rejected, csv_round_trip, parquet_written_once, resumed_append, stream_append_new, parse_isolation, mirror_todo, evidence_own_document, point_lookup, preview_rows,
    head_rows, index_saved_and_extended, hybrid_search, retrieval_comparison, answer_run_record, regenerated_from_contexts, judge_prompt, pair_judge_parse, answers_joined, pair_judged, judged_answers, configured_chunks,
)}

_SEVEN = "right(sha256(CAST({k} AS VARCHAR)), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e')"
_SETS = """
a AS (SELECT user_id AS query_id, max(event_id) AS event_id, max_by(CAST(floor(value / 10) AS BIGINT), event_id) AS x, max_by(event_id % 2 = 0, event_id) AS page_hit FROM events WHERE event_type <> 'error' GROUP BY user_id),
b AS (SELECT user_id AS query_id, max_by(CAST(floor(value / 20) AS BIGINT), event_id) AS y FROM events WHERE event_type <> 'view' GROUP BY user_id)"""


def _compared(name: str, evidence: str) -> str:
    columns = [f"round(avg(page_hit_{k}), 6) AS page_hit_{k}" for k in KS]
    columns += [f"round((SELECT avg({c}) FROM ev WHERE k = {k}), 6) AS {n}_{k}" for k in KS for c, n in (("any_hit", "evidence_hit"), ("token_recall", "token_recall"), ("gram_recall", "gram_recall"))]
    return f"SELECT * FROM ({evidence} SELECT '{name}' AS configuration, {', '.join(columns)} FROM metrics)"


_BODY = r"regexp_replace(regexp_replace(text, '[\s\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')"
_RECORD = f"""{_PAGES},
r AS (SELECT item_id AS query_id, 'type' || (item_id % 3) AS question_type, 'src' || (item_id % 4) AS doc_name FROM benchmark),
h AS (SELECT f.query_id, min(CASE WHEN page_gold THEN rank END) AS first_hit_rank, bool_or(f.doc_name = r.doc_name) AS doc_hit, bool_or(rank = 1 AND page_gold) AS cited_pages_valid,
  left(string_split(max(CASE WHEN rank = 1 THEN {_BODY} END), '. ')[1], 200) || ' [1]' AS answer FROM flags f JOIN r ON f.query_id = r.query_id WHERE rank <= 10 GROUP BY f.query_id),
record AS (SELECT r.*, first_hit_rank IS NOT NULL AS page_hit, first_hit_rank, coalesce(doc_hit, FALSE) AS doc_hit, coalesce(cited_pages_valid, FALSE) AS cited_pages_valid, h.query_id IS NULL AS refused,
  coalesce(answer, '{REFUSAL}') AS answer, CASE WHEN h.query_id IS NULL THEN '' ELSE '1' END AS cited FROM r LEFT JOIN h ON r.query_id = h.query_id)"""

SQL = {
    "jsonl_round_trip": "SELECT doc_id, md5(text) AS text_md5, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, source FROM documents",
    "jsonl_tolerant": "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0",
    "jsonl_rejected": "SELECT event_id % 3 <> 0 AS accepted, count(*) AS n FROM events GROUP BY 1",
    "csv_round_trip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "parquet_written_once": "SELECT n_nationkey, n_name FROM nation",
    "resumed_append": "SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 2 END AS run FROM documents",
    "stream_append_new": "SELECT event_id, event_type FROM events",
    "parse_isolation": """SELECT 'whole' AS parser, page_id, 'ok' AS status, 1::BIGINT AS pages, length(html) AS chars, NULL AS error_message FROM pages
UNION ALL SELECT 'strict', page_id, CASE WHEN length(html) % 3 = 0 THEN 'failed' ELSE 'ok' END, CASE WHEN length(html) % 3 = 0 THEN 0 ELSE 3 END, CASE WHEN length(html) % 3 = 0 THEN 0 ELSE length(html) END,
  CASE WHEN length(html) % 3 = 0 THEN 'a length that this parser cannot take' END FROM pages""",
    "mirror_todo": "SELECT 'd' || doc_id AS doc_name, 'https://files.test/d' || doc_id || '.pdf' AS doc_link FROM documents WHERE doc_id % 4 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "evidence_own_document": """SELECT o_orderkey AS query_id, span, CASE WHEN span = 2 THEN 'other' ELSE o_orderstatus END AS doc_name, CAST(o_orderkey % 7 + span AS INTEGER) AS page_num, o_orderpriority AS text
FROM orders, (VALUES (0::BIGINT), (1), (2)) v(span)""",
    "point_lookup": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "preview_rows": r"SELECT doc_id, left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 200) AS text FROM documents ORDER BY doc_id LIMIT 20",
    "head_rows": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25",
    "index_saved_and_extended": RETRIEVAL_SQL["bm25_topk"],
    "hybrid_search": f"{_rrf('[0.9::DOUBLE]')} SELECT query_id, chunk_id, source AS doc_name, CAST(doc_id + 1 AS INTEGER) AS page_number, rrf, rank, md5(text) AS text_md5 FROM ranked JOIN documents ON chunk_id = doc_id WHERE rank <= 5",
    "retrieval_comparison": _compared("bm25", _EVIDENCE) + " UNION ALL " + _compared("overlap", _EVIDENCE.replace(_bm25(20), f"{_OVERLAP}, hits AS (SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 20)")),
    "answer_run_record": f"{_RECORD} SELECT {', '.join(_RUN)}, md5(answer) AS answer_md5, cited FROM record",
    "generated_answers": f"{_RECORD} SELECT query_id, answer, cited, refused, page_hit, first_hit_rank, cited_pages_valid FROM record",
    "regenerated_from_contexts": f"{_RECORD} SELECT query_id, question_type, doc_name, page_hit, first_hit_rank, doc_hit, FALSE AS cited_pages_valid, TRUE AS refused, '{REFUSAL}' AS answer FROM record WHERE page_hit",
    "judge_prompt": f"SELECT conv_id, turn, md5('{judging.GRADE}' || chr(10) || chr(10) || 'Question: ' || coalesce(text, '') || chr(10) || 'Reference answer: ' || coalesce(role, '') || chr(10) || 'Candidate answer: 7') AS prompt_md5 FROM conversations",
    "pair_judge_parse": f"""WITH w AS (SELECT event_id, CASE WHEN event_id % 7 < 2 THEN 'A' WHEN event_id % 7 < 4 THEN 'B' ELSE 'tie' END AS winner, {_SEVEN.format(k="event_id")} AS seven_is_a FROM events)
SELECT event_id, winner, CASE WHEN winner = 'tie' THEN 'tie' WHEN (winner = 'A') = seven_is_a THEN '7b' ELSE '3b' END AS preferred, CASE WHEN event_id % 7 < 6 THEN 'r' || event_id ELSE 'unparseable judge output' END AS reason FROM w""",
    "answers_joined": f"WITH {_SETS} SELECT query_id, event_id, 'about ' || x AS answer, 'about ' || y AS other_answer, page_hit FROM a JOIN b USING (query_id)",
    "pair_judged": f"""WITH {_SETS}, s AS (SELECT query_id, page_hit, {_SEVEN.format(k="query_id")} AS seven_is_a, abs(x) = query_id % 25 AS small, abs(y) = query_id % 25 AS large FROM a JOIN b USING (query_id) WHERE page_hit)
SELECT query_id, page_hit, 'digits' AS judge, seven_is_a, CASE WHEN large AND NOT small THEN '7b' WHEN small AND NOT large THEN '3b' ELSE 'tie' END AS preferred,
  CAST(CASE WHEN seven_is_a THEN large ELSE small END AS INTEGER) || ' to ' || CAST(CASE WHEN seven_is_a THEN small ELSE large END AS INTEGER) AS reason FROM s""",
    "judged_answers": """WITH s AS (SELECT event_id AS query_id, abs(CAST(floor(value / 10) AS BIGINT)) = user_id % 25 AS good FROM events WHERE event_type <> 'error')
SELECT query_id, CASE WHEN good THEN 'correct' ELSE 'incorrect' END AS verdict, CASE WHEN good THEN '1.00' ELSE '0.00' END AS reason FROM s""",
    "configured_chunks": f"""WITH p AS (SELECT 'd' || (doc_id % 50) AS doc_name, CAST(doc_id + 1 AS INTEGER) AS page_number, regexp_extract_all(coalesce(text, ''), '{_RULER}') AS t FROM documents
  WHERE doc_id % 50 IN (SELECT doc_id % 50 FROM labels WHERE toxic = 1)),
w AS (SELECT doc_name, page_number, i, list_slice(t, i * 96 + 1, i * 96 + 128) AS w FROM (SELECT *, unnest(range(0, CAST(greatest(ceil((len(t) - 128) / 96.0), 0) AS BIGINT) + 1)) AS i FROM p WHERE len(t) > 0)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_name ORDER BY page_number, i) - 1 AS c, array_to_string(w, ' ') AS text FROM w)
SELECT doc_name || '__p' || page_number || '__c' || c AS chunk_id, CAST(len(w) AS INTEGER) AS n_tokens, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS text_md5 FROM n""",
}
