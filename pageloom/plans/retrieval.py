"""Queries on retrieval: BM25, vectors, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions.text import search_bag, search_tokens, weight_tag, word_tokens
from pageloom.operators import dense, evaluation, fusion, lexical, stats
from pageloom.operators.encoding import encode_column
from pageloom.operators.retriever import with_chunks
from pageloom.operators.scan import containing
from pageloom.store import stash

KS = (1, 3, 5, 10, 20)
WEIGHTS = (0.0, 0.5, 0.7, 0.8, 0.9, 1.0)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _chunks(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _queries(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark, sf_dir):
    return lexical.bm25_top_k(_queries(spark, sf_dir), _chunks(spark, sf_dir), 10)


def bm25_tokenize_subruns(spark, sf_dir):
    t = search_tokens(F.col("text"))
    return _chunks(spark, sf_dir).select("chunk_id", F.size(t).cast("long").alias("n_tokens"), F.md5(F.array_join(t, " ").cast("binary")).alias("tokens_md5"))


def bm25_term_stats(spark, sf_dir):
    index = lexical.LexicalIndex.build(_chunks(spark, sf_dir))
    return lexical.term_stats(index.terms, lexical.corpus_stats(index.counts)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_postings(spark, sf_dir):
    return lexical.postings(_chunks(spark, sf_dir))


def _vectors(spark, sf_dir):
    v = _read(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return queries, v.select("vec_id", F.col("embedding").alias("v"))


def dense_topk(spark, sf_dir):
    return dense.dense_top_k(*_vectors(spark, sf_dir), k=10)


def dense_topk_numpy(spark, sf_dir):
    return dense.dense_top_k_blocks(spark, *_vectors(spark, sf_dir), k=10)


def hashed_encoder_topk(spark, sf_dir):
    encode = encode_column()
    queries = _queries(spark, sf_dir).select("query_id", encode("text").alias("q"))
    corpus = _chunks(spark, sf_dir).select(F.col("chunk_id").alias("vec_id"), encode("text").alias("v"))
    return dense.dense_top_k_blocks(spark, queries, corpus, k=10)


def overlap_top_k(queries: DataFrame, index: lexical.LexicalIndex, k: int) -> DataFrame:
    """The second ranked list of the fusion queries: cosine of the sets of tokens of the index's chunks."""
    chunks = index.chunks
    if (scan := index.scan(queries)) and (best := scan.overlap(k)) is not None:
        return lexical.top_k(best, k).select("query_id", "chunk_id", "score", "rank")
    asked = queries.select("query_id", F.array_distinct(search_tokens(F.col("text"))).alias("t")).select("query_id", F.size("t").alias("nq"), F.explode("t").alias("term"))
    rows = chunks.select("chunk_id", F.explode(F.array(F.array_distinct(search_bag(F.col("text"))))).alias("t")).select("chunk_id", F.size("t").alias("nd"), F.explode("t").alias("term"))
    score = F.count(F.lit(1)) / F.sqrt(F.col("nq") * F.col("nd").cast("double"))
    return lexical.top_k(rows.join(asked, "term").groupBy("query_id", "chunk_id", "nq", "nd").agg(score.alias("score")), k).select("query_id", "chunk_id", "score", "rank")


def _both_lists(queries: DataFrame, chunks: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Overlap and BM25, from one pass over the texts."""
    index = lexical.LexicalIndex.build(chunks)
    return overlap_top_k(queries, index, k), index.top_k(queries, k)


def _fused(spark, sf_dir, weights, k=20):
    queries, chunks = _queries(spark, sf_dir), _chunks(spark, sf_dir)
    table = spark.createDataFrame([(w,) for w in weights], "weight double")
    return fusion.fuse(*_both_lists(queries, chunks, fusion.POOL), table, k)


def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir, [0.9]).drop("weight")


def rrf_weight_sweep(spark, sf_dir):
    return _fused(spark, sf_dir, WEIGHTS).withColumn("tag", weight_tag(F.col("weight")))


def contained(spark, sf_dir) -> DataFrame:
    """(query_id, doc_name, page_num, text): documents that contain an item's text, blank items left out.

    An item's inner tokens - the first and last may be parts of longer ones - stand in each document that contains it. So documents are found by
    the longest of them and then checked on their text. Items of one or two tokens have no inner one; they are looked for in each document.
    """
    items = _read(spark, sf_dir, "benchmark").where(F.col("text").rlike(r"\S")).select(F.col("item_id").alias("query_id"), F.col("text").alias("item"), word_tokens(F.col("text")).alias("w"))
    inner = F.transform(F.slice("w", 2, F.size("w") - 2), lambda w: F.struct(F.length(w), w.alias("token")))
    docs = _read(spark, sf_dir, "documents")
    if (found := containing(items.select("query_id", "item", F.when(F.size("w") > 2, F.array_max(inner)["token"]).alias("token")), docs)) is not None:
        return found
    keyed = items.where(F.size("w") > 2).select("query_id", F.array_max(inner)["token"].alias("token"))
    # Explosion, join and all: no lambda over a document's tokens.
    found = docs.select("doc_id", F.explode(word_tokens(F.col("text"))).alias("token")).join(keyed, "token").select("doc_id", "query_id").distinct()
    short = items.where(F.size("w") <= 2).select("query_id", "item")
    checked = docs.join(found, "doc_id").join(items.select("query_id", "item"), "query_id").where(F.contains("text", "item"))
    direct = docs.join(short, F.contains("text", "item"))  # a stated query set against all rows
    columns = ["query_id", F.col("source").alias("doc_name"), F.col("doc_id").alias("page_num"), F.col("item").alias("text")]
    return checked.select(*columns).unionByName(direct.select(*columns))


def _questions(spark, sf_dir) -> DataFrame:
    return _queries(spark, sf_dir).select("query_id", F.concat(F.lit("type"), F.col("query_id") % 3).alias("question_type"))


def _evidence(spark, sf_dir) -> DataFrame:
    """Each containing page is evidence; the text counts once for each document, and for src0 where no page contains it."""
    found = stash(spark, contained(spark, sf_dir), "contained")
    pages = found.select("query_id", F.lit(-1).cast("long").alias("span"), "doc_name", "page_num", F.lit(None).cast("string").alias("text"))
    spans = found.select("query_id", "doc_name", "text").distinct()
    bare = _queries(spark, sf_dir).join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit("src0").alias("doc_name"), "text")
    texts = spans.unionByName(bare).select("query_id", F.crc32(F.col("doc_name").cast("binary")).alias("span"), "doc_name", F.lit(None).cast("long").alias("page_num"), "text")
    return pages.unionByName(texts)


def _pages_as_chunks(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_name"), (F.col("doc_id") + 1).cast("int").alias("page_number"), "text")


def _hits(spark, sf_dir) -> DataFrame:
    return with_chunks(lexical.bm25_top_k(_queries(spark, sf_dir), _chunks(spark, sf_dir), 20), _pages_as_chunks(spark, sf_dir))


def gold_pages(spark, sf_dir):
    return evaluation.gold_pages(_evidence(spark, sf_dir))


def _page_metrics(spark, sf_dir):
    return evaluation.page_metrics(_questions(spark, sf_dir), _evidence(spark, sf_dir), _hits(spark, sf_dir), KS)


def hit_at_k(spark, sf_dir):
    return _page_metrics(spark, sf_dir).select("query_id", *[f"{m}_hit_{k}" for m in ("doc", "page") for k in KS])


def page_recall_at_k(spark, sf_dir):
    return _page_metrics(spark, sf_dir).select("query_id", "n_gold_pages", *[F.round(f"page_recall_{k}", 6).alias(f"page_recall_{k}") for k in KS])


def mrr(spark, sf_dir):
    return _page_metrics(spark, sf_dir).select("query_id", "first_page_hit_rank", F.round("mrr", 6).alias("mrr"))


def _evidence_metrics(spark, sf_dir):
    return evaluation.evidence_metrics(_questions(spark, sf_dir), _evidence(spark, sf_dir), _hits(spark, sf_dir), KS)


def evidence_token_recall(spark, sf_dir):
    return _evidence_metrics(spark, sf_dir).select("query_id", "k", F.round("token_recall", 6).alias("token_recall"))


def evidence_ngram_recall(spark, sf_dir):
    return _evidence_metrics(spark, sf_dir).select("query_id", "k", F.round("gram_recall", 6).alias("gram_recall"))


def evidence_any_all_hit(spark, sf_dir):
    return _evidence_metrics(spark, sf_dir).select("query_id", "k", "any_hit", "all_hit")


def retrieval_summary_grouping_sets(spark, sf_dir):
    metrics = ["mrr", *[f"{m}_{k}" for m in ("doc_hit", "page_hit", "page_recall") for k in KS]]
    out = evaluation.summary(_page_metrics(spark, sf_dir), metrics)
    return out.select("label", "n", *[F.round(m, 6).alias(m) for m in metrics])


def paired_bootstrap_ci(spark, sf_dir):
    queries, chunks = _queries(spark, sf_dir), _chunks(spark, sf_dir)
    evidence, pages, parts = _evidence(spark, sf_dir), _pages_as_chunks(spark, sf_dir), []
    for name, top in zip(("overlap", "baseline"), _both_lists(queries, chunks, 10)):
        got = evaluation.page_metrics(_questions(spark, sf_dir), evidence, with_chunks(top, pages), (5, 10))
        parts.append(got.withColumn("variant", F.lit(name)))
    out = stats.paired_bootstrap(parts[0].unionByName(parts[1]), ["mrr", "page_hit_5", "page_hit_10"])
    return out.select("variant", "metric", *[F.round(c, 6).alias(c) for c in ("value", "delta_vs_baseline", "delta_ci95_low", "delta_ci95_high")], "n_questions")


QUERIES = {f.__name__: f for f in (
    bm25_topk, bm25_tokenize_subruns, bm25_term_stats, bm25_postings, dense_topk, dense_topk_numpy, hashed_encoder_topk, rrf_fuse, rrf_weight_sweep, gold_pages, hit_at_k,
    page_recall_at_k, mrr, evidence_token_recall, evidence_ngram_recall, evidence_any_all_hit, retrieval_summary_grouping_sets, paired_bootstrap_ci,
)}


def _words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def _tok(x: str) -> str:
    return f"""flatten(list_transform({_words(x)}, lambda w: CASE WHEN regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]')
      THEN list_concat([w], regexp_extract_all(w, '[a-z]+|[0-9]+')) ELSE [w] END))"""


_INDEX = f"""
dt AS (SELECT doc_id AS chunk_id, {_tok("text")} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM dt),
tf AS (SELECT term, chunk_id, dl, least(count(*), 65535) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM dt) GROUP BY term, chunk_id, dl),
idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, corpus GROUP BY term),
qt AS (SELECT item_id AS query_id, unnest(list_distinct({_tok("text")})) AS term FROM benchmark)"""


def _bm25(k: int, name: str = "hits") -> str:
    return f"""
scores_{name} AS (SELECT query_id, chunk_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN idf USING (term), corpus GROUP BY query_id, chunk_id),
{name} AS (SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank
  FROM scores_{name} WHERE score > 0) WHERE rank <= {k})"""


_DENSE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT * FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.x, b.x), 6) AS score,
    CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.x, b.x), 6) DESC, b.vec_id) AS INTEGER) AS rank
  FROM v a, v b WHERE a.vec_id % 100 = 0) WHERE rank <= 10"""

_OVERLAP = f"""
qd AS (SELECT item_id AS query_id, list_distinct({_tok("text")}) AS t FROM benchmark),
dd AS (SELECT chunk_id, list_distinct(t) AS t FROM dt),
qx AS (SELECT query_id, len(t) AS nq, unnest(t) AS term FROM qd),
dx AS (SELECT chunk_id, len(t) AS nd, unnest(t) AS term FROM dd),
ov AS (SELECT query_id, chunk_id, round(count(*) / sqrt(nq * CAST(nd AS DOUBLE)), 6) AS score FROM qx JOIN dx USING (term) GROUP BY query_id, chunk_id, nq, nd),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ov WHERE score > 0) WHERE rank <= 100)"""


def _rrf(weights: str) -> str:
    return f"""WITH {_INDEX}, {_bm25(100)}, {_OVERLAP},
weights AS (SELECT unnest({weights}) AS weight),
sides AS (SELECT query_id, chunk_id, rank, 0 AS side FROM dense UNION ALL SELECT query_id, chunk_id, rank, 1 FROM hits),
parts AS (SELECT weight, query_id, chunk_id, rank, side, CASE WHEN side = 0 THEN weight ELSE 1.0 - weight END AS w FROM sides, weights),
fused AS (SELECT weight, query_id, chunk_id, round(sum(w / (60 + rank)), 9) AS rrf, min(side * 100 + rank) AS seen FROM parts WHERE w <> 0 GROUP BY ALL),
ranked AS (SELECT weight, query_id, chunk_id, rrf, CAST(row_number() OVER (PARTITION BY weight, query_id ORDER BY rrf DESC, seen) AS INTEGER) AS rank FROM fused)"""


_GOLD = f"""
found AS (SELECT item_id AS query_id, source AS doc_name, doc_id, b.text AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE regexp_matches(b.text, '\\S')),
gold AS (SELECT DISTINCT query_id, doc_name, CAST(doc_id + 1 AS INTEGER) AS page_number FROM found)"""

_PAGES = f"""WITH {_INDEX}, {_bm25(20)}, {_GOLD},
placed AS (SELECT h.query_id, h.rank, source AS doc_name, CAST(doc_id + 1 AS INTEGER) AS page_number, text FROM hits h JOIN documents ON chunk_id = doc_id),
flags AS (SELECT p.*, EXISTS (SELECT 1 FROM gold g WHERE g.query_id = p.query_id AND g.doc_name = p.doc_name AND g.page_number = p.page_number) AS page_gold,
  EXISTS (SELECT 1 FROM gold g WHERE g.query_id = p.query_id AND g.doc_name = p.doc_name) AS doc_gold FROM placed p),
ng AS (SELECT query_id, count(*) AS n_gold_pages FROM gold GROUP BY query_id),
m AS (SELECT query_id, min(CASE WHEN page_gold THEN rank END) AS first_page_hit_rank, {", ".join(
    f"max(CASE WHEN rank <= {k} AND doc_gold THEN 1 ELSE 0 END) AS doc_hit_{k}, max(CASE WHEN rank <= {k} AND page_gold THEN 1 ELSE 0 END) AS page_hit_{k}, count(CASE WHEN rank <= {k} AND page_gold THEN 1 END) AS found_{k}" for k in KS)}
  FROM flags GROUP BY query_id),
metrics AS (SELECT item_id AS query_id, 'type' || (item_id % 3) AS question_type, coalesce(n_gold_pages, 0) AS n_gold_pages, first_page_hit_rank, coalesce(1.0 / first_page_hit_rank, 0.0) AS mrr, {", ".join(
    f"coalesce(doc_hit_{k}, 0) AS doc_hit_{k}, coalesce(page_hit_{k}, 0) AS page_hit_{k}, CASE WHEN n_gold_pages > 0 THEN CAST(coalesce(found_{k}, 0) AS DOUBLE) / n_gold_pages ELSE 0.0 END AS page_recall_{k}" for k in KS)}
  FROM benchmark LEFT JOIN ng ON item_id = ng.query_id LEFT JOIN m ON item_id = m.query_id)"""


def _grams(t: str) -> str:
    return f"list_distinct(CASE WHEN len({t}) = 0 THEN [] ELSE list_transform(range(1, greatest(len({t}) - 2, 1) + 1), lambda i: array_to_string(list_slice({t}, i, i + 2), ' ')) END)"


_EVIDENCE = f"""{_PAGES},
spans AS (SELECT DISTINCT query_id, doc_name, item FROM found UNION ALL SELECT item_id, 'src0', text FROM benchmark WHERE item_id NOT IN (SELECT query_id FROM found)),
ks AS (SELECT unnest({list(KS)}) AS k),
read AS (SELECT s.query_id, s.doc_name, k, {_words("any_value(item)")} AS want, {_words("string_agg(p.text, ' ' ORDER BY rank)")} AS got
  FROM spans s CROSS JOIN ks LEFT JOIN placed p ON p.query_id = s.query_id AND p.doc_name = s.doc_name AND p.rank <= k GROUP BY s.query_id, s.doc_name, k),
recalls AS (SELECT query_id, k, len(list_intersect(list_distinct(want), list_distinct(got))) / CAST(len(list_distinct(want)) AS DOUBLE) AS token_recall,
    len(list_intersect({_grams("want")}, {_grams("got")})) / CAST(len({_grams("want")}) AS DOUBLE) AS gram_recall FROM read WHERE len(want) > 0),
ev AS (SELECT item_id AS query_id, CAST(ks.k AS INTEGER) AS k, coalesce(avg(token_recall), 0.0) AS token_recall, coalesce(avg(gram_recall), 0.0) AS gram_recall,
    coalesce(max(CAST(gram_recall >= 0.3 AS INTEGER)), 0) AS any_hit, coalesce(min(CAST(gram_recall >= 0.3 AS INTEGER)), 0) AS all_hit
  FROM benchmark CROSS JOIN ks LEFT JOIN recalls r ON r.query_id = item_id AND r.k = ks.k GROUP BY item_id, ks.k)"""


def _top10(name: str) -> str:
    """Page metrics of the first ten hits."""
    lists = f"{_bm25(20)}" if name == "bm25" else f"{_OVERLAP}, hits AS (SELECT query_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM dense)"
    pages = _PAGES.replace(_bm25(20), lists).replace("FROM hits h JOIN documents ON chunk_id = doc_id)", "FROM hits h JOIN documents ON chunk_id = doc_id WHERE rank <= 10)")
    return f"{pages} SELECT query_id, mrr, page_hit_5, page_hit_10 FROM metrics"


_METRICS = ["mrr", *[f"{m}_{k}" for m in ("doc_hit", "page_hit", "page_recall") for k in KS]]
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in _METRICS)

SQL = {
    "bm25_topk": f"WITH {_INDEX}, {_bm25(10)} SELECT query_id, chunk_id, score, rank FROM hits",
    "bm25_tokenize_subruns": f"SELECT doc_id AS chunk_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)",
    "bm25_term_stats": f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_postings": f"WITH {_INDEX} SELECT term, chunk_id, CAST(tf AS INTEGER) AS tf, CAST(dl AS INTEGER) AS dl FROM tf",
    "dense_topk": _DENSE,
    "dense_topk_numpy": _DENSE,
    "rrf_fuse": f"{_rrf('[0.9::DOUBLE]')} SELECT query_id, chunk_id, rrf, rank FROM ranked WHERE rank <= 20",
    "rrf_weight_sweep": f"{_rrf('[0.0::DOUBLE, 0.5, 0.7, 0.8, 0.9, 1.0]')} SELECT *, replace(printf('d%.2f', weight), '.', 'p') AS tag FROM ranked WHERE rank <= 20",
    "gold_pages": f"WITH {_GOLD} SELECT * FROM gold",
    "hit_at_k": f"{_PAGES} SELECT query_id, {', '.join(f'{m}_hit_{k}' for m in ('doc', 'page') for k in KS)} FROM metrics",
    "page_recall_at_k": f"{_PAGES} SELECT query_id, n_gold_pages, {', '.join(f'round(page_recall_{k}, 6) AS page_recall_{k}' for k in KS)} FROM metrics",
    "mrr": f"{_PAGES} SELECT query_id, first_page_hit_rank, round(mrr, 6) AS mrr FROM metrics",
    "evidence_token_recall": f"{_EVIDENCE} SELECT query_id, k, round(token_recall, 6) AS token_recall FROM ev",
    "evidence_ngram_recall": f"{_EVIDENCE} SELECT query_id, k, round(gram_recall, 6) AS gram_recall FROM ev",
    "evidence_any_all_hit": f"{_EVIDENCE} SELECT query_id, k, any_hit, all_hit FROM ev",
    "paired_bootstrap_ci": f"""WITH base AS (SELECT * FROM ({_top10("bm25")})), other AS (SELECT * FROM ({_top10("overlap")})),
x AS (SELECT 'baseline' AS variant, * FROM base UNION ALL SELECT 'overlap', * FROM other),
long AS (SELECT variant, query_id, unnest(['mrr', 'page_hit_5', 'page_hit_10']) AS metric, unnest([CAST(mrr AS DOUBLE), page_hit_5, page_hit_10]) AS v FROM x),
d AS (SELECT l.variant, l.metric, l.v, l.v - b.v AS d, row_number() OVER (PARTITION BY l.variant, l.metric ORDER BY l.query_id) - 1 AS j, count(*) OVER (PARTITION BY l.variant, l.metric) AS n
  FROM long l JOIN long b ON b.variant = 'baseline' AND b.query_id = l.query_id AND b.metric = l.metric),
draws AS (SELECT r, CAST('0x' || left(md5('42|' || r || '|' || i), 8) AS BIGINT) % n AS j FROM range(5000) a(r), (SELECT DISTINCT n, unnest(range(1, n + 1)) AS i FROM d)),
means AS (SELECT variant, metric, r, sum(d) / any_value(n) AS m FROM draws JOIN d USING (j) GROUP BY variant, metric, r),
ci AS (SELECT variant, metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY variant, metric)
SELECT variant, metric, round(avg(v), 6) AS value, round(avg(d), 6) AS delta_vs_baseline, round(any_value(lo), 6) AS delta_ci95_low, round(any_value(hi), 6) AS delta_ci95_high, count(*) AS n_questions
FROM d JOIN ci USING (variant, metric) GROUP BY variant, metric""",
    "retrieval_summary_grouping_sets": f"{_PAGES} SELECT CASE WHEN grouping(question_type) = 1 THEN 'overall' ELSE question_type END AS label, count(*) AS n, {_MEANS} FROM metrics GROUP BY GROUPING SETS ((), (question_type))",
}
