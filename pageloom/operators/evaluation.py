"""Retrieval metrics: pages, documents and evidence text at k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import distinct_grams, grams_of, word_tokens

K_LIST = (1, 3, 5, 10, 20)
PAGE_OFFSET, GRAM, LEAST_RECALL = 1, 3, 0.30


def evidence_rows(questions: DataFrame) -> DataFrame:
    """questions(query_id, doc_name, evidence array) -> (query_id, span, doc_name, page_num, text); an evidence without a document has the question's."""
    rows = questions.select("query_id", F.col("doc_name").alias("own"), F.posexplode("evidence").alias("span", "e"))
    doc = F.coalesce(F.nullif(F.col("e.doc_name"), F.lit("")), F.col("own"))
    return rows.select("query_id", F.col("span").cast("long").alias("span"), doc.alias("doc_name"), F.col("e.evidence_page_num").alias("page_num"), F.col("e.evidence_text").alias("text"))


def gold_pages(evidence: DataFrame) -> DataFrame:
    """Distinct (query_id, doc_name, page_number); evidence counts pages from 0, pages from 1; null pages drop out."""
    return evidence.where("page_num IS NOT NULL").select("query_id", "doc_name", (F.col("page_num") + PAGE_OFFSET).cast("int").alias("page_number")).distinct()


def evidence_spans(evidence: DataFrame) -> DataFrame:
    """(query_id, span, doc_name, tokens, grams) of each evidence text with a token."""
    rows = evidence.select("query_id", "span", "doc_name", word_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return rows.select("query_id", "span", "doc_name", F.array_distinct("t").alias("tokens"), distinct_grams(F.col("t"), GRAM).alias("grams"))


def flagged(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """hits with page_gold and doc_gold."""
    pages = gold.select("query_id", "doc_name", "page_number", F.lit(True).alias("page_gold"))
    docs = gold.select("query_id", "doc_name").distinct().withColumn("doc_gold", F.lit(True))
    out = hits.join(pages, ["query_id", "doc_name", "page_number"], "left").join(docs, ["query_id", "doc_name"], "left")
    return out.fillna(False, ["page_gold", "doc_gold"])


def page_metrics(questions: DataFrame, evidence: DataFrame, hits: DataFrame, ks: tuple[int, ...] = K_LIST) -> DataFrame:
    """One row a question: n_gold_pages, first_page_hit_rank, mrr, doc_hit_k, page_hit_k, page_recall_k; all k from one pass."""
    gold = gold_pages(evidence)
    n_gold = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold_pages"))
    aggs: list[Column] = [F.min(F.when(F.col("page_gold"), F.col("rank"))).alias("first_page_hit_rank")]
    for k in ks:
        near = F.col("rank") <= k
        aggs += [
            F.max(F.when(near & F.col("doc_gold"), 1).otherwise(0)).alias(f"doc_hit_{k}"),
            F.max(F.when(near & F.col("page_gold"), 1).otherwise(0)).alias(f"page_hit_{k}"),
            F.countDistinct(F.when(near & F.col("page_gold"), F.struct("doc_name", "page_number"))).alias(f"found_{k}"),
        ]
    got = flagged(hits, gold).groupBy("query_id").agg(*aggs)
    out = questions.select("query_id", "question_type").join(n_gold, "query_id", "left").join(got, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cols = [zero("n_gold_pages").cast("long").alias("n_gold_pages"), F.col("first_page_hit_rank"), F.coalesce(1.0 / F.col("first_page_hit_rank"), F.lit(0.0)).alias("mrr")]
    for k in ks:
        recall = F.when(zero("n_gold_pages") > 0, zero(f"found_{k}") / F.col("n_gold_pages")).otherwise(F.lit(0.0))
        cols += [zero(f"doc_hit_{k}").alias(f"doc_hit_{k}"), zero(f"page_hit_{k}").alias(f"page_hit_{k}"), recall.alias(f"page_recall_{k}")]
    return out.select("query_id", "question_type", *cols)


def span_recalls(evidence: DataFrame, hits: DataFrame, ks: tuple[int, ...] = K_LIST) -> DataFrame:
    """(query_id, span, k, token_recall, gram_recall): the span in the same-document hits up to k, joined by a space in rank order."""
    spans = evidence_spans(evidence)
    # Each text is cut into tokens once, each document's hits are put together once for each query: what stands within k is a prefix of that.
    met = hits.where(F.col("rank") <= max(ks)).join(spans.select("query_id", "doc_name").distinct(), ["query_id", "doc_name"], "left_semi")
    cut = met.select("query_id", "doc_name", "rank", word_tokens(F.col("text")).alias("t"))
    per = cut.groupBy("query_id", "doc_name").agg(F.sort_array(F.collect_list(F.struct("rank", "t"))).alias("hits"))
    sizes = F.transform("hits", lambda h: F.named_struct(F.lit("rank"), h["rank"], F.lit("n"), F.size(h["t"]))).alias("sizes")
    read = per.select("query_id", "doc_name", sizes, F.explode(F.array(F.flatten("hits.t"))).alias("words"))
    read = read.select("query_id", "doc_name", "sizes", "words", F.explode(F.array(grams_of(F.col("words"), GRAM))).alias("run"))
    # Where each wanted token and gram stands first; 0: nowhere.
    places = lambda wanted, found: F.transform(wanted, lambda x: F.coalesce(F.array_position(found, x), F.lit(0)))
    rows = spans.join(read, ["query_id", "doc_name"], "left").select(
        "query_id", "span", "sizes", "grams", F.slice("words", 1, GRAM - 1).alias("head"), F.explode(F.array(F.struct(places("tokens", F.col("words")).alias("t"), places("grams", F.col("run")).alias("g")))).alias("at")
    )
    rows = rows.select("*", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    n = F.coalesce(F.aggregate("sizes", F.lit(0), lambda n, h: n + F.when(h["rank"] <= F.col("k"), h["n"]).otherwise(0)), F.lit(0))
    rows = rows.withColumn("n", n)
    within = lambda places, last: F.size(F.filter(places, lambda p: (p > 0) & (p <= last)))
    # Fewer tokens than a gram are one gram.
    short = F.exists("grams", lambda g: g == F.array_join(F.slice("head", F.lit(1), F.col("n")), " ")).cast("int")
    found = F.when(F.col("n") >= GRAM, within("at.g", F.col("n") - (GRAM - 1))).when(F.col("n") > 0, short).otherwise(0)
    return rows.select("query_id", "span", "k", (within("at.t", F.col("n")) / F.size("at.t")).alias("token_recall"), (found / F.size("grams")).alias("gram_recall"))


def evidence_metrics(questions: DataFrame, evidence: DataFrame, hits: DataFrame, ks: tuple[int, ...] = K_LIST) -> DataFrame:
    """(query_id, k, token_recall, gram_recall, any_hit, all_hit); a question without a span has zeros."""
    per = span_recalls(evidence, hits, ks).groupBy("query_id", "k").agg(
        F.avg("token_recall").alias("token_recall"),
        F.avg("gram_recall").alias("gram_recall"),
        F.max((F.col("gram_recall") >= LEAST_RECALL).cast("int")).alias("any_hit"),
        F.min((F.col("gram_recall") >= LEAST_RECALL).cast("int")).alias("all_hit"),
    )
    every = questions.select("query_id").crossJoin(F.broadcast(hits.sparkSession.createDataFrame([(k,) for k in ks], "k int")))
    return every.join(per, ["query_id", "k"], "left").fillna(0.0, ["token_recall", "gram_recall"]).fillna(0, ["any_hit", "all_hit"])


def comparison(questions: DataFrame, evidence: DataFrame, found: dict[str, DataFrame], ks: tuple[int, ...] = K_LIST) -> DataFrame:
    """A row for each configuration of found (name -> hits): means of page hit, evidence hit, token and gram recall at each k."""
    parts = []
    for name, hits in found.items():
        pages = page_metrics(questions, evidence, hits, ks).agg(*[F.avg(f"page_hit_{k}").alias(f"page_hit_{k}") for k in ks])
        at = lambda k, c: F.avg(F.when(F.col("k") == k, F.col(c)))
        spans = evidence_metrics(questions, evidence, hits, ks).agg(
            *[at(k, c).alias(f"{n}_{k}") for k in ks for c, n in (("any_hit", "evidence_hit"), ("token_recall", "token_recall"), ("gram_recall", "gram_recall"))]
        )
        parts.append(pages.crossJoin(F.broadcast(spans)).select(F.lit(name).alias("configuration"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(details: DataFrame, metrics: list[str], group: str = "question_type") -> DataFrame:
    """Means over all rows and for each group, in one aggregation."""
    label = F.when(F.grouping(group) == 1, F.lit("overall")).otherwise(F.col(group)).alias("label")
    return details.groupingSets([[], [group]], group).agg(label, F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics]).drop(group)
