"""Searches in texts keep the k best of each query in each task, and read tokens from bytes."""

import random
import re
import sys

from pyspark.sql import functions as F

from pageloom.functions.text import search_bag
from pageloom.operators import lexical, scan
from pageloom.plans import retrieval

SF = "/root/testdata/sf0.001"


def test_only_two_characters_fold_into_ascii():
    folded = [c for c in map(chr, range(128, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and re.search("[a-z0-9]", c.lower())]
    assert sorted(c.encode() for c in folded) == sorted(scan._FOLDED)


def test_tokens_are_those_of_the_expressions(spark):
    draw = random.Random(1)
    texts = ["".join(draw.choice("aZ09 .-\néKİıß\x1c\x00Σ") for _ in range(60)) for _ in range(300)] + ["", "fy2018FY2018 a1b2", "İstanbul 5K"]
    for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", search_bag(F.col("text")).alias("t")).collect():
        assert sorted(scan.bag(r.text.encode()).elements()) == sorted(x.encode() for x in r.t)
    raw = spark.createDataFrame([(bytearray(b"ab\xffcd \xe2\x84 k\xc3x1"),)], "b binary").selectExpr("b", "cast(b as string) AS text").select("b", search_bag(F.col("text")).alias("t"))
    for r in raw.collect():
        assert sorted(scan.bag(bytes(r.b)).elements()) == sorted(x.encode() for x in r.t)


def _texts(spark, n=3000):
    """Many ties: few words, copies, empty texts; keys in no order."""
    draw = random.Random(2)
    rows = [(i * 7919 % 100_003, " ".join(draw.choices("a b c d e f g h x1 y2".split(), k=draw.randrange(9)))) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(5), spark.createDataFrame([(0, "a x1"), (1, "g h c"), (2, "none"), (None, "b")], "query_id long, text string")


def _rows(df):
    return sorted((tuple(r) for r in df.select("query_id", "chunk_id", "score", "rank").collect()), key=str)


def test_blocks_find_what_the_joins_find(spark, monkeypatch):
    chunks, queries = _texts(spark)
    for made in (lambda: retrieval.overlap_top_k(queries, lexical.LexicalIndex.build(chunks), 15), lambda: lexical.bm25_top_k(queries, chunks, 15)):
        blocks = made()
        assert "MapInArrow" in blocks._jdf.queryExecution().optimizedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(scan, "MOST_TERMS", 2)
            joins = made()
        assert _rows(blocks) == _rows(joins) and blocks.count() == 45


def test_a_task_gives_few_rows(spark):
    """Every second chunk has the query's word; what leaves a task does not grow with them."""
    chunks = spark.range(20_000).selectExpr("id AS chunk_id", "concat(if(id % 2 = 0, 'a ', 'c '), repeat('b ', int(id % 997))) AS text").coalesce(1)
    queries = spark.createDataFrame([(0, "a")], "query_id long, text string")
    assert scan.Scan.of(queries, chunks).bm25(10).count() <= 60


def test_an_item_is_found_without_a_second_look_at_the_documents(spark):
    plan = retrieval.contained(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("documents") + plan.count("doc_id") > 0 and "Join" not in plan


def test_items_too_large_for_a_task_are_joined(spark, monkeypatch):
    want = sorted(map(tuple, retrieval.contained(spark, SF).collect()))
    monkeypatch.setattr(scan, "MOST_ITEM_BYTES", 1)
    assert sorted(map(tuple, retrieval.contained(spark, SF).collect())) == want and want


def test_evidence_is_made_once(spark):
    plan = retrieval._evidence(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
