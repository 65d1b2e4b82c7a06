from pageloom.operators import lexical
from pageloom.plans import retrieval

SF = "/root/testdata/sf0.001"


def test_asked_terms_alone_are_counted(spark):
    """A search that nobody saved an index for makes none, and finds what the index finds: empty, null and repeated chunks count too."""
    chunks = retrieval._chunks(spark, SF).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "fy2018 the " * 70_000), (-3, "fy2018 the")], "chunk_id long, text string"))
    queries = retrieval._queries(spark, SF).unionByName(spark.createDataFrame([(-1, "2018 fy2018 no-such-word"), (-2, "")], "query_id long, text string"))
    plain, built = lexical.LexicalIndex.build(chunks), lexical.LexicalIndex.build(chunks)
    assert built.counts.count() == chunks.count() and built.terms.count() > 0
    rows = lambda index: sorted(map(tuple, index.top_k(queries, 12).collect()))
    assert rows(plain) == rows(built) and plain._counts is None


def test_no_lambda_over_tokens(spark):
    plan = retrieval.contained(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    of_documents = [line for line in plan.split("\n") if "lambda" in line and "doc_id" in line]
    assert not of_documents
    found = {(r.query_id, r.page_num) for r in retrieval.contained(spark, SF).collect()}
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    assert found == {(i.item_id, d.doc_id) for i in items if i.text and i.text.strip() for d in docs if i.text in (d.text or "")}
