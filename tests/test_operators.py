"""Hand-derived cases of the operators."""

import json

import pytest
from pageloom.operators import answers, chunking, cleaning, dense, evaluation, fusion, lexical, pairwise, sampling, stats
from pageloom.sources import config, files
from pageloom.streaming.ingest import append_new
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def pages(spark, texts, doc="d"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts, 1)], "doc_name string, page_number int, text string")


def test_boilerplate_gates(spark):
    assert cleaning.boilerplate(pages(spark, ["head\nx"] * 3)).count() == 0
    four = pages(spark, ["Page 12\na", "Page 13\nb", "c", None])
    assert rows(cleaning.boilerplate(four).select("sig", "n")) == [("page #", 2)]
    assert cleaning.boilerplate(pages(spark, ["y" * 61] * 4)).count() == 0


def test_clean_pages(spark):
    own = [["abcd"[i] * n for n in range(1, 9)] for i in range(4)]  # lines that no other page has
    got = cleaning.clean_pages(pages(spark, [f"ACME  Page {i}\n{w[0]}\n\n\n\n{w[1]} " for i, w in enumerate(own)])).collect()
    assert {r.text for r in got} == {f"ACME Page {i}\n{w[0]}\n\n{w[1]}" for i, w in enumerate(own)}  # found on raw lines, sought on collapsed ones
    texts = ["\n".join([f"ACME Page {i}", *w[:3], f"ACME Page {i}", *w[3:6], "ﬁn" + w[6]]) for i, w in enumerate(own)]
    got = cleaning.clean_pages(pages(spark, texts)).collect()
    assert {r.text for r in got} == {"\n".join([*w[:3], f"ACME Page {i}", *w[3:6], "fin" + w[6]]) for i, w in enumerate(own)}
    audit = cleaning.clean_audit(cleaning.clean_pages(pages(spark, [None])), cleaning.boilerplate(pages(spark, [None]))).first()
    assert audit.pct_removed == 0.0 and audit.boilerplate_sigs == "" and audit.n_boilerplate == 0


@pytest.mark.parametrize("sizes, size, overlap, sums", [([10, 240, 100], 256, 50, [250, 240, 100]), ([100, 100, 100], 256, 0, [200, 100]), ([300, 10], 256, 0, [300, 10]), ([], 9, 2, [])])
def test_packed(sizes, size, overlap, sums):
    assert [sum(sizes[i:j]) for i, j in chunking.packed(sizes, size, overlap)] == sums


def test_atoms_keep_the_text():
    ruler = chunking.regex_ruler()
    text = "One two. Three four five\nsix seven\n\neight, nine! " * 9 + "x" * 30
    got = chunking.atoms(text, ruler, 4)
    assert "".join(got).replace(" ", "").replace("\n", "") == text.replace(" ", "").replace("\n", "")
    assert max(len(ruler(a)) for a in got) <= 4


def test_windows_and_numbers(spark):
    text = " ".join(["w"] * 300)
    w = chunking.fixed_windows(pages(spark, [text, "", " ".join(["v"] * 256)]))
    assert rows(w.select("page_number", "local_index", "n_tokens")) == [(1, 0, 256), (1, 1, 94), (3, 0, 256)]
    for n in (1, 1000):
        assert [r.chunk_id for r in chunking.numbered(w, n).orderBy("chunk_index").collect()] == ["d__p1__c0", "d__p1__c1", "d__p3__c2"]
    with pytest.raises(ValueError):
        chunking.fixed_windows(pages(spark, []), 10, 10)
    assert chunking.recursive_chunks(pages(spark, ["a b. c d", None, " "]), 2, 0).count() >= 2


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "tax rate"), (2, "tax"), (3, None), (4, "other")], "chunk_id int, text string")
    ask = lambda t: lexical.bm25_top_k(spark.createDataFrame([(1, t)], "query_id int, text string"), docs)
    assert rows(ask("tax tax")) == rows(ask("tax")) and [r.chunk_id for r in ask("tax").orderBy("rank").collect()] == [2, 1]
    assert ask("unknown").count() == 0


def test_fusion(spark):
    dense_hits = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "query_id int, chunk_id string, rank int")
    lexical_hits = spark.createDataFrame([(1, "B", 1), (1, "C", 2)], "query_id int, chunk_id string, rank int")
    weights = spark.createDataFrame([(0.9,), (1.0,), (0.0,)], "weight double")
    got = fusion.fuse(dense_hits, lexical_hits, weights)
    assert [(r.chunk_id, round(r.rrf, 6)) for r in got.where("weight = 0.9").orderBy("rank").collect()] == [("B", 0.016155), ("A", 0.014754), ("C", 0.001613)]
    assert [r.chunk_id for r in got.where("weight = 1").orderBy("rank").collect()] == ["A", "B"]
    assert [r.chunk_id for r in got.where("weight = 0").orderBy("rank").collect()] == ["B", "C"]


def test_dense(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(7)], "vec_id long, v array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "query_id long, q array<float>")
    cols = ["query_id", "vec_id", "score", "rank"]
    want = rows(dense.dense_top_k(q, v, 3).select(cols))
    assert want == rows(dense.dense_top_k_blocks(spark, q, v, 3, block=1).select(cols)) and (1, 0, 1.0, 1) in want
    assert dense.dense_top_k_blocks(spark, q.limit(0), v).count() == 0
    assert spark.range(1).select(dense.normalised(F.array(F.lit(3.0), F.lit(4.0))).alias("n")).first().n == [0.6, 0.8]


def evidence(spark, items):
    return spark.createDataFrame(items, "query_id int, span long, doc_name string, page_num int, text string")


def test_page_metrics(spark):
    nested = spark.createDataFrame([(1, "d", [(None, 0, "x"), ("e", None, "y"), ("", 2, "z")])], "query_id int, doc_name string, evidence array<struct<doc_name:string,evidence_page_num:int,evidence_text:string>>")
    ev = evaluation.evidence_rows(nested)
    assert rows(evaluation.gold_pages(ev)) == [(1, "d", 1), (1, "d", 3)]
    hits = spark.createDataFrame([(1, 1, "d", 9), (1, 2, "d", 9), (1, 3, "e", 1), (1, 4, "d", 3)], "query_id int, rank int, doc_name string, page_number int")
    q = spark.createDataFrame([(1, "t"), (2, "t")], "query_id int, question_type string")
    got = {r.query_id: r for r in evaluation.page_metrics(q, ev, hits, (3, 5)).collect()}
    assert (got[1].mrr, got[1].page_hit_3, got[1].page_recall_5, got[1].doc_hit_3) == (0.25, 0, 0.5, 1)
    assert (got[2].mrr, got[2].page_recall_5, got[2].n_gold_pages, got[2].first_page_hit_rank) == (0.0, 0.0, 0, None)


@pytest.mark.parametrize("span, texts, doc, want", [
    ("net sales were 10", ["net sales", "were 10"], "d", (1.0, 1.0)), ("net sales were 10", ["were 10", "net sales"], "d", (1.0, 0.0)),
    ("net sales", ["net sales were"], "d", (1.0, 0.0)), ("net sales", ["net sales"], "other", (0.0, 0.0)),
])
def test_evidence(spark, span, texts, doc, want):
    ev = evidence(spark, [(1, 0, "d", None, span), (1, 1, "d", None, "!")])
    hits = spark.createDataFrame([(1, i, doc, t) for i, t in enumerate(texts, 1)], "query_id int, rank int, doc_name string, text string")
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r.query_id: r for r in evaluation.evidence_metrics(q, ev, hits, (5,)).collect()}
    assert (got[1].token_recall, got[1].gram_recall) == want and got[1].any_hit == int(want[1] >= 0.3)
    assert (got[2].token_recall, got[2].any_hit, got[2].all_hit) == (0.0, 0, 0)


def test_answers(spark):
    ctx = "array<struct<rank:int,doc_name:string,page_number:int>>"
    df = spark.createDataFrame([("a [0] [11]", [(1, "d", 1)], [("d", 1)]), ("b [1]", [(1, "d", 1)], [("d", 1)]), ("c [1]", [(1, "e", 1)], [("d", 1)])], f"answer string, contexts {ctx}, gold_pages array<struct<doc_name:string,page_number:int>>")
    assert [(r.cited_pages_valid, r.page_hit, r.first_hit_rank) for r in answers.answered(df).orderBy("answer").collect()] == [(False, True, 1), (True, True, 1), (False, False, None)]
    graded = spark.createDataFrame([("t", True, True, True, False, True, None, True), ("t", True, False, True, False, False, None, False), ("t", False, False, False, False, False, None, False)],
                                   "question_type string, page_hit boolean, refused boolean, has_citation boolean, cited_pages_valid boolean, correct boolean, numeric_match boolean, correct_or_partial boolean")
    overall = answers.grade_summary(graded).where("label = 'overall'").first()
    assert overall.citation_rate == 0.5 and overall.numeric_match_acc is None and overall.n == 3


def test_a_failing_provider_does_not_fail_the_job(spark):
    class Broken:
        def complete(self, prompts):
            raise RuntimeError("no model")

    got = answers.generate(spark.createDataFrame([(1, "p")], "query_id int, prompt string"), Broken).first()
    assert got.answer is None and got.error == "no model"


def test_pairwise(spark):
    pairs = spark.range(50).withColumnRenamed("id", "k")
    a, b = pairwise.orders(pairs, "k"), pairwise.orders(pairs, "k", swap=True).withColumnRenamed("seven_is_a", "other")
    assert a.join(b, "k").where("seven_is_a = other").count() == 0
    j = spark.createDataFrame([("m", 1, "7b"), ("m", 2, "tie")], "judge string, id int, preferred string")
    s = spark.createDataFrame([("m", 1, "3b"), ("m", 2, "tie")], "judge string, id int, preferred string")
    assert rows(pairwise.order_robust(j, s)) == [("m", 1, "unstable"), ("m", 2, "tie")]


def test_sign_test(spark):
    df = spark.createDataFrame([(14, 11), (25, 14), (0, 0), (4, 0), (3, 0), (3000, 3000), (4000, 0)], "a long, b long")
    got = [round(r.p, 3) for r in df.select(stats.sign_test(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [0.690, 0.108, 1.0, 0.125, 0.25, 1.0, 0.0]


def test_bootstrap_of_a_variant_with_itself(spark):
    one = [(v, i, float(i % 3)) for v in ("baseline", "same") for i in range(12)]
    got = stats.paired_bootstrap(spark.createDataFrame(one, "variant string, query_id int, m double"), ["m"], 200).where("variant = 'same'").first()
    assert (got.delta_vs_baseline, got.delta_ci95_low, got.delta_ci95_high, got.n_questions) == (0.0, 0.0, 0.0, 12)


def test_sampling(spark):
    df = spark.range(150).select("id", (F.col("id") % 3).alias("g"))
    assert rows(sampling.stratified(df, "g", "id").groupBy("g").count()) == [(0, 10), (1, 10), (2, 10)]
    old, new = (spark.createDataFrame(x, "doc_name string, v string") for x in ([("a", "old"), ("b", "old")], [("b", "new"), ("c", "new")]))
    assert [tuple(r) for r in sampling.upsert(old, new).collect()] == [("a", "old"), ("b", "new"), ("c", "new")]
    dup = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "doc_name string, line int, v string")
    assert sampling.first_by(dup, ["doc_name"], "line").first().v == "x" and sampling.last_by(dup, ["doc_name"], "line").first().v == "y"
    chunks = spark.createDataFrame([("d", "t"), ("e", "t")], "doc_name string, text string")
    had = spark.createDataFrame([("d", "t", [1.0], 0), ("d", "t", [2.0], 1)], "doc_name string, text string, embedding array<float>, pos int")
    assert rows(sampling.reuse_vectors(chunks, had).select("doc_name", "reused", "embedding")) == [("d", True, [2.0]), ("e", False, None)]


def test_files(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": ')
    assert rows(files.read_jsonl(spark, str(tmp_path / "q.jsonl"), "a int", tolerant=True)) == [(1,), (2,)]
    files.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert any(json.loads(x) == {"a": 1, "b": None} for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines())
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/good.pdf").write_bytes(b"%PDF one\ftwo")
    (tmp_path / "docs/bad.pdf").write_bytes(b"<html>")
    raw = files.raw_documents(spark, str(tmp_path / "docs"))
    assert rows(raw.select("doc_name", "is_pdf")) == [("bad", False), ("good", True)]

    def parse(b):
        if b[:4] != b"%PDF":
            raise ValueError("not a PDF")
        return [*b[4:].decode().split("\f"), None]

    got = files.parse_pages(raw, {"split": parse})
    assert rows(got.where("status = 'ok'").select("doc_name", "page_number", "text")) == [("good", 1, " one"), ("good", 2, "two"), ("good", 3, "")]
    assert rows(files.parse_manifest(got).select("doc_name", "status", "pages", "error_message")) == [("bad", "failed", 0, "not a PDF"), ("good", "ok", 3, None)]
    manifest = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "u3")], "doc_name string, doc_link string")
    there = spark.createDataFrame([("a", 60000)], "doc_name string, size_bytes long")
    done = files.download(manifest, there, lambda link: (200, b"%PDF") if link == "u2" else (200, b"<html>"))
    assert rows(done.select("doc_name", "status")) == [("b", "downloaded"), ("c", "failed")]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("name: x\nchunk_size: 50\nchunk_overlap: 50\n")
    with pytest.raises(ValueError):
        config.load(config.ChunkConfig, str(tmp_path / "c.yaml"))
    with pytest.raises(ValueError):
        config.FusionConfig(dense_weight=1.5)


def test_stream_resumes(spark, tmp_path):
    landing, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, t string")
    df.write.parquet(landing)
    for _ in range(2):
        append_new(spark, landing, df.schema, out, check, "id").awaitTermination()
    assert rows(spark.read.parquet(out)) == [(1, "a"), (2, "b")]
    spark.createDataFrame([(2, "again"), (3, "c")], df.schema).write.mode("append").parquet(landing)
    append_new(spark, landing, df.schema, out, check, "id").awaitTermination()
    assert rows(spark.read.parquet(out)) == [(1, "a"), (2, "b"), (3, "c")]
