"""Indexes, retrievers, runs and judges on hand-made cases."""

import json
import sys

import numpy as np
import pytest
from pageloom import store
from pageloom.operators import answers, chunking, configured, judging, lexical, retriever, sampling
from pageloom.operators.encoding import encode_column, hashed_encoder
from pageloom.plans import retrieval
from pageloom.sources import config, files
from pyspark import cloudpickle
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers do not have this module
SF = "/root/testdata/sf0.001"
TEXTS = ["revenue rose to 12 million in fy2018", "costs fell", "", None, "revenue of the 2018 plan, revenue again", "nothing of note"]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(f"c{i}", f"d{i % 2}", i + 1, t) for i, t in enumerate(TEXTS)], "chunk_id string, doc_name string, page_number int, text string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "revenue 2018"), (2, "costs"), (3, "unknownword")], "query_id long, text string")


def plain(df):
    return sorted(tuple(r) for r in df.collect())


def test_term_counts(spark, chunks):
    got = {r.chunk_id: (r.dl, {(e.term, e.tf) for e in r.terms}) for r in lexical.term_counts(chunks).collect()}
    assert got["c4"] == (7, {("revenue", 2), ("of", 1), ("the", 1), ("2018", 1), ("plan", 1), ("again", 1)}) and got["c2"] == got["c3"] == (0, set())
    assert got["c0"] == (9, {(t, 1) for t in ("revenue", "rose", "to", "12", "million", "in", "fy2018", "fy", "2018")})


def test_index_saved_read_and_extended(spark, chunks, queries, tmp_path):
    whole = plain(lexical.LexicalIndex.build(chunks).top_k(queries, 3))
    lexical.LexicalIndex.build(chunks.where("chunk_id < 'c3'")).save(f"{tmp_path}/i")
    grown = lexical.LexicalIndex.load(spark, f"{tmp_path}/i").extended(chunks)
    assert plain(grown.top_k(queries, 3)) == whole and len(whole) == 3
    grown.save(f"{tmp_path}/j")
    assert plain(lexical.LexicalIndex.load(spark, f"{tmp_path}/j").top_k(queries, 3)) == whole
    for kind in (lexical.LexicalIndex, retriever.VectorIndex):
        with pytest.raises(FileNotFoundError):
            kind.load(spark, f"{tmp_path}/nowhere")
    with pytest.raises(Exception, match="(?i)exists"):
        grown.save(f"{tmp_path}/j")


def test_one_contract(spark, chunks, queries, tmp_path):
    cfg = config.EmbedConfig("h64", dim=64)
    vectors = configured.vectors_of(chunks, cfg)
    vectors.save(f"{tmp_path}/v")
    lexical.LexicalIndex.build(chunks).save(f"{tmp_path}/l")
    again = configured.vectors_of(chunks, config.EmbedConfig("h64", dim=64, reuse_index=f"{tmp_path}/v"))
    assert plain(again.chunks.select("chunk_id", "embedding")) == plain(vectors.chunks.select("chunk_id", "embedding"))
    passages, asked = configured.encoders_of(cfg)
    more = retriever.VectorIndex.load(spark, f"{tmp_path}/v").extended(chunks.withColumn("chunk_id", F.concat("chunk_id", F.lit("x"))), passages)
    assert more.chunks.count() == 12
    rag = configured.rag_of(spark, f"{tmp_path}/l", f"{tmp_path}/v", cfg, config.FusionConfig(0.5, 10), config.GenerateConfig("g", k=2))
    bm25, dense = rag.retriever.lexical, rag.retriever.dense
    for one in (bm25, dense, rag.retriever):
        hits = one.search(queries, 2)
        assert hits.columns == list(retriever.HIT) and hits.where("rank > 2").count() == 0
        assert hits.where("query_id = 2 AND rank = 1").first()["chunk_id"] == "c1"
    assert rag.retriever.name == "hybrid-d0p50__h64"
    with pytest.raises(ValueError):
        retriever.Hybrid(dense, bm25, 1.5)
    got = {r.query_id: r for r in rag.answer(queries.withColumnRenamed("text", "question")).collect()}
    assert got[2].answer == "costs fell [1]" and got[2].cited == [1] and not got[2].refused and len(got[1].contexts) == 2
    got = {r.query_id: r for r in retriever.RAG(bm25).answer(queries.withColumnRenamed("text", "question")).collect()}
    assert got[3].refused and got[3].contexts is None and got[3].cited == []


def test_configured_chunks(spark):
    pages = spark.createDataFrame([("a", 1, "one two three. four five six"), ("b", 1, "seven eight")], "doc_name string, page_number int, text string")
    for strategy in ("fixed", "recursive"):
        got = configured.chunks_of(pages, config.ChunkConfig("c", strategy, 3, 1))
        assert {"chunk_id", "n_tokens", "n_chars"} <= {*got.columns} and got.where("n_chars <> length(text)").count() == 0
    only = configured.chunks_of(pages, config.ChunkConfig("c", "fixed", 3, 1, eval_docs_only=True), spark.createDataFrame([("b",), ("b",)], "doc_name string"))
    assert [r.chunk_id for r in only.collect()] == ["b__p1__c0"]
    with pytest.raises(ValueError):
        configured.chunks_of(pages, config.ChunkConfig("c", eval_docs_only=True))
    with pytest.raises(ValueError):
        configured.provider_of(config.GenerateConfig("g", model="none"))


class Broken:
    def complete(self, prompts):
        raise RuntimeError("no model")


def test_runs(spark):
    questions = spark.createDataFrame([(1, "t", "d", "What?", "5"), (2, "t", "e", "Who?", "6"), (3, "t", "x", "No hits?", "7")], "query_id long, question_type string, doc_name string, question string, gold_answer string")
    hits = spark.createDataFrame([(1, 1, 0.5, "c1", "d", 3, "It is 5. Yes."), (1, 2, 0.4, "c2", "e", 1, "No."), (2, 1, 0.5, "c1", "d", 3, "Six people.")], "query_id long, rank int, score double, chunk_id string, doc_name string, page_number int, text string")
    evidence = spark.createDataFrame([(1, 0, "d", 2, "x"), (2, 0, "e", None, "y")], "query_id long, span long, doc_name string, page_num int, text string")
    run = answers.answer_run(questions, evidence, hits)
    got = {r.query_id: r for r in run.collect()}
    assert (got[1].answer, got[1].page_hit, got[1].first_hit_rank, got[1].doc_hit, got[1].cited_pages_valid) == ("It is 5 [1]", True, 1, True, True)
    assert (got[2].page_hit, got[2].doc_hit, got[2].cited_pages_valid, got[2].gold_pages) == (False, False, False, [])
    assert got[3].refused and got[3].contexts == [] and not got[3].doc_hit and got[3].error is None
    assert [r.query_id for r in answers.answer_run(questions, evidence, hits, limit=2, done=run.where("query_id = 1")).collect()] == [2]
    failed = answers.answer_run(questions, evidence, hits, Broken).collect()
    assert len(failed) == 3 and all(r.answer is None and r.error == "no model" and not r.cited_pages_valid for r in failed)
    again = answers.regenerated(run, answers.Extractive, page_hit_only=True)
    assert again.columns == run.columns and [(r.query_id, r.answer) for r in again.collect()] == [(1, "It is 5 [1]")]


class Says:
    def __init__(self, reply):
        self.reply = reply

    def complete(self, prompts):
        return [self.reply] * len(prompts)


@pytest.mark.parametrize("reply, verdict, reason", [('{"verdict": "Correct", "reason": "ok"}', "correct", "ok"), ('{"verdict": "fine"}', "incorrect", ""), ("{broken", "incorrect", "unparseable judge output")])
def test_grades(spark, reply, verdict, reason):
    rows = spark.createDataFrame([(1, "q", "g", None)], "query_id long, question string, gold_answer string, answer string")
    assert [(r.verdict, r.reason) for r in judging.judged(rows, lambda: Says(reply)).collect()] == [(verdict, reason)]
    assert judging.judged(rows, Broken).first()["verdict"] == "incorrect"


def test_pairs_in_both_orders(spark):
    rows = spark.createDataFrame([(i, "q", "g", "small", "large", "t", True) for i in range(20)], "query_id long, question string, gold_answer string, answer string, other_answer string, question_type string, page_hit boolean")
    for said in ("a", " A "):  # a judge that always likes the first: every preference turns with the order
        one, two = (judging.compared(rows, lambda: Says(json.dumps({"winner": said})), "j", swap).select("query_id", "preferred") for swap in (False, True))
        both = one.join(two.withColumnRenamed("preferred", "other"), "query_id").collect()
        assert len(both) == 20 and all({r.preferred, r.other} == {"7b", "3b"} for r in both)


def test_last_record_counts(spark):
    a = spark.createDataFrame([(1, 1, "old", False), (1, 2, "new", True), (2, 1, "x", True)], "query_id long, at int, answer string, page_hit boolean")
    b = spark.createDataFrame([(1, 5, "b"), (3, 1, "c")], "query_id long, at int, answer string")
    assert [(r.query_id, r.answer, r.other_answer) for r in judging.matched(a, b, "at").collect()] == [(1, "new", "b")]


def test_downloads():
    waits, tries = [], []

    def flaky(link):
        tries.append(link)
        if len(tries) < 3:
            return (503, b"") if len(tries) == 1 else (_ for _ in ()).throw(OSError("cut off"))
        return 200, b"%PDF"

    assert files.with_retries(flaky, sleep=waits.append)("x") == (200, b"%PDF") and waits == [1.5, 3.0]
    assert files.with_retries(lambda _: (503, b""), tries=2, sleep=waits.append)("x") == (503, b"")
    assert files.with_retries(lambda _: (404, b""), sleep=waits.append)("x") == (404, b"") and len(waits) == 3


def test_samples(spark, tmp_path):
    import hashlib

    rows = [(i, [None, "a", "b"][i % 3]) for i in range(1000)] + [(5, "a"), (5, "a")]
    df = spark.createDataFrame(rows, "k long, g string")
    want = []
    for g in (None, "a", "b"):
        own = sorted((k for k, x in rows if x == g), key=lambda k: (hashlib.md5(f"42|{k}".encode()).hexdigest(), k))
        want += [(k, g) for k in own[: round(0.2 * len(own))]]
    key = lambda r: (str(r[1]), r[0])
    assert sorted(map(tuple, sampling.stratified(df, "g", "k").collect()), key=key) == sorted(want, key=key)
    assert sampling.stratified(df.limit(0), "g", "k").count() == 0
    with pytest.raises(LookupError):
        sampling.lookup(df, "k", -1)
    row = sampling.timed(df, f"{tmp_path}/t", "step").first()
    assert row.n_rows == 1002 and row.seconds > 0 and spark.read.parquet(f"{tmp_path}/t").count() == 1002


def test_recursive_chunks_against_rule(spark):
    """Every chunk of every page again, by walking along the atoms one token sum at a time."""
    from pageloom.plans import corpus

    ruler, want = chunking.regex_ruler(), []
    for p in corpus._pages(spark, SF).collect():
        if not (p.text or "").strip():
            continue
        pieces = chunking.atoms(p.text, ruler, 256)
        n, i, local = [len(ruler(x)) for x in pieces], 0, 0
        while True:
            ends = [e for e in range(i + 1, len(n) + 1) if e == i + 1 or sum(n[i:e]) <= 256]
            body = "".join(pieces[i : ends[-1]]).strip()
            if body:
                want.append((p.doc_name, p.page_number, local, body, sum(n[i : ends[-1]])))
                local += 1
            if ends[-1] == len(n):
                break
            i = max([i + 1, *[b for b in range(i, ends[-1] + 1) if sum(n[b : ends[-1]]) >= 50]])
    assert sorted(map(tuple, corpus.recursive_chunks(spark, SF).collect())) == sorted(want) and len(want) > 200


def test_hashed_encoder_against_numpy(spark):
    docs, items = retrieval._chunks(spark, SF).orderBy("chunk_id").collect(), retrieval._queries(spark, SF).orderBy("query_id").collect()
    encode = hashed_encoder()
    v, q = encode([r.text for r in docs]).astype(float), encode([r.text for r in items]).astype(float)
    scores = np.round(q @ v.T, 6)
    got = {}
    for r in retrieval.hashed_encoder_topk(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert len(got) == len(items)
    for i, item in enumerate(items):
        best = np.lexsort(([r.chunk_id for r in docs], -scores[i]))[:10]
        mine = sorted(got[item.query_id])
        assert [d for _, d, _ in mine] == [docs[b].chunk_id for b in best] and np.allclose([s for *_, s in mine], scores[i][best], atol=2e-6)


def test_prefixes_reach_the_encoder(spark):
    seen = lambda: lambda texts: np.array([[float(len(t))] for t in texts], np.float32)
    df = spark.createDataFrame([("ab",), (None,)], "t string").select(encode_column(seen, "query: ")("t").alias("v"))
    assert [r.v for r in df.collect()] == [[9.0], None]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def __init__(self, known):
            self.known = known

        def get(self, key, default):
            return self.known or default

    class Session:
        def __init__(self, master, known=None):
            self.conf = Conf(known)
            self.sparkContext = type("C", (), {"master": master, "applicationId": "x"})

    for master in ("yarn", "spark://a:1", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            store.shared_dir(Session(master))
        assert store.shared_dir(Session(master, "hdfs://n/c/")) == "hdfs://n/c"
