"""The queries themselves on the smallest tables: those with SQL against DuckDB, the others against slow forms of their digests."""

import hashlib
import zlib

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from pageloom.llm import queries
from pageloom.llm.bpe import load_ranks
from test_lines import slow as without_lines
from test_simhash import slow_components, slow_fp

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) == sorted(tuple(r) for r in want.project(", ".join(sorted(want.columns))).fetchall())


def test_sharding(spark, docs):
    got = {r.doc_id: r for r in queries.op5_sharding(spark, SF).collect()}
    assert {*got} == {d for d, _ in docs} and {r.law for r in got.values()} == {"bytes"} and {r.grown_shard for r in got.values()} == {None}
    homes, slots, loads = {}, {}, [0] * 8
    for d, t in docs:
        r = got[d]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        assert homes.setdefault(t, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(loads) - min(loads) <= max(r["size"] for r in got.values())


def test_simhash(spark, docs):
    fps = [slow_fp(t) for _, t in docs]
    want = {d: (f"{f:016x}", c) for (d, _), f, c in zip(docs, fps, slow_components([d for d, _ in docs], fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash_near_dedup(spark, SF).collect()} == want


def test_bpe(spark, docs):
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    ids = {d: theirs.encode_ordinary(t or "") for d, t in docs}
    want = {d: (len(ids[d]), sha(",".join(map(str, ids[d]))), sha(t or "")) for d, t in docs}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_byte_bpe(spark, SF).collect()} == want


def test_line_dedup(spark, docs):
    kept = {docs[i][0]: "" if t == "gone" else t for i, t in without_lines(docs).items()}
    assert {r.doc_id: (r.chars_kept, r.text_sha256) for r in queries.op10_line_dedup(spark, SF).collect()} == {d: (len(t), sha(t)) for d, t in kept.items()}


def test_language_of_a_document_without_an_id(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    rows.unionByName(rows.limit(2).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_language_id(spark, str(tmp_path))
    assert [r.held_out for r in got.where("doc_id IS NULL").collect()] == [False, False]
    assert {r.doc_id for r in got.where("held_out").collect()} == {r.doc_id for r in rows.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
