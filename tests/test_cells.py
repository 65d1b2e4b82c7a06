"""Exact dense search: by blocks of queries with running bests, and from stored cells, against a scan in numpy."""

import numpy as np
import pytest
from pageloom.operators import dense
from pageloom.operators.cells import CellIndex
from pyspark.sql import functions as F
from test_postings import nodes


def slow(vectors, queries, k):
    out = []
    for q, x in queries.items():
        scores = sorted((-round(float(np.dot(x, v)), 6), key) for key, v in vectors.items())
        out += [(q, key, round(-s, 5), i + 1) for i, (s, key) in enumerate(scores[:k])]
    return sorted(out)


def rows(df, key="vec_id"):
    return sorted((r["query_id"], r[key], round(r["score"], 5), r["rank"]) for r in df.collect())


def table(spark, vectors, kind="long"):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], f"vec_id {kind}, v array<double>")


@pytest.fixture
def clustered():
    rng = np.random.default_rng(3)
    hearts = rng.normal(0, 4, (25, 12))
    vectors = {i: np.round(hearts[i % 25] + rng.normal(0, 0.3, 12), 3) for i in range(2000)}
    vectors |= {3000 + i: vectors[5] for i in range(40)} | {4000: np.zeros(12)}  # ties beyond k, and a zero
    queries = {i: vectors[i] for i in (0, 5, 13, 77)} | {9001: rng.normal(0, 1, 12), 9002: np.zeros(12), 9003: -vectors[8]}
    return vectors, queries


def asked(spark, queries):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in queries.items()], "query_id long, q array<double>")


def test_blocks_of_queries(spark, clustered):
    vectors, queries = clustered
    corpus = table(spark, vectors).repartition(3)
    for block in (2, 4096):
        assert rows(dense.dense_top_k_blocks(spark, asked(spark, queries), corpus, 5, block=block)) == slow(vectors, queries, 5)
    plan = dense.dense_top_k(asked(spark, queries), corpus, 5, block=3)
    assert rows(plan) == slow(vectors, queries, 5) and "Cartesian" not in plan._jdf.queryExecution().executedPlan().toString()
    names = {f"c{k}": v for k, v in vectors.items()}
    assert rows(dense.dense_top_k(asked(spark, queries), table(spark, names, "string"), 5, block=3)) == slow(names, queries, 5)


def test_running_best():
    rng = np.random.default_rng(4)
    for _ in range(50):
        best, every = dense.Best(3, 4), {0: [], 1: [], 2: []}
        for _ in range(4):
            some, ids = np.flatnonzero(rng.random(3) < 0.7), rng.permutation(1000)[: rng.integers(1, 9)]
            scores = rng.integers(0, 4, (len(some), len(ids))).astype(float)
            best.add(some, ids, scores)
            for i, row in enumerate(some):
                every[row] += [(-s, x) for s, x in zip(scores[i], ids)]
        assert sorted(zip(best.row.tolist(), (-best.score).tolist(), best.id.tolist())) == sorted((r, s, x) for r, v in every.items() for s, x in sorted(v)[:4])


def test_cells_through_their_life(spark, clustered, tmp_path):
    vectors, queries = clustered
    first = {k: v for k, v in vectors.items() if k % 3}
    index = CellIndex.create(f"{tmp_path}/ix", table(spark, first), cells=25)
    assert rows(index.top_k(asked(spark, queries), 5)) == slow(first, queries, 5)
    CellIndex.open(spark, f"{tmp_path}/ix").extended(table(spark, vectors))
    index = CellIndex.open(spark, f"{tmp_path}/ix")
    for block in (3, 4096):
        assert rows(index.top_k(asked(spark, queries), 5, block=block)) == slow(vectors, queries, 5)
    assert rows(index.top_k(asked(spark, queries), 3000)) == slow(vectors, queries, 3000)
    part = index.subset(f"{tmp_path}/part", table(spark, {k: v for k, v in vectors.items() if k % 2}))
    assert rows(part.top_k(asked(spark, queries), 5)) == slow({k: v for k, v in vectors.items() if k % 2}, queries, 5)
    assert index.top_k(asked(spark, {}), 5).count() == 0
    with pytest.raises(FileExistsError):
        CellIndex.create(f"{tmp_path}/ix", table(spark, first))


def test_most_cells_stay_unread(spark, clustered, tmp_path):
    vectors, _ = clustered
    index = CellIndex.create(f"{tmp_path}/ix", table(spark, vectors), cells=25)
    seen = []
    scored = CellIndex._scored
    try:
        CellIndex._scored = lambda self, wanted, *a: (seen.append(np.flatnonzero(wanted.any(axis=0)).tolist()), scored(self, wanted, *a))[1]
        assert rows(index.top_k(asked(spark, {1: vectors[7]}), 5)) == slow(vectors, {1: vectors[7]}, 5)
    finally:
        CellIndex._scored = scored
    visited = [c for s in seen for c in s]
    assert len(visited) == len({*visited}) <= 5
    df = index.vectors.where(F.col("cell").isin(visited))
    df.collect()
    read = sum(n.metrics().apply("numOutputRows").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan parquet"))
    assert read == index.stats()[0][visited].sum() < 0.3 * len(vectors)


def test_odd_vectors(spark, tmp_path):
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [None, 1.0]), ("d", [float("nan"), 1.0]), ("e", [0.0, 0.0]), ("f", [float("inf"), 0.0])], "vec_id string, v array<double>")
    index = CellIndex.create(f"{tmp_path}/ix", vectors)
    queries = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "query_id long, q array<double>")
    assert rows(index.top_k(queries, 5)) == [(1, "a", 3.0, 1), (1, "e", 0.0, 2)]
    none = CellIndex.create(f"{tmp_path}/none", vectors.limit(0))
    assert none.top_k(queries, 5).count() == 0
