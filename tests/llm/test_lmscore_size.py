import inspect

import numpy as np
from pageloom.llm import lmscore


def test_no_switch_by_size(spark, monkeypatch):
    """Rounds, passes and batches are the same laws for a small corpus and a larger one."""
    seen, own = [], lmscore.train_round
    monkeypatch.setattr(lmscore, "train_round", lambda spark, coded, start, tokens, epochs, rate, shard: seen.append((tokens, epochs, rate)) or start)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    lmscore.fit(spark, docs, fit_docs=20)
    monkeypatch.setattr(lmscore, "word_counts", lambda docs, counts=lmscore.word_counts: counts(docs).selectExpr("word", "n * 1000 AS n"))
    lmscore.fit(spark, docs, fit_docs=20)
    assert len(seen) == 6 and [x[1:] for x in seen[:3]] == [x[1:] for x in seen[3:]] and seen[3][0] > 900 * seen[0][0]
    assert "batch" not in inspect.signature(lmscore.train).parameters and "2_000_000" not in inspect.getsource(own)


def test_batches_grow_with_the_steps_alone():
    few, many = list(lmscore._batch_ends(1000)), list(lmscore._batch_ends(3_000_000))
    assert few == [(0, 512), (512, 1000)] and many[0] == few[0] and many[-1][1] == 3_000_000
    assert all(a[1] == b[0] for a, b in zip(many, many[1:])) and max(b - a for a, b in many) == lmscore.BATCH


def test_products_are_exact(spark):
    rng = np.random.default_rng(1)
    start = lmscore.untrained(rng.integers(1, 9, lmscore.EDGE))
    net = lmscore.WindowNetwork(list(start["v"]), start["c"], start["wa"] * 9, start["ba"], start["wb"] * 9, start["bb"])
    ids = rng.integers(0, lmscore.EDGE, 5000).astype(np.int32)
    own = net.log_probs_of([ids])
    for at in (1, 5, 700):
        assert (net.log_probs_of([ids[:at], ids])[at:] == own).all()
