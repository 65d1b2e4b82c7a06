import math
import zlib

import numpy as np
import pytest
from pageloom.llm import lmscore

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return docs, *lmscore.fit(spark, docs)


def test_pairs_of_all_tokens_reach_the_scores(spark, fitted):
    docs, vocabulary, net = fitted
    want = np.zeros((lmscore.EDGE + 1, lmscore.EDGE + 1))
    for r in docs.collect():
        ids = [lmscore.EDGE, *lmscore.ids_of(lmscore.words_of((r.text or "").encode()), vocabulary).tolist(), lmscore.EDGE]
        for x, y in zip(ids, ids[1:]):
            want[x, y] += len(ids) > 2
    assert (net.pairs == want).all()
    # Beyond the network's sample, more documents change the scores.
    few = lmscore.fit(spark, docs, fit_docs=0)[1]
    assert (few.pairs == want).all() and few.log_probs(np.array([3, 9, 5], np.int32)).std() > 0


def test_rare_words_have_their_own_share(spark, fitted):
    docs, vocabulary, net = fitted
    counts = {bytes(r.word): r.n for r in vocabulary.words.collect()}
    classes = [0] * lmscore.SIDE
    for w, n in counts.items():
        if w not in vocabulary:
            classes[zlib.crc32(w) % lmscore.SIDE] += n
    assert classes == vocabulary.in_class
    rare = sorted(w for w in counts if w not in vocabulary)[:2]
    texts = ["the " + rare[0].decode(), "the junk-of-no-corpus", f"{rare[1].decode()} the {rare[1].decode()}", "the the"]
    df = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts * 2)], "doc_id long, text string")
    got = lmscore.score(spark, df, vocabulary, net).collect()
    assert len(got) == 8
    for r in got:
        words = texts[r.doc_id].encode().split()
        own = sum(math.log(counts.get(w, 1) / (classes[zlib.crc32(w) % lmscore.SIDE] + 1)) for w in words if w not in vocabulary)
        assert abs(r.log_prob - own - net.log_probs(lmscore.ids_of(words, vocabulary)).sum()) < 1e-6
