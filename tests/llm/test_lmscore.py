import numpy as np
import pytest
from pageloom.llm import lmscore
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fitted(spark):
    return lmscore.fit(spark, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))


def test_counts_cover_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {}
    for r in docs.collect():
        for w in r.text.encode().lower().split():
            want[w] = want.get(w, 0) + 1
    assert {bytes(r.word): r.n for r in lmscore.word_counts(docs, flush=50).collect()} == want


def test_probabilities_sum_to_one(fitted):
    _, net = fitted
    left, right = 3, 9
    total = 0.0
    for y in range(0, lmscore.EDGE):
        total += np.exp(net.log_probs(np.array([left, left, y, right, right], np.int32))[2])
    assert abs(total - 1) < 1e-3


def test_shuffled_text_scores_lower(spark, fitted):
    """The same words in another order are less likely, as the network and the pairs see neighbours."""
    vocabulary, net = fitted
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 2000").limit(40).collect()]
    rng = np.random.default_rng(1)
    own = [lmscore.ids_of(lmscore.words_of(t.encode()), vocabulary) for t in texts]
    lower = [net.log_probs(rng.permutation(i)).mean() < net.log_probs(i).mean() for i in own]
    assert np.mean(lower) > 0.95


def test_scores_token_by_token(fitted):
    """Each token's probability worked out by itself: softmax over classes, softmax within the class, and the shares of the neighbouring pairs."""
    _, net = fitted
    rng = np.random.default_rng(4)
    ids = rng.integers(0, lmscore.EDGE, 40).astype(np.int32)
    pairs = net.pairs.astype(np.float64)
    at = lambda i: int(ids[i]) if 0 <= i < len(ids) else lmscore.EDGE
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    got = net.log_probs(ids, chunk=16)
    for i, y in enumerate(ids.tolist()):
        h = np.tanh(net.bias.astype(np.float64) + sum(v[at(i + p)].astype(np.float64) for p, v in zip(lmscore.PLACES, net.vectors)))
        c, w = divmod(y, lmscore.SIDE)
        p = soft(h @ net.to_class + net.class_bias)[c] * soft(h @ net.to_word + net.word_bias[c])[w]
        x, z = at(i - 1), at(i + 1)
        after, before = pairs[x, : lmscore.EDGE], pairs[: lmscore.EDGE, z]
        sides = 0.0
        for counts in (after, before):
            seen, kinds = counts.sum(), np.count_nonzero(counts)
            keep = seen / (seen + kinds) if seen else 0.0
            sides += 0.5 * ((counts[y] / seen * keep if seen else 0.0) + (1 - keep) * p)
        assert abs(got[i] - np.log(sides)) < 1e-4


def test_edges(spark, fitted):
    df = spark.createDataFrame([(1, None, "x"), (2, " \n", "x"), (3, "the", "x"), (4, "the the " * 20000, "x"), (4, "the", "x")], "doc_id long, text string, n_tokens string")
    got = sorted([(r.doc_id, r.n_tokens, r.log_prob, r.mean_log_prob) for r in lmscore.score(spark, df, *fitted).collect()], key=lambda r: r[:2])
    assert [g[1] for g in got] == [0, 0, 1, 1, 40000] and got[0][2:] == got[1][2:] == (0.0, None) and got[2][2:] == got[3][2:] and got[4][2] < 0
    assert lmscore.score(spark, df.limit(0), *fitted).count() == 0
    empty = df.limit(0)
    assert lmscore.score(spark, df, *lmscore.fit(spark, empty)).where(F.col("log_prob") < 0).count() == 3
