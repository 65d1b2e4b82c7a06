import numpy as np
import pytest
from pageloom.llm import lmscore

SF = "/root/testdata/sf0.001"


def network_alone(net, texts):
    """Mean log-probability by the network without the counts of pairs."""
    net = lmscore.WindowNetwork(net.vectors, net.bias, net.to_class, net.class_bias, net.to_word, net.word_bias)
    return np.concatenate([net.log_probs(t) for t in texts]).mean()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def test_every_text_is_learned_from(spark, docs):
    """However few texts are asked for at first, all of them train the network: words of a single text and both its neighbours are learned."""
    odd = " ".join(["zeta eta theta"] * 400)
    vocabulary, net = lmscore.fit(spark, docs.unionByName(spark.createDataFrame([(-1, odd)], docs.schema)), fit_docs=0)
    texts = [lmscore.ids_of(lmscore.words_of(t.text.encode()), vocabulary) for t in docs.limit(50).collect()]
    start = lmscore.untrained(np.ones(lmscore.EDGE))
    flat = lmscore.WindowNetwork(list(start["v"]), start["c"], start["wa"], start["ba"], start["wb"], start["bb"])
    assert network_alone(net, texts) > network_alone(flat, texts) + 0.5
    own = lmscore.ids_of(odd.encode().split(), vocabulary)
    assert network_alone(net, [own]) > network_alone(net, [np.random.default_rng(1).permutation(own)]) + 0.5


def test_partitions_and_order_do_not_matter(spark, docs):
    def weights(df):
        return lmscore.fit(spark, df, fit_docs=20, shard_tokens=10_000)[1]

    a, b = weights(docs.coalesce(1)), weights(docs.unionByName(docs.limit(0)).orderBy("text").repartition(5))
    for x, y in zip([*a.vectors, a.bias, a.to_class, a.to_word, a.word_bias, a.pairs], [*b.vectors, b.bias, b.to_class, b.to_word, b.word_bias, b.pairs]):
        assert np.abs(x - y).max() < 1e-6
