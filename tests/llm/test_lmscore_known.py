import numpy as np
import pytest
from pageloom.llm import lmscore
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def test_known_words_change_no_score(spark, docs):
    """What the tasks know of words is what the join gives; rows to join are those of unknown words only."""
    vocabulary, net = lmscore.fit(spark, docs, known_words=3000)
    assert 0 < len(vocabulary.more) <= 3000 and not vocabulary.more.keys() & vocabulary.keys()
    counts = {bytes(r.word): r.n for r in vocabulary.words.collect()}
    rest = counts.keys() - vocabulary.keys() - vocabulary.more.keys()
    assert all(counts[w] == n for w, n in vocabulary.more.items()) and max(counts[w] for w in rest) <= min(vocabulary.more.values())
    few = lmscore.within_class(docs, vocabulary).count()
    got = {r.doc_id: r.log_prob for r in lmscore.score(spark, docs, vocabulary, net).collect()}
    vocabulary.more = {}
    assert few <= lmscore.within_class(docs, vocabulary).count()
    want = {r.doc_id: r.log_prob for r in lmscore.score(spark, docs, vocabulary, net).collect()}
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-6
    everything = lmscore.fit(spark, docs, known_words=10**6)[0]
    assert lmscore.within_class(docs, everything).where(F.col("within").isNotNull()).count() == 0


def test_equal_texts_score_alike(spark, docs):
    """To the last digit, wherever they stand."""
    fitted = lmscore.fit(spark, docs)
    texts = [r.text for r in docs.limit(20).collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "the", *texts[::-1], "the"])], "doc_id long, text string")
    found = {}
    for r in lmscore.score(spark, df, *fitted).collect():
        found.setdefault(r.text, set()).add(r.log_prob)
    assert len(found) > 10 and all(len(scores) == 1 for scores in found.values())


def test_place_in_a_batch_changes_no_digit(spark, docs):
    vocabulary, net = lmscore.fit(spark, docs)
    texts = [lmscore.ids_of(lmscore.words_of(t.text.encode()), vocabulary) for t in docs.limit(60).collect()]
    alone = [net.log_probs(t) for t in texts]
    for order in (range(60), np.random.default_rng(2).permutation(60)):
        assert (net.log_probs_of([texts[i] for i in order]) == np.concatenate([alone[i] for i in order])).all()
