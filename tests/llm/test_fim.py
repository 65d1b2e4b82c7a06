import hashlib
import random
import re

import numpy as np
import pytest
from pageloom.llm import fim, queries
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow(doc_id, text, rate=50, spm=80):
    text = text or ""
    w, h = UNIT.findall(text), hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    i, j = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    a, b, c = "".join(w[:i]), "".join(w[i:j]), "".join(w[j:])
    if not text or any(m in text for m in fim.MARKERS) or h3 % 100 >= rate:
        return (doc_id, len(w), "plain", None, None, sha(text), sha(text))
    form, out = ("spm", f"<S>{c}<P>{a}<M>{b}") if h4 % 100 < spm else ("psm", f"<P>{a}<S>{c}<M>{b}")
    return (doc_id, len(w), form, len(a), len(b), sha(out), sha(text))


def test_lists_select_what_they_hold():
    rnd = random.Random(1)
    for _ in range(200):
        ends = np.array(sorted(rnd.sample(range(1, rnd.choice([50, 5000, 10**7])), rnd.randrange(1, 40))))
        packed = fim.pack(ends)
        assert [fim.select(packed, i) for i in range(len(ends) + 1)] == [0, *ends.tolist()]
    assert fim.select(fim.pack(np.zeros(0, np.int64)), 0) == 0
    words = np.cumsum(np.random.default_rng(2).integers(1, 12, 50_000))
    assert len(fim.pack(words)) < 50_000 * 5 / 8 + 100


def test_ends_of_units():
    rnd = random.Random(2)
    for _ in range(500):
        t = "".join(rnd.choice([" ", "\t", "\n", "a", "é", "世", "🙂", "\x1c", " ", "\x0b", "<P>"]) for _ in range(rnd.randrange(12)))
        assert fim.unit_ends(t.encode()).tolist() == np.cumsum([len(u) for u in UNIT.findall(t)] or [0]).tolist()[: len(UNIT.findall(t))]


@pytest.fixture
def odd(spark):
    rnd = random.Random(3)
    texts = [None, "", " ", "\n\n", "one", "a <P> b", "ends in <M", "P> starts", "<", "<S", "S>x <", "世界 🙂 x" * 9, "hot text of words", "w " * 30_000] + ["hot text of words"] * 300
    texts += ["".join(rnd.choice([" ", "\t", "a", "<", ">", "P", "é", "世", "<S"]) for _ in range(rnd.randrange(40))) for _ in range(200)]
    rows = [(None if i in (20, 21) else i, t, "clash", 5) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, output string, K1 int")


def of(df):
    sha2 = lambda c: F.sha2(c.cast("binary"), 256)
    got = df.select("doc_id", "n_units", "form", "prefix_chars", "middle_chars", sha2(F.col("output")), sha2(fim.restored(F.col("output"), F.col("form"))))
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize(("rate", "spm"), [(50, 80), (100, 0), (100, 100)])
def test_odd_texts(spark, odd, rate, spm):
    rows, df = odd
    made = fim.fill_in_middle(spark, df, rate=rate, spm=spm)
    assert made.columns == ["doc_id", "text", "K1", "n_units", "form", "prefix_chars", "middle_chars", "output"]
    assert of(made) == sorted((slow(r[0], r[1], rate, spm) for r in rows), key=str)
    assert fim.fill_in_middle(spark, df.limit(0)).count() == 0


def test_texts_that_share_a_key(spark, odd, monkeypatch):
    """With keys of three bits at first, texts meet; they are keyed anew and come out right."""
    keys, asked = fim._key, []
    monkeypatch.setattr(fim, "_key", lambda text, seed: asked.append(seed) or ([F.xxhash64(text) % 8, F.lit(0).cast("long")] if seed < 1 else keys(text, seed)))
    rows, df = odd
    assert of(fim.fill_in_middle(spark, df)) == sorted((slow(r[0], r[1]) for r in rows), key=str)
    assert {*asked} == {0, 1}


def test_markers():
    for bad in (("<P>", "<P>", "<M>"), ("P", "<S>", "<M>"), ("<P>", "<S<>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(None, None, markers=bad)


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert sorted(map(tuple, queries.op12_fill_in_middle(spark, "/root/testdata/sf0.001").collect()), key=str) == sorted((slow(r.doc_id, r.text) for r in docs), key=str)
