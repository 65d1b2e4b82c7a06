import hashlib
import random
import sys

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pageloom.llm.bpe import Encoder, bpe_decode, bpe_encode, load_ranks

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], np.int32).tolist()


@pytest.fixture(scope="module")
def own():
    ranks = load_ranks(PATH)
    return Encoder(ranks, P.PATTERN, 2000), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_code_point(own):
    encoder, theirs = own
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 5000):
        text = "".join(f"a{c} {c}" for c in chars[i : i + 5000])
        assert ids_of(encoder, text) == theirs.encode_ordinary(text)


def test_random_words(own):
    encoder, theirs = own
    rnd = random.Random(3)
    for n in range(60):
        alphabet = rnd.choice(["ab", "aé ", "the cat's ", "0123 \n\t", "aàbß中文🙂<|endoftext|>'ll "])
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 5, 50, 3000])))
        assert ids_of(encoder, text) == theirs.encode_ordinary(text), text[:50]
    for text in ("a" * 20000, " " * 5000 + "x", "!" * 3000):
        assert ids_of(encoder, text) == theirs.encode_ordinary(text)


def test_white_space_and_small_cache(own):
    rnd = random.Random(4)
    encoder = Encoder(load_ranks(PATH), P.PATTERN, 40)
    bits = [" ", "  ", "\n", " \n", "\n ", "\t", "\u00a0", " \u00a0", "\u2003", "\x1c", "\x85", "\ue001", "'s", "a", "Zo", "é1", "12", "!", "?!", "\u200b"]
    for _ in range(1500):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 9)))
        assert ids_of(encoder, text) == own[1].encode_ordinary(text), repr(text)


def test_table(spark, own):
    texts = [None, "", "Ündie the cats.", "Ündie the cats.", "x" * 100000, "<|endoftext|> ok"]
    df = spark.createDataFrame([(i, t, "clash", "c2") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded string")
    got = {r.doc_id: r for r in bpe_decode(spark, bpe_encode(spark, df, PATH, P.PATTERN, block_bytes=10), PATH).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == own[1].encode_ordinary(t or "")
        assert bytes(got[i].decoded) == (t or "").encode() and got[i].text == t
    assert hashlib.sha256(b"").hexdigest() and bpe_encode(spark, df.limit(0), PATH, P.PATTERN).count() == 0
