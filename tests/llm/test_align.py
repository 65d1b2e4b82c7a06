import collections
import hashlib
import itertools
import os
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pageloom.llm import align, queries
from pyspark.sql import functions as F
from tokenizers import Tokenizer

os.environ["TOKENIZERS_PARALLELISM"] = "false"
JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def slow_tokens(libraries, text):
    """([(id, bytes)], [(id, bytes)]) by the libraries on the whole text."""
    a, b = libraries
    if not text:
        return [], []
    of = align.byte_level_bytes()
    left = [(n, bytes(of[c] for c in t)) for n, t in (lambda e: zip(e.ids, e.tokens))(a.encode(f" {text}", add_special_tokens=False))]
    right = []
    for n in b.encode(text, num_threads=1):
        p = b.id_to_piece(n)
        right.append((n, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
    raw = f" {text}".encode()
    return (left, right) if all(b"".join(t for _, t in x) == raw for x in (left, right)) else ([], [])


def slow_groups(left, right):
    ends = [list(itertools.accumulate(len(t) for _, t in x)) for x in (left, right)]
    groups, i, j = [], 0, 0
    for e in sorted({*ends[0]} & {*ends[1]}):
        own = [], []
        while i < len(left) and ends[0][i] <= e:
            own[0].append(left[i][0])
            i += 1
        while j < len(right) and ends[1][j] <= e:
            own[1].append(right[j][0])
            j += 1
        groups.append(own)
    return groups


def slow(libraries, docs):
    tokens = [slow_tokens(libraries, t) for _, t in docs]
    groups = [slow_groups(*t) for t in tokens]
    links = [collections.Counter(p for a, b in g for p in itertools.product(a, b)) for g in groups]
    count = collections.Counter(p for x in links for p in x)
    best = {}
    for (a, _), n in count.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for (d, _), (a, b), g, x in zip(docs, tokens, groups, links):
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)
        sums = sum(n for p, n in x.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in x.items())
        out.append((d, len(a), len(b), len(g), sum(x.values()), *sums, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def test_query(spark, libraries):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op11_token_alignment(spark, SF).collect())) == sorted(slow(libraries, docs))


def test_odd_texts(spark, libraries, tmp_path):
    rnd = random.Random(5)
    bits = [" ", "  ", "\n", "\r\n", "\t", " ", " ", "\x1c", "\x85", "'s", "a", "Zo", "é", "中文", "🙂", "12", "!?", "​", "<|endoftext|>", "<s>", "<0x0A>", "ﬁ"]
    texts = [None, "", " ", "   ", "\n", "with ▁ in it", "▁", "same", "same", "x" * 3000, "世" * 700, " " * 5000 + "x", "ሴ\n" * 400]
    texts += ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 40))) for _ in range(250)]
    docs = [(None if i == 7 else i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, queries.op11_token_alignment(spark, str(tmp_path)).collect()), key=key) == sorted(slow(libraries, docs), key=key)


@pytest.mark.parametrize(("plain", "sent"), [(1, 3), (4, 200_000), (256, 0)])
def test_large_groups_and_rare_pairs(spark, libraries, monkeypatch, tmp_path, plain, sent):
    """Counting by distinct ids, and joining counts instead of sending them, change nothing."""
    monkeypatch.setattr(align, "PLAIN_LINKS", plain)
    monkeypatch.setattr(align, "BROADCAST_PAIRS", sent)
    docs = [(i, f"words and 世界{'ሴ' * (i % 5)} {'ab' * i} ok") for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op11_token_alignment(spark, str(tmp_path)).collect())) == sorted(slow(libraries, docs))


def test_every_code_point_and_small_cache(libraries):
    coder = align.Coder(open(JSON, encoding="utf-8").read(), open(MODEL, "rb").read(), keep_tokens=100)
    chars = [chr(c) for c in range(1, 0x3400) if c != 0x2581]
    texts = ["".join(f"a{c} {c}b{c}" for c in chars[i : i + 400]) for i in range(0, len(chars), 400)]
    for i in range(0, len(texts), 3):
        numbers, counts, stops, sides = coder.code(texts[i : i + 3])
        for side, (ids, ends, _) in enumerate(sides):
            units = [[] for _ in stops]
            for n, e in zip(ids.tolist(), np.searchsorted(stops, ends).tolist()):
                units[e].append(n)
            want = [n for t in texts[i : i + 3] for n, _ in slow_tokens(libraries, t)[side]]
            assert [n for u in numbers.tolist() for n in units[u]] == want and len(numbers) == counts.sum()


def test_columns_and_empty_table(spark, libraries):
    df = spark.createDataFrame([(1, "ab c", "x", 3, 4), (2, None, "y", 5, 6)], "doc_id long, text string, links string, _units int, row int")
    made = align.align(spark, df, JSON, MODEL, block_bytes=1)
    assert made.columns == ["doc_id", "text", "_units", "row", "n_a", "n_b", "n_groups", "n_links", "aligned", "links", "many_links"]
    got = made.select("*", align.groups_of(F.col("aligned")).alias("groups")).orderBy("doc_id").collect()
    assert [[(x.a, x.b) for x in r.groups] for r in got] == [[tuple(x) for x in slow_groups(*slow_tokens(libraries, t))] for t in ("ab c", None)] and got[0]["_units"] == 3
    assert align.with_link_sums(spark, align.align(spark, df.limit(0), JSON, MODEL)).count() == 0
