"""Subword rulers against slow forms."""

import random

import public_tokenizers as P
import pytest
from pageloom.operators import chunking, configured, subwords
from pageloom.operators.subwords import WordPiece
from pageloom.plans import corpus
from pageloom.sources import config
from tokenizers import Tokenizer
from tokenizers.models import WordPiece as Theirs
from tokenizers.normalizers import BertNormalizer
from tokenizers.pre_tokenizers import BertPreTokenizer

VOCABULARY = ["[UNK]", "un", "##aff", "##able", "##a", "##b", "a", "b", "ab", "##abc", "c", "##c", "the", "caf", "cafe", "##e", ",", ".", "-", "$", "1", "##1", "##2", "12", "世"]


def theirs():
    t = Tokenizer(Theirs({w: i for i, w in enumerate(VOCABULARY)}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer, t.pre_tokenizer = BertNormalizer(handle_chinese_chars=False), BertPreTokenizer()
    return t


def test_longest_match_first():
    rnd, own, other = random.Random(4), WordPiece(VOCABULARY), theirs()
    texts = ["unaffable the café, 12-1.", "", "  ", "abcabx ab", "a" * 101, "a" * 100, "CAFÉ\u0301 $1", "\u0301", "世1 世"]
    texts += ["".join(rnd.choice(["a", "b", "c", "ab", "1", "2", "un", "aff", "é", "the ", " ", ",", "\n", "-", "X"]) for _ in range(rnd.randrange(25))) for _ in range(400)]
    for t in texts:
        want = other.encode(t)
        ids, spots = own.encode(t)
        assert ids == want.ids, t
        assert all(0 <= a < b <= len(t) for a, b in spots) and [a for a, _ in spots] == sorted(a for a, _ in spots)
        assert "".join(own(t)) == (t if ids else "") and len(own(t)) == len(ids)
    assert own.decode(own.encode("unaffable, the 121")[0]) == "unaffable , the 121"
    with pytest.raises(ValueError):
        WordPiece(["a"])


def test_slices_of_a_tokenizer_file():
    ruler, other = subwords.tokenizer_ruler(P.path("byte_bpe_50k.json"))(), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in ("plain words, and 12", "世界🙂 <|endoftext|> é", "  lead\n\ntrail  ", "", " "):
        got = ruler(t)
        assert "".join(got) == t
        if "<|" not in t:
            assert len(got) == len(other.encode(t, add_special_tokens=False).ids)


def test_windows_and_chunks(spark, tmp_path):
    rnd = random.Random(5)
    texts = [None, "", " \n ", "one", *[" ".join(rnd.choice(["unaffable", "the", "abc", "x,y", "12\n\n", "a. b"]) for _ in range(rnd.randrange(1, 90))) for _ in range(30)]]
    pages = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_name string, page_number int, text string")
    ruler = WordPiece(VOCABULARY)
    want = []
    for p, t in enumerate(texts):
        tokens, local, start = ruler(t or ""), 0, 0
        while tokens and start < len(tokens):
            body = "".join(tokens[start : start + 20]).strip()
            if body:
                want.append(("d", p, local, body, len(tokens[start : start + 20])))
                local += 1
            if start + 20 >= len(tokens):
                break
            start += 15
    assert sorted(map(tuple, subwords.ruled_windows(pages, 20, 5, subwords.wordpiece_ruler(VOCABULARY)).collect())) == sorted(want)
    chunks = chunking.recursive_chunks(pages, 20, 5, subwords.wordpiece_ruler(VOCABULARY)).collect()
    assert chunks and all(c.n_tokens <= 20 for c in chunks) and all("".join(c.text.split()) in "".join(texts[c.page_number].split()) for c in chunks)
    cfg = config.ChunkConfig("s", "fixed", 20, 5, tokenizer=P.path("byte_bpe_50k.json"))
    assert all(r.n_tokens <= 20 for r in configured.chunks_of(pages, cfg).collect())
    with pytest.raises(ValueError):
        subwords.ruled_windows(pages, 5, 5, subwords.wordpiece_ruler(VOCABULARY))


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    ruler = subwords.tokenizer_ruler(P.path("byte_bpe_50k.json"))()
    pages = {(r.doc_name, r.page_number): r.text for r in corpus._pages(spark, sf).collect()}
    windows = corpus.subword_windows(spark, sf).collect()
    count = {}
    for w in windows:
        count[w.doc_name, w.page_number] = count.get((w.doc_name, w.page_number), 0) + 1
        assert w.n_tokens <= 256
    want = {k: -(-max(len(ruler(t or "")) - 50, 1) // 206) for k, t in pages.items() if (t or "").strip()}
    assert count == want
    assert all(c.n_tokens <= 256 for c in corpus.subword_chunks(spark, sf).collect())


def test_pieces_are_counted_once():
    """A text is not read into tokens where its words alone are too many, and a piece that fits is counted once; pieces and counts are those of the plain walk."""
    ruler, seen = subwords.tokenizer_ruler(P.path("byte_bpe_50k.json"))(), []
    rnd = random.Random(6)
    texts = ["".join(rnd.choice(["word ", "ab. ", "\n", "\n\n", "x" * 40, "  ", "é\x1c", "!\x1c!"]) for _ in range(rnd.randrange(1, 400))) + "." for _ in range(40)] + ["a" * 900, "a b " * 300]

    def walk(text, level=0):
        n = len(ruler(text))
        if n <= 60:
            return [(text, n)]
        if level == 4:
            tokens = ruler(text)
            return [(p, len(ruler(p))) for p in ("".join(tokens[i : i + 60]) for i in range(0, len(tokens), 60))]
        parts = text.split(chunking.SEPARATORS[level])
        return [x for p in [*(p + chunking.SEPARATORS[level] for p in parts[:-1]), parts[-1]] if p.strip() for x in walk(p, level + 1)]

    plain = lambda t: ruler(t)
    assert [chunking.sized_atoms(t, ruler, 60) for t in texts] == [walk(t) for t in texts] == [chunking.sized_atoms(t, plain, 60) for t in texts]
    counted = lambda t: seen.append(t) or ruler(t)
    counted.counts, counted.least = (lambda ts: seen.extend(ts) or ruler.counts(ts)), ruler.least
    assert chunking.sized_atoms("one two. " * 300, counted, 60) and max(map(len, seen)) < 60 * 10 and len(seen) == 300
