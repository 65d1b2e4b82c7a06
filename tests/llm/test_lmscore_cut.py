"""Words are cut for a whole batch at once; Python meets each distinct one once."""

from collections import Counter

import numpy as np
import pyarrow as pa

from pageloom.llm import lmscore

PIECES = [b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r", b"a", b"B", b"Z", b"\x1c", b"\x85", b"\xa0", b"\xc2\xa0", b"\xe2\x80\x83", b"\xff", b"\x00", b"\xc3\x84"]


def _texts():
    rng = np.random.default_rng(3)
    return [None, b"", b"  ", b" a ", *(b"".join(PIECES[i] for i in rng.integers(0, len(PIECES), rng.integers(0, 30))) for _ in range(3000))]


def test_cut_as_words_of():
    texts = pa.array(_texts(), pa.binary())
    for some in (texts, texts.cast(pa.large_binary()), texts.slice(5, 900), texts.slice(0, 3), texts.slice(0, 0)):
        sizes, which, distinct = lmscore.cut(some)
        words, each = lmscore.listed(distinct), [lmscore.words_of(t) for t in some.to_pylist()]
        assert sizes.tolist() == [len(w) for w in each]
        assert [words[i] for i in which] == [w for own in each for w in own]
        assert len(set(words)) == len(words)


def test_rare_words_by_first_place():
    texts = pa.array(_texts(), pa.binary())
    sizes, which, distinct = lmscore.cut(texts)
    known = np.array([len(w) % 2 == 0 for w in lmscore.listed(distinct)], bool)
    got = [[(r["word"], r["m"]) for r in own] for own in lmscore._rare(sizes, which, distinct, known).to_pylist()]
    assert got == [[*Counter(w for w in lmscore.words_of(t) if len(w) % 2).items()] for t in texts.to_pylist()]


def test_a_distinct_word_is_looked_up_once():
    class Counting(lmscore.Known):
        asked = 0

        def places(self, words):
            self.asked += len(words)
            return super().places(words)

    known = Counting({b"a": 0, b"b": 1}, {}, [1] * lmscore.SIDE)
    sizes, which, distinct = lmscore.cut(pa.array([b"a b a b a b"] * 100, pa.binary()))
    assert known.places(lmscore.listed(distinct))[which].tolist() == [0, 1] * 300 and known.asked == 2
