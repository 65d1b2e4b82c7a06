import random

import public_tokenizers as P
import tiktoken
from pageloom.llm.bpe import LONG_WORD, Encoder, load_ranks
from test_bpe import PATH, ids_of


def test_long_words_are_encoded_and_not_kept():
    rnd, ranks = random.Random(7), load_ranks(PATH)
    own, theirs = Encoder(ranks, P.PATTERN, 2000), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["".join(rnd.choices("abcdefgh", k=n)) for n in (LONG_WORD - 1, LONG_WORD, LONG_WORD + 1, 20_000, 20_000, 5)]
    for _ in range(2):
        text = " ".join([*words, *["".join(rnd.choices("abc", k=3000)) for _ in range(40)], words[3]])
        assert ids_of(own, text) == theirs.encode_ordinary(text)
        assert max(map(len, own.young)) <= LONG_WORD and words[5] in {w.strip() for w in own.young}
