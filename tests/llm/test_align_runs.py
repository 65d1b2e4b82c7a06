"""Units that go to the tokenizer library as one text get the tokens that each gets alone, in fewer calls."""

import random

import numpy as np
import public_tokenizers as tokenizers
from pageloom.llm import align


def test_runs_of_units():
    with open(tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(tokenizers.path("piece_bpe_32k.model"), "rb") as g:
        coder = align.Coder(f.read(), g.read())
    draw = random.Random(3)
    texts = ["".join(draw.choices("ab Zé1 2,.'s\n\t\r\x1c\x85 ▁　  <|endoftext|>ñ😀", k=draw.randrange(1, 40))) for _ in range(3000)]
    units = list({u for t in texts for u in (align._SPACED if coder.odd(t) else align._UNIT)(f" {t}")})
    size = np.array([len(u.encode()) for u in units])
    real, calls = coder.a, []

    class Counted:
        def encode_batch_fast(self, batch, **options):
            calls.append(len(batch))
            return real.encode_batch_fast(batch, **options)

    coder.a = Counted()
    counts, ids = coder._first(units, size)
    alone = [e.ids for e in real.encode_batch_fast(units, add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in alone] and ids.tolist() == [i for x in alone for i in x]
    plain = [f" w{n}" for n in range(5000)]
    calls.clear()
    coder._learn(plain)
    assert sum(calls) <= 5000 / align.RUN + 1
