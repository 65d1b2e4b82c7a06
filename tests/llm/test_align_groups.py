import collections
import itertools

import numpy as np
import public_tokenizers as P
from pageloom.llm import align
from test_align import slow_groups

JSON, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def test_groups_of_a_block():
    rng = np.random.default_rng(3)
    units = [[[(int(rng.integers(0, 9)), bytes(n)) for n in np.diff([0, *sorted({*rng.integers(1, size + 1, size // 2 + 1).tolist(), size})])] for _ in "ab"] for size in rng.integers(1, 30, 200).tolist()]
    stops = np.cumsum([sum(len(t) for _, t in a) for a, _ in units])
    sides = [(np.array([n for u in units for n, _ in u[s]]), np.cumsum([len(t) for u in units for _, t in u[s]])) for s in (0, 1)]
    want = [slow_groups(*u) for u in units]
    for most in (0, 4, 256):
        found = align.Groups(stops, *sides, most)
        assert found.n_groups.tolist() == [len(g) for g in want]
        assert found.texts([f"{n}{mark}" for mark in ",|;" for n in range(9)], 9) == ["".join(f"{','.join(map(str, p))}|{','.join(map(str, q))};" for p, q in g) for g in want]
        for links, at, weight, large in ((found.links, found.n_plain, np.ones(len(found.links)), False), (found.many[0], found.n_many, found.many[1], True)):
            got = [collections.Counter() for _ in units]
            for u, x, n in zip(np.repeat(np.arange(len(units)), at).tolist(), links.tolist(), weight.tolist()):
                got[u][x >> 32, x & 0xFFFFFFFF] += n
            assert got == [collections.Counter(x for p, q in g if (len(p) * len(q) > most) == large for x in itertools.product(p, q)) for g in want]


def test_no_lambda_and_one_coder(spark):
    """No lambda runs over tokens, and tasks find the coder that their worker process has."""
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(40)], "doc_id long, text string")
    made = align.align(spark, docs, JSON, MODEL)
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString()
    digest = "a worker's"
    align._coders[digest] = "kept"
    try:
        assert align._coder(digest, None) == "kept"
    finally:
        del align._coders[digest]
