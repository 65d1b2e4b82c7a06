import random

import numpy as np
import xxhash
from pageloom.llm.simhash import block_masks, blocks_for, fingerprint, link_edges, segments, simhash_components, simhash_near_dedup


def slow_fp(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, fps, bits=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_fingerprint():
    for t in (None, "", " \n", "One", "a b", "É a\tB c d", "the cat sat on the mat " * 50):
        assert fingerprint(None if t is None else t.encode()) == slow_fp(t)


def test_segments_all_sizes():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = np.array([int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for c in centre for _ in range(40)], dtype=np.uint64)
    unit = np.sort(np.repeat([1, 1, 1, 2, 3, 4], 40))
    a, b = segments(fps, unit, 4)
    assert all(np.bitwise_count(fps[a] ^ fps[b]) <= 4)
    from_links = slow_components(list(range(240)), [(int(u) << 70) | int(f) if False else int(f) for u, f in zip(unit, fps)])
    lab = np.arange(240)
    for _ in range(240):
        np.minimum.at(lab, a, lab[b])
        np.minimum.at(lab, b, lab[a])
    assert all(lab[i] >= from_links[i] for i in range(240))
    for u in (2, 3, 4):
        own = np.flatnonzero(unit == u)
        want = slow_components(own.tolist(), [int(f) for f in fps[own]])
        assert lab[own].tolist() == want


def test_against_brute_force(spark):
    rnd = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 3, 60, 300]))]
        for _ in range(4):
            copy = list(base)
            if len(copy) > 50:
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    texts += [None, "", " ", texts[0], "x " * 30000]
    ids = list(range(100, 100 + len(texts)))
    rows = [(i, t, 7) for i, t in zip(ids, texts)] + [(None, None, 7), (None, "lonely words of a row without id", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    got = simhash_components(spark, df).collect()
    want = slow_components([r[0] for r in rows], [slow_fp(r[1]) for r in rows])
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=key) == sorted(zip([r[0] for r in rows], want), key=key)
    kept = simhash_near_dedup(spark, df, k=4)
    assert kept.columns == df.columns
    groups = {c for c in want if c is not None}
    ids_kept = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids_kept if i is not None) == sorted(groups) and ids_kept.count(None) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(spark, df).count() == 0
    assert simhash_near_dedup(spark, df).count() == 0


def test_near_copies_without_an_id(spark):
    """Components whose ids are all null are one group each, as others are."""
    text = " ".join(f"word{i}" for i in range(300))
    for ids in ((1, 2), (None, None), (None, 2)):
        df = spark.createDataFrame([(ids[0], text, "a", 1), (ids[1], text + " more", "b", 2), (None, "something else altogether", "c", 3)], "doc_id long, text string, th1 string, _th1 int")
        got = simhash_near_dedup(spark, df)
        assert got.columns == df.columns and got.count() == 2


def test_any_number_of_blocks_finds_the_same_links(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for c in centre for _ in range(8)})
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = slow_components(list(range(len(fps))), fps)
    for blocks in (6, 7, 8):
        lab = np.arange(len(fps))
        edges = [(signed.index(r.a), signed.index(r.b)) for r in link_edges(df, 4, blocks=blocks).collect()]
        for _ in range(12):
            for a, b in edges:
                lab[a] = lab[b] = min(lab[a], lab[b])
        assert lab.tolist() == want
    assert [blocks_for(n, 4) for n in (0, 10**6, 10**10, 10**14)] == [6, 6, 8, 8] and len(block_masks(4, 8)) == 70
