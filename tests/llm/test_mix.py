import collections
import random
import re

import numpy as np
import pytest
from pageloom.llm import mix, queries

SF = "/root/testdata/sf0.01"


def slow_targets(words, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: words} -> {source: target}, by handing on what is above the limit until none is."""
    order = sorted(words, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, free = {}, {*words}
    while True:
        left = share * sum(words.values()) - sum(fixed.values())
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if got[s] > most * words[s]}
        if not over:
            return fixed | got
        fixed |= {s: most * words[s] for s in over}
        free -= over
        if not free:
            return fixed


def check(rows, got):
    """rows: (doc_id, source, words); got: rows of mix."""
    words, number = collections.Counter(), collections.Counter()
    for _, s, n in rows:
        words[s] += n
        number[s] += 1
    want, source = slow_targets(dict(words)), {d: s for d, s, _ in rows}
    taken, copies, largest = collections.Counter(), collections.Counter(), collections.Counter()
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((d, n) for d, _, n in rows)
    for r in got:
        s = source[r.doc_id]
        rate = want[s] / words[s] if words[s] else 0
        assert r.source_size == words[s] and r.target == pytest.approx(want[s]) and r.taken == r["size"] * r.copies
        assert r.copies in (int(rate + 1e-9), int(np.ceil(rate - 1e-9))) and r.copies <= 2
        taken[s] += r.taken
        copies[s] += r.copies
        largest[s] = max(largest[s], r["size"])
    for s in words:
        assert abs(taken[s] - want[s]) <= largest[s]
        assert abs(copies[s] - (want[s] / words[s] * number[s] if words[s] else 0)) <= 2


def test_a_step_keeps_the_totals():
    rng = np.random.default_rng(1)
    for _ in range(2000):
        units = [[int(rng.integers(0, 5)), float(rng.uniform(0.01, 0.99))] for _ in range(3)]
        before = [sum(u[1] for u in units), sum(u[0] * u[1] for u in units)]
        mix.settle(units, rng)
        assert [sum(u[1] for u in units), sum(u[0] * u[1] for u in units)] == pytest.approx(before, abs=1e-6)
        assert any(u[1] in (0.0, 1.0) for u in units) and all(0 <= u[1] <= 1 for u in units)


def test_a_step_keeps_expectations():
    rng, start = np.random.default_rng(2), [[3, 0.2], [7, 0.5], [4, 0.9]]
    mean = np.zeros(3)
    for _ in range(4000):
        units = [[*u] for u in start]
        mix.settle(units, rng)
        mean += [u[1] for u in units]
    assert np.allclose(mean / 4000, [0.2, 0.5, 0.9], atol=0.03)


def _table(spark, n=1500):
    rnd = random.Random(6)
    names = ["b", "a", "", None, "é", "Z", "hot", "empty"]
    rows = []
    for i in range(n):
        s = rnd.choice([*names, *["hot"] * 5])
        text = rnd.choice([None, "", " \n"]) if s == "empty" else " ".join(["w\x1cw"] * rnd.choice([0, 1, 2, 5, 9, 200])) if rnd.random() > 0.02 else None
        rows.append((i, s, text))
    df = spark.createDataFrame([(i, s, t, "x") for i, s, t in rows], "doc_id long, source string, text string, target string")
    return [(i, s, len(re.findall(mix.WORDS, t or ""))) for i, s, t in rows], df


@pytest.mark.parametrize("block", [4, 50, 10_000])
def test_table(spark, block):
    rows, df = _table(spark)
    got = mix.mix(spark, df, block_rows=block).collect()
    check(rows, got)
    again = mix.mix(spark, df.repartition(7), block_rows=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_kept_columns_and_odd_tables(spark):
    _, df = _table(spark, 60)
    assert mix.mix(spark, df, keep=("doc_id", "text", "target")).columns == ["doc_id", "text", "size", "source_size", "target", "copies", "taken"]
    assert mix.mix(spark, df.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "s", "a b")] * 200 + [(1, None, None)] * 3, "doc_id long, source string, text string")
    got = mix.mix(spark, same, share=1.5, block_rows=8).collect()
    assert sum(r.taken for r in got if r["size"]) == pytest.approx(600, abs=2) and len(got) == 203
    none = spark.createDataFrame([(1, "s", " ")], "doc_id long, source string, text string")
    assert [(r.target, r.taken) for r in mix.mix(spark, none).collect()] == [(0.0, 0)]


def test_many_sources_are_joined(spark, monkeypatch):
    monkeypatch.setattr(mix, "BROADCAST_SOURCES", 2)
    rows, df = _table(spark, 300)
    check(rows, mix.mix(spark, df, block_rows=20).collect())


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = [(r.doc_id, r.source, len(re.findall(mix.WORDS, r.text or ""))) for r in docs]
    got = queries.op13_source_mix(spark, SF).collect()
    want = slow_targets(collections.Counter({s: sum(n for _, x, n in rows if x == s) for s in {x for _, x, _ in rows}}))
    source, taken, largest = {d: s for d, s, _ in rows}, collections.Counter(), collections.Counter()
    for r in got:
        assert r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
        largest[source[r.doc_id]] = max(largest[source[r.doc_id]], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert sorted(map(str, got)) == sorted(map(str, queries.op13_source_mix(spark, SF).collect()))
