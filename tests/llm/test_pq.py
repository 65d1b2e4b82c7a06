import numpy as np
import pytest
from pageloom.llm.pq import near_vectors


def slow(rows, t=0.98):
    n = len(rows)
    ok = [lab is not None and x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(x) for _, lab, x in rows]
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = np.array(rows[i][2], float), np.array(rows[j][2], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                    links[i] += 1
                    links[j] += 1
                    root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(rows[i][0], links[i], least.get(find(i)), rows[i][0] is not None and rows[i][0] == least.get(find(i))) for i in range(n)]


@pytest.mark.parametrize("block_rows", [4096, 40])
def test_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(6)
    rows, vid = [], 1000
    for c in range(40):
        centre = rng.normal(size=12)
        for _ in range(rng.integers(1, 12)):
            x = centre + rng.normal(size=12) * rng.choice([0.02, 0.1, 0.3])
            rows.append((vid, int(rng.integers(0, 2)), [float(np.float32(v)) for v in x]))
            vid -= 1
    rows += [(5000 + i, 1, rows[3][2]) for i in range(60)]
    rows += [(1, None, rows[3][2]), (2, 1, None), (3, 1, [0.0] * 12), (4, 1, [float("nan")] * 12), (5, 1, [None] * 12), (6, 1, []), (7, 1, [float("inf")] + [1.0] * 11)]
    rows += [(8, 1, [2 * v for v in rows[3][2]]), (9, 1, [1.0, 2.0, 3.0]), (10, 1, [1.0, 2.0, 3.0]), (None, 1, rows[5][2]), (None, 1, [9.0, 1.0]), (11, 1, rows[3][2]), (11, 1, rows[3][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, root string")
    got = [tuple(r) for r in near_vectors(spark, df, lists=20, block_rows=block_rows).collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(slow(rows), key=key)


def test_null_components_link_with_nothing(spark):
    """A hash of an array passes over nulls, so these would share a key with their shorter neighbours."""
    df = spark.createDataFrame([(1, 1, [1.0, None, 2.0]), (2, 1, [1.0, 2.0, None]), (3, 1, [1.0, 2.0]), (4, 1, [1.0, 2.0]), (5, 1, [None, 1.0, 2.0])], "vec_id long, label int, embedding array<double>")
    got = [tuple(r) for r in near_vectors(spark, df).orderBy("vec_id").collect()]
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)]


def test_nothing_to_link(spark):
    df = spark.createDataFrame([(1, 1, None), (2, None, [1.0])], "vec_id long, label int, embedding array<float>")
    assert [tuple(r) for r in near_vectors(spark, df).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
    assert near_vectors(spark, df.limit(0)).count() == 0
