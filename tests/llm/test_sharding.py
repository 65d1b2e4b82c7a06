import heapq
import random
import zlib

from pageloom.llm.sharding import place, place_run, shard_by_size


def slow(sizes, shards):
    heap = [(0, i) for i in range(shards)]
    for s in sorted(sizes, reverse=True):
        x, i = heapq.heappop(heap)
        heapq.heappush(heap, (x + s, i))
    return [x for x, _ in sorted(heap, key=lambda h: h[1])]


def test_runs_end_as_the_heap_does():
    rnd = random.Random(2)
    for _ in range(300):
        loads = [rnd.randrange(0, rnd.choice([2, 100, 5000])) for _ in range(rnd.choice([1, 3, 8]))]
        size, n = rnd.randrange(1, 50), rnd.randrange(0, 400)
        heap = [(x, i) for i, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(n):
            x, i = heapq.heappop(heap)
            heapq.heappush(heap, (x + size, i))
        assert sum(place_run(loads, size, n)) == n
        assert loads == [x for x, _ in sorted(heap, key=lambda h: h[1])]


def test_table(spark):
    rnd = random.Random(4)
    texts = ["t" * rnd.randrange(0, 40) + str(rnd.randrange(30)) for _ in range(3000)] + ["hot"] * 900 + [None] * 5 + ["", "", "é" * 2000]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    got = shard_by_size(spark, df).collect()
    assert len(got) == len(texts)
    text_of = {(i if i else None): t for i, t in enumerate(texts)}
    groups, homes, loads, slots = {}, {}, [0] * 8, {}
    for r in got:
        t = text_of[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 1 and r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        assert homes.setdefault(t, r.shard) == r.shard
        groups[t] = groups.get(t, 0) + r["size"]
        loads[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert loads == slow(groups.values(), 8)
    assert place([], 8) == []


def test_empty(spark):
    assert shard_by_size(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
