"""The stored index against a slow BM25, through additions, deletions, replacements, merges and subsets."""

import math
import random
import re
from collections import Counter

import pytest
from pageloom.operators import postings
from pageloom.operators.postings import StoredIndex
from pageloom.operators.retriever import Lexical
from pyspark.sql import functions as F


def tokens(text):
    out = []
    for w in re.findall("[a-z0-9]+", (text or "").lower()):
        out.append(w)
        if re.search("[a-z]", w) and re.search("[0-9]", w):
            out += re.findall("[a-z]+|[0-9]+", w)
    return out


def slow(chunks, queries, k):
    bags = {c: Counter(tokens(t)) for c, t in chunks.items()}
    n, avgdl = len(bags), sum(sum(b.values()) for b in bags.values()) / max(1, len(bags))
    df = Counter(t for b in bags.values() for t in b)
    out = []
    for q, text in queries.items():
        scores = []
        for c, b in bags.items():
            dl = sum(b.values())
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.5 / (b[t] + 1.5 * (0.25 + 0.75 * dl / avgdl)) for t in {*tokens(text)} if t in b)
            if round(s, 6) > 0:
                scores.append((-round(s, 6), c))
        out += [(q, c, -s, i + 1) for i, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def search(index, spark, queries, k=5):
    asked = spark.createDataFrame([*queries.items()], "query_id long, text string")
    return sorted(tuple(r) for r in index.top_k(asked, k).select("query_id", "chunk_id", F.round("score", 6), "rank").collect())


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(postings, "SHARD_BITS", 2)
    monkeypatch.setattr(postings, "FIRST_SHARDS", 2)


@pytest.fixture
def corpus():
    rnd = random.Random(8)
    words = [f"w{i}" if i % 3 else f"fy20{i}" for i in range(60)]
    text = lambda: " ".join(rnd.choices(words, [1 / (i + 1) for i in range(60)], k=rnd.choice([0, 1, 3, 12, 60])))
    chunks = {i: text() for i in range(120)} | {200: None, 201: "", 202: "w1 w1 w2", 203: "w1 w1 w2"}
    return chunks, {1: "w1 w2", 2: text(), 3: "fy2030 w44 nowhere", 4: "", 5: None, 6: "nowhere", 7: " ".join(words)}


def table(spark, chunks):
    return spark.createDataFrame([(c, t, f"doc{c % 4}") for c, t in chunks.items()], "chunk_id long, text string, doc_name string")


def test_through_its_life(spark, small_shards, corpus, tmp_path):
    chunks, queries = corpus
    path, first = f"{tmp_path}/ix", {c: t for c, t in chunks.items() if c % 2}
    with pytest.raises(FileNotFoundError):
        StoredIndex.open(spark, path)
    one = StoredIndex.create(path, table(spark, first))
    assert search(one, spark, queries) == slow(first, queries, 5)
    with pytest.raises(FileExistsError):
        StoredIndex.create(path, table(spark, first))
    two = StoredIndex.open(spark, path).extended(table(spark, chunks))
    assert search(two, spark, queries) == slow(chunks, queries, 5) and len(two.segments) == 2
    gone = {c: t for c, t in chunks.items() if c % 5 != 1}
    three = two.without(spark.createDataFrame([(c,) for c in [*chunks, 999] if c % 5 == 1], "chunk_id long"))
    assert search(three, spark, queries) == slow(gone, queries, 5)
    assert search(two, spark, queries) == slow(chunks, queries, 5)  # an older version stays as it was
    new = {c: f"w1 new{c} fy2099" for c in gone if c % 7 == 3} | {500: "w2 brand new"}
    four = StoredIndex.open(spark, path).replaced(table(spark, new))
    assert search(four, spark, queries | {8: "new3 fy 2099"}) == slow(gone | new, queries | {8: "new3 fy 2099"}, 5)
    back = StoredIndex.open(spark, path).extended(table(spark, chunks))  # those taken out come back, the others stay
    assert search(back, spark, queries) == slow(chunks | gone | new, queries, 5)
    merged = back.compacted()
    assert len(merged.segments) == 1 and search(StoredIndex.open(spark, path), spark, queries) == slow(chunks | new, queries, 5)
    count = Counter(t for x in (chunks | new).values() for t in {*tokens(x)})
    assert {r.term: r.df for r in back.terms().collect()} == {r.term: r.df for r in merged.terms().collect()} == count
    part = merged.subset(f"{tmp_path}/part", spark.createDataFrame([("doc1",), ("doc3",)], "doc_name string"), "doc_name")
    assert search(part, spark, queries) == slow({c: t for c, t in (chunks | new).items() if c % 4 in (1, 3)}, queries, 5)
    none = part.without(part.chunks.select("chunk_id"))
    assert search(none, spark, queries) == [] and search(none.extended(table(spark, first)), spark, queries) == slow(first, queries, 5)


def test_nothing_to_add_and_no_tokens(spark, tmp_path):
    blank = {1: "", 2: None, 3: "!?"}
    index = StoredIndex.create(f"{tmp_path}/ix", table(spark, blank))
    assert search(index, spark, {1: "a", 2: ""}) == [] and index.n == 3 and index.terms().count() == 0
    same = index.extended(table(spark, blank))
    assert same.segments == index.segments and search(same.extended(table(spark, {4: "a b"})), spark, {1: "a"}) == slow(blank | {4: "a b"}, {1: "a"}, 5)
    none = StoredIndex.create(f"{tmp_path}/none", table(spark, blank).limit(0))
    assert none.segments == [] and search(StoredIndex.open(spark, f"{tmp_path}/none"), spark, {1: "a"}) == []
    assert none.subset(f"{tmp_path}/part", spark.createDataFrame([(1,)], "chunk_id long")).n == 0


def test_two_writers_of_one_version(spark, tmp_path):
    index = StoredIndex.create(f"{tmp_path}/ix", table(spark, {1: "a"}))
    index.extended(table(spark, {2: "b"}))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        index.extended(table(spark, {3: "c"}))
    assert {r.chunk_id for r in StoredIndex.open(spark, f"{tmp_path}/ix").chunks.collect()} == {1, 2}


@pytest.mark.parametrize("limits", [(0, 500, 500_000), (100_000, 0, 500_000), (100_000, 500, 0)])
def test_other_ways_beyond_the_limits(spark, small_shards, corpus, tmp_path, monkeypatch, limits):
    for name, x in zip(("PICK_TERMS", "PUSH_TERMS", "BROADCAST_ROWS"), limits):
        monkeypatch.setattr(postings, name, x)
    chunks, queries = corpus
    index = StoredIndex.create(f"{tmp_path}/ix", table(spark, chunks)).without(spark.createDataFrame([(3,), (202,)], "chunk_id long"))
    assert search(index, spark, queries) == slow({c: t for c, t in chunks.items() if c not in (3, 202)}, queries, 5)


def nodes(plan):
    """All nodes of a physical plan, through stages."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        below = [plan.executedPlan()]
    elif "QueryStage" in name:
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    yield plan
    for b in below:
        yield from nodes(b)


def rows_read(df):
    df.collect()
    return sum(n.metrics().apply("numOutputRows").value() for n in nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName().startswith("Scan parquet"))


def test_reads_what_the_terms_need(spark, tmp_path):
    """Rows read follow the asked terms' own, by parts, row groups and pages; the index is not shuffled."""
    rnd = random.Random(1)
    chunks = {i: " ".join(f"t{rnd.randrange(4000)}" for _ in range(40)) for i in range(3000)}
    index = StoredIndex.create(f"{tmp_path}/ix", table(spark, chunks))
    total = rows_read(index.blocks().select("term", "entries"))
    for asked in (["t17"], ["t100", "t2500", "t999"]):
        few = index.blocks(asked)
        assert {r.term for r in few.select("term").distinct().collect()} == {*asked}
        assert rows_read(index.blocks(asked).select("term", "entries")) < max(0.2, 0.05 * len(asked)) * total
    assert index._blocks(index.segments[0], ["zzz"]).count() == 0


def test_bounds_leave_shards_out(spark, tmp_path, monkeypatch):
    """Chunks that hold the asked words often stand in few shards; the others are not scored, and the hits are those of all."""
    monkeypatch.setattr(postings, "SHARD_BITS", 4)
    rnd = random.Random(2)
    chunks = {i: " ".join(["rare"] * (20 if i < 40 else rnd.randrange(2)) + rnd.choices(["a", "b", "c"], k=25)) for i in range(1500)}
    index, scored = StoredIndex.create(f"{tmp_path}/ix", table(spark, chunks)), []
    monkeypatch.setattr(postings, "stash", lambda s, df, tag, keep=postings.stash: (lambda out: (scored.append((tag, out.count())), out)[1])(keep(s, df, tag)))
    assert search(index, spark, {1: "rare a"}) == slow(chunks, {1: "rare a"}, 5)
    got = dict(scored)
    assert got["bounds"] > 80 and got["first"] + got["open"] < got["bounds"] / 4


def test_a_retriever_takes_it(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{i}", f"d{i % 2}", i, f"w{i} common") for i in range(9)], "chunk_id string, doc_name string, page_number int, text string")
    index = StoredIndex.create(f"{tmp_path}/ix", rows)
    hits = Lexical(index).search(spark.createDataFrame([(1, "w4 common")], "query_id long, text string"), 3).orderBy("rank").collect()
    assert [h.chunk_id for h in hits] == ["c4", "c0", "c1"] and hits[0].doc_name == "d0"


def test_a_search_sums_where_the_shards_are(spark, small_shards, tmp_path, monkeypatch):
    """Blocks go to their shard's task once, whatever number of queries asks for them; what leaves it are hits, not all pairs of query and chunk."""
    monkeypatch.setattr(postings, "TASK_PAIRS", 512)
    monkeypatch.setattr(postings, "SHARD_BITS", 4)
    rnd, kept = random.Random(3), {}
    chunks = {i: " ".join(rnd.choices(["a", "b", "c", "d"], k=rnd.randrange(1, 30))) for i in range(300)}
    queries = {i: " ".join(rnd.choices(["a", "b", "c", "d"], k=2)) for i in range(40)}
    index = StoredIndex.create(f"{tmp_path}/ix", table(spark, chunks)).without(spark.createDataFrame([(i,) for i in range(0, 300, 9)], "chunk_id long"))
    monkeypatch.setattr(postings, "stash", lambda s, df, tag, keep=postings.stash: kept.setdefault(tag, []).append(keep(s, df, tag)) or kept[tag][-1])
    assert search(index, spark, queries) == slow({c: t for c, t in chunks.items() if c % 9}, queries, 5)
    assert kept["sums"][1].count() < (kept["open"][0].count() << 4) / 2


def test_blocks_of_a_task():
    """Shards that batches cut are put together; an entry keeps its tf, dl and place."""
    import pyarrow as pa

    rnd = random.Random(5)
    rows = [{"shard": i // 4 + (i > 40) * 3, "pos": i % 4, "dl": rnd.choice([0, 1, 2**31 - 1]), "terms": [{"term": t, "tf": rnd.choice([1, 65535])} for t in rnd.sample("abcdé😀", rnd.randrange(4))]} for i in range(90)]
    kind = pa.schema([("shard", pa.int64()), ("pos", pa.int32()), ("dl", pa.int32()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 7], kind) for i in range(0, 90, 7)]
    got = [b for out in postings._grouped(iter([*batches, batches[0].slice(0, 0)])) for b in out.to_pylist()]
    want = {}
    for r in rows:
        for e in r["terms"]:
            want.setdefault((e["term"], r["shard"]), []).append((r["dl"], e["tf"], r["pos"]))
    assert len(got) == len(want) and {(b["term"], b["shard"]): sorted((e >> 31, e >> 15 & 65535, e & 32767) for e in b["entries"]) for b in got} == {k: sorted(v) for k, v in want.items()}
    assert all(b["max_tf"] == max(t for _, t, _ in want[b["term"], b["shard"]]) for b in got)
