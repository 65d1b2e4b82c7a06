import random
import re

from pageloom.llm.decontaminate import BenchmarkIndex, decontaminate, find_contamination


def slow(text, items, span=10):
    """Every window of every item against every position."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, names = cut(text), set(), set()
    for name, t in items:
        w = cut(t)
        n = min(span, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                names.add(name)
    return len(words), hit, names


def cases():
    rnd = random.Random(9)
    vocab = ["aa", "b", "Cé", "d1", "ee", "f"]
    items = [(str(i), " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([0, 1, 4, 9, 9, 10, 11, 30, 60, 60])]
    items += [("x", None), ("y", "?!"), ("z", items[7][1])]
    docs = [None, "", "...", "b"]
    for _ in range(60):
        doc = [rnd.choice(vocab + ["zz", "yy"]) for _ in range(rnd.choice([3, 12, 200]))]
        if rnd.random() < 0.7:
            w = rnd.choice(items[5:10])[1].split()
            s = rnd.randrange(len(w))
            at = rnd.randrange(len(doc))
            doc[at:at] = w[s : s + rnd.choice([8, 9, 10, 11, 40])]
        docs.append(rnd.choice([" ", ", ", "\n"]).join(doc))
    docs.append(" ".join(rnd.choice(vocab) for _ in range(20000)))
    return items, docs


def test_find_equals_brute_force():
    items, docs = cases()
    for some in (items, items[5:], items[:3]):
        index = BenchmarkIndex([(n, None if t is None else t.encode()) for n, t in some])
        for d in docs[:-1]:
            n, spans, names = index.find(None if d is None else d.encode())
            want = slow(d, some)
            assert (n, {p for s, e in spans for p in range(s, e)}, names) == want


def test_blocks_and_clashing_columns(spark):
    items, docs = cases()
    df = spark.createDataFrame([(i, d, "q", 3) for i, d in enumerate(docs)], "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(items[5:])] + [(0, items[5][1]), (None, "zz yy zz yy")], "item_id long, text string")
    one = find_contamination(spark, df, bench)
    many = find_contamination(spark, df, bench, block_bytes=100)
    assert one.columns == ["doc_id", "text", "n_words", "hit_spans", "items"]
    a, b = sorted(one.collect()[:-1], key=str), sorted(many.collect()[:-1], key=str)
    assert a == b and any(r.items for r in a) and not all(r.items for r in a)
    kept = decontaminate(spark, df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in one.collect() if not r["items"]}


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert find_contamination(spark, df.limit(0), bench).count() == 0
    assert find_contamination(spark, df, bench.limit(0)).collect()[0]["n_words"] == 3
    assert decontaminate(spark, df, bench.limit(0)).count() == 1
