"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. A window is ``span``
consecutive words of an item; an item of fewer words is one window. Of every ``span`` words the
least of their k-gram hashes is kept, so a document and an item that share a window keep a common
hash: the kept hashes of a document are looked up among those of the benchmark, and each hit is extended to the
windows around it, compared word for word. Items shorter than ``span`` words have their
whole word sequence looked up at every position instead (winnowing over a window of one).

The benchmark is the query set. It is read in blocks of about ``block_bytes`` of text, each indexed on the driver and broadcast;
a block's size is the bound of what is broadcast, and documents pass the blocks one after another
without a shuffle, each adding its hits. Work for a document follows its length, not the number of items
that share a passage.

Null text has no words. Null item text has no window; a null item_id is written as the empty string. Repeated items count
once. Rows, their order within a partition and all columns stay; result columns replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Bytes to bytes: A-Z to a-z, ASCII that is neither letter nor digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive symbols."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = symbols[:n].copy()
    for j in range(1, k):
        h *= _STEP
        h += symbols[j : j + n]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of hashes that are the least of some w consecutive ones (all ties)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = h[:n].copy()
    for j in range(1, w):
        np.minimum(least, h[j : j + n], out=least)
    most = np.zeros(len(h), np.uint64)
    for j in range(w):
        np.maximum(most[j : j + n], least, out=most[j : j + n])
    return np.flatnonzero(h == most)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h if len(known) else np.zeros(len(h), bool)


class BenchmarkIndex:
    """Windows of the items, and the hashes that find them."""

    def __init__(self, items: list[tuple[str, bytes | None]], span: int = 10, k: int = 5):
        self.span, self.k = span, k
        self.ids: dict[bytes, int] = {}
        texts = [(name, np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(t)], np.int32)) for name, t in items]
        rng = np.random.default_rng(11)
        self.symbols = rng.integers(0, 1 << 63, len(self.ids) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        owners: dict[bytes, set[str]] = {}
        long_hashes: list[np.ndarray] = []
        short: dict[int, list[np.ndarray]] = {}
        for name, ids in texts:
            n = min(span, len(ids))
            if not n:
                continue
            raw = ids.tobytes()
            for s in range(len(ids) - n + 1):
                owners.setdefault(raw[4 * s : 4 * (s + n)], set()).add(name)
            if n == span:
                h = grams(self.symbols[ids], k)
                long_hashes.append(h[winnow(h, span - k + 1)])
            else:
                short.setdefault(n, []).append(grams(self.symbols[ids], n))
        self.owners = {key: tuple(sorted(names)) for key, names in owners.items()}
        self.hashes = np.unique(np.concatenate(long_hashes)) if long_hashes else np.zeros(0, np.uint64)
        self.short = {n: np.unique(np.concatenate(h)) for n, h in short.items()}

    def find(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit spans [start, end) in words, names of the items that occur."""
        words = words_of(text)
        n, get = len(words), self.ids.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        symbols = self.symbols[ids]
        found: list[tuple[int, int]] = []
        if n >= self.span and len(self.hashes):
            w = self.span - self.k + 1
            h = grams(symbols, self.k)
            at = winnow(h, w)
            at = at[_among(h[at], self.hashes)]
            if len(at):
                s = np.unique(at[:, None] - np.arange(w))
                found += [(int(x), self.span) for x in s[(s >= 0) & (s <= n - self.span)]]
        for m, hashes in self.short.items():
            if n >= m:
                found += [(int(x), m) for x in np.flatnonzero(_among(grams(symbols, m), hashes))]
        raw, spans, names = ids.tobytes(), [], set()
        for s, m in sorted(found):
            owner = self.owners.get(raw[4 * s : 4 * (s + m)])
            if owner is not None:
                names.update(owner)
                spans.append((s, s + m))
        return n, merged(spans), names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


_MADE = ("n_words", "hit_spans", "items")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 5, block_bytes: int = 4_000_000, keep_text: bool = True) -> DataFrame:
    """docs with n_words long, hit_spans array<struct<start, end>> in words, items array<string>, sorted."""
    bounded_batches(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kept = docs.drop(*[c for c in docs.columns if c.lower() in _MADE or c.lower() == "__text" or not keep_text and c.lower() == "text"])
    names = [*kept.columns, "__text", *_MADE]
    empty = [F.lit(None).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("hit_spans"), F.array().cast("array<string>").alias("items")]
    out = docs.withColumn("__text", F.col("text").cast("binary")).select(*[F.col(f"`{c}`") for c in kept.columns], "__text", *empty)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).orderBy("item", "text").collect()
        shared = spark.sparkContext.broadcast(BenchmarkIndex([(r.item, r.text) for r in own], span, k))
        out = out.mapInArrow(_marker(shared, names), schema)
    return out.drop("__text")


def _marker(shared, names: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            c = b.num_columns - 4
            counts, spans, found = [], [], []
            for text, old_spans, old_items in zip(b.column(c), b.column(c + 2), b.column(c + 3)):
                n, hit, owners = index.find(text.as_py())
                if len(old_spans):
                    hit = merged(hit + [(x["start"], x["end"]) for x in old_spans.as_py()])
                if len(old_items):
                    owners = owners.union(old_items.as_py())
                counts.append(n)
                spans.append([{"start": s, "end": e} for s, e in hit])
                found.append(sorted(owners))
            made = [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(c + 1)], *made], names)

    return work


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """docs without those in which a window of the benchmark occurs; columns are those of docs."""
    return find_contamination(spark, docs.withColumn("__row", F.struct("*")).select("__row", "text"), benchmark, keep_text=False, **params).where(F.size("items") == 0).select("__row.*")
