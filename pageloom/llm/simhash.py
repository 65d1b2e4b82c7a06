"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distance.

Fingerprint. A-Z lower-cased, words are runs of bytes other than space and 0x09-0x0D, shingles of
``k`` words (repeats included) joined by a space; fewer words than ``k`` make one shingle, no word
makes fingerprint 0. A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42).

Links. Two fingerprints link at ``max_bits`` differing bits or fewer. The 64 bits are cut into
``max_bits + 2`` blocks or, for many fingerprints, more; a linked pair differs in at most ``max_bits`` of them, so all others are
equal, and each choice of that many blocks is a key: at 4 bits 15 keys of about 21 bits, or 35 of 27, or 70 of 32. Equal fingerprints are
one vertex before that. A bucket's rows never become all its pairs: a search by pivots
compares a fingerprint with those not yet reached only and returns one edge for each it reaches.
Buckets that a sample shows to hold over ``block_rows`` fingerprints are cut into blocks, and each pair of blocks is one unit.

Null or empty text: fingerprint 0, linked like any other. Null doc_id: takes part, is never a
component's name unless all of its component's ids are null. Repeated rows give repeated rows. Very long texts are read in parts of 65,536 shingles.
An empty table gives an empty table. Extra columns pass through ``simhash_near_dedup``, whatever their names, and are ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, components, fresh, stash

SEED = 42


def fingerprint(text: bytes | None, k: int = 4) -> int:
    """The unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    if n <= k:
        return xxh64_intdigest(joined, SEED)
    h = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, th1, th2, fp long) of each row; th: 128 bits that stand for doc_id and text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in b.column(3)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fp)], ["doc_id", "th1", "th2", "fp"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("doc_id").cast("long"), "text").alias("th1"),
        F.xxhash64(F.lit(1), F.col("doc_id").cast("long"), "text").alias("th2"),
        F.col("text").cast("binary").alias("text"),
    )
    return rows.mapInArrow(work, "doc_id long, th1 long, th2 long, fp long")


def blocks_for(n: int, max_bits: int, per_key: int = 64) -> int:
    """How many blocks n fingerprints take: at least two must agree, and more as n grows, so that a key of even fingerprints has about ``per_key`` of them."""
    blocks = max_bits + 2
    while blocks < 2 * max_bits and n >> (64 * (blocks - max_bits) // blocks) > per_key:
        blocks += 1
    return blocks


def block_masks(max_bits: int, blocks: int | None = None) -> list[int]:
    """Masks of every ``blocks - max_bits`` of the blocks, as signed longs; ``max_bits`` differing bits leave one of them untouched."""
    blocks = blocks or max_bits + 2
    cuts = np.linspace(0, 64, blocks + 1).round().astype(int)
    parts = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    both = [sum(some) for some in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in both]


def reach(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among uint64 fps.

    Returns index arrays (from, to). A popped pivot is compared with what is not yet reached.
    """
    src, dst = [], []
    rest = np.arange(len(fps))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]) <= max_bits
            if near.any():
                hit = rest[near]
                src.append(np.full(len(hit), x))
                dst.append(hit)
                queue.extend(hit)
                rest = rest[~near]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def link_edges(distinct: DataFrame, max_bits: int = 4, block_rows: int = 1 << 16, sample: int = 64, blocks: int | None = None) -> DataFrame:
    """distinct(fp) -> edges (a, b) whose components are those of all links."""
    masks = block_masks(max_bits, blocks)
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    keys = distinct.select("fp", slots.alias("s")).select("fp", "s.slot", "s.key")
    # Fixed by the fingerprint alone, so that all rows of a key see the same count.
    hot = (
        distinct.where(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0)
        .select("fp", slots.alias("s"))
        .groupBy("s.slot", "s.key")
        .count()
        .where(F.col("count") * sample > block_rows)
        .select("slot", "key", F.ceil(F.col("count") * sample / block_rows).cast("int").alias("nb"))
    )
    n = F.coalesce("nb", F.lit(1))
    units = keys.join(hot, ["slot", "key"], "left").select("fp", "slot", "key", n.alias("nb"), F.pmod(F.xxhash64(F.lit(2), "fp"), n).cast("int").alias("blk"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "fp", F.xxhash64("slot", "key", F.least("blk", "other"), F.greatest("blk", "other")).alias("unit")
    )
    # A unit's name is a hash: two units that share one are only compared needlessly.
    dealt = units.repartition("unit").sortWithinPartitions("unit")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(fp: np.ndarray, unit: np.ndarray) -> pa.RecordBatch:
            a, b = segments(fp.view(np.uint64), unit, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

        for x in batches:
            fp, unit = x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)
            if not len(fp):
                continue
            if unit[0] == unit[-1] and (not held or held[-1][1][-1] == unit[0]):
                held.append((fp, unit))
                continue
            cut = int(np.searchsorted(unit, unit[-1], side="left"))
            held.append((fp[:cut], unit[:cut]))
            yield flush(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held = [(fp[cut:], unit[cut:])]
        if held:
            yield flush(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))

    return dealt.mapInArrow(work, "a long, b long").distinct()


def segments(fps: np.ndarray, unit: np.ndarray, max_bits: int, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Edges within each run of equal units; runs of up to ``small`` are compared by lag, all at once."""
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[starts, len(unit)])
    size_of = np.repeat(sizes, sizes)
    src, dst = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    some = np.flatnonzero((size_of > 1) & (size_of <= small))
    f, u = fps[some], unit[some]
    for lag in range(1, int(min(small, sizes.max(initial=1)))):
        near = (u[lag:] == u[:-lag]) & (np.bitwise_count(f[lag:] ^ f[:-lag]) <= max_bits) if len(f) > lag else np.zeros(0, bool)
        i = np.flatnonzero(near)
        src.append(some[i])
        dst.append(some[i + lag])
    for s, n in zip(starts[sizes > small], sizes[sizes > small]):
        a, b = reach(fps[s : s + n], max_bits)
        src.append(a + s)
        dst.append(b + s)
    return np.concatenate(src), np.concatenate(dst)


def simhash_components(spark: SparkSession, docs: DataFrame, k: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, th1, th2, fp, root, component_id) for each row of docs; root names the component also where all its ids are null."""
    prints = stash(spark, fingerprints(docs, k), "prints")
    distinct = stash(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(spark, link_edges(distinct.select("fp"), max_bits, blocks=blocks_for(distinct.count(), max_bits)))
    named = distinct.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = stash(spark, named, "roots")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = stash(spark, named.join(least, "root").select("fp", "root", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", "th1", "th2", "fp", "root", "component_id")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, k: int = 5, max_bits: int = 4) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id (nulls last), then the smallest
    hash of the row. Rows equal in doc_id and text are one document. Columns are those of docs.
    """
    found = stash(spark, simhash_components(spark, docs, k, max_bits), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "th1", "th2")).alias("w")
    stay = found.groupBy("root").agg(first).select("w.th1", "w.th2")
    return one_row_each(docs, stash(spark, stay, "stay"))


def one_row_each(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """A row of docs for each (th1, th2) of stay; the join and the choice among repeated rows share one exchange."""
    a, b = fresh(docs.columns, "th1", "th2")
    doc = F.col("doc_id").cast("long")
    keyed = docs.withColumns({a: F.xxhash64(doc, "text"), b: F.xxhash64(F.lit(1), doc, "text")})
    kept = keyed.join(stay.select(F.col("th1").alias(a), F.col("th2").alias(b)), [a, b], "left_semi")
    return kept.dropDuplicates([a, b]).select(docs.columns)
