"""Mixing sources to target weights by the cube method.

Each source's target over its size says how often each of its documents is taken: a whole number of times, and once more with the fraction left as its inclusion
probability. The flight phase settles those: of any three open documents of one source there is a direction in which words and documents both keep their totals
(the null space of two constraints); probabilities move along it, one way or the other by a seeded draw that keeps each one's expectation, until one is 0 or 1. At most two documents of a
block stay open. Blocks of a source are settled side by side, and what they leave open is dealt into fewer blocks, until a source is one block: its last two are the landing,
settled so that the source's words come out nearest. A source's words thus miss the target by less than its two last documents' sizes.

Targets: ``share`` of all words, by the weights that repeat over the sources in code point order (null last); none is above ``most`` times its source's words, and what that takes off goes to the others by
weight. Null text has no words; documents without words take part in the balance of documents and bring none. Equal sizes, repeated rows and null doc_ids are settled like others; which of
several fully equal rows is taken is left open. Blocks are streamed and only three documents are in hand, so neither a hot source nor very long texts (only counted) fill a task. An empty table gives an empty table.
Columns named in ``keep`` are kept; ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sharding import _numbered, _starts
from .shared import Stash, stash

WORDS = r"[^\x20\x09-\x0D]+"
#: Source tables of up to this many rows are broadcast.
BROADCAST_SOURCES = 100_000
_NEAR = 1e-9


def targets(spark: SparkSession, sources: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(source, n, words) -> (no, source, n, words, target). The driver sees sums alone; each round settles all sources that are above their limit."""
    ordered = sources.repartitionByRange(F.asc_nulls_last("source")).sortWithinPartitions(F.asc_nulls_last("source"))
    ranked = _numbered(spark, ordered, "sources")
    starts = _starts(ranked.groupBy("pid").agg(F.count(F.lit(1)).alias("n")), ["pid"], [])
    no = F.col("start") + F.col("idx")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (no % len(weights)).cast("int"))
    table = stash(spark, ranked.join(starts, "pid").select(no.alias("no"), "source", "n", "words", weight.alias("weight")), "weights")
    total = table.agg(F.sum("words")).first()[0] or 0
    rate, limit = 0.0, F.col("words") * most
    while True:
        over = F.col("weight") * rate > limit
        full, free = table.agg(F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        new = (share * total - (full or 0.0)) / free if free else rate
        if new <= rate:
            break
        rate = new
    return table.select("no", "source", "n", "words", F.least(F.col("weight") * rate, limit).alias("target"))


def settle(units: list[list], rng: np.random.Generator) -> None:
    """Moves the probabilities of three units [size, probability, ...] so that sizes and number keep their totals and one is settled."""
    a, b, c = (u[0] for u in units)
    way = (c - b, a - c, b - a)
    if way == (0, 0, 0):
        way = (1, -1, 0)
    up = min((1 - u[1]) / d if d > 0 else u[1] / -d for u, d in zip(units, way) if d)
    down = min(u[1] / d if d > 0 else (1 - u[1]) / -d for u, d in zip(units, way) if d)
    step = up if rng.random() * (up + down) < down else -down
    for u, d in zip(units, way):
        p = u[1] + step * d
        u[1] = 0.0 if p < _NEAR else 1.0 if p > 1 - _NEAR else p


def land(units: list[list]) -> None:
    """Settles the last units so that their words, then their number, come nearest to what was expected."""
    choices = [[x >> i & 1 for i in range(len(units))] for x in range(1 << len(units))]
    off = lambda c: (abs(sum(u[0] * (x - u[1]) for u, x in zip(units, c))), abs(sum(x - u[1] for u, x in zip(units, c))), c)
    for u, x in zip(units, min(choices, key=off)):
        u[1] = float(x)


def _flight(level: int, seed: int):
    """Rows sorted by block, with no, block, last, size and p -> the same rows with p moved; at most two of a block are left open, none if it is the last."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[int, list] = {}  # batches of which a row is still open: p by row, and open rows
        held: list[list] = []  # [size, p, batch, row]
        now, rng, was_last = None, None, False

        def give_back(unit: list) -> None:
            rows = pending[unit[2]]
            rows[1][unit[3]] = unit[1]
            rows[2] -= 1

        def close(last: bool) -> None:
            if last:
                land(held)
            for u in held:
                give_back(u)
            held.clear()

        for number, batch in enumerate(batches):
            blocks = list(zip(batch["no"].to_pylist(), batch["block"].to_pylist()))
            last, size, p = batch["last"].to_pylist(), batch["size"].to_pylist(), batch["p"].to_pylist()
            pending[number] = [batch, p, len(p)]
            for row, block in enumerate(blocks):
                if block != now:
                    close(was_last)
                    now, was_last, rng = block, last[row], np.random.default_rng([seed, level, *block])
                held.append([size[row], p[row], number, row])
                while len(held) == 3:
                    settle(held, rng)
                    for u in [u for u in held if u[1] in (0.0, 1.0)]:
                        give_back(u)
                        held.remove(u)
            yield from _ready(pending)
        close(was_last)
        yield from _ready(pending)

    return work


def _ready(pending: dict[int, list]) -> Iterator[pa.RecordBatch]:
    for number in [k for k, v in pending.items() if not v[2]]:
        batch, p, _ = pending.pop(number)
        yield batch.set_column(batch.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def mix(
    spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, keep: tuple[str, ...] = ("doc_id",), size: Column | None = None, seed: int = 42, block_rows: int = 10_000
) -> DataFrame:
    """docs(source, text, ...) -> keep, size, source_size, target, copies, taken: how often each document goes into the mix, and the words of that.

    ``size`` stands for the number of words where given. Blocks have about ``block_rows`` documents, by a hash of seed, the kept columns and text, whatever the partitions.
    """
    taken_names = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in keep if c.lower() not in taken_names]
    words = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)) if size is None else size
    own = [F.col(f"`{c}`").alias(f"keep{i}") for i, c in enumerate(kept)]
    hashed = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in kept], "text")
    rows = stash(spark, docs.select(*own, "source", words.cast("long").alias("size"), hashed.alias("h")), "mixed")
    sources = targets(spark, rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), weights, share, most)
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    beside = sources.select("no", F.col("source").alias("named"), F.col("words").alias("source_size"), "target", F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0).alias("rate"))
    rows = rows.join(F.broadcast(beside) if few else beside, F.equal_null("source", "named")).drop("source", "named")
    whole = F.floor(F.col("rate") + _NEAR)
    rows = rows.withColumn("base", whole.cast("long")).withColumn("p", F.greatest(F.col("rate") - whole, F.lit(0.0))).withColumn("p", F.when(F.col("p") > _NEAR, F.col("p")).otherwise(0.0)).drop("rate")
    is_open = "p > 0 AND p < 1"
    level, done, left = 0, [rows.where(f"NOT ({is_open})")], rows.where(is_open)
    while True:
        counts = left.groupBy("no").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
        counts = F.broadcast(counts) if few else counts
        block = F.pmod(F.xxhash64("h", F.lit(level)), F.col("blocks"))
        dealt = left.join(counts, "no").withColumn("block", block).withColumn("last", F.col("blocks") == 1).drop("blocks")
        dealt = dealt.repartition("no", "block").sortWithinPartitions("no", "block", "h", "size")
        moved = Stash(spark, dealt.mapInArrow(_flight(level, seed), dealt.schema), "flight").df.drop("block", "last")
        done.append(moved.where(f"NOT ({is_open})"))
        left = moved.where(is_open)
        if left.limit(1).count() == 0:
            break
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("base") + F.col("p")).cast("long")
    return out.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(kept)], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
