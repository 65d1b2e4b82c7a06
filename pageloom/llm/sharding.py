"""Sharding by longest processing time: rows that must stay together go whole to the least-loaded shard.

Groups (equal texts) are sized, and taken from the largest to the smallest; each goes to the shard of least
load, the first of equals, from a heap. Groups of one size are alike, so the driver needs only the histogram of
group sizes: distinct sizes are at most the square root of twice all bytes, whatever the number of rows. A long run of equal
sizes is placed in one step, with the loads that the heap would leave. Executors then rank the groups within their
size, and number the rows within their shard.

Size of a row: UTF-8 bytes of the text plus 1; null text counts as no bytes and is a group of its own, apart from the empty text.
Groups are told apart by 128 bits of their text's hash. Repeated rows are rows of one group. Fewer groups than shards leave shards empty.
Null doc_ids are rows like any other. A very long text is one row of its size. An empty table gives an empty table. Extra columns are ignored.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stash


def place_run(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n groups of one size each shard gets; loads is brought up to date."""
    given = [0] * len(loads)

    def below(level: int) -> int:
        """Groups that start under this load."""
        return sum(max(0, -((x - level) // size)) for x in loads)

    if n > 4 * len(loads):
        low, high = min(loads), max(loads) + size * (n + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if below(mid) <= n else (low, mid)
        for i, x in enumerate(loads):
            given[i] = max(0, -((x - low) // size))
            loads[i] += given[i] * size
        n -= sum(given)
    heap = [(x, i) for i, x in enumerate(loads)]
    heapify(heap)
    for _ in range(n):
        x, i = heappop(heap)
        given[i] += 1
        loads[i] = x + size
        heappush(heap, (loads[i], i))
    return given


def place(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, list[int]]]:
    """[(size, groups)] -> [(size, groups of larger size, groups of this size in shards 0..i for each i)]."""
    loads, out, before = [0] * shards, [], 0
    for size, n in sorted(histogram, reverse=True):
        total, sums = 0, []
        for k in place_run(loads, size, n):
            total += k
            sums.append(total)
        out.append((size, before, sums))
        before += n
    return out


def _numbered(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """df, written, with ``pid`` and ``idx``: the partition, and the row's number in it."""
    at = F.monotonically_increasing_id()
    made = df.withColumn("__at", at).withColumns({"pid": F.shiftright("__at", 33).cast("int"), "idx": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    return stash(spark, made.drop("__at"), tag)


def _starts(counts: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """counts(keys, n) -> (keys, start): what the rows of earlier keys come to, within each of ``by``. One row for each partition (and shard)."""
    earlier = Window.partitionBy(*by).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))


def shard_by_size(spark: SparkSession, docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of docs."""
    raw = F.col("text").cast("binary")
    rows = stash(
        spark,
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            F.xxhash64("text").alias("g1"),
            F.xxhash64(F.lit(1), "text").alias("g2"),
        ),
        "rows",
    )
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("total"))
    dealt = groups.repartitionByRange(F.desc("total"), "g1", "g2").sortWithinPartitions(F.desc("total"), "g1", "g2")
    ranked = _numbered(spark, dealt, "groups")
    histogram = [(r["total"], r["count"]) for r in ranked.groupBy("total").count().collect()]
    plan = spark.createDataFrame(place(histogram, shards), "total long, before long, sums array<long>")
    rank = F.col("start") + F.col("idx") - F.col("before")
    parts = ranked.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    homes = ranked.join(_starts(parts, ["pid"], []), "pid").join(plan, "total").select("g1", "g2", F.size(F.filter("sums", lambda s: s <= rank)).alias("shard"))
    homes = stash(spark, homes, "homes")
    placed = _numbered(spark, rows.join(homes, ["g1", "g2"]).select("doc_id", "size", "text_crc32", "shard"), "placed")
    key = ["shard", "pid"]
    parts = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    own = F.row_number().over(Window.partitionBy(*key).orderBy("idx")) - 1  # a partition's rows of a shard, not a shard's
    return placed.withColumn("own", own).join(_starts(parts, key, ["shard"]), key).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("own")).alias("slot"))
