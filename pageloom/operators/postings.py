"""A stored BM25 index: postings by term in blocks with score bounds, in segments that are added to, emptied of chunks, and merged.

Under the index's path:

- ``versions/v=N``: a row for each segment of version N (its folder, live chunks and tokens, folders of deletions). A version that is written is the index; one that is not
  is nothing, and of two writers of one version the second fails. Segments are never changed, so a reader keeps its version.
- ``SEGMENT/rows`` (key, shard, pos, dl, terms, chunk): where a chunk stands, its terms, and what it has itself. ``SEGMENT/terms`` (term, df).
- ``SEGMENT/postings/part=P``: a row for each term and shard of 128 neighbouring chunks, (term, shard, n, max_tf, min_dl, entries); an entry is tf, dl and the place in the shard in one number.
  They are made where the chunks are, and only they are shuffled: dealt to parts by ranges of (term, shard), which splits frequent terms, and sorted; ``SEGMENT/parts`` says from which term to
  which each part goes.
- ``SEGMENT/dead-N/keys`` (key, shard, pos) and ``/terms``: chunks that version N takes out, and the document frequencies that go with them.

A search reads the parts, row groups and pages of the asked terms. Score bounds of a shard come from the blocks' greatest tf and least dl, so they hold whatever the mean length becomes.
The best-bounded shards of each query are scored first; their k-th score leaves out every shard whose bound is below. The blocks of a shard that is left come together, so that its scores
are summed in one task, and only those that reach the k-th leave it. The result is that of scoring all chunks.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.store import exists, folders, stash

from . import lexical

SHARD_BITS = 7
#: Rows up to which a side is broadcast; counted before.
BROADCAST_ROWS = 500_000
#: Asked terms up to which parts are picked on the driver, and up to which the scan itself gets the terms.
PICK_TERMS, PUSH_TERMS = 100_000, 500
#: Shards that are scored before the others are bounded.
FIRST_SHARDS = 4
#: Pairs of query and chunk that a task sums at most.
TASK_PAIRS = 1 << 19
#: Shards whose lists of chunks taken out are broadcast.
BROADCAST_SHARDS = 30_000
_SLACK = 1e-6  # scores are rounded to as many digits
# An entry: 32 bits of dl, 16 of tf, 15 of the place in the shard.
_TF, _DL = 15, 31


@dataclass(frozen=True)
class Segment:
    name: str
    n: int
    tokens: int
    dead: tuple[str, ...] = ()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few enough rows, or eight times as many that are but an integer key; else joined by a shuffle of what it meets."""
    most = BROADCAST_ROWS * (8 if [t for _, t in df.dtypes] in (["bigint"], ["int"]) else 1)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _made(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Blocks of whole shards, sorted by term and shard."""
    lists = pa.concat_arrays(rows["terms"].chunks)
    found = lists.flatten()
    if not len(found):
        return
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = found.field("term").dictionary_encode()
    by_term = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(by_term), np.int64)
    rank[by_term.to_numpy()] = np.arange(len(by_term))
    shards, number = np.unique(rows["shard"].to_numpy(), return_inverse=True)
    place = rank[coded.indices.to_numpy()] * len(shards) + number[owner]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    tf, dl = found.field("tf").to_numpy()[order].astype(np.int64), rows["dl"].to_numpy().astype(np.int64)[owner]
    entries = tf << _TF | dl << _DL | rows["pos"].to_numpy()[owner]
    out = pa.RecordBatch.from_arrays([
        coded.dictionary.take(by_term).take(pa.array(place[first] // len(shards))), pa.array(shards[place[first] % len(shards)]),
        pa.array(np.maximum.reduceat(tf, first).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.r_[first, len(place)].astype(np.int32)), pa.array(entries)),
    ], ["term", "shard", "max_tf", "entries"])
    for i in range(0, len(out), 10_000):
        yield out.slice(i, 10_000)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows (shard, pos, dl, terms); a batch's last shard waits for its other rows."""
    kept = None
    for batch in batches:
        if not len(batch):
            continue
        rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        shard = rows["shard"].to_numpy()
        others = np.flatnonzero(shard != shard[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield from _made(rows.slice(0, cut))
        kept = rows.slice(cut)
    if kept is not None:
        yield from _made(kept)


@dataclass
class StoredIndex:
    spark: SparkSession
    path: str
    key: str
    version: int
    segments: list[Segment]
    _parts: dict[str, list] = field(default_factory=dict)

    # Making and opening.

    @classmethod
    def create(cls, path: str, chunks: DataFrame, key: str = "chunk_id") -> StoredIndex:
        """An index of chunks(key, text, ...) where there is none yet."""
        spark = chunks.sparkSession
        if exists(spark, f"{path}/versions"):
            raise FileExistsError(f"there is an index at {path}")
        return cls(spark, path, key, 0, [])._with(chunks)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredIndex:
        """The latest version at path."""
        found = [int(n[2:]) for n in folders(spark, f"{path}/versions") if n.startswith("v=") and exists(spark, f"{path}/versions/{n}/_SUCCESS")]
        if not found:
            raise FileNotFoundError(f"no index at {path}")
        rows = spark.read.parquet(f"{path}/versions/v={max(found)}").collect()
        return cls(spark, path, rows[0]["key"], max(found), [Segment(r["name"], r["n"], r["tokens"], tuple(r["dead"])) for r in rows if r["name"]])

    def _publish(self, segments: list[Segment]) -> StoredIndex:
        segments = [s for s in segments if s.n]
        rows = [(s.name, s.n, s.tokens, [*s.dead], self.key) for s in segments] or [("", 0, 0, [], self.key)]
        made = self.spark.createDataFrame(rows, "name string, n long, tokens long, dead array<string>, key string").coalesce(1)
        made.write.parquet(f"{self.path}/versions/v={self.version + 1}")
        return replace(self, version=self.version + 1, segments=segments)

    def _read(self, segment: Segment, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{segment.name}/{table}")

    def _segment(self, rows: DataFrame) -> Segment:
        """A new segment from rows(key, dl, terms, chunk)."""
        name = f"s{self.version + 1}-{uuid.uuid4().hex[:8]}"
        own = f"{self.path}/{name}"
        # Numbered once and written, so that every later reading has the same shards: neighbours in the input share one.
        numbered = rows.withColumn("id", F.monotonically_increasing_id())
        numbered = numbered.select(self.key, F.shiftright("id", SHARD_BITS).alias("shard"), F.col("id").bitwiseAND((1 << SHARD_BITS) - 1).cast("int").alias("pos"), "dl", "terms", "chunk")
        numbered.write.option("compression", "zstd").parquet(f"{own}/rows")
        rows = self.spark.read.parquet(f"{own}/rows")
        blocks = rows.select("shard", "pos", "dl", "terms").mapInArrow(_grouped, "term string, shard long, max_tf int, entries array<long>")
        # What the entries tell is added after the shuffle.
        dealt, least = blocks.repartitionByRange("term", "shard"), F.shiftright(F.array_min("entries"), _DL).cast("int")
        placed = dealt.select("term", "shard", F.size("entries").cast("long").alias("n"), "max_tf", least.alias("min_dl"), "entries", F.spark_partition_id().alias("part")).sortWithinPartitions("part", "term", "shard")
        small = placed.write.partitionBy("part").option("compression", "zstd").option("parquet.page.row.count.limit", "512").option("parquet.block.size", str(16 << 20))
        small.parquet(f"{own}/postings")
        blocks = self.spark.read.schema(placed.schema).parquet(f"{own}/postings")
        ranges = blocks.groupBy("part").agg(F.min("term").alias("first"), F.max("term").alias("last"), F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("postings"))
        ranges.coalesce(1).write.parquet(f"{own}/parts")
        blocks.groupBy("term").agg(F.sum("n").alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.option("compression", "zstd").parquet(f"{own}/terms")
        n, tokens = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return Segment(name, n, tokens)

    def _new(self, chunks: DataFrame) -> Segment:
        known = self._read(self.segments[0], "rows").schema["chunk"].dataType.names if self.segments else []
        columns = known if {*known} == {*chunks.columns} else chunks.columns
        return self._segment(lexical.term_counts(chunks, self.key, F.struct(*columns)).withColumnRenamed("beside0", "chunk"))

    def _with(self, chunks: DataFrame) -> StoredIndex:
        return self._publish([*self.segments, self._new(chunks)])

    # What is in it.

    def _standing(self, rows: DataFrame, places: DataFrame, inside: bool) -> DataFrame:
        """Those of a segment's rows that stand, or do not stand, at places(shard, pos): rows meet one list a shard and stay where they are."""
        lists = places.groupBy("shard").agg(F.collect_list("pos").alias("places"))
        lists = F.broadcast(lists) if lists.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS else lists
        at = F.coalesce(F.array_contains("places", F.col("pos")), F.lit(False))
        return rows.join(lists, "shard", "inner" if inside else "left").where(at if inside else ~at).select(rows.columns)

    def _rows(self, segment: Segment, *columns: str) -> DataFrame:
        """A segment's rows without the chunks that were taken out."""
        rows = self._read(segment, "rows").select(*dict.fromkeys(["shard", "pos", *(columns or (self.key, "dl", "terms", "chunk"))]))
        return self._standing(rows, _union([self._read(segment, f"{d}/keys") for d in segment.dead]).select("shard", "pos"), False) if segment.dead else rows

    def _live(self, *columns: str) -> DataFrame:
        """The same of all segments, one at least."""
        return _union([self._rows(s, *columns).select(*columns) for s in self.segments])

    @property
    def chunks(self) -> DataFrame:
        return _union([self._rows(s, "chunk").select("chunk.*") for s in self.segments])

    @property
    def forward(self) -> DataFrame:
        return self._live(self.key, "dl", "terms")

    @property
    def n(self) -> int:
        return sum(s.n for s in self.segments)

    @property
    def avgdl(self) -> float:
        return sum(s.tokens for s in self.segments) / max(1, self.n)

    def terms(self, asked: DataFrame | None = None) -> DataFrame:
        """(term, df) of live chunks, of the asked(term) if given: frequencies of all segments less those of chunks taken out."""
        parts = []
        for s in self.segments:
            for table, sign in [("terms", 1), *[(f"{d}/terms", -1) for d in s.dead]]:
                rows = self._read(s, table).select("term", (F.col("df") * sign).alias("df"))
                parts.append(rows if asked is None else rows.join(small(asked.select("term").distinct()), "term", "left_semi"))
        return _union(parts).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    # Changing it. Each gives the next version; this one stays readable.

    def extended(self, chunks: DataFrame) -> StoredIndex:
        """With the chunks whose key it does not have yet; only those are read into tokens."""
        return self._with(chunks.join(small(self._live(self.key)), self.key, "left_anti").select(chunks.columns) if self.segments else chunks)

    def _emptied(self, keys: DataFrame) -> list[Segment]:
        out, keys = [], small(keys.select(self.key).distinct())
        for s in self.segments:
            gone = stash(self.spark, self._rows(s, self.key, "dl").join(keys, self.key, "left_semi"), "gone")
            n, tokens = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
            if n:
                name = f"dead-{self.version + 1}-{uuid.uuid4().hex[:8]}"
                gone.select(self.key, "shard", "pos").write.parquet(f"{self.path}/{s.name}/{name}/keys")
                terms = self._standing(self._read(s, "rows").select("shard", "pos", "terms"), gone.select("shard", "pos"), True)
                terms.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.option("compression", "zstd").parquet(f"{self.path}/{s.name}/{name}/terms")
                s = replace(s, n=s.n - n, tokens=s.tokens - tokens, dead=(*s.dead, name))
            out.append(s)
        return out

    def without(self, keys: DataFrame) -> StoredIndex:
        """Without the chunks of keys(key); unknown keys are ignored. Reads where they stand and the terms of those that go, writes what went."""
        return self._publish(self._emptied(keys))

    def replaced(self, chunks: DataFrame) -> StoredIndex:
        """With these chunks in place of those of the same keys, in one version."""
        new = self._new(chunks)  # written first: the keys that go are those that came
        return self._publish([*self._emptied(self._read(new, "rows").select(self.key)), new])

    def compacted(self) -> StoredIndex:
        """One segment of what is live, without reading texts into tokens again."""
        return self._publish([self._segment(_union([self._rows(s).drop("shard", "pos") for s in self.segments]))] if self.segments else [])

    def subset(self, path: str, keep: DataFrame, by: str | None = None) -> StoredIndex:
        """A new index at path of the chunks whose ``by`` (the key, or another column such as doc_name) is in keep; no text is read into tokens."""
        if exists(self.spark, f"{path}/versions"):
            raise FileExistsError(f"there is an index at {path}")
        by, made = by or self.key, StoredIndex(self.spark, path, self.key, 0, [])
        if not self.segments:
            return made._publish([])
        keep, parts = stash(self.spark, keep.select(F.col(by).alias("wanted")).distinct(), "keep"), []
        for s in self.segments:
            places = self._rows(s, "chunk").select("shard", "pos", F.col("chunk")[by].alias("wanted")).join(small(keep), "wanted", "left_semi")
            parts.append(self._standing(self._rows(s), stash(self.spark, places.select("shard", "pos"), "places"), True).drop("shard", "pos"))
        return made._publish([made._segment(_union(parts))])

    # Searching.

    def _blocks(self, segment: Segment, asked: list[str] | None) -> DataFrame:
        """A segment's blocks, as few as the asked terms allow."""
        schema = "term string, shard long, n long, max_tf int, min_dl int, entries array<long>, part int"
        blocks = self.spark.read.schema(schema).parquet(f"{self.path}/{segment.name}/postings")  # no file where no chunk has a token
        if asked is None:
            return blocks
        if segment.name not in self._parts:
            self._parts[segment.name] = [tuple(r) for r in self._read(segment, "parts").select("part", "first", "last").collect()]
        wanted = [p for p, first, last in self._parts[segment.name] if (i := bisect_left(asked, first)) < len(asked) and asked[i] <= last]
        blocks = blocks.where(F.col("part").isin(wanted))
        if len(asked) <= PUSH_TERMS:
            # Few values at a time: longer lists reach the scan as one range.
            blocks = blocks.where(reduce(Column.__or__, [F.col("term").isin(asked[i : i + 10]) for i in range(0, len(asked), 10)] or [F.lit(False)]))
        return blocks

    def blocks(self, asked: list[str] | None = None) -> DataFrame:
        """(segment, term, shard, n, max_tf, min_dl, entries) of the asked terms, a sorted list, or of all."""
        return _union([self._blocks(s, asked).drop("part").withColumn("segment", F.lit(i)) for i, s in enumerate(self.segments)])

    def _part_score(self, tf: str, dl: str) -> Column:
        return F.col("idf") * F.col(tf) * (lexical.K1 + 1) / (F.col(tf) + lexical.K1 * (1 - lexical.B + lexical.B * F.col(dl) / F.lit(self.avgdl)))

    def top_k(self, queries: DataFrame, k: int = 10, query_key: str = "query_id") -> DataFrame:
        """(query, key, score, rank): the k best live chunks of each query, ties by key, as ``lexical.top_k`` has them."""
        q, spark = query_key, self.spark
        asked = stash(spark, lexical.query_terms(queries, q), "asked")
        if not self.n:
            return lexical.top_k(asked.select(q, F.lit(None).cast("string").alias(self.key), F.lit(0.0).alias("score")), k, q, self.key)
        names = asked.select("term").distinct().limit(PICK_TERMS + 1).collect()
        picked = sorted(r["term"] for r in names) if len(names) <= PICK_TERMS else None
        idf = lexical.term_stats(self.terms(asked), spark.createDataFrame([(self.n,)], "n long"))
        weights = small(stash(spark, asked.join(idf.select("term", "idf"), "term"), "weights"))
        blocks = self.blocks(picked)
        shard, place = [q, "segment", "shard"], ["segment", "shard", "pos"]
        weighed = blocks.join(weights, "term")
        bounds = stash(spark, weighed.groupBy(*shard).agg(F.sum(self._part_score("max_tf", "min_dl")).alias("bound")), "bounds")
        keys = _union([self._rows(s, self.key).withColumn("segment", F.lit(i)) for i, s in enumerate(self.segments)])

        def summed(found: DataFrame, *by: str) -> DataFrame:
            """Scores by where the chunks stand; found may be dealt by more columns that go with the place."""
            entries = found.select(*by, *shard, "idf", F.explode("entries").alias("e"))
            entries = entries.select(*by, *shard, "idf", F.col("e").bitwiseAND((1 << _TF) - 1).alias("pos"), F.shiftright("e", _TF).bitwiseAND((1 << _DL - _TF) - 1).alias("tf"), F.shiftright("e", _DL).alias("dl"))
            return entries.groupBy(*by, *place, q).agg(F.sum(self._part_score("tf", "dl")).alias("score")).select(*place, q, "score")

        def named(sums: DataFrame, tag: str) -> DataFrame:
            """The k best live ones; keys are read where they stand."""
            found = small(stash(spark, sums, tag))
            return lexical.top_k(keys.join(found, place).select(q, self.key, "score"), k, q, self.key).drop("rank")

        order = Window.partitionBy(q).orderBy(F.desc("bound"), "segment", "shard")
        first = stash(spark, bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST_SHARDS), "first")
        best = stash(spark, named(summed(weighed.join(small(first.select(*shard)), shard)), "sums"), "best")
        least = best.groupBy(q).agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("m")).where(F.col("m") == k).select(q, "least")
        reaches = lambda score: F.col("least").isNull() | (F.col(score) >= F.col("least") - _SLACK)
        open_ = stash(spark, bounds.join(small(least), q, "left").where(reaches("bound")).join(small(first.select(*shard)), shard, "left_anti"), "open")
        # One row a shard with the queries that it is open to; blocks go to their shard's task once, whatever number of queries asks for them.
        tasks = max(1, -(-(open_.count() << SHARD_BITS) // TASK_PAIRS))
        # One number for both: a segment that is the only one is a constant, by which nothing is known to be dealt.
        at = (F.col("shard") * len(self.segments) + F.col("segment")).alias("at")
        by_shard = open_.select(at, q).repartition(tasks, "at").groupBy("at").agg(F.collect_list(q).alias("open"))
        met = blocks.select(at, "segment", "shard", "term", "entries").repartition(tasks, "at").join(by_shard.hint("shuffle_hash"), "at")
        rest = summed(met.join(weights, "term").where(F.array_contains("open", F.col(q))), "at").join(small(least), q, "left").where(reaches("score")).drop("least")
        return lexical.top_k(best.unionByName(named(rest, "sums")), k, q, self.key)
