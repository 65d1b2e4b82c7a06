"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often each two ids do so in the corpus.

Workers cut and code texts by the two tokenizer libraries and, on the arrays of a block of documents, find their groups and links; counting ids over the corpus and all sums are Spark's. Coding works on units,
texts cut where white space follows another character. Neither vocabulary has a token across such a place - where the second has pieces with white space other than the space, texts that hold that are cut at
spaces alone - so a unit's tokens are those it has in the whole text. Workers keep the tokens of units seen up to a bound; memory does not grow with the corpus.

A byte offset where tokens of both end is in the intersection of the two arrays of ends. Unit ends are common ends, so groups, their text and their links are made once for each distinct unit of a block, and
documents are put together from units. A group's links are all its pairs of tokens. Groups of more than ``PLAIN_LINKS`` pairs (long runs in which the vocabularies never meet) are counted by distinct ids and their
numbers, not pair by pair; the sums are the same.

Null or empty text, and text whose tokens do not give back its bytes (in practice text with U+2581, which the second vocabulary reads as a space), has no tokens, groups or links.
Very long texts are coded whole, and very long units are coded and not kept. Repeated rows count as documents of their own. An empty table gives an empty table. Columns of docs are kept;
``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``aligned``, ``links`` and ``many_links`` replace columns of that name.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import _parts, _without
from .shared import Stash, bounded_batches, fresh

#: Groups of more pairs than this are counted by distinct ids.
PLAIN_LINKS = 256
#: So many units go to the first library as one text.
RUN = 64
#: Counts of this many id pairs, the most frequent, go to every task; the others are joined in.
BROADCAST_PAIRS = 200_000

_MADE = ("n_a", "n_b", "n_groups", "n_links", "aligned", "links", "many_links")


_UNIT = re.compile(r"\s*\S+|\s+").findall
_SPACED = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*(?:\s+\Z)?|\s+").findall


def byte_level_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on in their order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


#: What follows an id: another one of its side and group, the other side, the next group.
_MARKS = ",|;"


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts, starts + 1, ... of each run, one run after another."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Groups:
    """Groups of the distinct units of a block: ends of the units, and for each side the tokens' (ids, ends) from unit to unit, as ``Coder.code`` has them.

    ``n_groups``, ``n_plain`` and ``n_many`` are by unit; ``links`` (a << 32 | b) and ``many`` (pair, times) stand from unit to unit.
    """

    def __init__(self, stops: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int):
        common = np.intersect1d(a[1], b[1], assume_unique=True)
        self.ids = [x[0].astype(np.int64) for x in (a, b)]
        # Tokens of group g: from first[side][g] on, n[side][g] of them.
        last = [np.searchsorted(x[1], common) for x in (a, b)]
        self.n = [np.diff(x, prepend=-1) for x in last]
        self.first = [x - n + 1 for x, n in zip(last, self.n)]
        self.n_groups = np.diff(np.searchsorted(common, stops) + 1, prepend=0)
        unit = np.repeat(np.arange(len(stops)), self.n_groups)
        pairs = self.n[0] * self.n[1]
        large = np.flatnonzero(pairs > most)
        plain = np.where(pairs > most, 0, pairs)
        self.n_plain = np.bincount(unit, plain, len(stops)).astype(np.int64)
        within = _spread(np.zeros_like(plain), plain)
        n_b = np.repeat(self.n[1], plain)
        self.links = self.ids[0][np.repeat(self.first[0], plain) + within // n_b] << 32 | self.ids[1][np.repeat(self.first[1], plain) + within % n_b]
        found = [self._crossed(g) for g in large.tolist()]
        self.many = tuple(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in (0, 1))
        self.n_many = np.bincount(unit[large], [len(x[0]) for x in found], len(stops)).astype(np.int64)

    def _crossed(self, g: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of a group and how many times it has each."""
        (x, n), (y, m) = (np.unique(ids[f[g] : f[g] + n[g]], return_counts=True) for ids, f, n in zip(self.ids, self.first, self.n))
        return (x[:, None] << 32 | y).ravel(), (n[:, None] * m).ravel()

    def texts(self, names: list[str], n_ids: int) -> list[str]:
        """Each unit's groups as ``a1,a2|b1;``, by the names of ids with the marks after them."""
        (n_a, n_b), ends = self.n, np.cumsum(self.n[0] + self.n[1])
        which = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        which[_spread(ends - n_a - n_b, n_a)] = self.ids[0][_spread(self.first[0], n_a)]
        which[_spread(ends - n_b, n_b)] = self.ids[1][_spread(self.first[1], n_b)]
        which[ends - n_b - 1] += n_ids
        which[ends - 1] += 2 * n_ids
        parts = list(map(names.__getitem__, which.tolist()))
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(self.n_groups)])].tolist()
        return ["".join(parts[i:j]) for i, j in zip(cuts, cuts[1:])]


class Coder:
    """Codes texts by both vocabularies; keeps the tokens of units, those of one batch and about ``keep_tokens`` more."""

    def __init__(self, json: str, model: bytes, keep_tokens: int = 800_000, long_unit: int = 256):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        of = byte_level_bytes()
        a = {n: bytes(of[c] for c in t) for t, n in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        b = {n: bytes([int(t[3:5], 16)]) if self.b.is_byte(n) else t.replace("▁", " ").encode() for n, t in enumerate(pieces)}
        if any("▁" in t.lstrip("▁") for t in pieces):
            raise ValueError("a piece goes on across a space")
        self.bytes = a, b
        self.lengths = [np.array([len(t.get(n, b"")) for n in range(max(t) + 1)], np.int32) for t in (a, b)]
        # Each id's text in an alignment, with each of the marks that may follow it.
        self.n_ids = max(map(len, self.lengths))
        self.names = [f"{n}{mark}" for mark in _MARKS for n in range(self.n_ids)]
        # White space that stands in longer pieces, and what only this language counts as white space: units may not begin with it.
        bound = {c for t in pieces if len(t) > 1 and not t.startswith("<0x") for c in t if c.isspace()} | {*"\x1c\x1d\x1e\x1f"}
        self.odd = re.compile(f"[{re.escape(''.join(sorted(bound)))}]").search
        self.space = self.b.piece_to_id("▁")
        self.keep_tokens, self.long_unit = keep_tokens, long_unit
        self._clear()

    def _clear(self) -> None:
        none = np.zeros(0, np.int32)
        self.known: dict[str, int] = {}
        self.whole = none.astype(bool)  # of each unit, whether its tokens give its bytes
        self.size = none.astype(np.int64)
        self.counts = [none.astype(np.int64)] * 2
        self.ids, self.ends = [none] * 2, [none] * 2
        self.new: list[list[tuple[np.ndarray, ...]]] = [[], []]  # (ids, ends, counts), not yet in the arrays
        self.full = False

    def _pieces(self, units: list[str]) -> list[list[int]]:
        """The second side adds a space itself: it stands for the unit's own, or goes again."""
        found = self.b.encode([u[u[0] == " " :] for u in units], num_threads=1)
        return [f if u[0] != " " else f or [self.space] for u, f in zip(units, [f if u[0] == " " else f[1:] for u, f in zip(units, found)])]

    def _first(self, units: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of the first side. Units are coded in runs, as a call costs as much as a unit; no token crosses from one to the next where white space follows another character."""
        ends = [i + 1 for i, u in enumerate(units) if u[-1].isspace()]  # nothing may follow these
        cuts = sorted({0, len(units), *range(0, len(units), RUN), *ends})
        coded = self.a.encode_batch_fast(["".join(units[i:j]) for i, j in zip(cuts, cuts[1:])], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), np.int32)
        stops, of_unit = np.cumsum(self.lengths[0][ids], dtype=np.int64), np.cumsum(size)
        last = np.searchsorted(stops, of_unit, "right")
        if len(ids) and last[0] and last[-1] == len(ids) and (stops[last - 1] == of_unit).all():
            return np.diff(last, prepend=0), ids
        coded = self.a.encode_batch_fast(units, add_special_tokens=False)
        return np.fromiter(map(len, coded), np.int64, len(units)), np.fromiter(chain.from_iterable(e.ids for e in coded), np.int32)

    def _learn(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [u.encode() for u in units]
        size = np.array([len(r) for r in raw], np.int64)
        whole = np.ones(len(units), bool)
        # Ids go into arrays at once: lists of all units' ids would be looked through by the garbage collector again and again.
        self._add(0, raw, size, whole, *self._first(units, size))
        coded = self._pieces(units)
        self._add(1, raw, size, whole, np.fromiter(map(len, coded), np.int64, len(units)), np.fromiter(chain.from_iterable(coded), np.int32))
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units))))
        return whole, size

    def _add(self, side: int, raw: list[bytes], size: np.ndarray, whole: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """New units' tokens on one side; whole: less those whose tokens do not give their bytes."""
        stops = np.cumsum(self.lengths[side][ids], dtype=np.int64)
        last = np.cumsum(counts)
        before = np.concatenate([[0], stops])[last - counts]  # bytes of the units before
        table = self.bytes[side]
        said = b"".join(map(table.__getitem__, ids.tolist()))
        if said != b"".join(raw) or (np.concatenate([[0], stops])[last] - before != size).any():
            ends = np.concatenate([[0], stops])[last].tolist()
            whole &= [said[i:j] == r for i, j, r in zip(before.tolist(), ends, raw)]
        self.new[side].append((ids, (stops - np.repeat(before, counts)).astype(np.int32), counts))

    def code(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Numbers of the texts' units, how many each text has, ends of the distinct units, and for each side their tokens' (ids, ends), which go on from unit to unit, and the tokens of each text."""
        if self.full or sum(map(len, self.ids)) > self.keep_tokens:
            self._clear()
        units = [(_SPACED if self.odd(t) else _UNIT)(f" {t}") if t else [] for t in texts]
        new = list(set(chain.from_iterable(units)) - self.known.keys())
        learnt = [self._learn(new[i : i + 5000]) for i in range(0, len(new), 5000)]
        if new:
            for side, own in enumerate(self.new):
                self.ids[side], self.ends[side], self.counts[side] = (np.concatenate(x) for x in zip((self.ids[side], self.ends[side], self.counts[side]), *own))
                own.clear()
            self.whole, self.size = (np.concatenate(x) for x in zip((self.whole, self.size), *learnt))
            self.full = max(map(len, new)) > self.long_unit  # long units are not kept beyond this batch
        sizes = [len(u) for u in units]
        every = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, sum(sizes))
        if not self.whole[every].all():
            parts = np.split(every, np.cumsum(sizes)[:-1])
            parts = [x if self.whole[x].all() or self._gives_back(x, t) else x[:0] for x, t in zip(parts, texts)]
            every, sizes = np.concatenate(parts), [len(x) for x in parts]
        own, numbers = np.unique(every, return_inverse=True)
        of_text = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        stops, sides = np.cumsum(self.size[own]), []
        for ids, ends, counts in zip(self.ids, self.ends, self.counts):
            starts, n = np.cumsum(counts) - counts, counts[own]
            spot = np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            sides.append((ids[spot], ends[spot] + np.repeat(stops - self.size[own], n).astype(np.int32), np.diff(np.concatenate([[0], np.cumsum(counts[every])])[of_text])))
        return numbers.astype(np.int32), np.array(sizes, np.int32), stops.astype(np.int32), sides

    def _gives_back(self, units: np.ndarray, text: str) -> bool:
        """For texts with a unit that does not: whether the tokens of all together do."""
        raw = f" {text}".encode()
        starts = [np.cumsum(c) - c for c in self.counts]
        tokens = lambda side: (n for u in units for n in self.ids[side][starts[side][u] :][: self.counts[side][u]].tolist())
        return all(b"".join(map(self.bytes[side].__getitem__, tokens(side))) == raw for side in (0, 1))


#: A worker process keeps its coder from one task to the next.
_coders: dict[str, Coder] = {}


def _coder(digest: str, files) -> Coder:
    """Of this module, not of a task's function, which has globals of its own."""
    if digest not in _coders:
        _coders.clear()
        _coders[digest] = Coder(*files.value)
    return _coders[digest]


def _listed(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _of_texts(by_unit: np.ndarray, of_text: np.ndarray) -> np.ndarray:
    """Sums of what the units of each text have."""
    return np.diff(np.concatenate([[0], np.cumsum(by_unit)])[of_text])


def align(spark: SparkSession, docs: DataFrame, json_path: str, model_path: str, finish=lambda aligned: aligned, block_bytes: int = 1_000_000) -> DataFrame:
    """docs with n_a, n_b, n_groups, n_links (long), aligned, links and many_links.

    ``aligned`` has the ids between neighbouring common ends, as ``a1,a2|b1;a3|b2,b3``, or what ``finish`` makes of that, a digest say; ``groups_of`` reads it. ``links`` array<long> has an entry
    a << 32 | b for each link, ``many_links`` array<struct<pair long, times long>> those of large groups. a is the byte-level vocabulary of a tokenizers file, on the text after one space; b the
    pieces of a sentencepiece model, which adds that space itself. The vocabulary files are read on the driver and sent out; their size is independent of the corpus.
    """
    bounded_batches(spark, rows=2000)
    with open(json_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        files = f.read(), g.read()
    digest = hashlib.sha256(files[0].encode() + files[1]).hexdigest()
    shared, most = spark.sparkContext.broadcast(files), PLAIN_LINKS
    kept = _without(docs, *_MADE)
    raw = fresh(kept.columns, "raw")[0]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept.columns], F.col("text").cast("binary").alias(raw))
    made = "n_a long, n_b long, n_groups long, n_links long, aligned string, links array<long>, many_links array<struct<pair: long, times: long>>"
    names = [*kept.columns, *_MADE]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], made])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(digest, shared)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for i, j in _parts(sizes, block_bytes):
                numbers, counts, stops, (left, right) = coder.code([(x.as_py() or b"").decode("utf-8", "replace") for x in texts.slice(i, j - i)])
                found = Groups(stops, left[:2], right[:2], most)
                of_text = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
                # Links and texts of the units, put together to those of the documents.
                plain, large = (_spread((np.cumsum(n) - n)[numbers], n[numbers]) for n in (found.n_plain, found.n_many))
                n_plain, n_many = (_of_texts(n[numbers], of_text) for n in (found.n_plain, found.n_many))
                pairs, times = (x[large] for x in found.many)
                n_links = n_plain + np.diff(np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], np.cumsum(n_many)])])
                by_unit = found.texts(coder.names, coder.n_ids)
                own, cuts = list(map(by_unit.__getitem__, numbers.tolist())), of_text.tolist()
                aligned = ["".join(own[s:e])[:-1] for s, e in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(c).slice(i, j - i) for c in range(b.num_columns - 1)], *[pa.array(x, pa.int64()) for x in (left[2], right[2], _of_texts(found.n_groups[numbers], of_text), n_links)],
                        pa.array(aligned, pa.string()), _listed(pa.array(found.links[plain]), n_plain),
                        _listed(pa.StructArray.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "times"]), n_many),
                    ],
                    names,
                )

    out = rows.mapInArrow(work, schema)
    return out.withColumn("aligned", finish(F.col("aligned")))


def groups_of(aligned: Column) -> Column:
    """array<struct<a array<int>, b array<int>>> of an alignment's text."""
    ids = lambda x, i: F.split(F.get(F.split(x, r"\|"), F.lit(i)), ",").cast("array<int>")
    return F.when(aligned == "", F.array().cast("array<struct<a: array<int>, b: array<int>>>")).otherwise(F.transform(F.split(aligned, ";"), lambda x: F.struct(ids(x, 0).alias("a"), ids(x, 1).alias("b"))))


def pair_counts(spark: SparkSession, rows: DataFrame) -> Stash:
    """(pair, docs, best): in how many rows each pair of ids is linked, and whether no other pair of its a is in more. Written: it is read three times.

    Pairs are distinct within a row's array before they are counted. A window holds the pairs of one id, at most as many as the other vocabulary has.
    """
    counts = rows.select(F.explode(F.array_distinct(F.concat("links", "many_links.pair"))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return Stash(spark, counts.withColumn("best", F.col("docs") == most), "pairs")


def link_sums(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """(key, n_best, count_sum) of each row (key, links, many_links) that has a link: links whose count is the highest of their a, and the counts' sum."""
    counts = pair_counts(spark, rows).df
    top = Stash(spark, counts.orderBy(F.desc("docs"), "pair").limit(BROADCAST_PAIRS), "top").df
    links = rows.select(key, F.explode("links").alias("pair")).withColumn("times", F.lit(1).cast("long"))
    links = links.unionByName(rows.where(F.size("many_links") > 0).select(key, F.inline("many_links")))
    sums = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum")
    frequent = links.join(F.broadcast(top), "pair").groupBy(key).agg(*sums)
    rest = links.join(F.broadcast(top.select("pair")), "pair", "left_anti").join(counts, "pair").groupBy(key).agg(*sums)
    return frequent.unionByName(rest).groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def with_link_sums(spark: SparkSession, aligned: DataFrame) -> DataFrame:
    """aligned without links and many_links, with n_best and count_sum (long). Written first, so that texts are coded once."""
    row = fresh(aligned.columns, "row")[0]
    rows = Stash(spark, aligned.withColumn(row, F.monotonically_increasing_id()), "links").df
    sums = link_sums(spark, rows, row)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.drop("links", "many_links").join(sums, row, "left").select(*[F.col(f"`{c}`") for c in aligned.columns if c not in ("links", "many_links")], zero("n_best"), zero("count_sum"))
