"""Byte-level BPE by ranks: merges replayed over a block of words, and decoding.

``replay`` holds every distinct new word of a block as one linked row of tokens, with an inverted
index from the rank of a mergeable pair to the positions where it stands. It takes the least rank that waits, merges
at its positions from left to right, and looks again only at the two neighbours of each merge. Where a merge
makes a pair of a lower rank, the rest of that word waits until that pair is done, so each word sees
its merges in the order that an encoder of single words would take. A word that is itself a token stays whole.

Words repeat, so a worker keeps about ``cache_words`` of them encoded, those lately in use and of up to ``LONG_WORD`` characters;
memory does not grow with the corpus, nor with long words beyond those of the texts in hand. No shuffle: documents are independent.

Very long words and texts are encoded whole; repeated rows are rows like others, and an empty table gives an empty table. Null or empty text gives an empty list of ids, and decodes to no bytes. Bytes that are not UTF-8
are read as U+FFFD. All rows and columns are kept; ``ids`` and ``decoded`` replace columns of that name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches

#: Code points (hexadecimal, ranges inclusive) that the ``regex`` library already counts as letters or
#: numbers and the tokenizer library does not yet, as they came with later editions of Unicode.
LATER = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959
10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6
187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81
1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e
2cea2-2cead 323b0-33479 3d000-3fc3f
"""

#: Words replayed together, and their characters; more of them no longer fit in a core's cache.
BLOCK_WORDS, BLOCK_CHARS = 1000, 200_000
#: Longer words are replayed each time and not kept, so that the cache is bounded in bytes, too.
LONG_WORD = 256

#: The pattern that most byte-level vocabularies share, and what it says of texts that hold only ``PLAIN`` characters,
#: for Python's own, faster matcher.
SHARED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+"
NOT_PLAIN = r"[^\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ]"


def splitter(pattern: str):
    """A function that cuts a text as the tokenizer library cuts it: ``LATER`` are neither letters nor numbers."""
    import regex

    spans = [[chr(int(c, 16)) for c in x.split("-")] for x in LATER.split()]
    later = regex.compile("[" + "".join(f"{a[0]}-{a[-1]}" for a in spans) + "]")
    cut = regex.compile(pattern)
    odd = re.compile(NOT_PLAIN if pattern == SHARED_PATTERN else "").search
    plain = re.compile(PLAIN_PATTERN).findall

    def split(text: str) -> list[str]:
        if not odd(text):
            return plain(text)
        if text.isascii() or not later.search(text):
            return cut.findall(text)
        # A private-use character is neither letter, number nor space, and as long.
        return [text[m.start() : m.end()] for m in cut.finditer(later.sub("\ue000", text))]

    return split


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a .tiktoken file, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class Vocabulary(dict):
    """Ranks by token; ``pairs`` has the rank of each two tokens that together are one. All 256 bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(ranks)
        self.pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.byte_ids = np.array([ranks[bytes([c])] for c in range(256)], np.int64)
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)


def replay(words: Iterable[bytes], ranks: Vocabulary) -> list[bytes]:
    """The ids of each word, as the bytes of int32 numbers."""
    out = [b"" if n is None else array("i", (n,)).tobytes() for n in map(ranks.get, words)]
    todo = [n for n, w in enumerate(words) if not out[n] and w]
    if not todo:
        return out
    raw = np.frombuffer(b"".join([words[n] for n in todo]), np.uint8)
    sizes = np.array([len(words[n]) for n in todo])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word_of = np.repeat(np.arange(len(todo)), sizes).tolist()
    after, before = np.arange(1, len(raw) + 1), np.arange(-1, len(raw) - 1)
    after[ends - 1] = -1
    before[starts] = -1
    pair = np.full(len(raw), -1)
    pair[:-1] = ranks.byte_pairs[raw[:-1].astype(np.int64) * 256 + raw[1:]]
    pair[ends - 1] = -1
    spots = np.flatnonzero(pair >= 0)
    spots = spots[np.argsort(pair[spots], kind="stable")]
    waiting, at = np.unique(pair[spots], return_index=True)
    waiting = waiting.tolist()  # sorted, so a heap
    at, spots = at.tolist(), spots.tolist()
    index = {r: spots[i:j] for r, i, j in zip(waiting, at, [*at[1:], len(spots)])}
    ids, nxt, prv, now = ranks.byte_ids[raw].tolist(), after.tolist(), before.tolist(), pair.tolist()
    of = ranks.pairs.get
    while waiting:
        r = heappop(waiting)
        held, again = -1, []
        for p in sorted(index.pop(r)):
            if now[p] != r:  # merged meanwhile
                continue
            if word_of[p] == held:
                again.append(p)
                continue
            j = nxt[p]
            ids[p] = r
            ids[j] = now[j] = -1
            k = nxt[p] = nxt[j]
            if k >= 0:
                prv[k] = p
                new = now[p] = of(r << 32 | ids[k], -1)
                if new >= 0:
                    if new in index:
                        index[new].append(p)
                    else:
                        index[new] = [p]
                        heappush(waiting, new)
                    if new < r:
                        held = word_of[p]
            else:
                now[p] = -1
            x = prv[p]
            if x >= 0:
                new = now[x] = of(ids[x] << 32 | r, -1)
                if new >= 0:
                    if new in index:
                        index[new].append(x)
                    else:
                        index[new] = [x]
                        heappush(waiting, new)
                    if new < r:
                        held = word_of[p]
        if again:
            if r in index:
                index[r] += again
            else:
                index[r] = again
                heappush(waiting, r)
    last = np.array(ids)
    alive = last >= 0
    packed = last[alive].astype(np.int32).tobytes()
    stop = (4 * np.cumsum(np.add.reduceat(alive, starts, dtype=np.int64))).tolist()
    for n, s, e in zip(todo, [0, *stop], stop):
        out[n] = packed[s:e]
    return out


class Encoder:
    """Encodes texts; keeps the ids of words seen, each as the bytes of its int32 ids.

    Words in use move to the young half of the cache; what was not used while that filled up is dropped.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_words: int = 300_000):
        self.ranks, self.split, self.limit = Vocabulary(ranks), splitter(pattern), cache_words // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; their new words are replayed in blocks."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        pieces = [self.split(t) for t in texts]
        new = []
        for w in set(chain.from_iterable(pieces)) - self.young.keys():
            got = self.old.get(w)
            if got is None:
                new.append(w)
            else:
                self.young[w] = got
        for i, j in _parts([max(len(w), BLOCK_CHARS // BLOCK_WORDS) for w in new], BLOCK_CHARS):
            some = new[i:j]
            self.young.update(zip(some, replay([w.encode("utf-8", "replace") for w in some], self.ranks)))
        get = self.young.__getitem__
        out = [b"".join(map(get, p)) for p in pieces]
        for w in new:
            if len(w) > LONG_WORD:
                del self.young[w]
        return out


#: A worker process keeps its encoder from one task to the next.
_encoders: dict[tuple, Encoder] = {}


def worker_encoder(shared, digest: str, pattern: str, cache_words: int) -> Encoder:
    key = (digest, pattern, cache_words)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value, pattern, cache_words)
    return _encoders[key]


def _parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows whose sizes sum to about ``most``, one row at least."""
    i, total = 0, 0
    for j, n in enumerate(sizes):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if sizes:
        yield i, len(sizes)


def _without(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower() in names])


def bpe_encode(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, cache_words: int = 300_000, block_bytes: int = 1_000_000, keep_text: bool = True) -> DataFrame:
    """docs with ``ids array<int>``; without ``text`` if keep_text is False.

    The vocabulary is the one thing broadcast: its size is that of the rank file and independent of the corpus.
    """
    bounded_batches(spark)
    ranks = load_ranks(ranks_path)
    shared, digest = spark.sparkContext.broadcast(ranks), hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    kept = _without(docs, "ids") if keep_text else _without(docs, "ids", "text")
    names = [*kept.columns, "ids"]
    rows = _without(docs, "ids", "__text").withColumn("__text", F.col("text").cast("binary")).select(*[F.col(f"`{c}`") for c in kept.columns], "__text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["ids array<int>"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, digest, pattern, cache_words)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for i, j in _parts(sizes, block_bytes):
                got = encoder.encode([(x.as_py() or b"").decode("utf-8", "replace") for x in texts.slice(i, j - i)])
                ends = np.cumsum([0, *[len(g) // 4 for g in got]], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32)))
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, j - i) for c in range(b.num_columns - 1)], ids], names)

    return rows.mapInArrow(work, schema)


def bpe_decode(spark: SparkSession, encoded: DataFrame, ranks_path: str, block_ids: int = 1_000_000) -> DataFrame:
    """encoded (with ``ids``) with ``decoded binary``; null ids give null, an id outside the ranks fails the job."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(load_ranks(ranks_path))
    kept = _without(encoded, "decoded")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["decoded binary"])
    at, names = kept.columns.index("ids"), [*kept.columns, "decoded"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = {r: t for t, r in shared.value.items()}
        for b in batches:
            col = b.column(at)
            counts = pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_pylist()
            for i, j in _parts(counts, block_ids):
                own = col.slice(i, j - i)
                words = list(map(texts.__getitem__, own.flatten().to_numpy(zero_copy_only=False).tolist()))
                out, k = [], 0
                for n, valid in zip(counts[i:j], own.is_valid().to_pylist()):
                    out.append(b"".join(words[k : k + n]) if valid else None)
                    k += n
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, j - i) for c in range(b.num_columns)], pa.array(out, pa.binary())], names)

    return kept.mapInArrow(work, schema)
