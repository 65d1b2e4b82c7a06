"""Masked pseudo-likelihood: a bidirectional window network scores each token from both sides.

Tokens are the lower-cased (ASCII) words of a text between white space. The vocabulary is the ``top`` most frequent words of all documents;
rarer words fall by hash into 64 shared classes, where a word's share of its class is its count in the corpus by that of the class plus one; the one is
left for a word that the corpus does not have. The network sees the two tokens left and right of a masked one, each with a
vector for its place; their sum goes through tanh, and a token's probability is that of its class of 64 times that within the
class, whose logits also depend on the class. That is mixed, half from each side, with the shares that the counts of neighbouring pairs give
after the left and before the right neighbour; a neighbour with few tokens for its distinct ones leaves more to the network (Witten-Bell).
A document's score is the sum of the natural logarithms over all its tokens.

Counts of words and of pairs cover all tokens of the corpus and are pre-aggregated in the tasks. Words stay a table and are joined in by word, but for the
``known_words`` most frequent ones after the vocabulary, whose counts the tasks hold; pairs of vocabulary and class ids fit a matrix of fixed size. The network is trained on every token of the corpus, in three rounds over disjoint
shares of the texts, by hash: the first ``fit_docs`` texts, three times over, seven times as many, and all others. In a round each shard of about ``shard_tokens`` tokens
trains from the round before, on an executor, and the changes are averaged. Batches grow with the steps of a shard. None of this goes by the size of the corpus. Texts are dealt by their hash and sums are of whole numbers, so
partitions do not matter. The driver holds one set of weights and the matrix. Everything else runs by batch.

Null text and text without a word: no tokens, score 0.0, mean null. Result columns replace columns of their names; all rows stay. Repeated rows and null doc_ids are
rows like any other for counts and scores; for training equal texts count once. Very long texts are read whole, a batch of tokens at a time. An empty corpus gives an
untrained network and no counts, which scores every token of a text that is given to it by chance alone; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, stash

SIDE, EDGE = 64, 64 * 64  # classes, words in each; the id beyond a text's ends
PLACES = (-2, -1, 1, 2)
#: Steps and tokens of a shard's first batches; all later ones have BATCH tokens.
FIRST_BATCHES, BATCH = ((256, 512), (128, 2048)), 8192


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """How many words each of the texts (binary) has, which of the distinct words each is, one text after the other, and the distinct words.

    The words are those of ``words_of``; Python then meets each distinct one once.
    """
    texts = texts.view(pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    sizes, words = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    empty = pc.equal(pc.binary_length(words), 0)  # a blank text has one empty word
    if pc.any(empty).as_py():
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[empty.to_numpy(zero_copy_only=False)], minlength=len(sizes))
        words = words.filter(pc.invert(empty))
    coded = words.dictionary_encode()
    distinct = coded.dictionary
    return sizes, coded.indices.to_numpy(zero_copy_only=False), distinct.view(pa.large_binary() if pa.types.is_large_string(distinct.type) else pa.binary()).cast(pa.binary())


def listed(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist


class Vocabulary(dict):
    """Ids of the frequent words; words(word, n) counts all of the corpus, in_class those of the rest by class, more(word -> n) some of the rest."""

    words: DataFrame
    in_class: list[int]
    more: dict[bytes, int]


def ids_of(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    get, rare = vocabulary.get, EDGE - SIDE
    return np.array([i if (i := get(w)) is not None else rare + zlib.crc32(w) % SIDE for w in words], np.int32)


class Known(dict):
    """A place for each word of a vocabulary and of its ``more``; any other word has the id of its class. ids and shares are by place."""

    def __init__(self, vocabulary: dict[bytes, int], more: dict[bytes, int], in_class: list[int]):
        super().__init__(vocabulary)
        self.update((w, EDGE + i) for i, w in enumerate(more))
        classes = np.array([zlib.crc32(w) % SIDE for w in more], np.int64)
        self.ids = np.concatenate([np.arange(EDGE, dtype=np.int32), (EDGE - SIDE + classes).astype(np.int32)])
        # The logarithm of a word's share of its class.
        self.shares = np.concatenate([np.zeros(EDGE), np.log(np.array([*more.values()], np.float64)) - np.log(np.array(in_class, np.float64)[classes] + 1)])

    def __missing__(self, word: bytes) -> int:
        return EDGE - SIDE + zlib.crc32(word) % SIDE

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def word_counts(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word binary, n) over all documents; a task sums up to ``flush`` words before it hands them on."""
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        for b in batches:
            _, which, distinct = cut(b.column(0))
            seen.update(dict(zip(listed(distinct), np.bincount(which, minlength=len(distinct)).tolist())))
            if len(seen) > flush:
                yield give()
                seen.clear()
        if seen:
            yield give()

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class WindowNetwork:
    vectors: list[np.ndarray]  # for each place (EDGE + 1) x h
    bias: np.ndarray  # h
    to_class: np.ndarray  # h x 64
    class_bias: np.ndarray
    to_word: np.ndarray  # h x 64
    word_bias: np.ndarray  # 64 x 64: by class
    pairs: np.ndarray | None = None  # (EDGE + 1) x (EDGE + 1): how often an id follows another

    def __post_init__(self) -> None:
        # Numbers of so few bits that sums of products are exact in double precision: in inexact ones, equal rows could differ by their places in a block.
        self.exact = [np.round(w.astype(np.float64).clip(-64, 64) * 2**20) / 2**20 for w in (self.to_class, self.to_word)]
        self.bounded = _bounded(self.to_class, self.class_bias) and _bounded(self.to_word, self.word_bias)
        if self.pairs is not None:
            self.after, self.before = self.pairs[:, :EDGE].sum(axis=1, dtype=np.float64), self.pairs[:EDGE].sum(axis=0, dtype=np.float64)
            # The share of a side's counts, n / (n + distinct), divided by n; half for each side.
            self.left = 0.5 / np.maximum(1, self.after + np.count_nonzero(self.pairs[:, :EDGE], axis=1))
            self.right = 0.5 / np.maximum(1, self.before + np.count_nonzero(self.pairs[:EDGE], axis=0))
            self.rest = 0.5 - self.left * self.after, 0.5 - self.right * self.before

    def log_probs(self, ids: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """The logarithm of each token's probability, given its neighbours."""
        return self.log_probs_of([ids], chunk)

    def log_probs_of(self, texts: list[np.ndarray], chunk: int = 2048) -> np.ndarray:
        """Those of the tokens of all texts, one text after the other.

        All products are of ``chunk`` rows, the last one filled up, and exact: else equal rows could differ in the last digits.
        """
        ends = np.full(2, EDGE, np.int32)
        flat = np.concatenate([ends, *(part for t in texts for part in (t, ends))])
        spots = np.flatnonzero(flat != EDGE)
        out = np.empty(len(spots), np.float64)
        rows = np.arange(chunk)
        for s in range(0, len(spots), chunk):
            at = spots[s : s + chunk]
            n = len(at)
            at = np.concatenate([at, np.full(chunk - n, at[0])]) if n < chunk else at
            y, sides = flat[at], [flat[at + p] for p in PLACES]
            h = self.bias + sum(v.take(i, axis=0) for i, v in zip(sides, self.vectors))
            h = np.rint(np.tanh(h, out=h) * np.float32(2**20)).astype(np.float64) / 2**20
            a, b = y // SIDE, y % SIDE
            first = (h @ self.exact[0]).astype(np.float32)
            first += self.class_bias
            second = (h @ self.exact[1]).astype(np.float32)
            second += self.word_bias.take(a, axis=0)
            own = first[rows, a] + second[rows, b]
            own -= _log_sum(first, self.bounded)
            own -= _log_sum(second, self.bounded)
            if self.pairs is not None:
                x, z = sides[1], sides[2]
                own = np.log((self.rest[0][x] + self.rest[1][z]) * np.exp(own.astype(np.float64)) + self.left[x] * self.pairs[x, y] + self.right[z] * self.pairs[y, z])
            out[s : s + n] = own[:n]
        return out


def _bounded(w: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit can leave the range of exp in single precision; tanh is at most 1."""
    return bool(np.abs(w).sum(axis=0).max() + np.abs(bias).max() < 60)


def _log_sum(z: np.ndarray, bounded: bool) -> np.ndarray:
    """Row by row; z is overwritten."""
    top = 0 if bounded else z.max(axis=1)
    if not bounded:
        z -= top[:, None]
    return top + np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def untrained(counts: np.ndarray, hidden: int = 24, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights to start from: random vectors, and biases at the corpus's counts of the ids."""
    rng = np.random.default_rng(seed)
    f = np.float32
    counts = counts.reshape(SIDE, SIDE) + 0.1
    return {
        "v": rng.normal(0, 0.1, (4, EDGE + 1, hidden)).astype(f), "c": np.zeros(hidden, f), "wa": rng.normal(0, 0.1, (hidden, SIDE)).astype(f), "ba": np.log(counts.sum(1) / counts.sum()).astype(f),
        "wb": rng.normal(0, 0.1, (hidden, SIDE)).astype(f), "bb": np.log(counts / counts.sum(1, keepdims=True)).astype(f),
    }


def _add_rows(out: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    """Add the sum of the rows of each id to its row of out, which is zero."""
    order = np.argsort(ids, kind="stable")
    own = ids[order]
    at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    out[own[at]] = np.add.reduceat(rows.take(order, axis=0), at, axis=0)


def _adam(p: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, rise: np.float32, least: np.float32, block: int = 1 << 14) -> None:
    """One step, in place and by blocks that fit the processor's cache."""
    p, m, v, g = (x.reshape(-1) for x in (p, m, v, g))
    for s in range(0, len(p), block):
        pb, mb, vb, gb = (x[s : s + block] for x in (p, m, v, g))
        mb *= np.float32(0.9)
        mb += gb
        t = gb * gb
        vb *= np.float32(0.999)
        vb += t
        np.sqrt(vb, out=t)
        t += least
        np.divide(mb, t, out=t)
        t *= rise
        pb -= t


def _batch_ends(n: int) -> Iterator[tuple[int, int]]:
    """From where to where each batch of n tokens goes."""
    s = 0
    for size in chain(*(repeat(size, steps) for steps, size in FIRST_BATCHES), repeat(BATCH)):
        if s >= n:
            return
        yield s, min(n, s + size)
        s += size


def train(start: dict[str, np.ndarray], texts: list[np.ndarray], epochs: int = 1, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """The weights after epochs over every token of the texts (uint16 ids). Adam on cross-entropy."""
    rng = np.random.default_rng(seed)
    p = {k: x.copy() for k, x in start.items()}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    ends = np.full(2, EDGE, np.uint16)
    flat = np.concatenate([ends, *(part for t in texts for part in (t, ends))])
    spots, ones = np.flatnonzero(flat != EDGE), np.ones(SIDE, np.float32)
    for _ in range(epochs):
        order = rng.permutation(spots)
        for s, stop in _batch_ends(len(order)):
            own = order[s:stop]
            y = flat[own]
            by_id = np.argsort(y, kind="stable")  # tokens of a class follow each other
            own, y = own[by_id], y[by_id]
            sides = [flat[own + i] for i in PLACES]
            a, b, rows = y // SIDE, y % SIDE, np.arange(len(own))
            h = np.tanh(p["c"] + sum(p["v"][i].take(x, axis=0) for i, x in enumerate(sides)))
            # A row of e times its number in scale is the gradient of its logits: narrow factors are scaled in place of e.
            grads = []
            for w, bias, own_bias, k in (("wa", p["ba"], p["ba"], a), ("wb", p["bb"], p["bb"].take(a, axis=0), b)):
                z = h @ p[w]
                z += own_bias
                if not _bounded(p[w], bias):
                    z -= z.max(axis=1, keepdims=True)
                e = np.exp(z, out=z)
                total = e @ ones
                e[rows, k] -= total
                grads.append((e, 1 / (total * np.float32(len(own)))))
            (ea, sa), (eb, sb) = grads
            dh = (ea @ p["wa"].T) * sa[:, None]
            dh += (eb @ p["wb"].T) * sb[:, None]
            dh *= 1 - h * h
            dv = np.zeros_like(p["v"])
            for i, x in enumerate(sides):
                _add_rows(dv[i], x, dh)
            dbb = np.zeros_like(p["bb"])
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            for s0, s1 in zip(starts, [*starts[1:], len(a)]):
                dbb[a[s0]] = sb[s0:s1] @ eb[s0:s1]
            step += 1
            # m and v are ten and a thousand times Adam's moments.
            root = ((1 - 0.999**step) / 0.001) ** 0.5
            rise, least = np.float32(rate / (1 - 0.9**step) * 0.1 * root), np.float32(1e-8 * root)
            for k, g in (("v", dv), ("c", np.ones(len(own), np.float32) @ dh), ("wa", (h * sa[:, None]).T @ ea), ("ba", sa @ ea), ("wb", (h * sb[:, None]).T @ eb), ("bb", dbb)):
                _adam(p[k], m[k], v[k], g, rise, least)
    return p


def _blocks(p: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The weights as matrices with a row for each id (vectors), each class (its word biases) and one for all others."""
    return [p["v"].transpose(1, 0, 2).reshape(EDGE + 1, -1), p["bb"], np.concatenate([p[k].ravel() for k in ("c", "wa", "ba", "wb")])[None]]


def _from_blocks(blocks: list[np.ndarray], like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    hidden = len(like["c"])
    out = {"v": np.ascontiguousarray(blocks[0].reshape(EDGE + 1, 4, hidden).transpose(1, 0, 2)), "bb": blocks[1]}
    at = 0
    for k in ("c", "wa", "ba", "wb"):
        out[k] = blocks[2][0, at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def train_round(spark: SparkSession, coded: DataFrame, start: dict[str, np.ndarray], tokens: float, epochs: int, rate: float, shard_tokens: int) -> dict[str, np.ndarray]:
    """One round over every text of coded(h, ids): a shard of texts, dealt by hash, trains from the same start, and the
    shards' changes are averaged, each row by how often its id or class occurs in the shard.
    """
    shards = max(1, round(tokens / shard_tokens))
    shared = spark.sparkContext.broadcast(start)
    step, part = 256, 1 << 22

    def learned(texts: list[np.ndarray], shard: int) -> pa.RecordBatch:
        from_here = shared.value
        end = train(from_here, texts, epochs, rate, shard)
        n = np.bincount(np.concatenate(texts), minlength=EDGE + 1)
        n[EDGE] = len(texts)
        weights = [n, n[:EDGE].reshape(SIDE, SIDE).sum(1), n[:EDGE].sum()[None]]
        names, changes, counts = [], [], []
        for i, (x, y, w) in enumerate(zip(_blocks(from_here), _blocks(end), weights)):
            for s in range(0, len(x), step):
                names.append(i * 100 + s // step)
                changes.append((y[s : s + step] - x[s : s + step]).tobytes())
                counts.append(w[s : s + step].astype(np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(changes, pa.binary()), pa.array(counts, pa.binary())], ["k", "change", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, texts = None, None, []
        for b in batches:
            for own, h, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if own != shard and texts:
                    yield learned(texts, shard)
                    texts = []
                if (own, h) != (shard, last):  # equal texts follow each other
                    texts.append(np.frombuffer(ids.as_py(), np.uint16))
                shard, last = own, h
        if texts:
            yield learned(texts, shard)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, change, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                w = np.frombuffer(n.as_py(), np.int64)
                # Whole numbers: sums do not depend on the order of the shards.
                x = np.rint(np.frombuffer(change.as_py(), np.float32).reshape(len(w), -1).astype(np.float64) * w[:, None] * part).astype(np.int64)
                sums[k] = [sums[k][0] + x, sums[k][1] + w] if k in sums else [x, w]
        for k, (x, w) in sums.items():
            mean = (x / (np.maximum(w, 1)[:, None] * float(part))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["k", "mean"])

    dealt = coded.select(F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), "h", "ids").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h")
    changed = dealt.mapInArrow(work, "k int, change binary, n binary").repartition("k").mapInArrow(total, "k int, mean binary")
    blocks = [x.copy() for x in _blocks(start)]
    for r in stash(spark, changed, "weights").collect():
        x = blocks[r["k"] // 100]
        s = r["k"] % 100 * step
        x[s : s + step] += np.frombuffer(r["mean"], np.float32).reshape(-1, x.shape[1])
    return _from_blocks(blocks, start)


def coded_texts(docs: DataFrame, vocabulary: Vocabulary, recent: int = 100_000) -> DataFrame:
    """(h, ids, again) of each text with a word: its hash, its ids as uint16, and whether the task has lately seen an equal text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((dict(vocabulary), vocabulary.more, vocabulary.in_class))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(*shared.value)
        seen: set[int] = set()
        for b in batches:
            hashes, out, again = [], [], []
            sizes, which, distinct = cut(b.column(1))
            ids, ends = known.ids.astype(np.uint16)[known.places(listed(distinct))][which], np.cumsum(sizes)
            for h, start, end in zip(b.column(0).to_pylist(), ends - sizes, ends):
                if start < end:
                    hashes.append(h)
                    out.append(ids[start:end].tobytes())
                    again.append(h in seen)
                    seen.add(h)
            if len(seen) > recent:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(out, pa.binary()), pa.array(again, pa.bool_())], ["h", "ids", "again"])

    texts = docs.where("text IS NOT NULL").select(F.xxhash64(F.lit(23), "text").alias("h"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(work, "h long, ids binary, again boolean")


def pair_counts(coded: DataFrame) -> np.ndarray:
    """How often each id follows each other one in all of coded(ids); a task hands on a row of its sums for each left id."""
    bounded_batches(coded.sparkSession)
    width, kind = EDGE + 1, np.dtype([("id", "<u2"), ("n", "<u4")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(width * width, np.uint32)
        edge = np.array([EDGE], np.int32)
        for b in batches:
            codes = []
            for t in b.column(0):
                ids = np.frombuffer(t.as_py(), np.uint16).astype(np.int32)
                codes.append(np.concatenate([edge, ids]) * width + np.concatenate([ids, edge]))
            if codes:
                which, n = np.unique(np.concatenate(codes), return_counts=True)
                seen[which] += n.astype(np.uint32)
        lefts, rows = [], []
        for left, row in enumerate(seen.reshape(width, width)):
            at = np.flatnonzero(row)
            if len(at):
                packed = np.empty(len(at), kind)
                packed["id"], packed["n"] = at, row[at]
                lefts.append(left)
                rows.append(packed.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lefts, pa.int32()), pa.array(rows, pa.binary())], ["a", "row"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for left, row in zip(b.column(0).to_pylist(), b.column(1)):
                packed = np.frombuffer(row.as_py(), kind)
                sums.setdefault(left, np.zeros(width))[packed["id"]] += packed["n"]
        for left, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([left], pa.int32()), pa.array([zlib.compress(row.astype("<f4").tobytes(), 1)], pa.binary())], ["a", "row"])

    parts = coded.select("ids").mapInArrow(count, "a int, row binary").repartition("a").mapInArrow(total, "a int, row binary")
    out = np.zeros((width, width), np.float32)
    for r in parts.collect():
        out[r["a"]] = np.frombuffer(zlib.decompress(r["row"]), "<f4")
    return out


def fit(spark: SparkSession, docs: DataFrame, fit_docs: int = 2000, shard_tokens: int = 4_000_000, known_words: int = 100_000) -> tuple[Vocabulary, WindowNetwork]:
    """The vocabulary of all docs, by falling frequency, and the network, trained on every token of them."""
    counts = stash(spark, word_counts(docs), "words")
    top = counts.orderBy(F.desc("n"), "word").limit(EDGE - SIDE).collect()
    vocabulary = Vocabulary({bytes(r["word"]): i for i, r in enumerate(top)})
    vocabulary.words, vocabulary.in_class = counts, [0] * SIDE
    for r in counts.groupBy(_class_of("word").alias("c")).agg(F.sum("n").alias("n")).collect():
        vocabulary.in_class[r["c"]] = r["n"]
    tokens = sum(vocabulary.in_class)
    for r in top:
        vocabulary.in_class[zlib.crc32(r["word"]) % SIDE] -= r["n"]
    # Tasks know the counts of up to so many words more: all above a count, found by a few hundred numbers.
    level = F.floor(8 * F.log2("n"))
    cut, most = None, len(top) + known_words
    for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():
        most -= r["words"]
        if most < 0:
            break
        cut = r["level"]
    more = counts.where(level >= cut).collect() if cut is not None else []
    vocabulary.more = {bytes(r["word"]): r["n"] for r in more if bytes(r["word"]) not in vocabulary}
    of_ids = np.zeros(EDGE)
    of_ids[: len(top)] = [r["n"] for r in top]
    of_ids[EDGE - SIDE :] = vocabulary.in_class
    coded = stash(spark, coded_texts(docs, vocabulary), "coded")
    n = coded.select(F.count(F.lit(1))).first()[0]
    # Rounds: fit_docs texts by hash, seven times as many, and all others.
    first = fit_docs / max(n, 1)
    cuts = [0, *[int(min(1.0, x) * (1 << 32)) for x in (first, 8 * first)], 1 << 32]
    weights, place = untrained(of_ids), F.shiftrightunsigned("h", 32)
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        if low < high and tokens:
            some = coded.where(~F.col("again") & (place >= low) & (place < high))
            weights = train_round(spark, some, weights, tokens * (high - low) / (1 << 32), 1 if i else 3, 0.01 / (1 + i), shard_tokens)
    p = weights
    return vocabulary, WindowNetwork(list(p["v"]), p["c"], p["wa"], p["ba"], p["wb"], p["bb"], pair_counts(coded))


def _class_of(word: str) -> Column:
    return (F.crc32(word) % SIDE).cast("int")


def _rare(sizes: np.ndarray, which: np.ndarray, distinct: pa.Array, known: np.ndarray) -> pa.Array:
    """The words of each text, cut as ``cut`` has it, that are not known, with how often it has them, by first place in it."""
    at = np.flatnonzero(~known[which])
    text = np.repeat(np.arange(len(sizes)), sizes)[at]
    pairs, first, m = np.unique(text * max(len(distinct), 1) + which[at], return_index=True, return_counts=True)
    order = np.argsort(first)
    n = np.concatenate([[0], np.cumsum(np.bincount(text[first], minlength=len(sizes)))]).astype(np.int32)
    each = [distinct.take(pa.array(pairs[order] % max(len(distinct), 1))), pa.array(m[order], pa.int32())]
    return pa.ListArray.from_arrays(pa.array(n), pa.StructArray.from_arrays(each, ["word", "m"]))


def _within(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(h, within) of texts(h, rare)."""
    rows = texts.select("h", F.posexplode("rare").alias("i", "r"))
    rows = rows.select("h", (F.col("i") == 0).alias("first"), F.col("r.m").alias("m"), F.xxhash64("r.word").alias("w"), _class_of("r.word").cast("byte").alias("c"))
    known = vocabulary.words.select(F.xxhash64("word").alias("w"), "n")
    total = F.element_at(F.array(*[F.lit(float(n)) for n in vocabulary.in_class]), F.col("c") + 1)
    each = rows.join(known, "w", "left").select("h", "first", (F.col("m") * (F.log(F.coalesce("n", F.lit(1)).cast("double")) - F.log(total + 1))).alias("x"))
    # Rows of one text gave their words once each.
    return each.groupBy("h").agg((F.sum("x") / F.sum(F.col("first").cast("int"))).alias("within"))


def within_class(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(h, within) of each text with words that the tasks do not know: the sum of their logarithms within their classes; h stands for the text."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast({*vocabulary, *vocabulary.more})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            *words, distinct = cut(b.column(1))
            known = np.fromiter(map(shared.value.__contains__, listed(distinct)), bool, len(distinct))
            yield pa.RecordBatch.from_arrays([b.column(0), _rare(*words, distinct, known)], ["h", "rare"])

    rows = docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return _within(rows.mapInArrow(work, "h long, rare array<struct<word: binary, m: int>>"), vocabulary)


def score(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, network: WindowNetwork) -> DataFrame:
    """docs with n_tokens long, log_prob double (the sum) and mean_log_prob double."""
    bounded_batches(spark)
    made = ("n_tokens", "log_prob", "mean_log_prob")
    kept = docs.drop(*[c for c in docs.columns if c.lower() in (*made, "__text", "__h", "__rare")])
    columns = kept.columns
    kept = kept.withColumn("__h", F.xxhash64("text"))
    names = [*kept.columns, "n_tokens", "log_prob", "__rare"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["n_tokens long, log_prob double, __rare array<struct<word: binary, m: int>>"])
    shared = spark.sparkContext.broadcast((dict(vocabulary), vocabulary.more, vocabulary.in_class, network))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *of_words, net = shared.value
        known = Known(*of_words)
        for b in batches:
            counts, which, distinct = cut(b.column(b.num_columns - 1))
            place = known.places(listed(distinct))
            sums, some = np.zeros(len(counts)), counts > 0
            if some.any():
                each = net.log_probs_of(np.split(known.ids[place][which], np.cumsum(counts)[:-1])) + known.shares[place][which]
                sums[some] = np.add.reduceat(each, (np.cumsum(counts) - counts)[some])
            rare = _rare(counts, which, distinct, (place < EDGE - SIDE) | (place >= EDGE))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64()), pa.array(sums, pa.float64()), rare], names)

    # Written, so that texts are cut into words once for both.
    by_class = stash(spark, kept.withColumn("__text", F.col("text").cast("binary")).mapInArrow(work, schema), "scored")
    within = _within(by_class.select(F.col("__h").alias("h"), F.col("__rare").alias("rare")), vocabulary).select(F.col("h").alias("__h"), "within")
    both = by_class.join(within, "__h", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("within", F.lit(0.0)))
    return both.select(*[F.col(f"`{c}`") for c in columns], "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
