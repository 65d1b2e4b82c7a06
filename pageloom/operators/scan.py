"""Searches in texts that nobody saved an index for.

One pass over the texts counts the tokens that some query asks for, a second over those counts scores blocks of chunks for all queries at
once and keeps, in each task, what can still be among the k best of a query. Texts are never shuffled, nor is a score that k others beat.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import search_tokens
from pageloom.store import bounded_batches, stash

#: Up to here the queries' terms go to all tasks; counted before. Beyond that, and where keys repeat, the caller's joins do the work.
MOST_TERMS, MOST_SCORES, MOST_ITEM_BYTES = 500_000, 4_000_000, 16_000_000
K1, B, MAX_TF = 1.5, 0.75, 65535
#: Scores are rounded to six digits by who ranks them; those this far apart do not become equal by that.
MARGIN = 1e-6
#: Letters in lower case, digits as they are, all else a space; so no byte of a character beyond ASCII is in a token.
_TOKENS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: The only characters beyond ASCII with an ASCII letter in their lower case: the Kelvin sign and the dotted capital I.
_FOLDED = (chr(0x212A).encode(), chr(0x130).encode())
_runs = re.compile(rb"[a-z]+|[0-9]+").findall


def words(text: bytes) -> list[bytes]:
    """The tokens of functions.text.word_tokens."""
    if _FOLDED[0] in text or _FOLDED[1] in text:
        text = text.decode("utf-8", "replace").lower().encode()
    return text.translate(_TOKENS).split()


def bag(text: bytes | None) -> Counter[bytes]:
    """How often each token of functions.text.search_bag occurs."""
    out = Counter(words(text or b""))
    for w, n in [(w, n) for w, n in out.items() if not (w.isalpha() or w.isdigit())]:
        for r in _runs(w):
            out[r] += n
    return out


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def _count(shared: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, dl, nd, terms, tf): all tokens and distinct ones of a chunk, numbers of the asked ones, and how often each stands there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t.encode(): i for i, t in enumerate(shared.value)}
        n = max(len(known), 1)
        for batch in batches:
            dl, nd, met, times, sizes = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = bag(text)
                asked = known.keys() & found.keys()
                dl.append(found.total())
                nd.append(len(found))
                met += [known[w] for w in asked]
                times += [found[w] for w in asked]
                sizes.append(len(asked))
            code = np.repeat(np.arange(len(sizes)), sizes) * n + np.array(met, np.int64)
            order = np.argsort(code)  # equal texts have their terms in one order
            per, code, tf = np.array(sizes, np.int64), code[order], np.minimum(np.array(times, np.int64), MAX_TF)[order]
            columns = [batch.column(0), pa.array(dl, pa.int32()), pa.array(nd, pa.int32()), _lists(code % n, per), _lists(tf, per)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "dl", "nd", "terms", "tf"])

    return work


class _Best:
    """What can be among the k best of each query so far: (query, key, score). Scores within MARGIN of the k-th stay, as rounding may make them equal."""

    def __init__(self, n: int, k: int):
        self.best, self.held = np.full((n, k), -np.inf), []

    def add(self, scores: np.ndarray, keys: pa.Array) -> None:
        """scores[i, j] of query i and keys[j]; nothing at or below zero is a hit."""
        k = self.best.shape[1]
        every = np.concatenate([self.best, scores], axis=1)
        self.best = np.partition(every, every.shape[1] - k, axis=1)[:, -k:]
        q, c = np.nonzero((scores > 0) & (scores >= self.least()[:, None]))
        self.held.append((q, keys.take(pa.array(c)), scores[q, c]))

    def least(self) -> np.ndarray:
        return self.best.min(axis=1) - MARGIN

    def pruned(self) -> int:
        """Leaves out what later chunks have beaten; how many stay."""
        if not self.held:
            return 0
        q, s = (np.concatenate([h[i] for h in self.held]) for i in (0, 2))
        keys = pa.concat_arrays([h[1] for h in self.held])
        kept = np.nonzero(s >= self.least()[q])[0]
        self.held = [(q[kept], keys.take(pa.array(kept)), s[kept])]
        return len(kept)


def _score(shared: Any, k: int, part: Callable[..., np.ndarray], whole: Callable[..., np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """part: what each (chunk, term) gives to a query that asks for the term; whole: scores from sums and the chunks' sizes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, about = shared.value
        n_queries = len(asked.names)
        best = _Best(n_queries, k)

        def out() -> pa.RecordBatch:
            (q, keys, s), best.held = best.held[0], []
            return pa.RecordBatch.from_arrays([asked.names.take(pa.array(q)), keys, pa.array(s, pa.float64())], ["query", "key", "score"])

        # Neither the scores of a block nor the pairs of its terms with queries get many.
        block = max(1, min(1_000_000 // n_queries, MOST_SCORES // len(asked.who)))
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                rows = batch.slice(at, block)
                n, sizes = rows.num_rows, pc.list_value_length(rows.column(3)).to_numpy(zero_copy_only=False)
                dl, nd, term, tf = (x.to_numpy(zero_copy_only=False) for x in (rows.column(1), rows.column(2), rows.column(3).flatten(), rows.column(4).flatten()))
                row = np.repeat(np.arange(n), sizes)
                gives = part(about, term, tf.astype(np.float64), dl[row])
                spread = asked.starts[term + 1] - asked.starts[term]
                each = np.repeat(np.arange(len(term)), spread)
                place = np.arange(len(each)) - np.repeat(np.cumsum(spread) - spread, spread) + asked.starts[term][each]
                sums = np.bincount(asked.who[place] * n + row[each], weights=gives[each], minlength=n_queries * n).reshape(n_queries, n)
                best.add(whole(about, sums, nd), rows.column(0))
            if best.pruned() > MOST_TERMS:
                yield out()
        if best.pruned():
            yield out()

    return work


@dataclass
class _Asked:
    """Terms that queries ask for, by number: term t is asked by names[who[starts[t]:starts[t + 1]]]."""

    terms: list[str]
    starts: np.ndarray
    who: np.ndarray
    names: pa.Array


def _one(x: Any) -> pa.Array:
    x = x.combine_chunks()
    return pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x


def _asked(queries: DataFrame, query_key: str) -> _Asked | None:
    """None where they are too many, or none at all."""
    rows = queries.select(query_key, F.explode(F.array_distinct(search_tokens(F.col("text")))).alias("term")).limit(MOST_TERMS + 1).toArrow()
    if not 0 < rows.num_rows <= MOST_TERMS:
        return None
    names, terms = (_one(c).dictionary_encode(null_encoding="encode") for c in (rows.column(0), rows.column(1)))
    who, term = names.indices.to_numpy(), terms.indices.to_numpy()
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms.dictionary)))])
    return _Asked(terms.dictionary.to_pylist(), starts, who[np.argsort(term, kind="stable")].astype(np.int64), names.dictionary)


def _repeats(df: DataFrame, key: str) -> bool:
    return bool(df.groupBy(key).count().where("count > 1").limit(1).count())


def _bm25_part(about, term, tf, dl):
    idf, avgdl = about
    return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


@dataclass
class Scan:
    """Queries that have met the chunks: ``counts`` has a row for each chunk, with the asked terms alone."""

    queries: DataFrame
    asked: _Asked
    counts: DataFrame
    key: str
    query_key: str

    @classmethod
    def of(cls, queries: DataFrame, chunks: DataFrame, key: str = "chunk_id", query_key: str = "query_id") -> Scan | None:
        """None where the terms are too many for one table in each task or where a key repeats, so that its rows' scores are to be added."""
        asked = _asked(queries, query_key)
        if asked is None:
            return None
        spark = chunks.sparkSession
        bounded_batches(spark)
        shared = spark.sparkContext.broadcast(asked.terms)
        schema = f"key {dict(chunks.dtypes)[key]}, dl int, nd int, terms array<int>, tf array<int>"
        counts = stash(spark, chunks.select(key, F.col("text").cast("binary")).mapInArrow(_count(shared), schema), "asked")
        return None if _repeats(counts, "key") else cls(queries, asked, counts, key, query_key)

    def _best(self, k: int, about: Any, part: Callable, whole: Callable) -> DataFrame | None:
        if k * len(self.asked.names) > MOST_SCORES:
            return None
        shared = self.counts.sparkSession.sparkContext.broadcast((self.asked, about))
        schema = f"query {dict(self.queries.dtypes)[self.query_key]}, key {dict(self.counts.dtypes)['key']}, score double"
        out = self.counts.select("key", "dl", "nd", "terms", "tf").mapInArrow(_score(shared, k, part, whole), schema)
        return out.select(F.col("query").alias(self.query_key), F.col("key").alias(self.key), "score")

    def bm25(self, k: int) -> DataFrame | None:
        """(query, key, score) of at least the k best of each query, before rounding. None where too much would be held at once."""
        n, avgdl = self.counts.agg(F.count(F.lit(1)), F.avg("dl")).first()
        df = np.zeros(len(self.asked.terms))
        for r in self.counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[r["term"]] = r["count"]
        return self._best(k, (np.log(1 + (n - df + 0.5) / (df + 0.5)), avgdl or 1.0), _bm25_part, lambda about, sums, nd: sums)

    def overlap(self, k: int) -> DataFrame | None:
        """The same of the cosine of the sets of tokens."""
        if _repeats(self.queries, self.query_key):
            return None
        nq = np.bincount(self.asked.who, minlength=len(self.asked.names)).astype(np.float64)
        ones = lambda about, term, tf, dl: np.ones(len(term))
        return self._best(k, nq, ones, lambda nq, sums, nd: sums / np.sqrt(nq[:, None] * np.maximum(nd, 1)))


def _within(shared: Any) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, query, item) of each item that a text contains."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items, tokens = shared.value
        by_token, always = {}, []
        for i, t in enumerate(tokens):
            (always if t is None else by_token.setdefault(t.encode(), [])).append(i)
        keyed = frozenset(by_token)
        for batch in batches:
            at, met = [], []
            for j, text in enumerate(batch.column(2).to_pylist()):
                if text is not None:
                    found = [i for i in [*always, *(i for w in keyed.intersection(words(text)) for i in by_token[w])] if items[i] in text]
                    met += found
                    at += [j] * len(found)
            at = pa.array(at, pa.int64())
            columns = [names.take(pa.array(met, pa.int64())), batch.column(1).take(at), batch.column(0).take(at), pa.array([items[i].decode() for i in met], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "doc_name", "page_num", "text"])

    return work


def containing(items: DataFrame, docs: DataFrame) -> DataFrame | None:
    """items(query_id, item, token) and docs(doc_id, source, text) -> (query_id, doc_name, page_num, text) of each document that contains an item.

    A document is looked through for the items alone whose token it has, and for all that have none. None where the items are too large for each task.
    """
    rows = items.select("query_id", F.col("item").cast("binary").alias("item"), "token")
    if (rows.agg(F.sum(F.length("item") + 64)).first()[0] or 0) > MOST_ITEM_BYTES:
        return None
    spark, table = docs.sparkSession, rows.toArrow()
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((_one(table.column(0)), table.column(1).to_pylist(), table.column(2).to_pylist()))
    kinds = dict(docs.dtypes)
    schema = f"query_id {dict(items.dtypes)['query_id']}, doc_name {kinds['source']}, page_num {kinds['doc_id']}, text string"
    return docs.select("doc_id", "source", F.col("text").cast("binary")).mapInArrow(_within(shared), schema)
