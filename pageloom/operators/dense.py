"""Exact inner-product search over vectors that stand in the row with their metadata."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions.text import inner_product
from pageloom.store import stash


def normalised(vector: Column) -> Column:
    """The vector at length one, in double precision; null for a zero vector."""
    length = F.sqrt(inner_product(vector, vector))
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length))


#: Vectors with a component beyond this, or one that is not a number, are compared by expressions.
_LARGE = 1e150


def dense_top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, digits: int = 6, block: int = 4096) -> DataFrame:
    """queries(query_id, q), corpus(vec_id, v) -> (query_id, vec_id, score, rank).

    Every query meets every row, as an exact scan must; the queries are the stated set. Vectors of the queries' length meet in matrix products, as ``dense_top_k_blocks`` has them;
    pairs with another one - null, of another length, with a component that is null, huge or no number - by expressions.
    """
    spark, length = queries.sparkSession, queries.agg(F.max(F.size("q"))).first()[0] or 0

    def even(v: str) -> Column:
        plain = (F.size(F.array_compact(v)) == length) & (F.size(v) == length) & (F.array_max(v).cast("double") < _LARGE) & (F.array_min(v).cast("double") > -_LARGE)
        return F.coalesce(plain, F.lit(False))

    by_product = dense_top_k_blocks(spark, queries.where(even("q")), corpus.where(even("v")), k, digits, block).drop("rank")
    columns = ["query_id", "vec_id", F.round(inner_product("q", "v"), digits).alias("score")]
    others = [(corpus.where(~even("v")), queries), (corpus.where(even("v")), queries.where(~even("q")))]
    scored = [rows.crossJoin(F.broadcast(own) if own.limit(block + 1).count() <= block else own).select(*columns) for rows, own in others]
    return best_of_each(by_product.unionByName(scored[0]).unionByName(scored[1]), "vec_id", k)


def best_of_each(scored: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of each query with their rank, ties by key."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_top_k_blocks(spark: SparkSession, queries: DataFrame, corpus: DataFrame, k: int = 10, digits: int = 6, block: int = 4096) -> DataFrame:
    """The same by matrix products: queries go out in blocks of fixed size, each task keeps k rows a query. Null vectors have no score.

    The driver holds one block of queries at a time: of several, each one's hits are written before the next is read.
    """
    many, parts = queries.limit(block + 1).count() > block, []
    schema = f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(corpus.dtypes)['vec_id']}, score double"
    rows = queries.where("q IS NOT NULL").select("query_id", "q").toLocalIterator()
    while own := list(islice(rows, block)):
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in own]), np.array([r["q"] for r in own], dtype=np.float64)))
        hits = corpus.where("v IS NOT NULL").select("vec_id", "v").mapInPandas(_best_of(shared, k, digits), schema)
        parts.append(stash(spark, hits, "hits") if many else hits)
        if many:
            shared.destroy()
    if not parts:
        return spark.createDataFrame([], f"{schema}, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return best_of_each(found, "vec_id", k)


class Best:
    """The k best ids of each of n queries so far, ties by id: ``row`` (number of the query), ``id`` and ``score``, side by side."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.row, self.id, self.score = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores[i, j] of query rows[i] and ids[j]. What cannot be among the k best is left out before anything is sorted."""
        least = self.least[rows]
        if scores.shape[1] > self.k:
            least = np.maximum(least, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero(scores >= least[:, None])
        row, new, score = np.concatenate([self.row, rows[r]]), ids[c], np.concatenate([self.score, scores[r, c]])
        every = new if self.id is None else np.concatenate([self.id, new])
        order = np.lexsort((np.unique(every, return_inverse=True)[1], -score, row))
        row, every, score = row[order], every[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.id, self.score = row[kept], every[kept], score[kept]
        last = place == self.k - 1
        self.least[row[last]] = score[last]


def _best_of(shared, k: int, digits: int):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        best, rows = Best(len(ids), k), np.arange(len(ids))
        for f in frames:
            if len(f):
                best.add(rows, f["vec_id"].to_numpy(), np.round(q @ np.array(f["v"].tolist(), dtype=np.float64).T, digits))
        if best.id is not None:
            yield pd.DataFrame({"query_id": ids[best.row], "vec_id": best.id, "score": best.score})

    return work
