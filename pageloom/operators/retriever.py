"""One contract for retrieval: ``search(queries, k)`` over lexical, dense and fused indexes, and answers from any of them.

queries: (query_id, text). Hits: (query_id, rank, score, chunk_id, doc_name, page_number, text), rank from 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.store import exists, stash

from . import answers, dense, fusion
from .lexical import LexicalIndex

HIT = ("query_id", "rank", "score", "chunk_id", "doc_name", "page_number", "text")


class Retriever(Protocol):
    name: str

    def ranked(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, chunk_id, score, rank)."""

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Hits with what the chunks say."""


#: Hits up to which they go to the chunks; counted before.
BROADCAST_HITS = 500_000


def with_chunks(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits are few beside the chunks: they are written, counted and sent to where the texts are."""
    hits = stash(ranked.sparkSession, ranked, "hits")
    hits = F.broadcast(hits) if hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS else hits
    return chunks.select("chunk_id", "doc_name", "page_number", "text").join(hits, "chunk_id").select(*HIT)


@dataclass
class Lexical:
    index: LexicalIndex
    name: str = "bm25"

    def ranked(self, queries: DataFrame, k: int) -> DataFrame:
        return self.index.top_k(queries, k).select("query_id", "chunk_id", "score", "rank")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return with_chunks(self.ranked(queries, k), self.index.chunks)


@dataclass
class VectorIndex:
    """chunks(chunk_id, doc_name, page_number, text, embedding): a vector stands in its chunk's row, so nothing can fall out of step."""

    chunks: DataFrame
    encoder: str = "hashed"

    @classmethod
    def build(cls, chunks: DataFrame, encode: Callable[[Column], Column], encoder: str = "hashed") -> VectorIndex:
        return cls(chunks.withColumn("embedding", encode(F.col("text"))), encoder)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        self.chunks.write.mode(mode).parquet(f"{path}/chunks")
        self.chunks.sparkSession.createDataFrame([(self.encoder,)], "encoder string").write.mode(mode).parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        if not exists(spark, f"{path}/about"):
            raise FileNotFoundError(f"no index at {path}")
        return cls(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/about").first()["encoder"])

    def extended(self, chunks: DataFrame, encode: Callable[[Column], Column]) -> VectorIndex:
        """With the chunks whose id it does not have yet; only those are encoded."""
        new = chunks.join(self.chunks.select("chunk_id"), "chunk_id", "left_anti")
        return VectorIndex(self.chunks.unionByName(new.withColumn("embedding", encode(F.col("text")))), self.encoder)


@dataclass
class Dense:
    index: VectorIndex
    encode: Callable[[Column], Column]  # text of a query -> vector
    name: str = "dense"

    def ranked(self, queries: DataFrame, k: int) -> DataFrame:
        asked = queries.select("query_id", self.encode(F.col("text")).alias("q"))
        corpus = self.index.chunks.where("embedding IS NOT NULL").select(F.col("chunk_id").alias("vec_id"), F.col("embedding").alias("v"))
        return dense.dense_top_k(asked, corpus, k).select("query_id", F.col("vec_id").alias("chunk_id"), "score", "rank")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return with_chunks(self.ranked(queries, k), self.index.chunks)


@dataclass
class Hybrid:
    """Two retrievers' first ``pool`` hits, fused by reciprocal rank."""

    dense: Retriever
    lexical: Retriever
    dense_weight: float = 0.5
    pool: int = fusion.POOL

    def __post_init__(self) -> None:
        if not 0 <= self.dense_weight <= 1:
            raise ValueError("dense_weight must be between 0 and 1")

    @property
    def name(self) -> str:
        return f"hybrid-d{self.dense_weight:.2f}__{self.dense.name}".replace(".", "p")

    def ranked(self, queries: DataFrame, k: int) -> DataFrame:
        weights = queries.sparkSession.createDataFrame([(float(self.dense_weight),)], "weight double")
        fused = fusion.fuse(self.dense.ranked(queries, self.pool), self.lexical.ranked(queries, self.pool), weights, k)
        return fused.select("query_id", "chunk_id", F.col("rrf").alias("score"), "rank")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return with_chunks(self.ranked(queries, k), self.lexical.index.chunks)


@dataclass
class RAG:
    """Questions in, cited answers with their contexts out."""

    retriever: Retriever
    make_provider: Callable[[], answers.Provider] = answers.Extractive
    k: int = 10
    context_tokens: int | None = None  # what prompt and answer may have together
    max_new_tokens: int = 384

    def answer(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """questions(query_id, question) -> (query_id, question, contexts, answer, error, cited, refused)."""
        asked = answers.prompts(questions, self.retriever.search(questions.select("query_id", F.col("question").alias("text")), k or self.k), self.context_tokens, self.max_new_tokens)
        return answers.with_answers(asked, self.make_provider)

