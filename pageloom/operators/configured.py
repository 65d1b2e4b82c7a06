"""What a configuration stands for: the chunks, vectors and answers that it asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.sources.config import ChunkConfig, EmbedConfig, FusionConfig, GenerateConfig

from . import chunking, retriever
from .answers import Extractive, Provider
from .encoding import encode_column, hashed_encoder
from .sampling import reuse_vectors, subset
from .subwords import ruled_windows, tokenizer_ruler

STRATEGIES: dict[str, Callable[..., DataFrame]] = {"fixed": chunking.fixed_windows, "recursive": chunking.recursive_chunks}
RULED: dict[str, Callable[..., DataFrame]] = {"fixed": ruled_windows, "recursive": chunking.recursive_chunks}
PROVIDERS: dict[str, Callable[[GenerateConfig], Provider]] = {"extractive": lambda cfg: Extractive()}


def chunks_of(pages: DataFrame, cfg: ChunkConfig, eval_docs: DataFrame | None = None) -> DataFrame:
    """Numbered chunks by the strategy of cfg; with eval_docs_only those of eval_docs(doc_name) alone."""
    if cfg.eval_docs_only:
        if eval_docs is None:
            raise ValueError("eval_docs_only needs the documents to keep")
        pages = subset(pages, eval_docs.distinct(), "doc_name")
    if cfg.tokenizer:
        cut = RULED[cfg.strategy](pages, cfg.chunk_size, cfg.chunk_overlap, tokenizer_ruler(cfg.tokenizer))
    else:
        cut = STRATEGIES[cfg.strategy](pages, cfg.chunk_size, cfg.chunk_overlap)
    return chunking.numbered(cut).withColumn("n_chars", F.length("text"))


def encoders_of(cfg: EmbedConfig) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Column functions for passages and for queries, each with its prefix."""
    make = lambda: hashed_encoder(cfg.dim)
    return encode_column(make, cfg.passage_prefix), encode_column(make, cfg.query_instruction)


def vectors_of(chunks: DataFrame, cfg: EmbedConfig) -> retriever.VectorIndex:
    """A vector index of chunks; vectors of equal texts are taken over from the index that cfg names."""
    passages, _ = encoders_of(cfg)
    if not cfg.reuse_index:
        return retriever.VectorIndex.build(chunks, passages, cfg.name)
    old = retriever.VectorIndex.load(chunks.sparkSession, cfg.reuse_index).chunks.withColumn("pos", F.col("chunk_id"))
    return retriever.VectorIndex(reuse_vectors(chunks, old, passages).drop("reused"), cfg.name)


def provider_of(cfg: GenerateConfig) -> Callable[[], Provider]:
    """A maker of providers with cfg's settings; the makers by model name are in PROVIDERS, which a caller may add to."""
    if cfg.model not in PROVIDERS:
        raise ValueError(f"no provider for the model {cfg.model}")
    make = PROVIDERS[cfg.model]
    return lambda: make(cfg)


def rag_of(spark: SparkSession, lexical_path: str, vector_path: str, embed: EmbedConfig, fused: FusionConfig, generator: GenerateConfig) -> retriever.RAG:
    """Answers from two saved indexes."""
    _, queries = encoders_of(embed)
    dense = retriever.Dense(retriever.VectorIndex.load(spark, vector_path), queries, embed.name)
    lexical = retriever.Lexical(retriever.LexicalIndex.load(spark, lexical_path))
    return retriever.RAG(retriever.Hybrid(dense, lexical, fused.dense_weight, fused.pool), provider_of(generator), generator.k, generator.context_tokens, generator.max_new_tokens)
