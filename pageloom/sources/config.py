"""Configurations from YAML, checked on the driver."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class ChunkConfig:
    name: str
    strategy: str = "recursive"
    chunk_size: int = 256
    chunk_overlap: int = 50
    eval_docs_only: bool = False
    tokenizer: str | None = None  # a file of the tokenizers library, whose tokens sizes are in

    def __post_init__(self):
        if self.strategy not in ("recursive", "fixed"):
            raise ValueError("strategy must be recursive or fixed")
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("chunk_overlap must be smaller than chunk_size")


@dataclass(frozen=True)
class EmbedConfig:
    name: str
    dim: int = 256
    query_instruction: str = ""
    passage_prefix: str = ""
    shard_size: int = 1024
    reuse_index: str | None = None


@dataclass(frozen=True)
class GenerateConfig:
    name: str
    model: str = "extractive"
    k: int = 10
    max_new_tokens: int = 384
    context_tokens: int = 8192
    temperature: float = 0.0
    seed: int = 0


@dataclass(frozen=True)
class FusionConfig:
    dense_weight: float = 0.5
    pool: int = 100
    rrf_c: int = 60

    def __post_init__(self):
        if not 0 <= self.dense_weight <= 1:
            raise ValueError("dense_weight must be between 0 and 1")


def load(kind: type, path: str):
    """A configuration of a kind; unknown keys are left out, missing ones take their defaults, a missing name is an error."""
    import yaml

    with open(path) as f:
        raw = yaml.safe_load(f) or {}
    known = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in raw.items() if k in known})
