"""Text to vectors: a pluggable encoder, and a hashed one that needs no model."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_encoder(dim: int = 256) -> Callable[[list[str]], np.ndarray]:
    """Signed hashed counts of word tokens, at length one; a text without tokens is zero."""
    find = re.compile("[a-z0-9]+").findall

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for t in find((text or "").lower()):
                h = zlib.crc32(t.encode())
                row[h % dim] += 1 if h >> 31 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    return encode


def encode_column(make_encoder: Callable[[], Callable[[list[str]], np.ndarray]] = hashed_encoder, prefix: str = "") -> Callable[[Column], Column]:
    """A column function text -> array<float>; the encoder is made once a worker. Null text gives null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            vectors = encode([prefix + t for t in texts.fillna("")])
            yield pd.Series([None if t is None else v for t, v in zip(texts, vectors)])

    return run
