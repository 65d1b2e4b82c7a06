"""Fill-in-the-middle: texts cut at two seeded unit boundaries, and written prefix-suffix-middle or suffix-prefix-middle.

Equal texts have equal boundaries, so these are found once for each distinct text that some document cuts. Those texts are grouped by their content itself; each distinct one gets a key of
128 bits and the Elias-Fano list of the places where its units end, some 5 bits a unit. The keys are then counted: should two
texts of the corpus share one, all are keyed anew with the next seed. So a document that meets the index by key has met its own text. Documents are joined to the index by plain exchanges on
both sides, which lets adaptive execution split a text that a third of the documents have; each reads its two cuts out of the list.

Units are ``[white space]*[other]+`` or white space at the end, where white space is U+0020 and U+0009 to U+000D; cuts and lengths count code points. The draw
of a document depends on seed and doc_id alone, so rows repeated or equal in doc_id are cut alike, and a null doc_id draws as an empty one. Null
text is an empty text; empty texts, texts that hold a marker, and the share not drawn stay plain: their units are only counted, where they are. Very long texts are cut like others. An empty table gives an
empty table. All columns are kept; ``n_units``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` replace columns of that name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import _without
from .shared import Stash, bounded_batches, fresh

#: Prefix, suffix, middle.
MARKERS = ("<P>", "<S>", "<M>")
_HEAD = np.dtype([("n", "<u8"), ("low", "u1")])


def unit_ends(raw: bytes) -> np.ndarray:
    """Code points up to the end of each unit of a UTF-8 text."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    space = (b == 0x20) | ((b >= 0x09) & (b <= 0x0D))
    ends = np.flatnonzero(~space & np.append(space[1:], True))
    if space[-1]:
        ends = np.append(ends, len(b) - 1)
    return np.cumsum((b & 0xC0) != 0x80)[ends]


def pack(ends: np.ndarray) -> bytes:
    """The Elias-Fano list of ascending numbers: low bits side by side, high parts as gaps between ones."""
    n = len(ends)
    low = max(0, int(ends[-1] // n).bit_length() - 1) if n else 0
    bits = ((ends[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel() if low else np.zeros(0, np.uint8)
    high = np.zeros(n + int(ends[-1] >> low) + 1 if n else 0, np.uint8)
    high[(ends >> low) + np.arange(n)] = 1
    return np.array([(n, low)], _HEAD).tobytes() + np.packbits(bits, bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def select(packed: bytes, i: int) -> int:
    """The i-th number of the list, from 1; 0 for i = 0. Reads the high parts' bytes, not the numbers before."""
    if i == 0:
        return 0
    n, low = np.frombuffer(packed, _HEAD, 1)[0].tolist()
    start = _HEAD.itemsize + (n * low + 7) // 8
    high = np.frombuffer(packed, np.uint8, offset=start)
    ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
    at = int(np.searchsorted(ones, i))
    before = int(ones[at - 1]) if at else 0
    bit = int(np.flatnonzero(np.unpackbits(high[at : at + 1], bitorder="little"))[i - before - 1])
    first = (i - 1) * low
    whole = int.from_bytes(packed[_HEAD.itemsize + first // 8 : _HEAD.itemsize + (first + low + 7) // 8], "little")
    return ((at * 8 + bit - (i - 1)) << low) | ((whole >> first % 8) & ((1 << low) - 1))


def _key(text: Column, seed: int) -> list[Column]:
    """128 bits of a text."""
    return [F.xxhash64(F.lit(seed), text), F.xxhash64(text, F.lit(seed))]


def text_index(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, int]:
    """(k1, k2, n_units, ends) of each distinct text, and the seed with which no two of them share a key. Texts are combined before they are shuffled."""
    bounded_batches(spark)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("docs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [unit_ends(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(e) for e in ends], pa.int64()), pa.array([pack(e) for e in ends], pa.binary())], ["k1", "k2", "n_units", "ends"])

    for seed in count():
        k1, k2 = _key(F.col("text"), seed)
        made = Stash(spark, texts.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("binary").alias("raw")).mapInArrow(work, "k1 long, k2 long, n_units long, ends binary"), "units")
        if made.df.groupBy("k1", "k2").count().where("count > 1").limit(1).count() == 0:
            return made.df, seed
        made.drop()


@F.pandas_udf(StructType([StructField("a", LongType()), StructField("b", LongType())]))
def _cuts(ends: pd.Series, i: pd.Series, j: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"a": [select(e, x) for e, x in zip(ends, i)], "b": [select(e, x) for e, x in zip(ends, j)]}, dtype="int64")


def fill_in_middle(spark: SparkSession, docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """docs with ``n_units``, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null where plain) and ``output``.

    rate: percent of texts that are cut; spm: percent of those that have the suffix first. A marker is one pair of angle brackets with no other in it, so that
    it cannot arise where a piece of text meets a marker.
    """
    if len({*markers}) != 3 or not all(re.fullmatch("<[^<>]+>", m) for m in markers):
        raise ValueError("markers must be three different names in angle brackets")
    p, s, m = map(F.lit, markers)
    kept = _without(docs, "n_units", "form", "prefix_chars", "middle_chars", "output")
    text, k1, k2, draw, cut, ends = fresh(kept.columns, "body", "k1", "k2", "draw", "cut", "ends")
    rows = kept.withColumn(text, F.coalesce("text", F.lit("")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumn(draw, F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]))
    h = lambda i, n: F.get(draw, F.lit(i)) % n
    plain = (F.col(text) == "") | F.contains(text, p) | F.contains(text, s) | F.contains(text, m) | (h(2, 100) >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h(3, 100) < spm, "spm").otherwise("psm"))
    columns, drawn = [F.col(f"`{c}`") for c in kept.columns], rows.where("form <> 'plain'")

    drawn = drawn.drop(text)  # it is the text itself where there is one
    index, key_seed = text_index(spark, drawn)
    drawn = drawn.withColumns(dict(zip((k1, k2), _key(F.col("text"), key_seed))))
    found = drawn.join(index.select(F.col("k1").alias(k1), F.col("k2").alias(k2), "n_units", F.col("ends").alias(ends)), [k1, k2])
    found = found.withColumn(draw, F.array_sort(F.array(h(0, F.col("n_units") + 1), h(1, F.col("n_units") + 1))))
    found = found.withColumn(cut, _cuts(ends, *[F.get(draw, F.lit(i)) for i in (0, 1)]))
    a, b = F.col(f"{cut}.a").cast("int"), F.col(f"{cut}.b").cast("int")
    prefix, middle, suffix = F.substr("text", F.lit(1), a), F.substr("text", a + 1, b - a), F.substr("text", b + 1)
    output = F.when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.concat(p, prefix, s, suffix, m, middle))
    made = found.select(*columns, "n_units", "form", F.col(f"{cut}.a").alias("prefix_chars"), (F.col(f"{cut}.b") - F.col(f"{cut}.a")).alias("middle_chars"), output.alias("output"))
    n_units = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + F.when(F.rlike(text, F.lit(r"[\x20\x09-\x0D]\z")), 1).otherwise(0)
    none = F.lit(None).cast("long")
    left = rows.where("form = 'plain'").select(*columns, n_units.cast("long").alias("n_units"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col(text).alias("output"))
    return made.unionByName(left)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from."""
    p, s, m = markers
    body, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)

    def swapped(first: str, second: str) -> tuple[Column, Column]:
        return F.substr(F.substring_index(body, second, 1), F.lit(len(first) + 1)), F.substring_index(body, second, -1)

    prefix, suffix = swapped(p, s)
    late_suffix, late_prefix = swapped(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, middle, late_suffix)).otherwise(output)
