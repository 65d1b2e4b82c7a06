"""Samples, subsets, reuse of vectors, and resuming."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified(rows: DataFrame, group: str, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """The rounded fraction of each group, by the order of the MD5 of seed and key; exact, where sampleBy is not.

    Counts by group and by the first four hexadecimal digits of the hash say which rows stay and which go; only the rows of the one digit run
    of a group in which the border lies are ranked, so no window holds a group.
    """
    hashed = rows.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))).withColumn("__d", F.left("__h", F.lit(4)))
    counts = hashed.groupBy(F.col(group).alias("__g"), "__d").agg(F.count(F.lit(1)).alias("__m"))
    whole = Window.partitionBy("__g")
    before = whole.orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__g", F.col("__d").alias("__e"), "__m", F.bround(fraction * F.sum("__m").over(whole), 0).cast("long").alias("__want"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"))
    near = hashed.join(counts.where("__before < __want"), F.equal_null(F.col(group), "__g") & (F.col("__d") == F.col("__e")))
    inside = near.where("__before + __m <= __want").select(rows.columns)
    rank = F.row_number().over(Window.partitionBy("__g", "__d").orderBy("__h", key))
    border = near.where("__before + __m > __want").withColumn("__r", rank).where("__before + __r <= __want").select(rows.columns)
    return inside.unionByName(border)


def head(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by a stated order, as a trial run takes them."""
    return rows.orderBy(order).limit(n)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key; an error where there is none."""
    found = rows.where(F.col(key) == F.lit(value))
    if not found.limit(1).count():
        raise LookupError(f"no {key} {value!r}")
    return found


def preview(rows: DataFrame, order: list[str], n: int = 5, text: str = "text", chars: int = 200) -> DataFrame:
    """The first n rows with white space collapsed and cut to ``chars``, for the eye."""
    cut = F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit(chars))
    return rows.orderBy(*order).limit(n).withColumn(text, cut)


def timed(df: DataFrame, path: str, name: str) -> DataFrame:
    """Write df to path as Parquet; one row (name, n_rows, seconds, rows_per_second)."""
    began = time.perf_counter()
    df.write.parquet(path)
    took = time.perf_counter() - began
    n = df.sparkSession.read.parquet(path).count()
    return df.sparkSession.createDataFrame([(name, n, took, n / took)], "name string, n_rows long, seconds double, rows_per_second double")


def subset(rows: DataFrame, keep: DataFrame, key: str | list[str] = "doc_name") -> DataFrame:
    return rows.join(keep.select(key), key, "left_semi")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not yet in the output."""
    return rows.join(done.select(key), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_name") -> DataFrame:
    """old without the keys of new, then new, in key order."""
    return not_done(old, new, key).unionByName(new).orderBy(key)


def first_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by a stated order (max_by and min_by pre-aggregate, a window would not)."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("r")).select(*key, "r.*")


def last_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("r")).select(*key, "r.*")


def reuse_vectors(chunks: DataFrame, old: DataFrame, encode=None) -> DataFrame:
    """chunks(doc_name, text, ...) with ``embedding`` of the last old row of equal document and text, ``reused``; misses are encoded.

    Texts are compared by their SHA-256, so that no text is shuffled as a key.
    """
    keyed = old.withColumn("__t", F.sha2(F.col("text").cast("binary"), 256))
    last = keyed.groupBy("doc_name", "__t").agg(F.max_by("embedding", "pos").alias("__old"))
    rows = chunks.withColumn("__t", F.sha2(F.col("text").cast("binary"), 256)).join(last, ["doc_name", "__t"], "left")
    fresh: Column = encode(F.when(F.col("__old").isNull(), F.col("text"))) if encode else F.lit(None).cast("array<float>")
    return rows.withColumns({"reused": F.col("__old").isNotNull(), "embedding": F.coalesce(F.col("__old"), fresh)}).drop("__t", "__old")


def shards(rows: DataFrame, pos: str, size: int) -> DataFrame:
    return rows.withColumn("shard_id", F.floor(F.col(pos) / size).cast("int"))


def next_shards(sharded: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """Rows of the first ``most`` shards that are not yet written."""
    missing = not_done(sharded.select("shard_id").distinct(), done, "shard_id").orderBy("shard_id").limit(most)
    return sharded.join(missing, "shard_id", "left_semi")
