"""Reciprocal-rank fusion of two ranked lists, for one weight or many."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_C, POOL = 60, 100


def fuse(dense: DataFrame, lexical: DataFrame, weights: DataFrame, k: int = 20, c: int = RRF_C, pool: int = POOL) -> DataFrame:
    """dense and lexical (query_id, chunk_id, rank), weights(weight) -> (weight, query_id, chunk_id, rrf, rank).

    A side of weight 0 brings no rows. Ties keep the order of first sight: dense by rank, then those that are lexical only.
    A weights table is a handful of rows; the ranked lists are made once and serve all of them.
    """
    both = dense.where(F.col("rank") <= pool).select("query_id", "chunk_id", "rank", F.lit(0).alias("side")).unionByName(
        lexical.where(F.col("rank") <= pool).select("query_id", "chunk_id", "rank", F.lit(1).alias("side"))
    )
    w = F.when(F.col("side") == 0, F.col("weight")).otherwise(1.0 - F.col("weight"))
    rows = both.crossJoin(F.broadcast(weights)).withColumn("w", w).where("w <> 0")
    summed = rows.groupBy("weight", "query_id", "chunk_id").agg(F.sum(F.col("w") / (c + F.col("rank"))).alias("rrf"), F.min(F.col("side") * pool + F.col("rank")).alias("seen"))
    summed = summed.withColumn("rrf", F.round("rrf", 9))
    order = Window.partitionBy("weight", "query_id").orderBy(F.desc("rrf"), "seen")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("weight", "query_id", "chunk_id", "rrf", "rank")
