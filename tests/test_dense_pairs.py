import math
import random

from pageloom.operators import dense
from pageloom.operators.dense import best_of_each, inner_product
from pyspark.sql import functions as F


def test_odd_vectors_and_products(spark):
    """Matrix products give what expressions give, for null, short, long, huge and non-finite vectors too."""
    rnd = random.Random(2)
    vectors = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(150)]
    vectors += [None, [], [1.0] * 7, [1.0] * 9, [None] + [1.0] * 7, [math.inf] + [0.0] * 7, [math.nan] * 8, [1e200] * 8, [0.0] * 8]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, v array<double>")
    for queries in (df.where("vec_id % 10 = 0"), df.where("vec_id >= 145"), df.where("vec_id = 150"), df.limit(0)):
        queries = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        for k in (3, 200):
            want = best_of_each(queries.crossJoin(df).select("query_id", "vec_id", F.round(inner_product("q", "v"), 6).alias("score")), "vec_id", k)
            rows = lambda d: sorted((r.query_id, r.rank, r.vec_id, str(r.score)) for r in d.collect())
            assert rows(dense.dense_top_k(queries, df, k)) == rows(want)


def test_pairs_of_even_vectors_meet_no_lambda(spark, monkeypatch):
    seen, own = [], dense.dense_top_k_blocks
    monkeypatch.setattr(dense, "dense_top_k_blocks", lambda spark, q, c, *more: seen.append((q.count(), c.count())) or own(spark, q, c, *more))
    df = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v"))
    dense.dense_top_k(df.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), df).count()
    assert seen == [(5, 50)]
