"""Paired statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sign_test(wins_a: Column, wins_b: Column) -> Column:
    """Exact two-sided binomial p of two win counts, summed in logarithms, so that no power underflows."""
    n, low = wins_a + wins_b, F.least(wins_a, wins_b)
    half = n * F.log(F.lit(2.0))
    step = lambda s, i: F.struct(
        (s["log_c"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))).alias("log_c"),
        (s["p"] + F.exp(s["log_c"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) - half)).alias("p"),
    )
    start = F.struct(F.lit(0.0).alias("log_c"), F.exp(-half).alias("p"))
    ks = F.filter(F.sequence(F.lit(0).cast("long"), low.cast("long")), lambda k: k > 0)
    total = F.aggregate(ks, start, step, lambda s: s["p"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total))


def paired_bootstrap(details: DataFrame, metrics: list[str], samples: int = 5000, seed: int = 42) -> DataFrame:
    """details(variant, query_id, metric columns; one variant is 'baseline') -> value, delta and its 95 % interval for each variant and metric.

    Resamples are drawn by MD5 of seed, sample and place, so a run repeats; one draw serves all variants and metrics of as many questions, which
    keeps the pairing. Draws are rows, counted by (sample, question) before they meet the differences: nothing gathers a variant in one row.
    """
    long = details.unpivot(["variant", "query_id"], metrics, "metric", "x").withColumn("x", F.col("x").cast("double"))
    base = long.where("variant = 'baseline'").select("query_id", "metric", F.col("x").alias("base"))
    paired = long.join(base, ["query_id", "metric"]).withColumn("d", F.col("x") - F.col("base"))
    sides = paired.groupBy("variant", "metric").agg(F.avg("x").alias("value"), F.avg("d").alias("delta_vs_baseline"), F.count(F.lit(1)).alias("n_questions"))
    place = F.row_number().over(Window.partitionBy("variant", "metric").orderBy("query_id")) - 1
    placed = paired.select("variant", "metric", "d", place.cast("long").alias("j")).join(sides.select("variant", "metric", F.col("n_questions").alias("n")), ["variant", "metric"])
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("r").cast("string"), F.col("i").cast("string")).cast("binary"))
    sizes = sides.select(F.col("n_questions").alias("n")).distinct()
    draws = details.sparkSession.range(samples).withColumnRenamed("id", "r").crossJoin(F.broadcast(sizes)).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    counts = draws.select("r", "n", (F.conv(F.left(draw, F.lit(8)), 16, 10).cast("long") % F.col("n")).alias("j")).groupBy("r", "n", "j").agg(F.count(F.lit(1)).alias("c"))
    means = counts.join(placed, ["n", "j"]).groupBy("variant", "metric", "r").agg((F.sum(F.col("c") * F.col("d")) / F.first("n")).alias("m"))
    span = means.groupBy("variant", "metric").agg(F.percentile("m", [0.025, 0.975]).alias("ci"))
    out = sides.join(span, ["variant", "metric"])
    return out.select("variant", "metric", "value", "delta_vs_baseline", F.col("ci")[0].alias("delta_ci95_low"), F.col("ci")[1].alias("delta_ci95_high"), "n_questions")
