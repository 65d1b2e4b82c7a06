"""What several operators need beside stored tables: batches, free names, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.store import Stash, bounded_batches, stash

__all__ = ["Stash", "bounded_batches", "components", "fresh", "stash"]

def fresh(taken: list[str], *names: str) -> list[str]:
    """names, each with as many leading underscores as it takes not to be one of taken, in any case."""
    known = {t.lower() for t in taken}
    out = []
    for name in names:
        while (name := f"_{name}").lower() in known:
            pass
        out.append(name)
    return out


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components: edges(a long, b long) -> (v long, root long), root the smallest vertex.

    Each round takes, for every vertex, the least grandparent among its neighbours, offers that to
    the vertex and to its parent, and replaces parents by grandparents, until nothing changes. Rounds
    grow with the logarithm of the longest path. All joins have plain exchanges on both sides, so that
    AQE can split a hub; all minima are pre-aggregated. Self loops and null ends are ignored; a vertex without
    an edge is not returned; no edges give no rows.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    once = edges.where("a <> b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    e = Stash(spark, once, "edges")
    both = e.df.unionByName(e.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parent = Stash(
        spark,
        both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("p"), F.lit(True).alias("moved")),
        "parents",
    )
    while True:
        up = parent.df.select(F.col("v").alias("q"), F.col("p").alias("gp"))
        grand = Stash(spark, parent.df.join(up, F.col("p") == F.col("q")).select("v", "p", "gp"), "grand")
        seen = (
            both.join(grand.df.select(F.col("v").alias("b"), "gp"), "b")
            .groupBy(F.col("a").alias("v"))
            .agg(F.min("gp").alias("m"))
        )
        best = grand.df.join(seen, "v", "left").select("v", "p", F.least("p", "gp", "m").alias("c"))
        offers = best.select("v", "c", F.col("p").alias("old")).unionByName(
            best.select(F.col("p").alias("v"), "c", F.lit(None).cast("long").alias("old"))
        )
        nxt = Stash(
            spark,
            offers.groupBy("v").agg(F.min("c").alias("p"), F.max("old").alias("old")).select("v", "p", (F.col("p") < F.col("old")).alias("moved")),
            "parents",
        )
        parent.drop()
        grand.drop()
        parent = nxt
        if parent.df.where("moved").limit(1).count() == 0:
            e.drop()
            return parent.df.select("v", F.col("p").alias("root"))
