"""Page cleaning: running heads and feet found by repetition, then taken off the page edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.text import EDGE_LINES, MAX_EDGE_CHARS, collapse, signature, utrim
from pageloom.functions.unicode import nfkc

MIN_PAGES, FREQUENCY = 4, 0.50


def _edge(i: Column, n: Column) -> Column:
    return (i < EDGE_LINES) | (i >= n - EDGE_LINES)


def boilerplate(pages: DataFrame, frequency: float = FREQUENCY, min_pages: int = MIN_PAGES, symmetric: bool = False) -> DataFrame:
    """(doc_name, sig, n): signatures of short edge lines on at least ``frequency`` of a document's pages.

    A page counts once for a signature, which is settled within the page's row, so the only shuffle is the pre-aggregated count.
    Signatures come from raw lines; ``symmetric`` takes them from collapsed ones, as stripping does.
    """
    split = pages.select("doc_name", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines")).withColumn("n", F.size("lines"))
    edges = F.filter("lines", lambda _, i: _edge(i, F.col("n")))
    bare = F.transform(edges, collapse if symmetric else utrim)
    sigs = F.array_distinct(F.transform(F.filter(bare, lambda x: (x != "") & (F.length(x) <= MAX_EDGE_CHARS)), signature))
    counts = split.select("doc_name", F.explode(sigs).alias("sig")).groupBy("doc_name", "sig").agg(F.count(F.lit(1)).alias("n"))
    sizes = pages.groupBy("doc_name").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(sizes, "doc_name").where((F.col("pages") >= min_pages) & (F.col("n") >= frequency * F.col("pages"))).select("doc_name", "sig", "n")


def clean_pages(pages: DataFrame, frequency: float = FREQUENCY, unicode_form: bool = True, symmetric: bool = False) -> DataFrame:
    """pages with cleaned text, char_count_raw and char_count. ``unicode_form`` False leaves NFKC out, and with it the Python worker."""
    found = boilerplate(pages, frequency, symmetric=symmetric).groupBy("doc_name").agg(F.collect_set("sig").alias("sigs"))
    raw = F.coalesce("text", F.lit(""))
    rows = pages.withColumn("char_count_raw", F.length(raw)).withColumn("text", nfkc(raw) if unicode_form else raw)
    # One row a document: small beside the pages, whose hot documents AQE can split.
    rows = rows.join(found, "doc_name", "left")
    rows = rows.withColumn("__lines", F.transform(F.split("text", "\n"), collapse)).withColumn("sigs", F.coalesce("sigs", F.array().cast("array<string>")))
    kept = F.filter("__lines", lambda x, i: ~(_edge(i, F.size("__lines")) & (x != "") & F.array_contains("sigs", signature(x))))
    text = utrim(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))
    return rows.withColumn("text", text).withColumn("char_count", F.length("text")).drop("sigs", "__lines")


def clean_audit(cleaned: DataFrame, found: DataFrame) -> DataFrame:
    """One row a document: pages, characters before and after, share removed, its signatures."""
    sums = cleaned.groupBy("doc_name").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("char_count_raw").alias("chars_raw"), F.sum("char_count").alias("chars_clean")
    )
    sigs = found.groupBy("doc_name").agg(F.array_join(F.sort_array(F.collect_set("sig")), " | ").alias("boilerplate_sigs"), F.countDistinct("sig").alias("n_boilerplate"))
    removed = F.when(F.col("chars_raw") == 0, F.lit(0.0)).otherwise(F.round(100 * (F.col("chars_raw") - F.col("chars_clean")) / F.col("chars_raw"), 2))
    return sums.join(sigs, "doc_name", "left").withColumn("pct_removed", removed).fillna("", ["boilerplate_sigs"]).fillna(0, ["n_boilerplate"])
