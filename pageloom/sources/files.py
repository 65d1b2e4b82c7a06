"""Readers and writers: Parquet, JSON lines, CSV, raw documents, provenance."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines; tolerant leaves malformed rows out, as a cut-off last line is one."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def jsonl_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(accepted, n): how many lines a tolerant reader takes, and how many it leaves out."""
    broken = "_broken"
    parsed = spark.read.text(path).select(F.from_json("value", f"{schema}, {broken} string", {"columnNameOfCorruptRecord": broken}).alias("j"))
    return parsed.groupBy(F.col(f"j.{broken}").isNull().alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with null fields written out."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file; for summaries, which are a few rows."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_once(df: DataFrame, path: str) -> None:
    """Parquet, left alone where it exists."""
    df.write.mode("ignore").parquet(path)


def raw_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_name, content, size_bytes, is_pdf) of each file; the first four bytes tell a PDF from an error page."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(name.alias("doc_name"), "content", F.col("length").alias("size_bytes"), is_pdf(F.col("content")).alias("is_pdf"))


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


#: bytes -> text of each page
Parser = Callable[[bytes], list[str]]


def parse_pages(raw: DataFrame, parsers: dict[str, Parser]) -> DataFrame:
    """(parser, doc_name, status, page_number, text, char_count, error_message, seconds): a row a page, 1-based, null text empty; seconds for the whole document.

    A parser that fails on a document gives one row with its error; other parsers and documents go on.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, content in zip(f["doc_name"], f["content"]):
                for name, parse in parsers.items():
                    began = time.perf_counter()
                    try:
                        pages = list(parse(bytes(content)))
                        took = time.perf_counter() - began
                        out += [(name, doc, "ok", i, t or "", len(t or ""), None, took) for i, t in enumerate(pages, 1)]
                    except Exception as e:  # noqa: BLE001 - a document's own failure is data here
                        out.append((name, doc, "failed", None, None, None, str(e)[:200], time.perf_counter() - began))
            yield pd.DataFrame(out, columns=[*kinds]).astype({"page_number": "Int32", "char_count": "Int32"})

    kinds = {"parser": "string", "doc_name": "string", "status": "string", "page_number": "int", "text": "string", "char_count": "int", "error_message": "string", "seconds": "double"}
    return raw.select("doc_name", "content").mapInPandas(work, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def parse_manifest(pages: DataFrame) -> DataFrame:
    """One row for each parser and document: pages, characters, error."""
    return pages.groupBy("parser", "doc_name").agg(
        F.max("status").alias("status"), F.count("page_number").alias("pages"), F.coalesce(F.sum("char_count"), F.lit(0)).alias("chars"), F.max("error_message").alias("error_message"), F.max("seconds").alias("seconds")
    )


def download(manifest: DataFrame, present: DataFrame, fetch: Callable[[str], tuple[int, bytes]], least_bytes: int = 50_000) -> DataFrame:
    """manifest rows whose document is not yet there in full size, fetched: doc_name, status, http_status, content, error_message.

    ``fetch`` does the request and its retries; only 200 with a PDF's first bytes counts as downloaded.
    """
    full = present.where(F.col("size_bytes") > least_bytes).select("doc_name")
    todo = manifest.join(full, "doc_name", "left_anti").select("doc_name", "doc_link")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for doc, link in zip(f["doc_name"], f["doc_link"]):
                try:
                    code, body = fetch(link)
                    good = code == 200 and body[:4] == b"%PDF"
                    out.append((doc, "downloaded" if good else "failed", code, body if good else None, None if good else f"HTTP {code}"))
                except Exception as e:  # noqa: BLE001 - a link's own failure is data here
                    out.append((doc, "failed", None, None, str(e)[:200]))
            yield pd.DataFrame(out, columns=["doc_name", "status", "http_status", "content", "error_message"]).astype({"http_status": "Int32"})

    return todo.mapInPandas(work, "doc_name string, status string, http_status int, content binary, error_message string")


def with_retries(fetch: Callable[[str], tuple[int, bytes]], tries: int = 4, backoff: float = 1.5, again: tuple[int, ...] = (500, 502, 503, 504), sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[int, bytes]]:
    """fetch, asked again after an error or one of the codes in ``again``, each time after twice the wait; the last answer or error counts."""

    def run(link: str) -> tuple[int, bytes]:
        for n in range(tries):
            try:
                code, body = fetch(link)
                if code not in again or n == tries - 1:
                    return code, body
            except OSError:
                if n == tries - 1:
                    raise
            sleep(backoff * 2**n)
        raise ValueError("tries must be positive")

    return run


def mirror_manifest(listing: DataFrame, present: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(doc_name, doc_link) of a mirror's listing(name, download_url) for files of the suffix that are not in present(name) yet."""
    todo = listing.where(F.endswith("name", F.lit(suffix))).join(present.select("name"), "name", "left_anti")
    return todo.select(F.expr(f"left(name, length(name) - {len(suffix)})").alias("doc_name"), F.col("download_url").alias("doc_link"))


def html_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags out, the five named entities back, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def provenance(spark: SparkSession, config: dict, count: int, seconds: float) -> DataFrame:
    """One row that says how an output was made."""
    row = spark.createDataFrame([(str(config.get("name", "")), {k: str(v) for k, v in config.items()}, count, seconds)], "name string, config map<string,string>, rows long, seconds double")
    return row.withColumn("built_at", F.current_timestamp())
