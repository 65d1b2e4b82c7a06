"""Queries on building the corpus: cleaning, chunking, manifests, sampling, reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import chunking, cleaning, sampling, subwords
from pageloom.sources.files import html_text
from pageloom.streaming.ingest import windowed_counts

FREQUENCY = 0.15


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pages(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("source").alias("doc_name"), (F.col("doc_id") + 1).cast("int").alias("page_number"), "text")


def _md5(c: str):
    return F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")


def boilerplate_signatures(spark, sf_dir):
    return cleaning.boilerplate(_pages(spark, sf_dir), FREQUENCY)


def clean_pages(spark, sf_dir):
    return cleaning.clean_pages(_pages(spark, sf_dir), FREQUENCY).select("doc_name", "page_number", "char_count_raw", "char_count", _md5("text"))


def clean_audit(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return cleaning.clean_audit(cleaning.clean_pages(pages, FREQUENCY), cleaning.boilerplate(pages, FREQUENCY))


def fixed_windows(spark, sf_dir):
    return chunking.fixed_windows(_pages(spark, sf_dir)).select("doc_name", "page_number", "local_index", "n_tokens", _md5("text"))


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def subword_windows(spark, sf_dir):
    """Windows of 256 subword tokens, 50 shared."""
    return subwords.ruled_windows(_pages(spark, sf_dir), 256, 50, subwords.tokenizer_ruler(_tokenizer())).select("doc_name", "page_number", "local_index", "n_tokens", _md5("text"))


def subword_chunks(spark, sf_dir):
    """The recursive splitter in subword tokens."""
    return chunking.recursive_chunks(_pages(spark, sf_dir), make_ruler=subwords.tokenizer_ruler(_tokenizer())).select("doc_name", "page_number", "local_index", "n_tokens", _md5("text"))


def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(_pages(spark, sf_dir))


def chunk_numbering(spark, sf_dir):
    return chunking.numbered(chunking.fixed_windows(_pages(spark, sf_dir))).select("chunk_id", "doc_name", "page_number", "chunk_index", "n_tokens")


def chunk_stats_percentiles(spark, sf_dir):
    s = chunking.chunk_stats(chunking.fixed_windows(_pages(spark, sf_dir)))
    return s.select("n_chunks", "n_docs", *[F.round(c, 6).alias(c) for c in ("mean_tokens", "median_tokens", "p95_tokens")], "max_tokens")


def stratified_pilot(spark, sf_dir):
    return sampling.stratified(_read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


def subset_by_docs(spark, sf_dir):
    toxic = _read(spark, sf_dir, "labels").where("toxic = 1").join(_read(spark, sf_dir, "documents"), "doc_id").select("lang", "source").distinct()
    return sampling.subset(_read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), toxic, ["lang", "source"])


def vector_reuse(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("doc_name"), "text")
    old = docs.join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    old = old.select("doc_name", "text", F.array(F.col("doc_id").cast("float")).alias("embedding"), F.col("doc_id").alias("pos"))
    return sampling.reuse_vectors(docs, old).select("doc_id", "reused", F.col("embedding")[0].cast("long").alias("old_pos"))


def manifest_first_dedupe(spark, sf_dir):
    rows = _read(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "doc_id", "source")
    return sampling.first_by(rows, ["text_md5"], "doc_id")


def last_record_wins(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return sampling.last_by(rows, ["user_id"], "event_id")


def manifest_upsert(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    old = nation.select(F.col("n_name").alias("doc_name"), F.lit("old").alias("status"))
    europe = _read(spark, sf_dir, "region").where("r_name = 'EUROPE'")
    new = nation.join(europe, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("doc_name"), F.lit("new").alias("status"))
    return sampling.upsert(old, new)


def resume_anti_join(spark, sf_dir):
    return sampling.not_done(_read(spark, sf_dir, "documents").select("doc_id", "source"), _read(spark, sf_dir, "labels"), "doc_id")


def next_missing_shards(spark, sf_dir):
    sharded = sampling.shards(_read(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 64)
    return sampling.next_shards(sharded, spark.createDataFrame([(0,), (2,)], "shard_id int"), 3)


def html_pages_extract(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text")).select("page_id", F.length("text").cast("long").alias("n_chars"), _md5("text"))


def events_by_hour(spark, sf_dir):
    w = windowed_counts(_read(spark, sf_dir, "events"))
    return w.select(F.unix_seconds("window.start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (
    boilerplate_signatures, clean_pages, clean_audit, fixed_windows, subword_windows, subword_chunks, recursive_chunks, chunk_numbering, chunk_stats_percentiles, stratified_pilot, subset_by_docs,
    vector_reuse, manifest_first_dedupe, last_record_wins, manifest_upsert, resume_anti_join, next_missing_shards, html_pages_extract, events_by_hour,
)}

_WS = r"[\s\x{85}\p{Z}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _sig(x: str) -> str:
    return rf"regexp_replace(lower({_trim(x)}), '\d+', '#', 'g')"


_PAGES = "p AS (SELECT source AS doc_name, CAST(doc_id + 1 AS INTEGER) AS page_number, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)"
_BOILER = f"""{_PAGES},
edges AS (SELECT DISTINCT doc_name, page_number, {_sig("line")} AS sig FROM (
    SELECT doc_name, page_number, len(lines) AS n, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM p)
  WHERE (i < 3 OR i >= n - 3) AND {_trim("line")} <> '' AND length({_trim("line")}) <= 60),
sizes AS (SELECT doc_name, count(*) AS pages FROM p GROUP BY doc_name),
boiler AS (SELECT doc_name, sig, count(*) AS n FROM edges GROUP BY doc_name, sig),
kept_sigs AS (SELECT b.* FROM boiler b JOIN sizes s USING (doc_name) WHERE pages >= 4 AND n >= {FREQUENCY} * pages)"""
_CLEAN = f"""{_BOILER},
ln AS (SELECT doc_name, page_number, len(lines) AS n, unnest(range(0, len(lines))) AS i, unnest(list_transform(lines, lambda x: {_trim("regexp_replace(x, '[ \t]+', ' ', 'g')")})) AS line FROM p),
stay AS (SELECT ln.* FROM ln WHERE NOT ((i < 3 OR i >= n - 3) AND line <> '' AND EXISTS (SELECT 1 FROM kept_sigs k WHERE k.doc_name = ln.doc_name AND k.sig = {_sig("line")}))),
joined AS (SELECT doc_name, page_number, string_agg(line, chr(10) ORDER BY i) AS body FROM stay GROUP BY doc_name, page_number),
cleaned AS (SELECT p.doc_name, p.page_number, CAST(length(p.text) AS INTEGER) AS char_count_raw, {_trim("regexp_replace(coalesce(body, ''), '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM p LEFT JOIN joined USING (doc_name, page_number))"""
_RULER = r"[\p{L}\p{M}\p{N}\p{Pc}]+|[^\s\x{85}\p{Z}\p{L}\p{M}\p{N}\p{Pc}]"
_WINDOWS = f"""{_PAGES},
toks AS (SELECT doc_name, page_number, regexp_extract_all(text, '{_RULER}') AS t FROM p),
wins AS (SELECT doc_name, page_number, CAST(i AS INTEGER) AS local_index, list_slice(t, i * 206 + 1, i * 206 + 256) AS w
  FROM (SELECT doc_name, page_number, t, unnest(range(0, CAST(greatest(ceil((len(t) - 256) / 206.0), 0) AS BIGINT) + 1)) AS i FROM toks WHERE len(t) > 0))"""

SQL = {
    "boilerplate_signatures": f"WITH {_BOILER} SELECT * FROM kept_sigs",
    "clean_pages": f"WITH {_CLEAN} SELECT doc_name, page_number, char_count_raw, CAST(length(text) AS INTEGER) AS char_count, md5(text) AS text_md5 FROM cleaned",
    "clean_audit": f"""WITH {_CLEAN},
s AS (SELECT doc_name, count(*) AS pages, CAST(sum(char_count_raw) AS BIGINT) AS chars_raw, CAST(sum(length(text)) AS BIGINT) AS chars_clean FROM cleaned GROUP BY doc_name),
b AS (SELECT doc_name, string_agg(sig, ' | ' ORDER BY sig) AS boilerplate_sigs, count(*) AS n_boilerplate FROM kept_sigs GROUP BY doc_name)
SELECT doc_name, pages, chars_raw, chars_clean, coalesce(boilerplate_sigs, '') AS boilerplate_sigs, coalesce(n_boilerplate, 0) AS n_boilerplate,
  CASE WHEN chars_raw = 0 THEN 0.0 ELSE round(100.0 * (chars_raw - chars_clean) / chars_raw, 2) END AS pct_removed FROM s LEFT JOIN b USING (doc_name)""",
    "fixed_windows": f"WITH {_WINDOWS} SELECT doc_name, page_number, local_index, CAST(len(w) AS INTEGER) AS n_tokens, md5(array_to_string(w, ' ')) AS text_md5 FROM wins",
    "chunk_numbering": f"""WITH {_WINDOWS}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_name ORDER BY page_number, local_index) - 1 AS INTEGER) AS chunk_index FROM wins)
SELECT doc_name || '__p' || page_number || '__c' || chunk_index AS chunk_id, doc_name, page_number, chunk_index, CAST(len(w) AS INTEGER) AS n_tokens FROM n""",
    "chunk_stats_percentiles": f"""WITH {_WINDOWS} SELECT count(*) AS n_chunks, count(DISTINCT doc_name) AS n_docs, round(avg(len(w)), 6) AS mean_tokens, round(CAST(median(len(w)) AS DOUBLE), 6) AS median_tokens,
  round(CAST(quantile_cont(len(w), 0.95) AS DOUBLE), 6) AS p95_tokens, CAST(max(len(w)) AS BIGINT) AS max_tokens FROM wins""",
    "stratified_pilot": """SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, count(*) OVER (PARTITION BY o_orderpriority) AS n,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= round_even(0.2 * n, 0)""",
    "subset_by_docs": "SELECT doc_id, lang, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l JOIN documents x USING (doc_id) WHERE toxic = 1 AND x.source = d.source AND x.lang = d.lang)",
    "vector_reuse": """WITH old AS (SELECT lang, text, max(doc_id) AS pos FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang, text)
SELECT doc_id, pos IS NOT NULL AS reused, pos AS old_pos FROM documents d LEFT JOIN old ON old.lang = d.lang AND old.text = d.text""",
    "manifest_first_dedupe": "SELECT md5(text) AS text_md5, min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY md5(text)",
    "last_record_wins": "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "manifest_upsert": "SELECT n_name AS doc_name, CASE WHEN r_name = 'EUROPE' THEN 'new' ELSE 'old' END AS status FROM nation JOIN region ON n_regionkey = r_regionkey",
    "resume_anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "next_missing_shards": """WITH s AS (SELECT vec_id, CAST(floor(vec_id / 64) AS INTEGER) AS shard_id FROM embeddings)
SELECT vec_id, shard_id FROM s WHERE shard_id IN (SELECT DISTINCT shard_id FROM s WHERE shard_id NOT IN (0, 2) ORDER BY shard_id LIMIT 3)""",
    "html_pages_extract": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '', '') AS t FROM pages),
b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, length(text) AS n_chars, md5(text) AS text_md5 FROM b""",
    "events_by_hour": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
