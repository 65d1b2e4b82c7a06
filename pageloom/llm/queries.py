"""The queries of this subpackage and their SQL; each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontaminate, fim, langid, lines, lmscore, mix, pq, secrets, sharding, simhash


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    held_out = F.coalesce(remainder == 0, F.lit(False))
    model = langid.fit_language_id(docs.where(remainder != 0))  # a document without an id has no remainder and is not learned from
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return lmscore.score(spark, docs, *lmscore.fit(spark, docs)).drop("text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = secrets.corpus_words(docs)
    found = secrets.find_secrets(docs, secrets.fit_forest(secrets.example_table(spark), words, path="path"), words, path="source")
    return found.select("doc_id", "word", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.round("score", 9).alias("score"), "is_secret")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sharding.shard_by_size(spark, docs, shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash.simhash_components(spark, docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(spark, docs, benchmark, span=10, keep_text=False)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "\\### Assistant: </turn> ok"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    done = chat.format_chats(turns.unionByName(more)).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = bpe.bpe_decode(spark, bpe.bpe_encode(spark, docs, path, tokenizers.PATTERN, keep_text=False), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = lines.line_dedup(spark, docs, keep_emptied=True)
    return left.select("doc_id", F.length("text").cast("long").alias("chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = lambda text: F.when(text != "", F.sha2(text.cast("binary"), 256)).otherwise("")
    aligned = align.align(spark, docs, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"), finish=digest)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("aligned").alias("groups_sha256")]
    return align.with_link_sums(spark, aligned.drop("text")).select(*columns)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fim.fill_in_middle(spark, docs, seed=42, rate=50, spm=80)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix.mix(spark, docs, weights=(3, 1, 2), share=1.5, most=2.0).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_secret_scan": op4_secret_scan,
    "op5_sharding": op5_sharding,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_chat_format": op8_chat_format,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_line_dedup": op10_line_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_mix": op13_source_mix,
}

SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT vec_id AS v, vec_id AS w FROM embeddings UNION SELECT v, b FROM reach JOIN links ON w = a),
least AS (SELECT v, min(w) AS c FROM reach GROUP BY v),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN least ON vec_id = v LEFT JOIN counts ON vec_id = a
""",
    "op7_decontamination": r"""
WITH folded AS (
  SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded),
items AS (SELECT id, w, least(len(w), 10) AS n FROM words WHERE kind = 'b' AND len(w) > 0),
windows AS (
  SELECT DISTINCT id AS item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
spots AS (
  SELECT id AS doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows) WHERE kind = 'd' AND len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, spots.n FROM spots JOIN windows ON spots.g = windows.g AND spots.n = windows.n),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN marks ON id = marks.doc_id LEFT JOIN found ON id = found.doc_id WHERE kind = 'd'
""",
    "op8_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t'), '</part>', '\p') AS et,
         replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), '</part>', '\p'), chr(10), '\n') AS er,
         role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS same
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(et) + CASE WHEN same THEN 7 ELSE 13 + length(er) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS r FROM d),
f AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS i, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS j,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT *, coalesce(array_to_string(list_slice(w, 1, i), ''), '') AS a, coalesce(array_to_string(list_slice(w, i + 1, j), ''), '') AS b, coalesce(array_to_string(list_slice(w, j + 1, n), ''), '') AS c
  FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
""",
}
