"""Explicit schemas of all datasets; nothing is inferred."""

MANIFEST = "doc_name STRING, doc_link STRING, status STRING, http_status INT, file_size_bytes BIGINT, error_message STRING, downloaded_at TIMESTAMP"
CATALOG = "doc_name STRING, doc_link STRING"
RAW_PAGE = "doc_name STRING, page_number INT, text STRING, char_count INT"
CLEAN_PAGE = "doc_name STRING, page_number INT, text STRING, char_count_raw INT, char_count INT"
CHUNK = "chunk_id STRING, doc_name STRING, page_number INT, chunk_index INT, text STRING, n_tokens INT, n_chars INT"
QUESTION = (
    "question_id STRING, question_type STRING, doc_name STRING, company STRING, question STRING, answer STRING, "
    "evidence ARRAY<STRUCT<doc_name: STRING, evidence_page_num: INT, evidence_text: STRING>>"
)
HIT = "query_id STRING, rank INT, score DOUBLE, chunk_id STRING, doc_name STRING, page_number INT, text STRING"
