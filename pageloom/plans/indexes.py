"""Queries on what is kept and changed: stored indexes, streams with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.operators.cells import CellIndex
from pageloom.operators.postings import StoredIndex, small
from pageloom.store import scratch
from pageloom.streaming.ingest import append_new, current, newest

from .retrieval import _DENSE, _INDEX, _bm25, _chunks, _queries, _read, _vectors


def bm25_topk_stored(spark, sf_dir):
    """bm25_topk from a stored index: the blocks of the asked terms, without those that cannot reach the first ten."""
    path = scratch(spark, "stored")
    StoredIndex.create(path, _chunks(spark, sf_dir))
    return StoredIndex.open(spark, path).top_k(_queries(spark, sf_dir), 10)


def _maintained(spark, sf_dir) -> StoredIndex:
    """Labelled documents with stale texts first, then all others, then the labelled ones anew, and the toxic ones taken out."""
    path, docs, labels = scratch(spark, "stored"), _chunks(spark, sf_dir), _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), "toxic")
    labelled = docs.join(small(labels.select("chunk_id")), "chunk_id", "left_semi").select("chunk_id", "text")
    StoredIndex.create(path, labelled.withColumn("text", F.concat(F.lit("stale "), F.reverse("text"))))
    StoredIndex.open(spark, path).extended(docs)
    StoredIndex.open(spark, path).replaced(labelled)
    return StoredIndex.open(spark, path).without(labels.where("toxic = 1"))


def index_maintained(spark, sf_dir):
    return _maintained(spark, sf_dir).top_k(_queries(spark, sf_dir), 10)


def index_compacted(spark, sf_dir):
    return _maintained(spark, sf_dir).compacted().top_k(_queries(spark, sf_dir), 10)


def index_maintained_terms(spark, sf_dir):
    """Document frequencies after all that, by decrement."""
    return _maintained(spark, sf_dir).terms()


def index_subset_topk(spark, sf_dir):
    """bm25_topk over the documents of good quality, from an index that was cut out of the index of all."""
    good = _read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"))
    return StoredIndex.create(scratch(spark, "stored"), _chunks(spark, sf_dir)).subset(scratch(spark, "subset"), good).top_k(_queries(spark, sf_dir), 10)


def dense_topk_cells(spark, sf_dir):
    """dense_topk from a stored index that leaves out the cells that cannot reach the first ten."""
    queries, corpus = _vectors(spark, sf_dir)
    path = scratch(spark, "cells")
    CellIndex.create(path, corpus)
    return CellIndex.open(spark, path).top_k(queries, 10)


def dense_cells_extended(spark, sf_dir):
    """The same from an index of the vectors with labels, extended by all."""
    queries, corpus = _vectors(spark, sf_dir)
    path, labelled = scratch(spark, "cells"), _read(spark, sf_dir, "embeddings").where("label IS NOT NULL").select("vec_id")
    CellIndex.create(path, corpus.join(labelled, "vec_id", "left_semi"))
    return CellIndex.open(spark, path).extended(corpus).top_k(queries, 10)


def dense_cells_subset(spark, sf_dir):
    """The same over the vectors of three labels, cut out of the index of all."""
    queries, corpus = _vectors(spark, sf_dir)
    wanted = _read(spark, sf_dir, "embeddings").where("label IN (1, 4, 7)").select("vec_id")
    return CellIndex.create(scratch(spark, "cells"), corpus).subset(scratch(spark, "subset"), wanted).top_k(queries, 10)


def stream_append_small_batches(spark, sf_dir):
    """Events land in many files, all of them twice; a file is a batch, and each event comes out once."""
    landing, out, checkpoint = (scratch(spark, t) for t in ("landing", "out", "checkpoint"))
    events = _read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    for _ in range(2):
        events.repartition(6, "event_type").write.mode("append").parquet(landing)
        append_new(spark, landing, events.schema, out, checkpoint, "event_id", files_per_batch=1).awaitTermination()
    return spark.read.parquet(out)


def stream_newest_rows(spark, sf_dir):
    """The last event of each user, as files of events come in."""
    landing, out, checkpoint = (scratch(spark, t) for t in ("landing", "out", "checkpoint"))
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    events.repartition(6, "event_type").write.parquet(landing)
    newest(spark, landing, events.schema, out, checkpoint, "user_id", "event_id", files_per_batch=2).awaitTermination()
    return current(spark, out, "user_id")


QUERIES = {f.__name__: f for f in (bm25_topk_stored, index_maintained, index_compacted, index_maintained_terms, index_subset_topk, dense_topk_cells, dense_cells_extended, dense_cells_subset, stream_append_small_batches, stream_newest_rows)}


def _over(where: str) -> str:
    return _INDEX.replace("FROM documents", f"FROM (SELECT * FROM documents WHERE {where})")


_LIVE = "doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
_TOP = f"{_bm25(10)} SELECT query_id, chunk_id, score, rank FROM hits"

SQL = {
    "bm25_topk_stored": f"WITH {_INDEX}, {_TOP}",
    "index_maintained": f"WITH {_over(_LIVE)}, {_TOP}",
    "index_compacted": f"WITH {_over(_LIVE)}, {_TOP}",
    "index_maintained_terms": f"WITH {_over(_LIVE)} SELECT term, df FROM idf",
    "index_subset_topk": f"WITH {_over('doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)')}, {_TOP}",
    "dense_topk_cells": _DENSE,
    "dense_cells_extended": _DENSE,
    "dense_cells_subset": _DENSE.replace("FROM v a, v b WHERE", "FROM v a, (SELECT * FROM v WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label IN (1, 4, 7))) b WHERE"),
    "stream_append_small_batches": "SELECT event_id, event_type, value FROM events",
    "stream_newest_rows": "SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id",
}
