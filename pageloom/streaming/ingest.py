"""Incremental ingest: new files in, rows not seen before out, with a checkpoint instead of a list of what is done."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _keys_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, not on the heap; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def append_new(
    spark: SparkSession, landing: str, schema, out: str, checkpoint: str, key: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, file_format: str = "parquet", files_per_batch: int = 100, ts: str | None = None, delay: str | None = None
) -> StreamingQuery:
    """Take landed files in batches, drop rows whose key came before, transform the rest, append. Ends when all files are in.

    The keys that came are state, partitioned by key and kept with the checkpoint, so a batch reads its own rows and the state of its own keys, not the output; a row without a key is
    a key of its own. The sink's log has each batch once: one that is run again after a failure changes nothing. ``transform`` is a plan of rows (select, where, explode, static joins).
    With ``ts`` and ``delay`` keys are forgotten once the watermark is that far past their event time, so the state does not grow with the history; a key that comes again after that counts as new.
    Rows of ``out`` that this stream did not write are neither looked at nor read back.
    """
    rows = spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_batch).load(landing)
    fresh = rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]) if ts and delay else rows.dropDuplicates([key])
    with _keys_on_disk(spark):
        return transform(fresh).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, landing: str, schema, out: str, checkpoint: str, key: str, order: str, file_format: str = "parquet", files_per_batch: int = 100) -> StreamingQuery:
    """The newest row of each key by ``order``, kept as state; ``current`` reads what came out. Each batch gives the keys that it changed.

    A batch goes to its own folder by its number, over what an earlier run of that batch left, so a batch that is run again changes nothing.
    """
    rows = spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_batch).load(landing)
    others = [F.col(c) for c in rows.columns if c != key]
    changed = rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("row")).select(key, "row.*")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with _keys_on_disk(spark):
        return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, key: str) -> DataFrame:
    """What ``newest`` holds now: of each key the row of its last batch."""
    rows = spark.read.parquet(out)
    own = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*own), "batch").alias("row")).select(key, "row.*")


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums by event time, with late rows up to ``late``; for batch and stream alike."""
    timed = events.withColumn("__t", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__t", late)
    return timed.groupBy(F.window("__t", width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
