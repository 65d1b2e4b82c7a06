"""Keyed state in place of reading the output: many small batches, a batch run again, keys that are forgotten."""

import datetime
import glob
import os

from pageloom.streaming.ingest import append_new, current, newest


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def paths(tmp_path):
    return tuple(f"{tmp_path}/{x}" for x in ("landing", "out", "check"))


def forget_last_commit(check):
    last = max(glob.glob(f"{check}/commits/[0-9]*"), key=lambda f: int(os.path.basename(f)))
    os.remove(last)
    crc = f"{check}/commits/.{os.path.basename(last)}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def test_small_batches_and_a_batch_run_again(spark, tmp_path):
    landing, out, check = paths(tmp_path)
    for i in range(6):
        land(spark, [(j, f"v{i}") for j in range(i * 4, i * 4 + 8)] + [(None, "none")], "id long, v string", landing)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    query = append_new(spark, landing, "id long, v string", out, check, "id", transform=lambda d: d.where("v <> 'v3'"), files_per_batch=1)
    query.awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    progress = [p for p in query.recentProgress if p["numInputRows"]]
    assert len(progress) == 6 and {p["numInputRows"] for p in progress} == {9}  # its own file, not what came before
    want = {r.id for r in spark.read.parquet(out).collect()}
    rows = spark.read.parquet(out).collect()
    assert len(rows) == len(want) and want >= {0, 1, None} and all(r.v != "v3" for r in rows)
    forget_last_commit(check)
    append_new(spark, landing, "id long, v string", out, check, "id", transform=lambda d: d.where("v <> 'v3'"), files_per_batch=1).awaitTermination()
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, rows))
    land(spark, [(0, "late"), (99, "new")], "id long, v string", landing)
    append_new(spark, landing, "id long, v string", out, check, "id").awaitTermination()
    assert {(r.id, r.v) for r in spark.read.parquet(out).where("id IN (0, 99)").collect()} == {(0, "v0"), (99, "new")}


def test_keys_are_forgotten(spark, tmp_path):
    landing, out, check = paths(tmp_path)
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    for h in (0, 1, 30, 60, 60):
        land(spark, [(1, at(h), h)], "id long, ts timestamp, h int", landing)
        append_new(spark, landing, "id long, ts timestamp, h int", out, check, "id", ts="ts", delay="10 hours").awaitTermination()
    assert sorted(r.h for r in spark.read.parquet(out).collect()) == [0, 60]  # at 30 h the watermark still stood at 1 h less the delay


def test_newest_row(spark, tmp_path):
    landing, out, check = paths(tmp_path)
    for i in range(5):
        land(spark, [(k, i if k % 2 else -i, f"{k}at{i}") for k in range(i, i + 4)], "id long, n int, v string", landing)
        newest(spark, landing, "id long, n int, v string", out, check, "id", "n", files_per_batch=1).awaitTermination()
    want = {k: f"{k}at{min(4, k) if k % 2 else max(0, k - 3)}" for k in range(8)}
    assert {r.id: r.v for r in current(spark, out, "id").collect()} == want
    forget_last_commit(check)
    newest(spark, landing, "id long, n int, v string", out, check, "id", "n", files_per_batch=1).awaitTermination()
    assert {r.id: r.v for r in current(spark, out, "id").collect()} == want
