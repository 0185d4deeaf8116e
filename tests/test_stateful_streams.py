"""Streams with state: several micro-batches, a stop after one of them, and replays, against the batch result."""

import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from runlake.streaming import stateful as SF
from runlake.streaming import streams as ST

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def folder_of(spark, batches, schema):
    """One file per micro-batch, in order."""
    d = tempfile.mkdtemp(prefix="runlake-st-")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(d)
    return d


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def stopped_after_one(stream, name, location, mode, spark):
    """The first micro-batch only: the source is run until it has made one epoch, then stopped."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)

    def sink(batch, epoch):
        if epoch > 0:
            raise RuntimeError("stopped")
        batch.write.mode("overwrite").parquet(f"{location}/table/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{location}/checkpoint") \
        .trigger(availableNow=True).start()
    with pytest.raises(Exception, match="stopped"):
        q.awaitTermination()


TOGGLE = "user_id long, content_type string, object_id long"


def test_favorites_start_from_the_table_and_survive_a_stop(spark):
    favorites = spark.createDataFrame([(1, "f", 1), (1, "f", 2), (2, "f", 1), (2, "f", 1), (9, "f", 9)], TOGGLE)
    batches = [[(1, "f", 1), (3, "f", 1), (3, "f", 2), (3, "f", 2)], [(1, "f", 1), (3, "f", 1), (1, "f", 2)],
               [(3, "f", 1), (2, "f", 1), (4, "f", 4), (4, "f", 4)]]
    folder = folder_of(spark, batches, TOGGLE)
    want = {(1, 1), (9, 9), (3, 1)}           # on at first, xor an odd number of toggles
    for stop in (False, True):
        place = tempfile.mkdtemp(prefix="runlake-st-")
        if stop:
            stopped_after_one(SF.stream_favorites(source(spark, folder, TOGGLE), favorites), "f", place, "update", spark)
        changes = ST.run_stream(SF.stream_favorites(source(spark, folder, TOGGLE), favorites), "f", "update", SF.FAVORITE, place)
        assert {(r["user_id"], r["object_id"]) for r in SF.favorites_after(favorites, changes).collect()} == want
        # a key whose toggles cancel out in its batch is not emitted
        assert (3, 2) not in {(r["user_id"], r["object_id"]) for r in changes.collect()}
        assert (4, 4) not in {(r["user_id"], r["object_id"]) for r in changes.collect()}


CHUNK = "job_id long, channel string, seq long, chunk string, ts timestamp"


def test_blocks_are_appended_once(spark):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, "stdout", 2, "c", at(3)), (1, "stdout", 0, "a", at(1)), (2, "stdout", 0, "x", at(2))],
               [(1, "stdout", 1, "b", at(4)), (1, "stdout", 3, None, at(5)), (1, "stderr", 0, "e", at(6))],
               [(3, "stdout", 0, "late job", at(4000))], [(4, "stdout", 0, "open", at(9000))]]
    folder = folder_of(spark, batches, CHUNK)
    for stop in (False, True):
        place = tempfile.mkdtemp(prefix="runlake-st-")
        make = lambda: SF.stream_output_blocks(source(spark, folder, CHUNK), "10 minutes", 600_500, 3)
        if stop:
            stopped_after_one(make(), "b", place, "append", spark)
        got = sorted(tuple(r) for r in ST.run_stream(make(), "b", "append", location=place).collect())
        assert got == [(1, "stderr", 0, "e", 1, False), (1, "stdout", 0, "abc", 3, True), (1, "stdout", 1, "", 1, False),
                       (2, "stdout", 0, "x", 1, False), (3, "stdout", 0, "late job", 1, False)]


EVENT = "job_id long, status string, ts timestamp"


def test_silent_jobs_fail_once(spark):
    at = lambda m: START + timedelta(minutes=m)
    batches = [[(1, "running", at(0)), (2, "running", at(1)), (3, "running", at(2))],
               [(1, "running", at(50)), (2, "completed", at(30)), (4, "submitted", at(40))],
               [(5, "running", at(600))], [(5, "running", at(650)), (6, "running", at(900))]]
    folder = folder_of(spark, batches, EVENT)
    got = {r["job_id"]: (r["status"], r["dead_at_ms"]) for r in ST.run_stream(
        SF.stream_dead_status(source(spark, folder, EVENT)), "d", "append").collect()}
    ms = lambda m: int(at(m).timestamp() * 1000) + 3_600_500
    assert got == {1: ("FAILURE", ms(50)), 3: ("FAILURE", ms(2)), 4: ("FAILURE", ms(40)), 5: ("FAILURE", ms(650))}


UPLOAD = "file_id long, checksum string, uploaded_at timestamp"


def test_replaying_an_epoch_changes_nothing(spark):
    at = lambda s: START + timedelta(seconds=s)
    batches = [[(1, "a", at(5)), (2, "a", at(4)), (3, "b", at(6))], [(4, "a", at(1)), (5, "c", at(2)), (6, "c", at(2))], [(7, "b", at(9))]]
    folder = folder_of(spark, batches, UPLOAD)
    place = tempfile.mkdtemp(prefix="runlake-cat-")
    rows = lambda df: sorted((r["file_id"], r["stored_id"], r["created"]) for r in df.collect())
    made = rows(SF.run_catalog(source(spark, folder, UPLOAD), place))
    assert made == [(1, 2, False), (2, 2, True), (3, 3, True), (4, 2, False), (5, 5, True), (6, 5, False), (7, 3, False)]
    sink = SF.catalog_sink(f"{place}/catalog")
    for epoch in (1, 0, 2):
        sink(spark.createDataFrame(batches[epoch], UPLOAD), epoch)
        assert rows(SF.catalog_files(spark, f"{place}/catalog")) == made
    # a further run with the same location sees only new files
    spark.createDataFrame([(8, "c", at(20))], UPLOAD).coalesce(1).write.mode("append").parquet(folder)
    assert rows(SF.run_catalog(source(spark, folder, UPLOAD), place)) == [*made, (8, 5, False)]
    assert SF.catalog_files(spark, f"{place}/none").count() == 0
