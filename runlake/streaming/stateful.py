"""Streams with keyed state, timers and an initial state, and the catalog sink.

* ``stream_favorites`` starts from the favorites table and emits changes only.
* ``stream_output_blocks`` keeps the chunks of open output blocks in list
  state and appends a block once: when it is full, or when an event-time timer
  says that nothing came for a while.
* ``stream_dead_status`` sets the failure status of jobs that went silent.
* ``catalog_sink`` merges uploads into a file catalog, one folder per epoch.

State lives in RocksDB and is dropped with its block, job or key, so it is as
large as what is open, not as what has passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runlake.operators.jobs import FAILED, TERMINAL_STATES
from runlake.operators.joins import shuffled
from runlake.streaming.streams import ROCKSDB, _exists

FAVORITE = ["user_id", "content_type", "object_id"]


def use_rocksdb(spark: SparkSession) -> None:
    """These operators need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# ---------------------------------------------------------------- favorites
BUCKETS = 1 << 15     # fixed for good: a checkpoint holds its state by these buckets
CHANGE = Row(*FAVORITE, "is_favorite")


class Toggle(StatefulProcessor):
    """The favorites of one bucket that are on; an even number of toggles of a favorite in a batch changes nothing and emits nothing.

    A bucket is read and written once per batch: calls of the state, and the Arrow batch that Spark makes for each
    key, cost a hundred times more than a toggle.  It has no state while none of its favorites is on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.on = handle.getValueState("on", "favorites array<struct<user_id: bigint, content_type: string, object_id: bigint>>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.on.update(([tuple(f[c] for c in FAVORITE) for f in initialState["favorites"]],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        odd = set()
        for r in rows:
            odd ^= {r[:len(FAVORITE)]}
        if not odd:
            return
        before = {tuple(f) for f in (self.on.get() or ([],))[0]}
        after = before ^ odd
        if after:
            self.on.update(([*after],))
        else:
            self.on.clear()
        for f in odd:
            yield CHANGE(*f, f in after)

    def close(self) -> None:
        pass


def _bucket(df: DataFrame) -> DataFrame:
    """Only the columns of a favorite, these first, and its bucket."""
    return df.select(*FAVORITE, F.pmod(F.xxhash64(*FAVORITE), F.lit(BUCKETS)).alias("bucket"))


def stream_favorites(toggles: DataFrame, favorites: DataFrame) -> DataFrame:
    """Favorites that a micro-batch of toggles changed (update mode), from the given favorites on."""
    use_rocksdb(toggles.sparkSession)
    begun = _bucket(favorites.select(*FAVORITE).distinct()).groupBy("bucket").agg(F.collect_list(F.struct(*FAVORITE)).alias("favorites"))
    return _bucket(toggles).groupBy("bucket").transformWithState(
        statefulProcessor=Toggle(), outputStructType="user_id long, content_type string, object_id long, is_favorite boolean",
        outputMode="Update", timeMode="None", initialState=begun.groupBy("bucket"))


def favorites_after(favorites: DataFrame, changes: DataFrame) -> DataFrame:
    """The favorites once the last change of every key is applied."""
    kept = favorites.select(*FAVORITE).distinct().join(shuffled(changes.select(*FAVORITE)), FAVORITE, "left_anti")
    return kept.unionByName(changes.where("is_favorite").select(*FAVORITE))


# ------------------------------------------------------------- output blocks
class Block(StatefulProcessor):
    """Chunks of one output block until it is full or silent."""

    def __init__(self, size: int, silence_ms: int):
        self.size, self.silence_ms = size, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "seq long, chunk string")
        self.seen = handle.getValueState("seen", "n long, last_ms long")

    def _emit(self, key, full: bool) -> Iterator[pd.DataFrame]:
        parts = sorted(self.chunks.get(), key=lambda p: p[0])
        self.chunks.clear()
        self.seen.clear()
        yield pd.DataFrame({"job_id": [key[0]], "channel": [key[1]], "block": [key[2]],
                            "text": ["".join(p[1] or "" for p in parts)], "n_chunks": [len(parts)], "full": [full]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last = self.seen.get() if self.seen.exists() else (0, 0)
        for batch in rows:
            self.chunks.appendList([(int(s), c) for s, c in zip(batch["seq"], batch["chunk"])])
            n, last = n + len(batch), max(last, int(batch["ts_ms"].max()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if n >= self.size:
            yield from self._emit(key, True)
        else:
            self.seen.update((n, last))
            self.handle.registerTimer(last + self.silence_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            yield from self._emit(key, False)

    def close(self) -> None:
        pass


def stream_output_blocks(chunks: DataFrame, delay: str = "10 minutes", silence_ms: int = 600_500, block_size: int = 1024) -> DataFrame:
    """Text of finished blocks (append mode) of chunks (job_id, channel, seq, chunk, ts).

    A block holds ``block_size`` consecutive chunks of a (job, channel); it is
    finished when all are there, or when the watermark passes its last chunk
    by ``silence_ms``.  Chunks behind the watermark are late and dropped, as in any append stream."""
    use_rocksdb(chunks.sparkSession)
    c = chunks.withWatermark("ts", delay).withColumns({
        "block": F.floor(F.col("seq") / block_size).cast("bigint"), "ts_ms": F.unix_millis("ts")})
    return c.groupBy("job_id", "channel", "block").transformWithStateInPandas(
        statefulProcessor=Block(block_size, silence_ms),
        outputStructType="job_id long, channel string, block long, text string, n_chunks long, full boolean",
        outputMode="Append", timeMode="EventTime")


# ------------------------------------------------------------------ dead jobs
class Deadline(StatefulProcessor):
    """Last sign of life of a job; silence before a terminal status makes it fail."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last_ms long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before, ended = self.last.get() or (None, False)
        last = before
        for r in rows:
            last = last if r["ts_ms"] is None else max(last or 0, int(r["ts_ms"]))
            ended = ended or r["status"] in TERMINAL_STATES
        self.last.update((last, ended))
        # a job has one timer, at its last sign of life and the silence
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.silence_ms)
            self.handle.registerTimer(last + self.silence_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, ended = self.last.get() or (0, True)
        self.last.clear()
        if not ended:
            yield Row(job_id=key[0], status=FAILED, dead_at_ms=last + self.silence_ms)

    def close(self) -> None:
        pass


def stream_dead_status(events: DataFrame, delay: str = "1 hour", silence_ms: int = 3_600_500) -> DataFrame:
    """(job_id, status, dead_at_ms) of jobs that had no event (job_id, status, ts) for ``silence_ms`` (append mode).

    A terminal status ends a job; its state stays until the same silence has passed, so
    that stragglers do not revive it."""
    use_rocksdb(events.sparkSession)
    e = events.withWatermark("ts", delay).withColumn("ts_ms", F.unix_millis("ts")).select("job_id", "status", "ts", "ts_ms")
    return e.groupBy("job_id").transformWithState(
        statefulProcessor=Deadline(silence_ms), outputStructType="job_id long, status string, dead_at_ms long",
        outputMode="Append", timeMode="EventTime")


# -------------------------------------------------------------- catalog sink
def catalog_sink(location: str) -> Callable[[DataFrame, int], None]:
    """Merge of uploads (file_id, checksum, uploaded_at, ...) into the catalog at ``location``, for ``foreachBatch``.

    Every epoch writes one folder with its files: ``stored_id`` is the file
    that holds the content, one of an earlier epoch or else the first upload of this one
    (by time and id), and ``created`` marks that file.  An epoch reads only the
    folders of earlier epochs and replaces its own, so replaying it after a
    failure gives the same rows, and no ledger can disagree with the data."""
    base = location.rstrip("/")

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("file_id", "checksum", "uploaded_at")
        first = rows.groupBy("checksum").agg(F.min_by("file_id", F.struct("uploaded_at", "file_id")).alias("first_id"))
        stored = catalog_files(spark, base, epoch)
        known = stored.where("created").select("checksum", F.col("stored_id").alias("known_id"))
        made = rows.join(first, "checksum").join(known, "checksum", "left").select(
            "file_id", "checksum", "uploaded_at", F.coalesce("known_id", "first_id").alias("stored_id"),
            (F.col("known_id").isNull() & (F.col("file_id") == F.col("first_id"))).alias("created"))
        made.write.mode("overwrite").parquet(f"{base}/epoch={epoch}")

    return merge


CATALOG = "file_id long, checksum string, uploaded_at timestamp, stored_id long, created boolean"


def catalog_files(spark: SparkSession, location: str, before: int | None = None) -> DataFrame:
    """Files of the catalog, of the epochs before the given one if any."""
    base = location.rstrip("/")
    if not _exists(spark, base):
        return spark.createDataFrame([], CATALOG)
    rows = spark.read.schema(f"{CATALOG}, epoch long").parquet(base)
    return (rows if before is None else rows.where(F.col("epoch") < before)).drop("epoch")


def run_catalog(uploads: DataFrame, location: str) -> DataFrame:
    """Drive the sink with all uploads that are there, and return the catalog; a run with the same location goes on."""
    base = location.rstrip("/")
    q = (uploads.writeStream.foreachBatch(catalog_sink(f"{base}/catalog")).option("checkpointLocation", f"{base}/checkpoint")
                .trigger(availableNow=True).start())
    q.awaitTermination()
    return catalog_files(uploads.sparkSession, f"{base}/catalog")
