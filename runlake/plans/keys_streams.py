"""Keys of the streaming family: each stream runs to completion with
``Trigger.AvailableNow`` and must equal its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.plans.queries import key
from runlake.sources import tables as T
from runlake.sources.writers import scratch_path
from runlake.streaming import stateful as SF
from runlake.streaming import streams as ST


def _events(c):
    return ST.read_stream(c.spark, c.sf_dir, "events")


@key("stream_output")
def _stream_output(c):
    chunks = T.v_chunk(ST.read_stream(c.spark, c.sf_dir, "conversations"))
    return ST.run_stream(ST.stream_output(chunks), "output", "complete")


@key("stream_status")
def _stream_status(c):
    ev = T.v_status_event(_events(c))
    return ST.run_stream(ST.stream_status(ev), "status", "complete")


@key("stream_dead_jobs")
def _stream_dead_jobs(c):
    hb = _events(c).select(F.col("user_id").alias("job_id"), "ts")
    out = ST.run_stream(ST.stream_dead_jobs(hb, "6 hours"), "dead", "append")
    return out.select("job_id", F.unix_micros("first_beat").alias("first_beat_us"),
                      F.unix_micros("dead_at").alias("dead_at_us"), "beats")


@key("stream_queue_depth")
def _stream_queue_depth(c):
    out = ST.run_stream(ST.stream_queue_depth(T.v_job(_events(c))), "depth", "complete")
    return out.select(F.unix_micros("w.start").alias("window_start_us"),
                      "n_jobs", "running", "submitted", "finished")


@key("stream_favorites")
def _stream_favorites(c):
    """Favorites after a stream of toggles that starts from the favorites table."""
    toggles = T.v_toggle(_events(c)).select("user_id", F.lit("userfile").alias("content_type"),
                                            F.col("object_id").cast("bigint").alias("object_id"))
    changes = ST.run_stream(SF.stream_favorites(toggles, c.favorite()), "favorites", "update", keys=SF.FAVORITE)
    return SF.favorites_after(c.favorite(), changes)


@key("stream_output_blocks")
def _stream_output_blocks(c):
    """Blocks of two chunks that are full or silent; a conversation is a job that writes a chunk a second."""
    chunks = T.v_chunk(ST.read_stream(c.spark, c.sf_dir, "conversations"))
    chunks = chunks.withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("job_id") * 60 + F.col("seq")))
    return ST.run_stream(SF.stream_output_blocks(chunks, block_size=2), "blocks", "append")


@key("stream_dead_status")
def _stream_dead_status(c):
    """Jobs without a terminal status that went silent, and when."""
    ev = T.v_status_event(_events(c)).select("job_id", "status", ST.event_time("ts").alias("ts"))
    return ST.run_stream(SF.stream_dead_status(ev, "6 hours", 21_600_500), "dead_status", "append")


@key("stream_catalog")
def _stream_catalog(c):
    """Uploads merged into a file catalog: which stored file holds each upload."""
    files = T.v_file(ST.read_stream(c.spark, c.sf_dir, "documents")).select(
        "file_id", "checksum", F.timestamp_seconds(F.lit(1704067200) - F.col("file_id") * 7).alias("uploaded_at"))
    return SF.run_catalog(files, scratch_path(c.spark, "catalog")).select("file_id", "checksum", "stored_id", "created")


@key("stream_uploads")
def _stream_uploads(c):
    files = T.v_file(ST.read_stream(c.spark, c.sf_dir, "documents"))
    return ST.run_stream(ST.stream_uploads(files), "uploads", "append")


@key("stream_last_used")
def _stream_last_used(c):
    out = ST.run_stream(ST.stream_last_used(T.v_request(_events(c)), c.key(), c.user()), "last_used", "complete")
    return out.select("key_id", "user_id", "n_requests", F.unix_micros(ST.event_time("last_used")).alias("last_used_us"))


@key("stream_expiry")
def _stream_expiry(c):
    return ST.run_stream(ST.stream_expiry(T.v_job(_events(c)), "2024-01-31 00:00:00", "10 days", "20 days"),
                         "expiry", "append")


@key("stream_files")
def _stream_files(c):
    """New files of the data folder through the binary file stream (rows-only)."""
    out = ST.run_stream(ST.stream_files(c.spark, c.sf_dir, "*.parquet"), "files", "append",
                        finish=ST.large_files(c.sf_dir, "*.parquet"))
    return out.select(F.substring_index("path", "/", -1).alias("name"), "size_bytes", "checksum")


@key("stream_output_stateful")
def _stream_output_stateful(c):
    chunks = T.v_chunk(ST.read_stream(c.spark, c.sf_dir, "conversations"))
    return ST.run_stream(ST.stream_output_stateful(chunks, c.job()), "output_state", "update",
                         keys=["job_id", "channel"])
