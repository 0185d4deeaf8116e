"""Sinks: JSON queue documents, content-addressed file store, scratch tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.operators.files import write_addressed_paths
from runlake.operators.jobs import queue_top, queue_totals
from runlake.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a
    machine-local temp folder on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def queue_document(jobs: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """Per viewer (users and the anonymous viewer): queue totals and the
    newest ``n`` job ids of each queue as one JSON document."""
    tot = queue_totals(jobs, users)
    top = queue_top(jobs, users, n)
    glob = top.filter(F.col("queue") == "global").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "job_id"))), lambda x: x["job_id"]).alias("g")
    ).scalar()
    per = top.filter(F.col("queue") != "global").groupBy("viewer_id").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("queue") == q, F.struct("rank", "job_id")))),
                      lambda x: x["job_id"]).alias(q) for q in ("user", "results")])
    t = tot.withColumnRenamed("user_id", "viewer_id")
    j = t.join(per, t["viewer_id"].eqNullSafe(per["viewer_id"]), "left").select(t["viewer_id"], *[
        c for c in ("global_total", "user_total", "results_total")], "user", "results")
    empty = F.array().cast("array<bigint>")
    doc = F.struct(
        F.struct(F.col("global_total").alias("global"), F.col("user_total").alias("user"),
                 F.col("results_total").alias("results")).alias("totals"),
        F.struct(F.coalesce(glob, empty).alias("global"), F.coalesce(F.col("user"), empty).alias("user"),
                 F.coalesce(F.col("results"), empty).alias("results")).alias("items"))
    return j.select("viewer_id", F.to_json(doc).alias("document"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_addressed(files: DataFrame, root: str) -> DataFrame:
    """Add each checksum that the store does not hold yet, once, laid out by
    checksum prefix and suffix folders (``partitionBy``), and return the path
    table.  One file id per checksum is chosen first, so contents are read
    once and never aggregated."""
    paths = write_addressed_paths(files, root)
    chosen = files.groupBy("checksum").agg(F.min("file_id").alias("file_id"))
    if folder_exists(files.sparkSession, root):
        stored = files.sparkSession.read.schema("checksum string").parquet(root)
        chosen = chosen.join(stored, "checksum", "left_anti")
    content = files.select("file_id", "content").join(chosen, "file_id").select("checksum", "content")
    new = paths.join(content, "checksum").repartition("prefix", "suffix")
    new.write.mode("append").partitionBy("prefix", "suffix").parquet(root)
    return paths


def folder_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
