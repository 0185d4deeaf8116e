"""Catalog loads composed from the smaller operators: registering a batch
of script versions, building the file catalog of finished jobs, and the
backfills of derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.functions.text import content_checksum, version_or_default
from runlake.operators import files as FL
from runlake.operators.joins import shuffled
from runlake.operators.ranking import row_number_by


def register_versions(versions: DataFrame, scripts: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Load a batch of script files (batch_id, script_name, checksum,
    version_text, description, set_default) in order of batch_id.

    The result is that of loading them one after another, where later rows
    see earlier ones, found by set operations:

    * a file whose (name, checksum) is in the catalog, or came earlier in the
      batch, is a duplicate and names that version (of several in the catalog
      the last by version text and iteration);
    * a name that is not in the catalog makes a script; its id follows the
      largest one, in order of first appearance; its first version is the default;
    * the version text is checked (invalid or missing -> "1"), the iteration
      counts on from the largest of (script, version);
    * a row with ``set_default`` takes the default from all earlier versions
      of its script, those of the catalog and of the batch;
    * an empty description is filled by the first row that has one.

    Returns (rows, scripts, unset): every batch row with its outcome, script,
    version, iteration and whether it is a default in the end; every script
    that got a version, with its description; the catalog versions that are no
    default any more.
    """
    named = versions.join(shuffled(scripts.select("script_id", "script_name")), "script_id")
    existing = named.groupBy("script_name", "checksum").agg(
        F.max_by("version_id", F.struct("script_version", "iteration", "version_id")).alias("existing_id"))
    known = scripts.groupBy("script_name").agg(F.min("script_id").alias("known_id"))
    first = batch.groupBy("script_name", "checksum").agg(F.min("batch_id").alias("first_id"))
    b = (batch.join(shuffled(first), ["script_name", "checksum"]).join(shuffled(existing), ["script_name", "checksum"], "left")
              .join(shuffled(known), "script_name", "left").withColumn("script_version", version_or_default(F.col("version_text"))))
    fresh = b.filter(F.col("existing_id").isNull() & (F.col("batch_id") == F.col("first_id")))
    # a name's first appearance is never a duplicate, so new names can be read from the batch alone
    names = batch.join(shuffled(known), "script_name", "left_anti").groupBy("script_name").agg(F.min("batch_id").alias("made_by"))
    names = row_number_by(names, [], ["made_by"], name="_s").select(
        "script_name", "made_by", (F.col("_s") + F.coalesce(scripts.select(F.max("script_id")).scalar(), F.lit(0))).alias("made_id"))
    fresh = fresh.join(shuffled(names), "script_name", "left").select(
        "batch_id", "script_name", F.coalesce("known_id", "made_id").alias("script_id"), "script_version", "description",
        "set_default", F.coalesce(F.col("made_by") == F.col("batch_id"), F.lit(False)).alias("creates"))
    numbers = row_number_by(fresh.select("batch_id"), [], ["batch_id"], name="_v")
    turns = row_number_by(fresh.select("batch_id", "script_id", "script_version"), ["script_id", "script_version"], ["batch_id"], name="_k")
    base = versions.groupBy("script_id", "script_version").agg(F.max("iteration").alias("_max"))
    taken = fresh.filter(F.col("set_default") & ~F.col("creates")).groupBy("script_id").agg(F.max("batch_id").alias("_last"))
    ids = numbers.select("batch_id", (F.col("_v") + F.coalesce(versions.select(F.max("version_id")).scalar(), F.lit(0))).alias("version_id"))
    new_rows = (fresh.join(shuffled(ids), "batch_id").join(shuffled(turns.select("batch_id", "_k")), "batch_id")
                     .join(shuffled(base), ["script_id", "script_version"], "left").join(shuffled(taken), "script_id", "left")
                     .select("batch_id", F.lit("new").alias("outcome"), "script_id", "version_id", "script_version",
                             (F.coalesce("_max", F.lit(0)) + F.col("_k")).cast("bigint").alias("iteration"),
                             ((F.col("creates") | F.col("set_default")) & (F.col("_last").isNull() | (F.col("batch_id") >= F.col("_last"))))
                             .alias("default_version")))
    dup = b.filter(F.col("existing_id").isNotNull() | (F.col("batch_id") != F.col("first_id")))
    dup_rows = (dup.join(shuffled(ids.select(F.col("batch_id").alias("first_id"), F.col("version_id").alias("first_version"))), "first_id", "left")
                   .join(shuffled(names.select("script_name", "made_id")), "script_name", "left")
                   .select("batch_id", F.lit("duplicate").alias("outcome"), F.coalesce("known_id", "made_id").alias("script_id"),
                           F.coalesce("existing_id", "first_version").alias("version_id"), F.lit(None).cast("string").alias("script_version"),
                           F.lit(None).cast("bigint").alias("iteration"), F.lit(None).cast("boolean").alias("default_version")))
    told = F.when(F.coalesce("description", F.lit("")) != "", F.col("description"))
    after = (fresh.groupBy("script_id").agg(
                F.min_by(told, F.when(told.isNotNull(), F.col("batch_id"))).alias("_told"), F.bool_or("creates").alias("created"),
                F.first("script_name").alias("script_name"))
             .join(shuffled(scripts.select("script_id", F.nullif("description", F.lit("")).alias("_old"))), "script_id", "left")
             .select("script_id", "script_name", F.coalesce("_old", "_told", F.lit("")).alias("description"), "created"))
    unset = versions.filter("default_version").join(shuffled(taken), "script_id", "left_semi").select("version_id", "script_id")
    return new_rows.unionByName(dup_rows), after, unset


def build_file_catalog(refs: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """Catalog rows of job outputs: files named by output parameters plus
    walked files not named by any parameter; each gets a job-salted
    checksum, a type and a group, and is matched to a stored file by
    checksum (reuse, else a new id)."""
    out = refs.filter(F.col("param") == "out").select("file_id")
    known = (out.join(shuffled(files.select("file_id", "path")), "file_id")
                .select(F.concat(F.lit("/srv/media/"), F.col("path")).alias("known_path")))
    # checksum and type are taken as a file is read: all that is shuffled is narrow, contents never are
    walked = FL.classify_files(files.withColumn("checksum", content_checksum("content", "job_id", "path", F.lit("output"))),
                               sniff=False, keep=("job_id", "checksum"))
    # both sources of a file are marked on its row, so that contents are read once for both
    named = out.distinct().withColumn("_named", F.lit("parameter"))
    unlisted = FL.unlisted_outputs(files.select("path").distinct(), known).select(
        F.col("path").alias("_path"), F.lit("walked").alias("_walked"))
    allf = (walked.join(shuffled(named), "file_id", "left").join(shuffled(unlisted), F.col("path").eqNullSafe(F.col("_path")), "left")
                  .select("file_id", "job_id", "path", "checksum", "filetype", F.explode(F.array_compact(F.array("_named", "_walked"))).alias("source")))
    salted = allf.drop("filetype").join(shuffled(allf.select("file_id", "filetype")), "file_id")
    grp = FL.catalog_group(F.col("filetype"), F.col("path"))
    m = FL.match_files(salted.select("file_id", "checksum"), stored.select("file_id", "checksum"))
    return (salted.join(shuffled(m.withColumnRenamed("upload_id", "file_id")), ["file_id", "checksum"])
                  .select("job_id", "file_id", "path", "source", grp.alias("group"), "checksum", "stored_id",
                          "created"))


def backfill_bridge(params: DataFrame) -> DataFrame:
    """Bridge rows (version, parameter): one for each parameter's foreign key to its version; rows without one have none."""
    return params.filter(F.col("version_id").isNotNull()).select("version_id", "param_id").distinct()


def backfill_uuid(jobs: DataFrame) -> DataFrame:
    """A repeatable uuid-shaped key per job derived from its id (sha-256)."""
    h = F.sha2(F.concat(F.lit("job:"), F.col("job_id").cast("string")), 256)
    u = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                    F.substring(h, 17, 4), F.substring(h, 21, 12))
    return jobs.select("job_id", u.alias("uuid"))


def backfill_checksum(files: DataFrame) -> DataFrame:
    return files.select("file_id", F.coalesce(F.col("checksum"), F.sha1("content")).alias("checksum"))


def backfill_parser(spec: DataFrame, versions: DataFrame) -> DataFrame:
    """Each parameter's parser version taken from its script's last version."""
    last = versions.groupBy("script_id").agg(
        F.max_by("version_id", F.struct("script_version", "iteration", "version_id")).alias("last_version_id"))
    return spec.select("param_id", "script_id", "parser_name").join(last, "script_id", "left")
