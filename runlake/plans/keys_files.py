"""Keys of the file inventory family."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.operators import files as FL
from runlake.plans.keys_functions import _ref
from runlake.plans.queries import key


@key("classify_files")
def _classify_files(c):
    """Types of all files; a third of them hold their lines as rows of comma cells, a third as rows of tab cells."""
    table = F.regexp_replace(F.regexp_replace("content", "[,\t\"]", " "), "(?md)^([^ \n]+) ?", F.when(
        F.col("file_id") % 3 == 1, F.lit('$1,"a, ""b"" c",')).otherwise(F.lit("$1\tx\t")))
    content = F.when(F.col("file_id") % 3 == 0, F.col("content")).otherwise(table)
    return FL.classify_files(c.file().withColumn("content", content)).select("file_id", "filetype", "delimiter")


def _typed(c):
    return FL.classify_files(c.file(), sniff=False)


@key("classify_group")
def _classify_group(c):
    return FL.group_summary(_typed(c))


@key("ungrouped_files")
def _ungrouped_files(c):
    return FL.ungrouped_files(_typed(c))


@key("preview_head_tail")
def _preview_head_tail(c):
    return FL.preview(c.cells()).select("file_id", "slot", "row_no", F.array_join("cells", ",").alias("cells"))


@key("preview_fasta")
def _preview_fasta(c):
    return FL.preview_fasta(c.fasta_line())


@key("record_number")
def _record_number(c):
    return FL.number_records(c.fasta_line()).select("file_id", "line_no", "rec_no")


@key("first_per_checksum")
def _first_per_checksum(c):
    return FL.dedup_uploads(c.file())


@key("match_or_insert")
def _match_or_insert(c):
    f = c.file()
    """Uploads matched against stored job outputs by checksum."""
    return FL.match_files(f.filter(~F.col("is_output")), f.filter(F.col("is_output")))


def _purged(c):
    """Jobs whose status is deleted."""
    return c.job().filter(F.col("status") == "deleted").select("job_id")


@key("unreferenced_files")
def _unreferenced_files(c):
    return FL.purge_plan(c.user_file(), _purged(c))


@key("sync_plan")
def _sync_plan(c):
    return FL.sync_plan(c.local(), c.remote())


@key("storage_diff")
def _storage_diff(c):
    f = c.file()
    local = c.local().select("file_id").join(f.select("file_id", "path", "content", "checksum"), "file_id").select(
        "path", "file_id", F.when(F.col("file_id") % 7 == 0, F.sha1(F.concat("content", F.lit("x"))))
                            .otherwise(F.col("checksum")).alias("checksum"))
    return FL.stale_copies(f.select("path", "file_id", "checksum"), local)


@key("write_content_addressed")
def _write_content_addressed(c):
    return FL.write_addressed_paths(c.file())


def _job_names(c):
    j = c.user_file().select("job_id").distinct()
    return j.select("job_id", F.when(F.col("job_id") % 10 == 0, F.lit("src0_en"))
                    .otherwise(F.concat(F.lit("job-"), F.col("job_id").cast("string"))).alias("job_name"))


@key("bundle_manifest")
def _bundle_manifest(c):
    return FL.bundle_manifest(c.user_file(), c.file(), _job_names(c))


@key("unlisted_outputs")
def _unlisted_outputs(c):
    f = c.file()
    known = (c.user_file().filter(F.col("param") == "out").join(f.select("file_id", "path"), "file_id")
              .select(F.concat(F.lit("/srv/media/"), F.col("path")).alias("known_path")))
    return FL.unlisted_outputs(f.select("file_id", "path"), known).select("file_id", "path")


@key("distinct_by_name")
def _distinct_by_name(c):
    return FL.first_by_name(c.file())


@key("available_name")
def _available_name(c):
    f = c.file()
    existing = f.select(F.col("job_id").alias("folder"), F.concat(
        F.split("filename", "_")[0],
        F.when(F.col("file_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("_"), (F.col("file_id") % 3).cast("string"))),
        F.lit(".txt")).alias("filename"))
    requests = f.select(F.col("job_id").alias("folder"), F.split("filename", "_")[0].alias("name"),
                        F.lit("txt").alias("ext")).distinct()
    return FL.available_names(requests, existing)


@key("resolve_file_ref")
def _resolve_file_ref(c):
    f = c.file()
    refs = f.select(F.col("file_id").alias("ref_id"), F.floor(F.col("file_id") / 7).cast("bigint").alias("viewer_id"),
                    _ref(f).alias("ref"))
    return FL.resolve_refs(refs, c.user_file(), f, c.job())


@key("file_previews")
def _file_previews(c):
    t = _typed(c)
    uf = c.user_file().join(c.file().select("file_id", "filename", "size_bytes"), "file_id")
    g = FL.catalog_group(F.col("filetype"), F.col("path"))
    return uf.join(t.select("file_id", "filetype", "path"), "file_id").select(
        "job_id", "file_id", F.col("filename").alias("name"), F.col("param").alias("slug"), "size_bytes",
        F.explode(F.when(g == "all", F.array(F.lit("all"))).otherwise(F.array(g, F.lit("all")))).alias("group"))
