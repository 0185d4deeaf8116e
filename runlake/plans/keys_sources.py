"""Keys of the sources / sinks family (round trips through the shared
scratch folder under ``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.operators.sequences import fasta_records
from runlake.plans.queries import key
from runlake.sources import readers as R
from runlake.sources import writers as W
from runlake.sources.tables import MATRIX_COLS


@key("read_delimited")
def _read_delimited(c):
    """v_matrix written as TSV and read back with a two-column index."""
    path = W.scratch_path(c.spark, "matrix-tsv")
    R.write_tsv(c.matrix(), path)
    back = R.read_delimited(c.spark, path, sep="\t", index=["major", "minor"])
    return back.select(F.col("major").cast("bigint").alias("major"), F.col("minor").cast("bigint").alias("minor"),
                       *[F.round(F.col(m), 6).alias(m) for m in MATRIX_COLS])


@key("write_fasta")
def _write_fasta(c):
    """FASTA records written as text and read back (header, seq)."""
    path = W.scratch_path(c.spark, "fasta")
    R.write_fasta(fasta_records(c.fasta_line()), path)
    return R.read_fasta(c.spark, path).select("header", "seq")


@key("scan_inventory")
def _scan_inventory(c):
    """Recursive listing of the data folder (rows-only check)."""
    return R.scan_inventory(c.spark, c.sf_dir).select("path", "size_bytes", "checksum")


@key("scan_scripts")
def _scan_scripts(c):
    f = c.t("documents")
    ext = F.element_at(F.array(F.lit(".py"), F.lit(".pyc"), F.lit("/__init__.py"), F.lit(".txt")),
                       (F.col("doc_id") % 4 + 1).cast("int"))
    paths = f.select("doc_id", F.concat(F.lit("scripts/"), F.col("source"), F.lit("_"),
                                        F.col("doc_id").cast("string"), ext).alias("path"))
    return paths.filter(R.script_filter(F.col("path")))


def _quoted(df, path, sep):
    """Written with every cell quoted, quotes doubled and line breaks kept."""
    df.write.option("sep", sep).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)


@key("read_sniffed")
def _read_sniffed(c):
    """A comma file of whole texts with line breaks and a tab file of JSON, of unknown dialect, read back."""
    base = W.scratch_path(c.spark, "sniff")
    _quoted(c.t("documents").select("doc_id", "source", "text"), f"{base}/comma", ",")
    c.t("events").select("event_id", "event_type", "props").write.option("sep", "\t").option("escape", '"').csv(f"{base}/tab")
    return R.read_sniffed(c.spark, base + "/*/*.csv").select(
        "delimiter", F.get("cells", F.lit(0)).cast("bigint").alias("id"), F.get("cells", F.lit(1)).alias("name"),
        F.get("cells", F.lit(2)).alias("content"), F.size("cells").cast("bigint").alias("n_cells"))


@key("read_records")
def _read_records(c):
    """Raw pages as one comma file, and the number of cells and the bytes of every record read back."""
    path = W.scratch_path(c.spark, "records")
    _quoted(c.t("pages").select("page_id", "url", "html"), path, ",")
    return R.read_records(c.spark, path, ",").select(
        F.get("cells", F.lit(0)).cast("bigint").alias("page_id"), F.size("cells").cast("bigint").alias("n_cells"),
        F.sha1(F.get("cells", F.lit(2))).alias("html_sha1"))


def _bodies(c):
    e = c.t("events")
    k = F.get_json_object("props", "$.k")
    body = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(
        F.concat(F.lit("k="), k, F.lit("&x=a+b%21&k="), (k.cast("int") + 1).cast("string")))
    ctype = F.when(F.col("event_id") % 2 == 0, F.lit("application/json")).otherwise(
        F.lit("application/x-www-form-urlencoded"))
    return e.select("event_id", body.alias("body"), ctype.alias("ctype"))


@key("read_json_params")
def _read_json_params(c):
    b = _bodies(c)
    return b.select("event_id", F.explode(R.read_params(F.col("body"), F.col("ctype"))).alias("key", "value"))


@key("read_query_string")
def _read_query_string(c):
    pages = c.html().select("page_id", "url")
    spec = c.spark.createDataFrame([("page", False), ("ref", True)], "name string, multiple boolean")
    return R.prefill(pages, spec).select("page_id", "name", F.array_join("values", "|").alias("values"))


@key("write_json")
def _write_json(c):
    """Queue documents (totals + newest 10 per queue) per viewer."""
    return W.queue_document(c.job(), c.user(), 10)


@key("write_tsv")
def _write_tsv(c):
    path = W.scratch_path(c.spark, "tsv")
    R.write_tsv(c.script().select("script_id", "script_name", "script_order"), path)
    back = c.spark.read.option("sep", "\t").option("header", True).csv(path)
    return back.select(F.col("script_id").cast("bigint").alias("script_id"), "script_name",
                       F.col("script_order").cast("int").alias("script_order"))
