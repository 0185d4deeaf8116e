"""Readers of delimited, FASTA, JSON/form and URL inputs, and folder scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlake.functions.delimited import HEAD, delimiter_of, ends_inside, split_cells
from runlake.functions.text import last_wins_map
from runlake.operators.joins import shuffled
from runlake.operators.ranking import row_number_by
from runlake.sources.checksums import checksummed

SLICE_BITS = 14   # lines of a file block are scanned in slices of up to 2 ** 14


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", index: str | list[str] | None = None,
                   schema=None, numeric: bool = True) -> DataFrame:
    """Delimited file with a header row.  The index (key) columns default to
    the first column; with ``numeric`` every other column is cast to DOUBLE
    (``try_cast``: text cells become NULL)."""
    r = spark.read.option("sep", sep).option("header", True)
    df = (r.schema(schema) if schema is not None else r).csv(path)
    keys = [index] if isinstance(index, str) else (index or [df.columns[0]])
    if not numeric or schema is not None:
        return df
    return df.select(*keys, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns if c not in keys])


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA files to (path, rec_no, header, seq).

    The text source splits on ``\\n>`` so each row is one record; files are
    split between tasks by Hadoop's record reader.  Only the first row of a
    file still has its ``>``; without one it is sequence under an empty
    header.  Record numbers follow file order and are computed without a
    per-file window.
    """
    raw = (spark.read.option("lineSep", "\n>").text(path)
                .select(F.col("_metadata.file_path").alias("path"), F.col("value"),
                        F.monotonically_increasing_id().alias("_pos")))
    first = raw.groupBy("path").agg(F.min("_pos").alias("_first"))
    headless = (F.col("_pos") == F.col("_first")) & ~F.startswith("value", F.lit(">"))
    raw = raw.join(first, "path").select("path", "_pos", F.when(headless, F.concat(F.lit("\n"), "value")).when(
        F.col("_pos") == F.col("_first"), F.substr("value", F.lit(2))).otherwise(F.col("value")).alias("value"))
    lines = F.split("value", "\n")
    rec = raw.select("path", "_pos", F.rtrim(F.element_at(lines, 1), F.lit("\r")).alias("header"),
                     F.array_join(F.transform(F.slice(lines, 2, 1 << 30), lambda l: F.btrim(l, F.lit(" \t\r"))), "")
                      .alias("seq"))
    rec = rec.filter(F.col("seq") != "")
    return row_number_by(rec, ["path"], ["_pos"], name="rec_no").drop("_pos")


def write_fasta(df: DataFrame, path: str, header: str = "header", seq: str = "seq", mode: str = "overwrite") -> None:
    """Header (with ``>``) and sequence lines per record."""
    h = F.when(F.startswith(F.col(header), F.lit(">")), F.col(header)).otherwise(F.concat(F.lit(">"), F.col(header)))
    df.select(F.concat_ws("\n", h, F.col(seq)).alias("value")).write.mode(mode).text(path)


def scan_inventory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Recursive listing: relative path, size, sha1 and modification time.

    Hashed on the executors; large files in blocks (``sources/checksums.py``).
    """
    df = checksummed(spark, root, glob)
    base = root.rstrip("/") + "/"
    return df.select(
        F.regexp_replace(F.col("path"), r"^file:", "").alias("abs_path"),
        F.col("length").alias("size_bytes"), "checksum",
        F.col("modificationTime").alias("modified")).withColumn(
        "path", F.substring_index(F.col("abs_path"), base.rstrip("/").split("/")[-1] + "/", -1))


def script_filter(path: Column) -> Column:
    """Import filter: ``.py`` files only, never ``.pyc`` or ``__init__``."""
    return F.endswith(path, F.lit(".py")) & ~F.contains(path, F.lit("__init__"))


def scan_scripts(spark: SparkSession, folder: str) -> DataFrame:
    return checksummed(spark, folder, "*.py").filter(script_filter(F.col("path"))).select(
        "path", F.col("length").alias("size_bytes"), "checksum")


def _file_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, _block (where its file block starts), _id (order within the block), value: lines, files split between tasks."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_id"), "value")


def _composed(order: Window, jump: Column, stay: Column) -> tuple[Column, Column]:
    """Last jump in front of a row, and whether an odd number of flips lies between it and the row.

    A line (or block) maps "inside quotes or not" in front of it to the same
    behind it: it jumps to a fixed value (``jump``, else null), or flips, or keeps it (``stay``)."""
    flips = F.sum(F.when(jump.isNull() & ~stay, 1).otherwise(0))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(jump.isNotNull(), F.struct(jump.alias("to"), F.col("_flips").alias("at"))), ignorenulls=True).over(before)
    return flips.over(upto), last


def _inside(last: Column, flips_before: Column, opened: Column) -> Column:
    odd = lambda n: n % 2 == 1
    return F.when(last.isNotNull(), last["to"] != odd(flips_before - last["at"])).otherwise(opened != odd(flips_before))


def read_records(spark: SparkSession, path: str, sep: str | None = ",", dialects: DataFrame | None = None) -> DataFrame:
    """Delimited files to (path, row_no, delimiter, record, cells); quoted cells may hold line breaks.

    Files are read in parallel blocks, and whether a line starts inside quotes
    follows from a prefix scan: every line maps the state in front of it to
    the state behind it, a window composes these maps within a slice (some ten
    thousand lines of a block), one small row per slice is composed along the
    file, and each line combines both.  Records of one line, nearly all, need no grouping; the lines of the
    others are put together per record.  A quote that is never closed makes
    the rest of its file one cell, as in other readers; empty lines are records of
    one empty cell.  ``dialects`` (path, delimiter) gives each file its own delimiter;
    files without one are left out.
    """
    lines = _file_lines(spark, path)
    if dialects is not None:
        lines = lines.join(F.broadcast(dialects.select("path", "delimiter")), "path")
    else:
        lines = lines.withColumn("delimiter", F.lit(sep))
    d = F.col("delimiter")
    maps = lines.withColumns({"_out": ends_inside(F.col("value"), d), "_in": ends_inside(F.col("value"), d, True)})
    maps = maps.withColumn("_slice", F.shiftright(F.col("_id").bitwiseAND((1 << 33) - 1), SLICE_BITS))
    order = Window.partitionBy("path", "_block", "_slice").orderBy("_id")
    jump, stay = F.when(F.col("_out") == F.col("_in"), F.col("_out")), F.col("_in")
    flips, last = _composed(order, jump, stay)
    at = maps.withColumn("_flips", flips).withColumn("_last", last)
    own = F.when(jump.isNull() & ~stay, 1).otherwise(0)
    ahead = F.col("_flips") - own
    at = at.withColumns({f"_s{int(o)}": _inside(F.col("_last"), ahead, F.lit(o)) for o in (False, True)})
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({f"_n{k}": F.sum(F.when(F.col(f"_s{k}"), 0).otherwise(1)).over(upto) for k in (0, 1)})
    ends = at.withColumn("_e0", F.when(F.col("_s0"), F.col("_in")).otherwise(F.col("_out"))) \
             .withColumn("_e1", F.when(F.col("_s1"), F.col("_in")).otherwise(F.col("_out")))
    blocks = ends.groupBy("path", "_block", "_slice").agg(F.max_by(F.struct("_e0", "_e1"), "_id").alias("e"),
                                                F.max("_n0").alias("n0"), F.max("_n1").alias("n1"))
    along = Window.partitionBy("path").orderBy("_block", "_slice")
    b_flips, b_last = _composed(along, F.when(F.col("e._e0") == F.col("e._e1"), F.col("e._e0")), F.col("e._e1"))
    b_own = F.when((F.col("e._e0") != F.col("e._e1")) & ~F.col("e._e1"), 1).otherwise(0)
    blocks = blocks.withColumn("_flips", b_flips).withColumn("_l", b_last).withColumn(
        "_opened", _inside(F.col("_l"), F.col("_flips") - b_own, F.lit(False)))
    started = F.when(F.col("_opened"), F.col("n1")).otherwise(F.col("n0"))
    blocks = blocks.withColumn("_offset", F.coalesce(F.sum(started).over(
        along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("path", "_block", "_slice", "_opened", "_offset")
    o = F.col("_opened")
    placed = at.join(shuffled(blocks), ["path", "_block", "_slice"]).select(
        "path", "_block", "_id", "delimiter", "value", F.when(o, F.col("_s1")).otherwise(F.col("_s0")).alias("_before"), "_in", "_out",
        (F.col("_offset") + F.when(o, F.col("_n1")).otherwise(F.col("_n0"))).alias("row_no"))
    after = F.when(F.col("_before"), F.col("_in")).otherwise(F.col("_out"))
    line = F.when(after, F.col("value")).otherwise(F.regexp_replace("value", "\r$", ""))
    placed = placed.withColumn("value", line).withColumn("_many", F.col("_before") | after)
    single = placed.where("not _many").select("path", "row_no", "delimiter", F.col("value").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("_block", "_id", "value")))
    several = placed.where("_many").groupBy("path", "row_no", "delimiter").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("record"))
    return single.unionByName(several).withColumn("cells", split_cells(F.col("record"), F.col("delimiter")))


def file_dialects(spark: SparkSession, path: str) -> DataFrame:
    """path, delimiter of the delimited files among ``path``, from their first 16 KiB."""
    first = _file_lines(spark, path).where("_block = 0")
    rank = Window.partitionBy("path").orderBy("_id")
    cut = first.select("path", "_id", "_size", F.substring("value", 1, HEAD).alias("value")) \
               .withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= HEAD)
    before = F.coalesce(F.sum(F.length("value") + 1).over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = F.array_sort(F.collect_list(F.struct("_id", "value")))
    heads = cut.withColumn("_at", before).where(F.col("_at") < HEAD).groupBy("path").agg(
        F.substring(F.array_join(F.transform(lines, lambda l: l["value"]), "\n"), 1, HEAD).alias("head"),
        (F.max("_size") <= HEAD).alias("whole"))
    return heads.select("path", delimiter_of(F.col("head"), F.col("whole")).alias("delimiter")).where("delimiter is not null")


def read_sniffed(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files of unknown dialect to (path, row_no, delimiter, record, cells).

    Files that are not delimited give no rows."""
    return read_records(spark, path, dialects=file_dialects(spark, path))


def read_params(body: Column, content_type: Column) -> Column:
    """Request body to a flat string map: JSON object, or form encoding
    (``a=1&b=2``) where the last repeated key wins."""
    js = F.from_json(body, "map<string,string>")
    pairs = F.transform(F.filter(F.split(body, "&"), lambda p: p != ""), lambda p: F.struct(
        F.url_decode(F.regexp_replace(F.substring_index(p, "=", 1), r"\+", " ")).alias("key"),
        F.url_decode(F.regexp_replace(
            F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, 1 << 30))
             .otherwise(F.lit("")), r"\+", " ")).alias("value")))
    return F.when(F.contains(content_type, F.lit("json")), js).otherwise(last_wins_map(pairs))


def query_pairs(url: Column) -> Column:
    """(key, value, pos) structs of a URL's query string, decoded."""
    q = F.parse_url(url, F.lit("QUERY"))
    parts = F.filter(F.split(F.coalesce(q, F.lit("")), "&"), lambda p: p != "")
    return F.transform(parts, lambda p, i: F.struct(
        F.url_decode(F.substring_index(p, "=", 1)).alias("key"),
        F.url_decode(F.when(F.contains(p, F.lit("=")), F.substring(p, F.instr(p, "=") + 1, 1 << 30))
                      .otherwise(F.lit(""))).alias("value"),
        i.alias("pos")))


def prefill(requests: DataFrame, params: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """URL parameters matched to known parameter names (name, multiple):
    multi-valued parameters keep every value in order, others the last."""
    ex = requests.select(key, F.explode(query_pairs(F.col(url))).alias("q")).select(key, "q.*")
    j = ex.join(params, ex["key"] == params["name"])
    return j.groupBy(key, "name", "multiple").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("_vals")
    ).select(key, "name", F.when(F.col("multiple"), F.col("_vals"))
             .otherwise(F.array(F.element_at("_vals", -1))).alias("values"))
