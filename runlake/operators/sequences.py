"""Sequence operators: FASTA records and frame translation over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.functions.sequences import translate_frame
from runlake.operators.files import number_records


def fasta_records(lines: DataFrame) -> DataFrame:
    """Line table (file_id, line_no, line) to records (file_id, rec_no,
    header, seq): header = the ``>`` line, seq = the stripped following
    lines concatenated; records without sequence are dropped.  Text before
    the first header is record 0 with an empty header.

    Records are assembled per (file, record), so a huge file spreads over
    many groups; the line order inside a record is carried explicitly.
    """
    numbered = number_records(lines)
    is_hdr = F.startswith(F.col("line"), F.lit(">"))
    recs = numbered.groupBy("file_id", "rec_no").agg(
        F.coalesce(F.min_by("line", F.when(is_hdr, F.col("line_no"))), F.lit("")).alias("header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~is_hdr, F.struct(
            "line_no", F.btrim(F.col("line"), F.lit(" \t\r")).alias("l"))))), lambda x: x["l"]), "").alias("seq"))
    return recs.filter(F.col("seq") != "")


def fasta_blocks(lines: DataFrame, block_lines: int = 4096) -> DataFrame:
    """Records as bounded blocks: (file_id, rec_no, header, block, seq) where
    ``block`` numbers runs of at most ``block_lines`` sequence lines of a
    record; a record's sequence is its blocks in order.  No group holds more
    than ``block_lines`` lines, however long a record is."""
    numbered = number_records(lines)
    is_hdr = F.startswith(F.col("line"), F.lit(">"))
    hdr = numbered.filter(is_hdr).select("file_id", "rec_no", F.col("line").alias("header"),
                                         F.col("line_no").alias("_h"))
    body = numbered.filter(~is_hdr).join(hdr, ["file_id", "rec_no"], "left").fillna({"header": "", "_h": 0})
    block = F.floor((F.col("line_no") - F.col("_h") - 1) / F.lit(block_lines)).cast("bigint")
    out = body.groupBy("file_id", "rec_no", "header", block.alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
            "line_no", F.btrim(F.col("line"), F.lit(" \t\r")).alias("l")))), lambda x: x["l"]), "").alias("seq"))
    return out.filter(F.col("seq") != "")


def translate_sequences(df: DataFrame, frame: str = "+1", seq: str = "seq", upper: bool = False) -> DataFrame:
    """Translate every sequence of a table in one frame.  ``upper=True``
    upper-cases first (the single-sequence path); file input is translated
    as given, so lower-case letters give ``X``."""
    s = F.upper(F.col(seq)) if upper else F.col(seq)
    return df.withColumn("protein", translate_frame(s, frame))
