"""Contiguous shards of near-equal bytes.

All documents are put in one order (id, then text checksum, then size).
Per-partition byte totals are prefix-summed, each document learns how many
bytes lie before it, and the byte line is cut at equal targets.  A document
belongs to the shard that holds its middle byte, so every shard is contiguous
and differs from its target by at most one document at either end.

Null text counts as empty; null ids sort first; repeated rows each take their
own slot; an empty table gives no rows; only the id and text columns are read,
so other columns may carry any name.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import running_totals


def byte_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 within a shard)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = running_totals(rows, order, {"bytes": "size"}, "shards").select(
        "doc_id", "size", "text_crc32", "before_rows",
        F.expr(f"cast(least({n_shards - 1}, (2 * before_bytes + size) * {n_shards} div (2 * total_bytes)) as int)")
        .alias("shard"))
    firsts = placed.groupBy(F.col("shard").alias("_shard")).agg(F.min("before_rows").alias("_first"))
    return placed.join(firsts, F.col("shard") == F.col("_shard")).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before_rows") - F.col("_first")).alias("slot"))
