"""Keys of the sequence family."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.operators import sequences as SQ
from runlake.plans.queries import key


@key("translate_sequences")
def _translate_sequences(c):
    return SQ.translate_sequences(c.seq(), "+2").select("seq_id", "protein")


@key("translate_upper")
def _translate_upper(c):
    d = c.t("documents").select(F.col("doc_id").alias("seq_id"),
                                F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("seq"))
    return SQ.translate_sequences(d, "-1", upper=True).select("seq_id", "protein")


@key("read_fasta")
def _read_fasta(c):
    return SQ.fasta_records(c.fasta_line())


@key("fasta_blocks")
def _fasta_blocks(c):
    return SQ.fasta_blocks(c.fasta_line())
