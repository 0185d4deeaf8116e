"""DNA sequence column functions: complement and frame translation."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The standard genetic code, amino acids listed for codons in
# T, C, A, G order of first, second and third base ("*" = stop).
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODON_TABLE = {"".join(c): aa for c, aa in zip(product(BASES, repeat=3), AMINO_ACIDS)}
UNKNOWN_AMINO = "X"

# Base complements (case kept); any other letter becomes N.
COMPLEMENT_FROM = "ACGTNacgtn"
COMPLEMENT_TO = "TGCANtgcan"

FRAMES = ["+1", "+2", "+3", "-1", "-2", "-3"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(seq) -> Column:
    """Base complement, **not** reversed; letters outside ACGTN become N."""
    s = F.regexp_replace(_c(seq), f"[^{COMPLEMENT_FROM}]", "N")
    return F.translate(s, COMPLEMENT_FROM, COMPLEMENT_TO)


def codons(seq, offset) -> Column:
    """Start positions (0-based) of the whole triplets from ``offset``."""
    n = F.length(_c(seq))
    off = offset if isinstance(offset, Column) else F.lit(offset)
    return F.when(n - 3 >= off, F.sequence(off, n - 3, F.lit(3))).otherwise(F.array().cast("array<int>"))


def _base_digit(s: Column, pos: Column) -> Column:
    """0-3 for T, C, A, G at a 1-based position of a digit-translated text, else -1."""
    d = F.ascii(F.substring(s, pos, 1)) - 48
    return F.when((d >= 0) & (d <= 3), d).otherwise(F.lit(-1))


_LUT = np.full(256, 4, dtype=np.uint8)
for _i, _b in enumerate(BASES):
    _LUT[ord(_b)] = _i
_AMINO = np.frombuffer(AMINO_ACIDS.encode("ascii") + UNKNOWN_AMINO.encode("ascii"), dtype=np.uint8)


def _translate_one(seq: str | None, offset: int) -> str | None:
    if seq is None:
        return None
    raw = np.frombuffer(seq.encode("utf-8"), dtype=np.uint8) if seq.isascii() else None
    if raw is None:  # non-ASCII letters are never bases: work on code points
        raw = np.array([ord(ch) if ord(ch) < 256 else 0 for ch in seq], dtype=np.uint8)
    n = (len(raw) - offset) // 3
    if n <= 0:
        return ""
    d = _LUT[raw[offset:offset + 3 * n]].reshape(n, 3).astype(np.int16)
    idx = d[:, 0] * 16 + d[:, 1] * 4 + d[:, 2]
    idx[(d >= 4).any(axis=1)] = 64
    return _AMINO[idx].tobytes().decode("ascii")


@F.pandas_udf(StringType())
def _translate_batch(seqs: pd.Series, frames: pd.Series) -> pd.Series:
    return pd.Series([_translate_one(s, int(f[1]) - 1) for s, f in zip(seqs, frames)], dtype=object)


def translate_frame(seq, frame) -> Column:
    """Translate in a frame ``+1``..``+3`` / ``-1``..``-3`` (vectorised).

    Negative frames complement the sequence first (natively, no reversal);
    the codon table lookup runs as one numpy gather per sequence inside an
    Arrow-batched pandas UDF.  Codons with a letter outside upper-case ACGT
    give ``X``; only whole triplets count.
    """
    fr = frame if isinstance(frame, Column) else F.lit(frame)
    s = F.when(F.startswith(fr, F.lit("-")), complement(seq)).otherwise(_c(seq))
    return _translate_batch(s, fr)


def translate_frame_native(seq, frame) -> Column:
    """Translate in a frame ``+1``..``+3`` / ``-1``..``-3`` with SQL functions only.

    Negative frames complement the sequence first (no reversal); codons
    with any letter outside upper-case ACGT give ``X``; only whole triplets
    count.  Each codon is an arithmetic index into the 64-letter table
    (bases translated to digits once per sequence), no map lookups.
    """
    fr = frame if isinstance(frame, Column) else F.lit(frame)
    s = F.when(F.startswith(fr, F.lit("-")), complement(seq)).otherwise(_c(seq))
    digits = F.translate(s, BASES, "0123")
    off = F.substring(fr, 2, 1).cast("int") - 1
    table = F.lit(AMINO_ACIDS)

    def amino(d, i):
        a, b, c = (_base_digit(d, i + k) for k in (1, 2, 3))
        ok = (a >= 0) & (b >= 0) & (c >= 0)
        return F.when(ok, F.substring(table, a * 16 + b * 4 + c + 1, 1)).otherwise(F.lit(UNKNOWN_AMINO))

    # The digit text is bound once as a lambda variable: lambda bodies are
    # not common-subexpression eliminated, so referring to the expression
    # inside the per-codon lambda would rebuild the whole text per codon.
    per_seq = F.transform(F.array(digits), lambda d: F.array_join(
        F.transform(codons(d, off), lambda i: amino(d, i)), ""))
    return F.element_at(per_seq, 1)
