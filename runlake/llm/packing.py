"""Packing documents into sequences: large items matched, the rest best-fit.

Pieces longer than a third of the capacity go at most two to a sequence: from
the longest down, each is paired with the longest other large piece that still
fits.  Smaller pieces then fill the remaining gaps, longest first, each into
the tightest gap that holds it.

Both rules only look at lengths, and there are at most ``capacity`` of them.
So the packing is planned on the histogram of lengths (at most 4096 counts,
whatever the size of the corpus): all pieces of one length are placed at once,
as *runs* of equal placements over intervals of sequences.  The plan is exact,
the same as placing piece by piece.  Spark numbers the pieces in one global
order by length with range-partitioned prefix sums, and every task looks its
pieces' numbers up in the runs.

The number of runs depends on the capacity, not on the data: a step of the
plan uses up a length or an interval, so it stays near a few times
``capacity`` (32 bytes each).  ``plan_runs`` checks it against ``MAX_RUNS``.

Null text is an empty document of one token; repeated rows are separate
documents; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import running_totals, stage

CAPACITY = 4096
END = (1).to_bytes(4, "little")        # the id that closes every document
MAX_RUNS = 2_000_000
CACHED = 400_000                       # words and pieces a task remembers
LONGEST = 64                           # characters of a remembered one
# one pre-token of the vocabulary's own pattern: contraction, letters, one digit, other signs
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# the same for lower-cased texts of plain Latin characters, where the built-in ``re`` cuts twice as fast
LATIN_LETTERS, LATIN_NUMBERS = ("".join(c for c in map(chr, range(0x180)) if unicodedata.category(c)[0] == kind) for kind in "LN")
PLAIN = re.compile(r"[\x20-\x7e\n¡-ſ]*")
PLAIN_PRETOKEN = re.compile(rf"[{LATIN_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{LATIN_NUMBERS}]|[^\s{LATIN_LETTERS}{LATIN_NUMBERS}]+")


def _encoder(vocabulary: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian 32-bit integers.

    A text of plain Latin characters is lower-cased and cut into pre-tokens
    here, which repeat and are remembered; each new one goes to the library's BPE.
    Of any other text the words are remembered, as the vocabulary drops white
    space and never joins characters across it.  A new word is plain Latin and
    cut as above, or goes to the whole tokenizer, which also normalises it.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    whole.encode_special_tokens = True       # their names in a text are ordinary text
    bare = Tokenizer(whole.model)            # BPE alone: one pre-token in, its ids out
    plain, cut = PLAIN.fullmatch, PLAIN_PRETOKEN.findall
    # printable characters that stand for bytes in byte-level vocabularies
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_char = {**{b: chr(b) for b in printable}, **{b: chr(256 + i) for i, b in enumerate(others)}, 10: "\n"}     # no pre-token holds \n
    pieces: dict[str, bytes] = {}
    words: dict[str, bytes] = {}

    def ids(encoding) -> bytes:
        made = encoding.ids
        return struct.pack(f"<{len(made)}I", *made)

    def bpe(new: list[str]) -> list[bytes]:
        signs = "\n".join(new).encode().decode("latin-1").translate(byte_char).split("\n") if new else []
        return list(map(ids, bare.encode_batch_fast(signs, add_special_tokens=False)))

    def word(new: list[str]) -> list[bytes]:
        cuts = [cut(w.lower()) if plain(w) else None for w in new]
        found = iter(look_up(pieces, [p for c in cuts if c for p in c], bpe))
        return [ids(whole.encode(w, add_special_tokens=False)) if c is None else b"".join(itertools.islice(found, len(c)))
                for w, c in zip(new, cuts)]

    def look_up(cache: dict[str, bytes], parts: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        found = list(map(cache.get, parts))
        gaps = [i for i, known in enumerate(found) if known is None]
        if gaps:
            if len(cache) > CACHED:
                cache.clear()
            new = list({parts[i] for i in gaps})
            made = dict(zip(new, learn(new)))
            cache.update((p, made[p]) for p in new if len(p) <= LONGEST)
            for i in gaps:
                found[i] = made[parts[i]]
        return found

    def encode(text: str) -> bytes:
        if plain(text):
            return b"".join(look_up(pieces, cut(text.lower()), bpe))
        return b"".join(look_up(words, text.replace("\n", " ").split(" "), word))

    return encode


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as tokens, cut only if longer than the capacity."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, step = _encoder(vocabulary), 4 * capacity
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text or "") + END
                for i in range(0, len(ids), step):
                    part = ids[i:i + step]
                    out.append((doc_id, i // step, i // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    made = rows.mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first piece, pieces, pieces per sequence, first sequence, offset), in order of first piece.

    Pieces are numbered by length, shortest first.  Pieces ``first + i`` of a
    run lie in sequence ``sequence + i div per``, at ``offset + (i mod per) *
    length``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    total = left.copy()
    starts = np.cumsum(left) - left
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}     # gap -> intervals of sequences (first, how many)
    open_gaps: list[int] = []                       # keys of gaps, ascending
    n_seq = 0

    def place(length: int, n: int, per: int, seq: int, offset: int) -> None:
        first = int(starts[length] + total[length] - left[length])
        runs.append((length, first, n, per, seq, offset))
        left[length] -= n

    def add_gap(gap: int, seq: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((seq, n))

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a] > 0:
            top = min(a, capacity - a)
            fit = np.flatnonzero(left[third + 1:top + 1]) if top > third else []
            b = third + 1 + int(fit[-1]) if len(fit) else 0
            if b == a and left[a] == 1:
                b = third + 1 + int(fit[-2]) if len(fit) > 1 else 0
            if b == a:
                n = int(left[a]) // 2
                place(a, 2 * n, 2, n_seq, 0)
            elif b:
                n = int(min(left[a], left[b]))
                place(a, n, 1, n_seq, 0)
                place(b, n, 1, n_seq, a)
            else:
                n = int(left[a])
                place(a, n, 1, n_seq, 0)
            add_gap(capacity - a - b, n_seq, n)
            n_seq += n
    for a in range(third, 0, -1):
        while left[a] > 0:
            i = bisect.bisect_left(open_gaps, a)
            if i == len(open_gaps):                       # no gap holds it: open sequences
                per = capacity // a
                add_gap(capacity, n_seq, -(-int(left[a]) // per))
                n_seq += -(-int(left[a]) // per)
                continue
            gap = open_gaps[i]
            seq, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(i)
            per = gap // a
            full = min(n, int(left[a]) // per)
            if full:
                place(a, full * per, per, seq, capacity - gap)
                add_gap(gap - per * a, seq, full)
            rest = int(left[a])
            if full < n and rest:
                place(a, rest, rest, seq + full, capacity - gap)
                add_gap(gap - rest * a, seq + full, 1)
                full += 1
            add_gap(gap, seq + full, n - full)
    if len(runs) > MAX_RUNS:
        raise ValueError(f"{len(runs)} runs; at most {MAX_RUNS} are sent to the tasks")
    return np.array(sorted(runs, key=lambda r: r[1]), dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...)."""
    pieces = stage(pieces, "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = pieces.sparkSession.sparkContext.broadcast(plan_runs(counts, capacity))
    order = [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")]
    numbered = running_totals(pieces, order, {}, "pack").drop("total_rows")

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = runs.value
        for batch in batches:
            at = batch.pop("before_rows").to_numpy()
            run = r[np.searchsorted(r[:, 1], at, side="right") - 1]
            i = at - run[:, 1]
            yield batch.assign(sequence_id=run[:, 4] + i // run[:, 3], offset=run[:, 5] + i % run[:, 3] * run[:, 0])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInPandas(look_up, f"{fields}, sequence_id long, `offset` long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    return pack(token_pieces(docs, vocabulary, capacity), capacity)
