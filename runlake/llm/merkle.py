"""Document fingerprints: Merkle trees over paragraphs and sections.

A paragraph ends behind a run of line breaks.  Long paragraphs are cut into
leaves by their content alone: behind a character where a rolling hash of the
last ``WINDOW`` characters hits one value in ``CUT``, but never less than ``LEAST`` or more than ``MOST``
characters apart.  No position enters a cut, so behind an insertion the cuts
fall into place again, in any script, with or without spaces and punctuation.
Texts of up to ``SHORT`` characters, which would be one or two leaves, are cut at half of the hashes and from two characters on.
Consecutive leaves form sections; a section ends behind a leaf whose digest has
four low zero bits, so that sections follow the content, too.  A section's
digest is taken over its leaves', the root over the sections'.

The fingerprint is the tree as text: ``root|section|section...``, the root as
32 hex digits; a section is four characters of its digest, then four of every leaf's
digest, then one for every leaf's length (24 bits and six bits in base 64).
Equal roots mean equal texts.  ``likeness`` is the share of characters in
leaves that both trees have, ``first_change`` walks down the branches whose
digests differ.

Null text counts as empty and has the tree of one empty leaf; rows are ordered
by (doc_id, text checksum), null ids first; equal rows stand side by side; an
empty table gives no rows; only doc_id and text are read, other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from base64 import b64encode
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlake.llm.common import small_batches, stage

WINDOW, CUT, LEAST, MOST, SHORT = 8, 16, 12, 63, 64
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
POWERS = [np.uint64(pow(BASE, j, 1 << 64)) for j in range(WINDOW)]
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
PIECE = 4_000_000              # characters hashed at a time: bounds the memory of very long texts


def _candidates(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character positions where a leaf may end, whether a paragraph ends there, and their byte offsets in UTF-8."""
    ends, hard, offsets, bytes_before = [], [], [], 0
    shift = np.uint64(63 if len(text) <= SHORT else 64 - CUT.bit_length() + 1)
    for start in range(0, len(text), PIECE):
        lead = min(start, WINDOW - 1)
        c = np.frombuffer(text[start - lead:start + PIECE + 1].encode("utf-32-le", "surrogatepass"), "<u4")
        n = min(PIECE, len(text) - start)
        h = np.zeros(len(c), np.uint64)
        for j, power in enumerate(POWERS):
            h[j:] += c[:max(len(c) - j, 0)] * power
        c, following, h = c[lead:lead + n], c[lead + 1:lead + 1 + n], h[lead:lead + n]
        paragraph = c == 10
        paragraph[:len(following)] &= following != 10
        at = np.flatnonzero(((h * np.uint64(MIX)) >> shift == 0) | paragraph)
        sizes = 1 + (c >= 0x80).astype(np.int8) + (c >= 0x800) + (c >= 0x10000)
        upto = np.cumsum(sizes, dtype=np.int64)
        ends.append(at + 1 + start)
        hard.append(paragraph[at])
        offsets.append(upto + bytes_before)
        bytes_before += int(upto[-1])
    if not ends:
        return np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
    return np.concatenate(ends), np.concatenate(hard), np.concatenate(offsets)


def _cuts(text: str) -> tuple[list[int], np.ndarray]:
    """Where leaves end, and the byte offset behind every character."""
    ends, hard, offsets = _candidates(text)
    out, last, least = [], 0, 2 if len(text) <= SHORT else LEAST
    for p, paragraph in zip(ends.tolist(), hard.tolist()):
        while p - last > MOST:
            last += MOST
            out.append(last)
        if p > last and (paragraph or p - last >= least):
            out.append(p)
            last = p
    while len(text) - last > MOST:
        last += MOST
        out.append(last)
    if last < len(text) or not out:
        out.append(len(text))
    return out, offsets


def leaves(text: str) -> list[str]:
    """The text's paragraphs, long ones in pieces; joined, they give the text."""
    cuts, _ = _cuts(text)
    return [text[a:b] for a, b in zip([0, *cuts], cuts)]


def fingerprint(text: str) -> str:
    cuts, offsets = _cuts(text)
    raw = text.encode("utf-8", "surrogatepass")
    digest = xxhash.xxh3_128_digest
    bounds = [0, *offsets[np.array(cuts) - 1].tolist()] if text else [0, 0]
    digests = [digest(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
    sizes = [LETTERS[b - a] for a, b in zip([0, *cuts], cuts)]
    sections, tops, start = [], [], 0
    for k, d in enumerate(digests, 1):
        if not d[-1] & 15 or k == len(digests):
            own = digests[start:k]
            top = hashlib.sha256(b"".join(own)).digest()
            tops.append(top)
            sections.append(b64encode(top[:3] + b"".join([x[:3] for x in own]), b"-_").decode() + "".join(sizes[start:k]))
            start = k
    return "|".join([hashlib.sha256(b"".join(tops)).hexdigest()[:32], *sections])


def _leaf_tokens(section: str) -> list[str]:
    """Digest and length of every leaf of a section."""
    n = (len(section) - 4) // 5
    return [section[4 + 4 * i:8 + 4 * i] + section[4 + 4 * n + i] for i in range(n)]


def _leaf_counts(tree: str) -> Counter:
    return Counter(t for s in tree.split("|")[1:] for t in _leaf_tokens(s))


def likeness(a: str, b: str) -> float:
    """Share of characters in common leaves, 0 to 1, from fingerprints alone."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = _leaf_counts(a), _leaf_counts(b)
    size = {c: i for i, c in enumerate(LETTERS)}
    total = sum(size[t[4]] * n for c in (x, y) for t, n in c.items())
    return 2.0 * sum(size[t[4]] * min(n, y[t]) for t, n in x.items() if t in y) / total if total else 0.0


def first_change(a: str, b: str) -> tuple[int, int] | None:
    """(section, leaf in it) where two trees first differ; None if their roots are equal."""
    if a[:32] == b[:32]:
        return None
    x, y = a.split("|")[1:], b.split("|")[1:]
    for i in range(max(len(x), len(y))):
        if i >= len(x) or i >= len(y):
            return i, 0
        if x[i] != y[i]:
            u, v = _leaf_tokens(x[i]), _leaf_tokens(y[i])
            return i, next((k for k in range(max(len(u), len(v))) if u[k:k + 1] != v[k:k + 1]), 0)
    return 0, 0


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by as many of the next text."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, " \
         "near_edited double, near_next double, change_section int, change_leaf int"


def _compare(text: str, tree: str, following: str, next_tree: str) -> tuple:
    new = edited(text, following)
    new_tree = fingerprint(new) if new != text else tree
    section, leaf = first_change(tree, new_tree) or (None, None)
    return (len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), tree, new_tree,
            likeness(tree, new_tree), likeness(tree, next_tree), section, leaf)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of ``FIELDS``, against the next document by ascending doc_id.

    Documents are range-partitioned by id.  A task streams through its sorted
    partition and sees each document with its successor; only the last
    document of a partition waits for the first of the next one, and those two
    texts per partition are joined afterwards."""
    kind = docs.schema["doc_id"].dataType
    text = F.coalesce("text", F.lit(""))
    order = [F.col("doc_id"), F.crc32(text.cast("binary"))]
    rows = docs.select("doc_id", text.alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    columns = [f.split(" ")[0] for f in FIELDS.split(", ")]
    blank = (None,) * len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None                               # (doc_id, text, tree, part) waiting for its successor
        for batch in batches:
            out = []
            for doc_id, text, part in zip(batch["doc_id"], batch["text"], batch["part"]):
                tree = fingerprint(text)
                if held is None:
                    out.append(("first", part, doc_id, text, *blank, None))
                else:
                    made = _compare(held[1], held[2], text, tree)
                    same = max(33, len(os.path.commonprefix((made[2][33:], made[3][33:]))) + 33)
                    out.append(("done", part, held[0], None, *made, same))
                held = (doc_id, text, tree, part)
            yield frame(out)
        if held is not None:
            yield frame([("last", held[3], held[0], held[1], *blank, None)])

    def frame(out: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(out, columns=["what", "part", "doc_id", "text", *columns, "_same"])
        return f.astype({c: "Int64" for c in ("n_chars", "change_section", "change_leaf", "_same")})

    # staged without what an edited fingerprint shares with the first one behind the root
    fresh = F.expr("length(edited_fingerprint)") - F.col("_same")
    done = rows.mapInPandas(run, f"what string, part int, doc_id string, text string, {FIELDS}, _same int")
    with small_batches(docs.sparkSession):
        done = stage(done.withColumn("edited_fingerprint", F.concat(
            F.substring("edited_fingerprint", 1, 33), F.substr("edited_fingerprint", F.col("_same") + 1, fresh))), "merkle")
    tail = F.substr("edited_fingerprint", F.lit(34))
    done = done.withColumn("edited_fingerprint", F.concat(
        F.substring("edited_fingerprint", 1, 33), F.substr("fingerprint", F.lit(34), F.col("_same") - 33), tail))
    firsts = done.where("what = 'first'").select("part", F.col("text").alias("following"))
    # one row per partition: each learns the next one that has documents, the last the first
    parts = firsts.select("part")
    ahead = F.lead("part").over(Window.orderBy("part"))
    successor = parts.select(F.col("part").alias("_p"), F.coalesce(
        ahead, F.min("part").over(Window.partitionBy())).alias("_next"))
    lasts = done.where("what = 'last'").select("part", "doc_id", "text").join(successor, F.col("part") == F.col("_p")) \
        .select("doc_id", "text", "_next").join(firsts, F.col("_next") == F.col("part")) \
        .select("doc_id", "text", "following")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, *_compare(t, fingerprint(t), f, fingerprint(f)))
                   for d, t, f in zip(b["doc_id"], b["text"], b["following"])]
            f = pd.DataFrame(out, columns=["doc_id", *columns])
            yield f.astype({c: "Int64" for c in ("n_chars", "change_section", "change_leaf")})

    ended = lasts.mapInPandas(finish, f"doc_id string, {FIELDS}")
    return done.where("what = 'done'").select("doc_id", *columns).unionByName(ended) \
        .withColumn("doc_id", F.col("doc_id").cast(kind))
