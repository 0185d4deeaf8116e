"""Near-duplicate documents: fast similarity sketches, bands, exact check.

A document is the set of its distinct five-word shingles (64-bit hashes of the
ASCII-lower-cased words).

* **Sketch.**  ``fast similarity sketching``: in round i every element hashes
  to a bin and to a value in [i, i + 1); a bin keeps its smallest value.  In
  rounds 0..t-1 the bin is random, in round t + j it is bin j, so after at
  most 2t rounds every coordinate is filled; rounds stop once all are.  Two
  sketches agree in a coordinate with probability equal to the Jaccard
  similarity, concentrated as for t independent hashes.
* **Exact copies first.**  Documents with one set (128-bit digest) form a
  class; only one row of a class goes on.
* **Bands.**  40 bands of 5 coordinates: a pair at similarity 0.75 meets in
  none with probability 2e-5, at 0.8 with 1e-7.
* **Links.**  All members of a bucket are checked against one of them, its hub
  (a star, linear in the bucket; each bucket draws its own hub), then against
  the best-linked one.  Classes already joined need no further check.  What
  open buckets hold together is a cluster with one pivot.  Copies of one text
  share most shingles, so the others are compared by how they differ from the
  pivot: two classes link only if they share a known part of their differences,
  hence one of the rarer ones (prefix filter).  Only pairs that share such a
  difference, at a place that leaves room for a link, are checked; no pair of
  a bucket that could link is skipped.  Checks use the full sets.
* **Components** run on class links.

Without words or text the set is empty and linked with nothing.  A row without
doc_id links with nothing, has no component and is kept.  Rows that repeat a
doc_id are one node; ``deduplicated`` takes texts as nodes instead, so no text
is lost for sharing its id.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlake.llm.common import apart, files, once, small_batches, stage
from runlake.llm.components import components

SHINGLE, ROWS, BANDS = 5, 5, 40
WIDTH = ROWS * BANDS
BROADCAST_IDS = 2_000_000              # ids (8 bytes each) that may be sent to every task
CACHED, LONGEST = 100_000, 64          # words a task remembers, and up to which length


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED and len(word) <= LONGEST:
            self[word] = h
        return h


def _shingles(text: str | None, known: _WordHashes, odd: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; bytes.lower and bytes.split know ASCII only, as asked."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
    m = max(1, n - SHINGLE + 1)
    s = np.full(m, np.uint64(min(n, SHINGLE)))
    for k in range(min(n, SHINGLE)):
        s += h[k:k + m] * odd[k]
    return np.unique(_mix64(s))


def _sketch(x: np.ndarray, width: int, seeds: np.ndarray) -> np.ndarray:
    """Smallest (round, hash) per bin.  Rounds run in blocks; those after the filling one change nothing."""
    bins = np.full(width, np.iinfo(np.uint64).max, dtype=np.uint64)
    at, step = 0, max(1, -(-2 * width // len(x)))
    while at < 2 * width:
        rounds = np.arange(at, min(2 * width, at + step))
        h = _mix64(x[None, :] ^ seeds[rounds][:, None])
        bin_ = (h >> np.uint64(48)) * np.uint64(width) >> np.uint64(16)
        late = rounds >= width
        bin_[late] = (rounds[late] - width)[:, None]
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(48)) | (h & np.uint64((1 << 48) - 1))
        np.minimum.at(bins, bin_.ravel().astype(np.intp), value.ravel())
        at += step
        if bins.max() < np.iinfo(np.uint64).max:
            break
    return bins


def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    odd = rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[:SHINGLE], rng.integers(0, 1 << 63, 2 * WIDTH, dtype=np.uint64), odd.reshape(BANDS, ROWS)


def sketches(docs: DataFrame, *also: Column) -> DataFrame:
    """doc_id, columns ``also``, n_shingles, digest, bands (the last two null without shingles)."""
    @F.pandas_udf("n_shingles long, digest binary, bands array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        odd, seeds, band_odd = _constants()
        known = _WordHashes()
        band_ids = np.arange(BANDS, dtype=np.uint64)
        for texts in batches:
            n, digests, bands = [], [], []
            for text in texts:
                x = _shingles(text, known, odd)
                n.append(len(x))
                if not len(x):
                    digests.append(None)
                    bands.append(None)
                    continue
                digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                rows = _sketch(x, WIDTH, seeds).reshape(BANDS, ROWS)
                bands.append(_mix64((_mix64(rows) * band_odd).sum(axis=1, dtype=np.uint64) + band_ids).view(np.int64))
            yield pd.DataFrame({"n_shingles": n, "digest": digests, "bands": bands})

    made = docs.select("doc_id", *also, sketch("text").alias("s"))
    return made.select(*made.columns[:-1], "s.*")


def _sets(docs: DataFrame) -> DataFrame:
    """digest, shingles: the full set of each document."""
    @F.pandas_udf("digest binary, shingles array<long>")
    def full(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        odd = _constants()[0]
        known = _WordHashes()
        for texts in batches:
            sets = [_shingles(text, known, odd) for text in texts]
            yield pd.DataFrame({"digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets],
                                "shingles": [x.view(np.int64) for x in sets]})

    return docs.select(full("text").alias("s")).select("s.*")


def _class_sets(classes: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """cid, shingles for the classes named in column ``cid``, read again from their texts.

    Their ids go to the scan as a broadcast if few enough, else by a shuffle join."""
    wanted = stage(members.where("key = cid").select("cid", "digest", "doc_id").join(classes, "cid"), "nd-named")
    ids = wanted.select("doc_id").distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = _sets(docs.join(ids, "doc_id", "left_semi")).join(wanted.select("cid", "digest"), "digest")
    with small_batches(docs.sparkSession):
        return stage(sets.select("cid", "shingles").dropDuplicates(["cid"]), "nd-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes with 100 * intersection >= 75 * union, on full sets."""
    left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("_sb"))
    both = pairs.join(left, "a").join(right, "b").select(
        "a", "b", F.size(F.array_intersect("_sa", "_sb")).alias("_i"),
        (F.size("_sa") + F.size("_sb")).alias("_n"))
    found = both.where("100 * _i >= 75 * (_n - _i)").select("a", "b")
    return stage(found.repartition(files(pairs.sparkSession, pairs.count())), "nd-links")     # after the checks, which stay spread


def _open(shared: DataFrame) -> DataFrame:
    """Rows of buckets that still hold two components."""
    split = shared.groupBy("bucket").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi")
    return shared.join(split.select("bucket"), "bucket", "left_semi")


def _rooted(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Bucket rows with their components under ``links``; only buckets that still hold two."""
    roots = components(links, links.count())
    rows = shared.drop("root").join(roots, F.col("cid") == F.col("node"), "left")
    return stage(_open(rows.select(*shared.drop("root").columns, F.coalesce("root", "cid").alias("root"))), "nd-open", shared.count())


def _differences(shared: DataFrame, sets: DataFrame, degree: DataFrame) -> DataFrame:
    """cid, root, n, cluster, pivot, near, diff: how each open class differs from the pivot of its cluster.

    A cluster is what open buckets hold together; its pivot is the best-linked
    class of it; ``near`` says that class and pivot are linked."""
    low = shared.groupBy("bucket").agg(F.min("cid").alias("a"))
    clusters = components(shared.join(low, "bucket").select("a", F.col("cid").alias("b")), shared.count()) \
        .select(F.col("node").alias("cid"), F.col("root").alias("cluster"))
    rows = shared.select("cid", "root", "n").distinct().join(clusters, "cid")
    pivots = rows.join(degree, F.col("cid") == F.col("_c"), "left").groupBy("cluster").agg(
        F.max_by("cid", F.struct(F.coalesce("_d", F.lit(0)), -F.col("cid"))).alias("pivot"))
    pivots = pivots.join(sets, F.col("pivot") == F.col("cid")).select("cluster", "pivot", F.col("shingles").alias("_p"))
    rows = rows.join(sets, "cid").join(pivots, "cluster")
    diff = F.concat(F.array_except("shingles", "_p"), F.array_except("_p", "shingles"))
    rows = once(rows, "diff", diff).withColumn("near", 7 * F.size("diff") <= F.col("n") + F.size("_p"))
    return stage(rows.select("cid", "root", "n", "cluster", "pivot", "near", "diff"), "nd-diffs")


def _alike(diffs: DataFrame) -> DataFrame:
    """Pairs (a, b) of one cluster, not joined yet, that share enough differences from the pivot to be a link.

    Classes x and y link if 7 |x ^ y| <= |x| + |y|, and |x ^ y| is d_x + d_y
    less twice the differences they share.  With differences in one order of
    the cluster, rarest first, a pair whose first common one has ``left_x`` and
    ``left_y`` at or after it shares no more than the smaller of these.  Two
    classes near the pivot are joined by it; a near class shares more than 3/7
    of its differences with one that is not near and links."""
    rows = diffs.where("cid <> pivot").select("cluster", "cid", "root", "n", "near", F.size("diff").alias("d"),
                                              F.explode("diff").alias("s"))
    held = rows.groupBy("cluster", "s").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    rows = rows.join(held, ["cluster", "s"])
    common_first = Window.partitionBy("cid").orderBy(F.col("_k").desc(), "s")    # one document's differences
    rows = rows.withColumn("left", F.row_number().over(common_first)).where(
        "3 * left >= 3 * d - n and (not near or 7 * left > 3 * d)")
    rows = stage(rows.drop("_k"), "nd-prefix")
    far, any_ = (rows.where(only).select("cluster", "s", *[F.col(x).alias(f"{x}_{c}") for x in ("cid", "root", "n", "d", "left")],
                                         *more) for c, only, more in (("a", "not near", []), ("b", "true", ["near"])))
    return far.join(any_, ["cluster", "s"]).where(
        "root_a <> root_b and (near or cid_a < cid_b) and 14 * least(left_a, left_b) >= 7 * (d_a + d_b) - (n_a + n_b)") \
        .select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()


def _class_links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links (a, b) between classes, enough of them to connect every component."""
    rows = members.where("key = cid").select("cid", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    # every bucket has a hub of its own, so a member of a large group meets up to one hub per band
    hubs = rows.groupBy("bucket").agg(F.min_by("cid", F.xxhash64("cid", "bucket")).alias("hub"),
                                      F.min("cid").alias("_low"), F.max("cid").alias("_top")).where("_low < _top")
    shared = stage(rows.join(hubs.select("bucket", "hub"), "bucket"), "nd-buckets", BANDS * members.count())
    sets = _class_sets(shared.select("cid").distinct(), members, docs)

    def star(rows: DataFrame) -> DataFrame:
        return rows.where("hub <> cid").select(F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).distinct()

    tried = stage(star(shared), "nd-star", shared.count())
    links = _verified(tried, sets)

    # once more around the best-linked member: variants of one text all resemble it, if nothing else
    shared = _rooted(shared.drop("hub"), links)
    degree = links.select(F.col("a").alias("_c")).unionAll(links.select("b")).groupBy("_c").agg(F.count(F.lit(1)).alias("_d"))
    ranked = shared.join(degree, F.col("cid") == F.col("_c"), "left")
    best = ranked.groupBy("bucket").agg(F.max_by(F.struct("cid", "root"), F.struct(F.coalesce("_d", F.lit(0)), -F.col("cid"))).alias("h"))
    again = shared.join(best, "bucket").where("h.root <> root").select("cid", F.col("h.cid").alias("hub"))
    again = stage(star(again).join(tried, ["a", "b"], "left_anti"), "nd-star", shared.count())
    links = links.unionByName(_verified(again, sets))

    # what is still apart: direct links with a cluster's pivot, and pairs that differ from it alike
    shared = _rooted(shared, links)
    diffs = _differences(shared, sets, degree)
    pivots = diffs.where("near and cid <> pivot").select(F.least("pivot", "cid").alias("a"), F.greatest("pivot", "cid").alias("b"))
    rest = _alike(diffs).join(tried.unionByName(again), ["a", "b"], "left_anti")
    return links.unionByName(pivots).unionByName(_verified(stage(rest, "nd-rest"), sets))


def _placed(docs: DataFrame, *also: Column, id_is_node: bool) -> tuple[DataFrame, DataFrame]:
    """Rows that link with something, with the ``root`` of their component, and all others (doc_id, n_shingles).

    With ``id_is_node`` rows that repeat a doc_id are one node, whatever their texts."""
    with small_batches(docs.sparkSession):
        found = stage(sketches(docs, *also).withColumn("key", F.monotonically_increasing_id()), "nd-sketches")
    extra = [c for c in found.columns if c not in ("doc_id", "n_shingles", "digest", "bands", "key")]
    usable = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    classes = found.where(usable).groupBy("digest").agg(F.min("key").alias("cid"))
    members = stage(found.where(usable).join(classes, "digest").select(
        "key", "doc_id", *extra, "n_shingles", "digest", "cid", F.when(F.col("key") == F.col("cid"), F.col("bands")).alias("bands")),
        "nd-members", found.count())
    links = _class_links(members, docs)
    if id_is_node:
        same_id = members.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("_top")).where("a < _top")
        links = links.unionByName(members.join(same_id, "doc_id").select("a", F.col("cid").alias("b")).where("a < b"))
    roots = components(links, links.count())
    placed = members.join(roots, F.col("cid") == F.col("node"), "left").select(
        "doc_id", *extra, "n_shingles", F.coalesce("root", "cid").alias("root"))
    return stage(placed, "nd-placed"), found.where(~usable).select("doc_id", "n_shingles")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``."""
    placed, others = _placed(docs, id_is_node=True)
    least = placed.groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("component_id"))
    linked = placed.join(least, F.col("root") == F.col("_root")).select("doc_id", "n_shingles", "component_id")
    alone = others.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay: one per component of texts, and all without doc_id or words.

    Texts that share a doc_id stay apart unless they are alike.  Of a component
    the least doc_id stays, of its texts the least by md5, and of rows equal in
    both the least by a hash of all columns, so reruns agree."""
    return apart(docs, "_nd_", ["doc_id", "text"], _one_each)


def _one_each(docs: DataFrame) -> DataFrame:
    placed, _ = _placed(docs, F.md5("text").alias("_nd_text"), id_is_node=False)
    kept = placed.groupBy("root").agg(F.min(F.struct("doc_id", "_nd_text")).alias("k")).select("k.*")
    has_word = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    linked = F.col("doc_id").isNotNull() & has_word
    rows = docs.where(linked).withColumn("_nd_text", F.md5("text")).join(kept, ["doc_id", "_nd_text"], "left_semi")
    one_each = rows.groupBy("doc_id", "_nd_text").agg(
        F.min_by(F.struct(*docs.columns), F.xxhash64(*[_hashable(docs, c) for c in docs.columns])).alias("r")).select("r.*")
    return one_each.unionByName(docs.where(~linked))


def _hashable(docs: DataFrame, column: str):
    """The column, or its JSON if it holds a map, which has no hash."""
    c = F.col("`" + column.replace("`", "``") + "`")
    kind = docs.schema[column].dataType.simpleString()
    return F.to_json(F.struct(c.alias("c"))) if "map<" in kind else c
