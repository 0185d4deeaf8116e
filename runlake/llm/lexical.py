"""Ranked lexical search: a dual-tree search over items and documents.

Documents are turned into sparse vectors over the items' terms, with the
coordinate ``(1000000000 * tf) div (1000 * tf + 12 * m)``; an item's vector has
``repeats * w``, so a score is an exact inner product of whole numbers.  Every
task reads its vectors in batches and builds a hierarchy over each batch whose
nodes hold the coordinate maxima of the documents below; the items have such a
hierarchy too.  The search walks pairs of nodes: the inner product of two nodes' maxima
bounds every score below the pair, and the pair is dropped whole when the
bound is below the weakest kth score among its items.  Pairs at the bound stay, as a tie
may go to a smaller id.  What is left is scored exactly, so no document is
missed.  One part of the documents is searched first; its kth scores are where all other
tasks start, so that those return few rows.

Items are taken in blocks of bounded text, each with its own pass over the
documents: the driver and the tasks hold one block's items and terms, never
all, and no count of the corpus by document.  Per item, the tasks' rows are
merged by salted groups first.

Every row of either table counts as one document or one item, repeated rows
included; equal scores go by ascending doc_id, nulls last.  Null and empty
texts have no terms: such documents are never found and do not count, such
items find nothing.  Empty tables give no rows.  Only doc_id, text, item_id
and (of the items) text are read; other columns do not matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlake.llm.common import running_totals, stage

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ITEM_BLOCK_BYTES = 8_000_000
BATCH = 2048                # documents of one hierarchy
LEAF, ITEM_LEAF, BRANCH = 16, 4, 4
CELLS = 4_000_000           # numbers in the node maxima of one hierarchy
PARTS, SALTS = 64, 64
EXACT = 2 ** 53


def terms(text: str | None) -> list[str]:
    return TERM.findall(text.translate(LOWER)) if text else []


def vectors(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, n (terms with repeats) and the terms of the vocabulary with their counts, for documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows, sizes, at, tf = [], [], [], []
                for k, text in enumerate(part.column("text")):
                    found = terms(text.as_py())
                    if not found:
                        continue
                    seen = Counter(map(known, found))
                    seen.pop(None, None)
                    rows.append(k)
                    sizes.append(len(found))
                    at.append(np.fromiter(seen.keys(), np.int32, len(seen)))
                    tf.append(np.fromiter(seen.values(), np.int32, len(seen)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(sizes, pa.int64()),
                     pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))],
                    names=["doc_id", "n", "at", "tf"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n long, at array<int>, tf array<int>")


class ItemTree:
    """Item vectors (item x term) and the coordinate maxima of groups of items, level by level."""

    def __init__(self, wanted: list[dict[int, int]], weights: np.ndarray, size: int):
        self.items = len(wanted)
        # Items that share terms lie together: by their heaviest term.
        self.order = sorted(range(self.items), key=lambda i: max(((weights[t], t) for t in wanted[i]), default=(0, 0)))
        self.rows = [(np.fromiter(wanted[i].keys(), np.int64, len(wanted[i])),
                      np.array([weights[t] * c for t, c in wanted[i].items()], np.int64)) for i in self.order]
        self.size = size
        # Sums below 2^53 are exact in doubles too, whose products are fast.
        top = max((int(v.sum()) for _, v in self.rows), default=0) * 1_000_000
        self.kind = np.float64 if top < EXACT else np.int64

    def leaf(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms of leaf ``k`` and its items' vectors on them."""
        rows = self.rows[k * ITEM_LEAF:(k + 1) * ITEM_LEAF]
        at = np.unique(np.concatenate([r[0] for r in rows]))
        dense = np.zeros((len(rows), len(at)), self.kind)
        for i, (t, v) in enumerate(rows):
            dense[i, np.searchsorted(at, t)] = v
        return at, dense

    def levels(self) -> list[np.ndarray]:
        """Maxima of the nodes, from the leaves to the root; terms beyond the vocabulary's use stay zero."""
        base = np.zeros((-(-self.items // ITEM_LEAF), self.size), self.kind)
        for k in range(len(base)):
            at, dense = self.leaf(k)
            base[k, at] = dense.max(0)
        return hierarchy(base)


def hierarchy(base: np.ndarray) -> list[np.ndarray]:
    out = [base]
    while len(out[-1]) > 1:
        out.append(np.maximum.reduceat(out[-1], np.arange(0, len(out[-1]), BRANCH), axis=0))
    return out


class Best:
    """The k best (score, id) of every item, and the score that a further document has to reach."""

    def __init__(self, items: int, k: int, floors: np.ndarray):
        self.k, self.found, self.floors = k, [[] for _ in range(items)], floors.copy()

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        for at in np.flatnonzero((scores >= self.floors[item]) & (scores > 0)):
            i = ids[at]
            self.found[item].append((-int(scores[at]), i is None, 0 if i is None else i))
        rows = self.found[item]
        if len(rows) >= self.k:
            rows.sort()
            del rows[self.k:]
            self.floors[item] = max(self.floors[item], -rows[-1][0])


def search_batch(best: Best, tree: ItemTree, item_levels: list[np.ndarray], leaves: list, ids: list, at: np.ndarray,
                 value: np.ndarray, ends: np.ndarray) -> tuple[int, int]:
    """Dual-tree search of one batch of sparse documents; returns pairs of leaves scored and possible."""
    count = len(ids)
    group = max(LEAF, -(-2 * count * tree.size // CELLS))       # documents of a leaf: keeps the maxima within CELLS
    starts = np.concatenate([[0], ends[:-1]])
    base = np.zeros((-(-count // group), tree.size), tree.kind)
    for leaf in range(len(base)):
        span = slice(starts[leaf * group], ends[min((leaf + 1) * group, count) - 1])
        np.maximum.at(base[leaf], at[span], value[span])
    doc_levels = hierarchy(base)
    a, b = len(item_levels) - 1, len(doc_levels) - 1
    pairs = np.zeros((1, 2), np.int64)
    scored = 0
    while True:
        floors = best.floors[tree.order]
        weakest = np.minimum.reduceat(floors, np.arange(0, len(floors), ITEM_LEAF * BRANCH ** a))
        bounds = item_levels[a][np.unique(pairs[:, 0])] @ doc_levels[b].T
        bounds = bounds[np.searchsorted(np.unique(pairs[:, 0]), pairs[:, 0]), pairs[:, 1]]
        pairs = pairs[(bounds > 0) & (bounds >= weakest[pairs[:, 0]])]
        if a == 0 and b == 0 or not len(pairs):
            break
        if a > 0 and (a >= b or b == 0):
            kids = pairs[:, :1] * BRANCH + np.arange(BRANCH)
            pairs = np.stack([kids, np.broadcast_to(pairs[:, 1:], kids.shape)], -1).reshape(-1, 2)
            a -= 1
            pairs = pairs[pairs[:, 0] < len(item_levels[a])]
        else:
            kids = pairs[:, 1:] * BRANCH + np.arange(BRANCH)
            pairs = np.stack([np.broadcast_to(pairs[:, :1], kids.shape), kids], -1).reshape(-1, 2)
            b -= 1
            pairs = pairs[pairs[:, 1] < len(doc_levels[b])]
    # Leaf pairs, the document leaf with the best bounds first, so that the kth scores rise early.
    column = np.full(tree.size, -1, np.int64)
    for k in np.unique(pairs[:, 0]):
        terms_at, dense = leaves[k]
        column[terms_at] = np.arange(len(terms_at))
        mine = pairs[pairs[:, 0] == k, 1]
        peaks = base[mine][:, terms_at] @ dense.T                # leaf x item
        for turn in np.argsort(-peaks.max(1), kind="stable"):
            leaf = mine[turn]
            items = [tree.order[k * ITEM_LEAF + j] for j in range(len(dense))]
            open_items = [j for j, i in enumerate(items) if peaks[turn, j] > 0 and peaks[turn, j] >= best.floors[i]]
            if not open_items:
                continue
            scored += 1
            first, last = leaf * group, min((leaf + 1) * group, count)
            span = slice(starts[first], ends[last - 1])
            col = column[at[span]]
            row = np.repeat(np.arange(last - first), ends[first:last] - starts[first:last])
            block = np.zeros((last - first, len(terms_at)), tree.kind)
            block[row[col >= 0], col[col >= 0]] = value[span][col >= 0]
            scores = block @ dense[open_items].T
            for j, i in enumerate(open_items):
                best.add(items[i], scores[:, j], ids[first:last])
        column[terms_at] = -1
    return scored, -(-len(tree.rows) // ITEM_LEAF) * len(base)


def searched(parts: DataFrame, wanted: list[dict[int, int]], weights: np.ndarray, floors: np.ndarray, total: int,
             length: int, k: int) -> DataFrame:
    """item (number in the block), doc_id, score: the best of every task."""
    shared = parts.sparkSession.sparkContext.broadcast((wanted, weights, floors))
    kind = parts.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights, floors = shared.value
        tree = ItemTree(wanted, weights, len(weights))
        best, levels = Best(tree.items, k, floors), tree.levels()
        leaves = [tree.leaf(j) for j in range(len(levels[0]))]
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                lists, n = batch.column("at"), batch.column("n").to_numpy()
                sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
                at = lists.flatten().to_numpy().astype(np.int64)
                tf = batch.column("tf").flatten().to_numpy().astype(np.int64)
                m = np.repeat(75 + (25 * n * total) // length, sizes)
                value = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
                # Documents that share their heaviest term lie together.
                heavy = np.full(len(sizes), -1, np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                by = np.lexsort((at, weights[at], owner))
                heavy[owner[by]] = at[by]
                order = np.lexsort((n, heavy))
                order = order[sizes[order] > 0]
                if not len(order):
                    continue
                begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
                ends = np.cumsum(sizes[order])
                take = np.arange(ends[-1]) - np.repeat(ends - sizes[order], sizes[order]) + np.repeat(begin[order], sizes[order])
                ids = batch.column("doc_id").take(pa.array(order)).to_pylist()
                search_batch(best, tree, levels, leaves, ids, at[take], value[take].astype(tree.kind), ends)
        rows = [(i, None if null else doc, -score) for i, f in enumerate(best.found) for score, null, doc in sorted(f)[:k]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], whole_type),
             pa.array([r[2] for r in rows], pa.int64())], names=["item", "doc_id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    whole_type = to_arrow_type(parts.schema["doc_id"].dataType)
    return parts.mapInArrow(search, f"item long, doc_id {kind}, score long")


def _block(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """Rankings of one block of items (rows with item_no and text)."""
    vocabulary: dict[str, int] = {}
    wanted = [Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms(r["text"])) for r in items]
    kept = [i for i, w in enumerate(wanted) if w]
    if not kept:
        return None
    found = stage(vectors(docs, vocabulary).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), "vectors")
    total, length = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for r in found.select(F.explode("at").alias("t")).groupBy("t").count().toLocalIterator():
        weights[r["t"]] = math.floor(1000 * math.log((2 * total + 2) / (2 * r["count"] + 1)))
    plain = [dict(wanted[i]) for i in kept]
    first = stage(best_rows(searched(found.where("part = 0"), plain, weights, np.zeros(len(kept), np.int64), total, length, k),
                            ["item"], k).drop("rank"), "first-part")
    floors = np.zeros(len(kept), np.int64)
    for r in first.groupBy("item").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).toLocalIterator():
        floors[r["item"]] = r["s"] if r["c"] >= k else 0
    rest = searched(found.where("part > 0"), plain, weights, floors, total, length, k)
    numbers = F.array(*[F.lit(items[i]["item_no"]) for i in kept])
    return first.unionByName(rest).select(F.element_at(numbers, (F.col("item") + 1).cast("int")).alias("item_no"),
                                          "doc_id", "score")


def best_rows(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows of every group, merged in salted groups first."""
    best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    w = Window.partitionBy(*by, "salt").orderBy(*best)
    salted = salted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best)))
    return ranked.where(F.col("rank") <= k).select(*rows.columns, "rank")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents."""
    kind = items.schema["item_id"].dataType.simpleString()
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 16
    sized = stage(running_totals(items.select("item_id", "text", size.cast("long").alias("size")),
                                 [F.col("item_id"), F.xxhash64("text")], {"size": "size"}, "items")
                  .select("item_id", "text", F.col("before_rows").alias("item_no"),
                          F.floor(F.col("before_size") / ITEM_BLOCK_BYTES).alias("block")), "items")
    out = None
    for b in [r["block"] for r in sized.select("block").distinct().orderBy("block").toLocalIterator()]:
        made = _block(docs, sized.where(F.col("block") == b).select("item_no", "text").collect(), k)
        if made is not None:
            out = made if out is None else out.unionByName(made)
    if out is None:
        kind_d = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {kind_d}, score long")
    names = sized.select("item_no", "item_id")
    return best_rows(out, ["item_no"], k).join(names, "item_no").select("item_id", F.col("rank").cast("int").alias("rank"),
                                                                      "doc_id", "score")
