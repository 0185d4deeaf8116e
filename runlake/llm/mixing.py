"""Mixing sources to target weights over fixed-length token blocks.

1. ``source_targets``: target words of every source, by water-filling.
2. The words of each source are laid end to end (document order) and cut into
   blocks of ``block`` words; only a source's last block may be shorter.
3. ``draw_slots``: the mix is written as output shards of ``per_shard`` slots;
   each shard draws its source counts from a multinomial whose probabilities
   are the sources' shares of all slots.  Shard counts are prefix-summed, so
   every slot knows its index within its source.  Draws beyond a source's
   quota are void, and what a source still lacks is drawn by one settling
   shard: totals come out exact, whatever the noise of the draws.
4. A slot's index gives an epoch and a position; a per-source, per-epoch
   affine permutation (multiplier and shift from hashes) maps it to a block.  An epoch holds
   each block once, so nothing is taken more than ``max_epochs`` times.  In
   the last, partial epoch the block that crosses the target is cut there.
5. Slots and documents meet in an equi-join on (source, block).

Spark estimates staged figures and exploded slots far too small.  So tables of
documents, blocks and slots are joined by key, and those with a row per source
stand right in a left join (each source has a row): only they can be broadcast.

Null text has no words; a null source is a source of its own, ordered last;
repeated rows are separate documents; an empty table gives no rows.  Only id,
text and source are read.  All steps are DataFrame functions and all random
numbers are hashes of the seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlake.llm.common import apart, once, running_totals, stage, words
from runlake.operators.joins import shuffled

SEED = 20240


def _null_last(c: str) -> Column:
    return F.col(c).asc_nulls_last()


def source_targets(sizes: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """source, rank, source_size, target: one row per source.

    Sources are ranked by code point (null last) and take ``weights`` in turn.
    They share ``share`` times all words by weight; a source stops at
    ``max_epochs`` times its size and its excess is shared again by weight
    until none is above.  In ascending order of cap per weight the capped
    sources are a prefix, so running sums give the fixed point directly.  The
    windows below run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(_null_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(max_epochs))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    goal = F.sum("source_size").over(whole) * F.lit(share)
    levelled = ranked.withColumn(
        "_level", (goal - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    capped = F.col("_cap") <= F.col("_w") * F.col("_level")
    # the level of the first source that is not capped holds for all after it
    level = F.min_by(F.when(~capped, F.col("_level")),
                     F.when(~capped, F.struct(F.col("_cap") / F.col("_w"), F.col("rank")))).over(whole)
    return levelled.withColumn("_open", level).select(
        "source", "rank", "source_size",
        F.when(capped, F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_open"))).alias("target"))


def _uniform(*cols: Column) -> Column:
    """Uniform in [0, 1) from a hash of the arguments."""
    return F.pmod(F.xxhash64(F.lit(SEED), *cols), F.lit(1 << 52)) / float(1 << 52)


def source_plan(targets: DataFrame, block: int) -> DataFrame:
    """Adds blocks, last_len, whole epochs, words of the partial epoch and slots."""
    goal = F.round("target").cast("long")
    t = targets.where("source_size > 0").select(
        "*", F.ceil(F.col("source_size") / block).cast("long").alias("blocks"), goal.alias("goal"))
    t = t.select("*", (F.col("source_size") - (F.col("blocks") - 1) * block).alias("last_len"),
                 F.expr("goal div source_size").alias("epochs"), F.expr("goal % source_size").alias("rest"))
    tail = F.when(F.col("rest") > 0, F.least(F.col("blocks"), F.ceil(F.col("rest") / block) + 1)).otherwise(0)
    return t.select("*", (F.col("epochs") * F.col("blocks") + tail).cast("long").alias("slots"))


def _multipliers() -> Column:
    """One multiplier per epoch of a source, coprime to its blocks: the first that is so of 64 hashes.

    1 and blocks - 1 keep neighbours together, so they are taken only where no other was drawn."""
    n = F.col("blocks")

    def coprime(a: Column) -> Column:
        ends = F.aggregate(F.sequence(F.lit(1), F.lit(96)), F.struct(a.alias("a"), n.alias("b")), lambda s, _: F.when(
            s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).alias("b"))))
        return ends["a"] == 1

    def of_epoch(epoch: Column) -> Column:
        drawn = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.pmod(
            F.xxhash64(F.lit(SEED), F.col("rank"), epoch, F.lit("multiplier"), i), F.greatest(n - 1, F.lit(1))) + 1)
        fit = F.filter(drawn, coprime)
        mixing = F.filter(fit, lambda a: (a > 1) & (a < n - 1))
        return F.coalesce(F.get(mixing, F.lit(0)), F.get(fit, F.lit(0)), F.lit(1).cast("long"))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.col("epochs")), of_epoch)


def draw_slots(plan: DataFrame, per_shard: int) -> DataFrame:
    """The columns of ``plan`` and ``index``: one row per slot, ``slots`` per source.

    Sources' quotas are laid side by side as intervals in a one-row list (one
    entry per source); a slot takes the source whose interval holds its number."""
    one = plan.agg(F.sort_array(F.collect_list(F.struct("rank", "slots"))).alias("srcs"), F.sum("slots").alias("n"))
    ends = F.aggregate("srcs", F.array().cast("array<bigint>"), lambda acc, s: F.concat(
        acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + s["slots"])))
    shards = one.where("n > 0").select(F.transform("srcs", lambda s: s["rank"]).alias("ranks"), ends.alias("ends"), "n",
                                       F.explode(F.expr(f"sequence(0L, (n - 1) div {per_shard})")).alias("shard"))
    slots = shards.repartition("shard").select("shard", "ranks", "ends", "n", F.explode(
        F.expr(f"sequence(1L, least({per_shard}L, n - shard * {per_shard}))")).alias("slot"))
    slots = once(slots, "u", _uniform(F.col("shard"), F.col("slot")) * F.col("n"))
    drawn = slots.select("shard", F.element_at(
        "ranks", F.size(F.filter("ends", lambda e: e <= F.col("u"))) + 1).alias("_rank"))
    counts = drawn.groupBy("shard", "_rank").agg(F.count(F.lit(1)).alias("count"))
    earlier = Window.partitionBy("_rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(counts.select("_rank", "count", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("from")),
                   "mix-draws")
    made = counts.groupBy("_rank").agg(F.sum("count").alias("_made"))
    lacking = plan.join(made, F.col("rank") == F.col("_rank"), "left").select(
        F.col("rank").alias("_rank"), (F.col("slots") - F.coalesce("_made", F.lit(0))).alias("count"),
        F.coalesce("_made", F.lit(0)).alias("from"))
    runs = counts.unionByName(lacking.where("count > 0")).join(plan, F.col("rank") == F.col("_rank"), "left")
    runs = runs.withColumn("to", F.least(F.col("from") + F.col("count"), F.col("slots"))).where("`from` < `to`")
    return runs.select(*plan.columns, F.explode(F.expr("sequence(`from`, `to` - 1)")).alias("index"))


def taken_blocks(plan: DataFrame, block: int, per_shard: int) -> DataFrame:
    """rank, epoch, block, taken: the first ``taken`` words of a block are in the mix."""
    slots = draw_slots(plan.withColumn("multipliers", _multipliers()), per_shard)
    slots = slots.select("*", F.expr("index div blocks").alias("epoch"), F.expr("index % blocks").alias("pos"))
    # x -> (a x + b) mod n permutes 0..n-1, as a and n are coprime.  b is chosen so that the short
    # last block stands at position `last_pos`, which fixes the words before every position.
    a = F.get("multipliers", F.col("epoch").cast("int"))
    last = F.floor(_uniform(F.col("rank"), F.col("epoch"), F.lit("last")) * F.col("blocks"))
    slots = slots.select("*", a.cast("long").alias("_a"), last.cast("long").alias("last_pos"))
    slots = slots.select("*", F.expr(
        "pmod(_a * pos + blocks - 1 - pmod(_a * last_pos, blocks), blocks)").alias("block"))
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("last_len")).otherwise(F.lit(block))
    gone = F.when(F.col("last_pos") < F.col("pos"), F.lit(block) - F.col("last_len")).otherwise(F.lit(0))
    taken = F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.greatest(
        F.lit(0), F.least(length, F.col("rest") - (F.col("pos") * block - gone))))
    return slots.select("rank", F.col("epoch").cast("int").alias("epoch"), "block",
                        taken.cast("long").alias("taken")).where("taken > 0")


def _pieces(docs: DataFrame, block: int) -> DataFrame:
    """One row per document and block it touches: words [lo, hi) of the block are the document's from ``at`` on."""
    touched = docs.where("size > 0").select("key", "rank", "start", "size", F.explode(
        F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    first = F.col("block") * block
    return touched.select("key", "rank", "block", F.greatest(F.lit(0), F.col("start") - first).alias("lo"),
                          F.least(F.lit(block), F.col("start") + F.col("size") - first).alias("hi"),
                          F.greatest(F.lit(0), first - F.col("start")).alias("at"))


def _mix(sized: DataFrame, block: int, per_shard: int, **targets_args) -> tuple[DataFrame, DataFrame]:
    """Documents with their targets, and the words taken of each: (key, epoch, at, n)."""
    targets = stage(source_targets(sized, **targets_args), "mix-targets")
    totals = running_totals(sized, [_null_last("source"), F.col("doc_id"), F.col("crc")], {"words": "size"}, "mix")
    firsts = totals.groupBy(F.col("source").alias("_src")).agg(F.min("before_words").alias("_first"))
    info = targets.join(firsts, F.col("source").eqNullSafe(F.col("_src"))).select(
        F.col("source").alias("_source"), "rank", "source_size", "target", "_first")
    docs = stage(totals.join(info, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "doc_id", "key", "source", "size", "rank", "source_size", "target",
        (F.col("before_words") - F.col("_first")).alias("start")), "mix-docs")
    blocks = taken_blocks(source_plan(targets, block), block, per_shard)
    taken = _pieces(docs, block).join(shuffled(blocks), ["rank", "block"]).select(
        "key", "epoch", "at", (F.least("hi", "taken") - F.col("lo")).alias("n")).where("n > 0")
    return docs, taken


def _sized(docs: DataFrame, key) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
                       F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc"), key.alias("key"))


def mix_counts(docs: DataFrame, block: int = 256, per_shard: int = 4096, **targets_args) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: the words the mix takes of each document."""
    sized = stage(_sized(docs, F.monotonically_increasing_id()), "mix-sizes")
    rows, taken = _mix(sized, block, per_shard, **targets_args)
    per_doc = taken.groupBy(F.col("key").alias("_key")).agg(F.sum("n").alias("taken"))
    return rows.join(shuffled(per_doc), F.col("key") == F.col("_key"), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source")


def mix(docs: DataFrame, block: int = 256, per_shard: int = 4096, **targets_args) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per document and epoch in which it is taken.

    A document taken whole keeps its text; otherwise the text is the taken
    words, joined by spaces.  ``n_chars``, if there, is brought up to date.
    Documents without words are never taken."""
    return apart(docs, "_mix_", ["doc_id", "text", "source", "n_chars"], lambda d: _mixed(d, block, per_shard, **targets_args))


def _mixed(docs: DataFrame, block: int, per_shard: int, **targets_args) -> DataFrame:
    keyed = stage(docs.withColumn("_mix_key", F.monotonically_increasing_id()), "mix-in")
    rows, taken = _mix(_sized(keyed, F.col("_mix_key")), block, per_shard, **targets_args)
    spans = taken.groupBy(F.col("key").alias("_mix_of"), F.col("epoch").alias("_mix_epoch")).agg(
        F.sum("n").alias("_mix_n"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("_mix_spans"))
    out = keyed.join(shuffled(spans), F.col("_mix_key") == F.col("_mix_of"))
    out = once(out, "_mix_words", words(F.col("text")))
    some = F.array_join(F.flatten(F.transform("_mix_spans", lambda s: F.slice(
        F.col("_mix_words"), (s["at"] + 1).cast("int"), s["n"].cast("int")))), " ")
    out = once(out, "_mix_text", F.when(F.col("_mix_n") == F.size("_mix_words"), F.col("text")).otherwise(some))
    new = {"text": F.col("_mix_text"), "n_chars": F.length("_mix_text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
