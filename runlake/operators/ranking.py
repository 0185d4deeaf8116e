"""Exact per-group row numbers that stay parallel when one group is huge.

``row_number() OVER (PARTITION BY k ORDER BY o)`` sends every row of a key
to one task.  When one key holds a third of the table that task becomes the
whole job.  ``row_number_by`` is one lazy plan at every size:

1. one row per long key, one of ``slice_rows`` rows or more: its row count and the
   least and greatest value of the first order column (partial aggregates);
2. a long key's value range is cut into equal slices, about one per
   ``slice_rows`` rows, so every row knows its slice from its own value;
   all other keys are one slice;
3. rows are numbered inside each (key, slice);
4. the number of rows in a long key's earlier slices is added.

There are at most ``rows / slice_rows`` long keys, and about twice as many slices
of them, so both are broadcast: without long keys the rows are shuffled once.

A slice is a function of the row and of exact per-key figures only, so every
branch of the plan, and every recomputation after a lost executor, sees the
same slices.  Text is cut by the bytes that follow what the key's values have
in common.  Slices are even where the values are; rows with one value of the
first order column always share a slice.  ``order`` must be a total order
inside each key (add a unique tie-break).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from runlake.operators.joins import shuffled

SLICE_ROWS = 1_000_000   # rows a single task numbers comfortably
MAX_SLICES = 100_000     # slices of one key; beyond, they grow wider


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _order(c) -> Column:
    """A column name, descending (nulls last) if it begins with ``-``."""
    return F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc()


def _code(value: Column, kind, low: Column, high: Column) -> Column | None:
    """A double that never falls where the value rises; None for types without one."""
    if isinstance(kind, NumericType):
        return value.cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    if not isinstance(kind, StringType):
        return None
    shortest = F.least(F.length(low), F.length(high), F.lit(256))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(shortest, F.lit(1))),
                             lambda i: F.left(low, i) == F.left(high, i)))
    digits = F.substring(F.hex(F.encode(F.substr(value, shared + 1, F.lit(6)), "UTF-8")), 1, 12)
    return F.conv(F.rpad(digits, 12, "0"), 16, 10).cast("double")


def row_number_by(df: DataFrame, by: list[str], order: list[str], name: str = "rn",
                  slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``name``: the row's number (from 1) inside its key.

    ``order`` lists column names; ``-name`` means descending.  NULL keys form
    one key.  Without ``by`` the whole table is one key.
    """
    lead, falling = order[0].lstrip("-"), order[0].startswith("-")
    kind = df.schema[lead].dataType
    stats = [F.count(F.lit(1)).alias("_cnt"), F.min(lead).alias("_low"), F.max(lead).alias("_high")]
    same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]
    keys = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]
    if by:
        # long keys are found by counting alone, so that the order columns are read again only if there are any
        long = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt")).filter(F.col("_cnt") >= slice_rows).drop("_cnt")
        long = df.join(F.broadcast(long), same, "left_semi").groupBy(*keys).agg(*stats)
        rows = df.join(F.broadcast(long), same, "left")
    else:
        rows = df.withColumn("_all", df.agg(F.struct(*stats).alias("_all")).scalar()).select(
            *df.columns, "_all._cnt", "_all._low", "_all._high")
    low, high = F.col("_low"), F.col("_high")
    code, first, last = (_code(x, kind, low, high) for x in (F.col(lead), low, high))
    if code is None:
        place = F.lit(0).cast("bigint")
    else:
        n = F.least(F.expr(f"_cnt div {slice_rows}") + 1, F.lit(MAX_SLICES))
        share = (code - first) / F.nullif(last - first, F.lit(0.0))
        cut = F.coalesce(F.least(F.floor(share * n), n - 1), F.lit(0)).cast("bigint")
        # NULL stands before all values; what has no finite share (NaN, infinities in a key) stays in one slice
        finite = F.abs(last - first) < float("inf")
        place = F.when(F.col("_cnt").isNull() | (n == 1) | ~F.coalesce(finite, F.lit(False)), F.lit(0)).when(F.col(lead).isNull(), F.lit(-1)).otherwise(cut)
    rows = rows.select(*df.columns, (-place if falling else place).cast("bigint").alias("_slice"), F.col("_cnt").isNotNull().alias("_long"))
    inside = Window.partitionBy(*by, "_slice").orderBy(*[_order(c) for c in order])
    local = rows.withColumn("_local", F.row_number().over(inside))
    sizes = rows.filter("_long").groupBy(*keys, F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*[f"_b{i}" for i in range(len(by))]).orderBy("_s").rowsBetween(
        Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    out = local.join(F.broadcast(before), [F.col("_slice") == F.col("_s"), *same], "left")
    return out.select(*df.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name))


def top_n_by(df: DataFrame, by: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per key.  ``row_number <= n`` is planned with a partial
    WindowGroupLimit before the shuffle, so a hot key ships at most ``n``
    rows per input partition; no slicing is needed."""
    w = Window.partitionBy(*by).orderBy(*[_col(c) for c in order])
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).filter(F.col(name) <= n)


def free_numbers(requests: DataFrame, taken: DataFrame, by: list[str], idx: str, rank: str, name: str,
                 start: int = 0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Give the request of rank r (from 1) of a key the r-th whole number from
    ``start`` upward that is not among the key's ``taken`` numbers.

    A taken number with f free numbers below it is passed over by every
    request of rank above f, so a running maximum over the two kinds of
    rows finds how many numbers a request passes over; no list of taken
    numbers is gathered.  The maximum runs in parallel: ranks are whole numbers
    without gaps, so ``slice_rows`` of them make a slice of that many requests at
    most (and as many steps), each slice runs on its own, and the greatest
    value of a key's earlier slices, one small row per slice, is carried in.
    Keys are compared like grouping keys (NULL equals NULL).
    """
    t = taken.select(*by, F.col(idx).cast("bigint").alias("_t")).filter(F.col("_t") >= start).distinct()
    t = row_number_by(t, by, ["_t"], name="_i")
    steps = t.groupBy(*by, (F.col("_t") - start - F.col("_i") + 1).alias("_free")).agg(F.max("_i").alias("_skip"))
    rows = requests.withColumn("_free", F.col(rank).cast("bigint") - 1).withColumn("_ask", F.lit(True))
    both = rows.unionByName(steps.withColumn("_ask", F.lit(False)), allowMissingColumns=True) \
               .withColumn("_slice", F.expr(f"_free div {slice_rows}"))
    keys = [F.col(c).alias(f"_b{i}") for i, c in enumerate(by)]
    same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]
    earlier = Window.partitionBy(*[f"_b{i}" for i in range(len(by))]).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, F.col("_slice").alias("_s")).agg(F.max("_skip").alias("_top")) \
                  .withColumn("_carry", F.max("_top").over(earlier))
    inside = Window.partitionBy(*by, "_slice").orderBy("_free", "_ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = both.withColumn("_run", F.max("_skip").over(inside)).filter("_ask")
    out = run.join(shuffled(carried), [F.col("_slice") == F.col("_s"), *same])
    number = F.col("_free") + F.lit(start) + F.coalesce(F.greatest("_run", "_carry"), F.lit(0))
    return out.withColumn(name, number.cast("bigint")).select(*requests.columns, name)
