"""Helpers shared by the operators of this subpackage.

* ``stage`` writes an intermediate result as Parquet into the shared folder
  named by ``spark.checkpoint.dir`` and reads it back: the lineage is cut, a
  lost executor only costs its running tasks, and two branches see one result.
  Told how many rows of ids a table holds at most, it writes files by rows, not
  one per shuffle partition: Spark's writer starts several processes for each
  file of a local folder, and opens each file again for reading.
* ``once`` evaluates an expression exactly once per row, also when later
  columns, lambdas or filters use it several times.
* ``running_totals`` gives exact global prefix sums without gathering the
  table, or any group of it, in one task.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlake.session import ensure_checkpoint_dir

WHITE = " \t\n\x0b\x0c\r"                  # what separates words: [\x20\x09-\x0D]
WHITE_RUN = "[\\x20\\x09-\\x0D]+"
FILE_ROWS = 100_000                         # rows of a few ids in one file


def files(spark: SparkSession, rows: int) -> int:
    """How many files hold ``rows`` rows of ids: as many as there are cores, more if rows ask for it."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))


def stage(df: DataFrame, tag: str, at_most: int | None = None) -> DataFrame:
    """``df``, written and read again; ``at_most`` is a bound on its rows, for narrow rows that are cheaply made."""
    spark = df.sparkSession
    df = df if at_most is None else df.coalesce(files(spark, at_most))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Fewer rows at a time in Python workers, for work done inside the block: bounds their memory on long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add ``name``.  A one-element ``explode`` keeps the optimizer from copying
    ``expr`` into every later use of the column."""
    return df.select("*", F.explode(F.array(expr)).alias(name))


def apart(docs: DataFrame, prefix: str, needed: list[str], run) -> DataFrame:
    """``run(docs)``, a stage that returns the columns of ``docs`` and uses own columns that begin with ``prefix``.

    Where a column of the input begins like them, all columns but the ``needed``
    ones travel in one struct, so that any names work."""
    if not any(c.lower().startswith(prefix) for c in docs.columns):
        return run(docs)
    own = [c for c in needed if c in docs.columns]
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    others = [c for c in docs.columns if c not in own]
    packed = docs.select(*own, F.struct(*[quoted[c].alias(f"c{i}") for i, c in enumerate(others)]).alias("others"))
    out = run(packed)
    return out.select(*[F.col(c) if c in own else F.col(f"others.c{others.index(c)}").alias(c) for c in docs.columns])


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")) \
        .otherwise(F.split(trimmed, WHITE_RUN))


def crc32_fold(doc_id: Column, folds: int = 5) -> Column:
    """Remainder of the crc32 of the id as text (null id: that of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def running_totals(df: DataFrame, order: list[Column], measures: dict[str, str], tag: str) -> DataFrame:
    """Rows of ``df`` with exclusive prefix sums over one total order.

    Adds ``before_rows``, ``total_rows`` and, for each ``name: column`` of
    ``measures``, ``before_<name>`` and ``total_<name>`` (long).  The rows are
    range-partitioned and staged, so partition numbers are fixed; one small row
    of totals per partition is prefix-summed, and each partition adds its own
    running sum.  Rows equal in ``order`` may swap places with each other.
    """
    parts = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), tag)
    sums = {"rows": F.count(F.lit(1)), **{n: F.coalesce(F.sum(c), F.lit(0)) for n, c in measures.items()}}
    per_part = parts.groupBy("_part").agg(*[e.cast("long").alias(f"_n_{n}") for n, e in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offsets = per_part.select(
        F.col("_part").alias("_at"),
        *[F.coalesce(F.sum(f"_n_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_n_{n}").over(whole).alias(f"total_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = parts.select("*", *[F.coalesce(F.sum(F.lit(1) if n == "rows" else F.col(measures[n])).over(inside),
                                           F.lit(0)).cast("long").alias(f"_l_{n}") for n in sums])
    joined = local.join(offsets, F.col("_part") == F.col("_at"))
    return joined.select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(f"before_{n}") for n in sums],
                         *[F.col(f"total_{n}") for n in sums])
