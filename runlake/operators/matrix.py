"""Numeric matrix operators: normalisation, major/minor summaries, pages,
column distances and clustering orders.

A matrix is a DataFrame with key columns and numeric value columns.  Whole
matrix statistics (global minimum) are one aggregate used as a scalar
subquery, never collected to the driver and never joined row by row.
Only small, bounded inputs (<= 50 columns, pages of <= 10 majors) are ever
clustered; rows are not clustered (quadratic).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_COLUMNS = 50            # fixed value: column guard of the heatmap
PAGE_SIZE = 10              # fixed value: majors per page
N_PAGES = 11                # fixed value: number of pages
MINOR_CUTOFF = 2            # fixed value: default minimum non-null count per column
CURVE_POINTS = 100          # fixed value: points of the gaussian curve
CURVE_SIGMAS = 4            # fixed value: curve spans +- 4 sigma


def _nan_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def select_columns(df: DataFrame, spec: str | None, index: str | None = None,
                   limit: int = MAX_COLUMNS) -> DataFrame:
    """Columns by name list, else by 1-based position after the index column.

    Resolved against the schema only (no job runs).  More than ``limit``
    value columns raise ``ValueError``.
    """
    idx = index or df.columns[0]
    values = [c for c in df.columns if c != idx]
    if spec:
        names = spec.split(",")
        if all(n in df.columns for n in names):
            chosen = names
        else:
            try:
                chosen = [values[int(i) - 1] for i in names]
            except (ValueError, IndexError) as exc:
                raise KeyError(spec) from exc
    else:
        chosen = values
    if len(chosen) > limit:
        raise ValueError("Too many columns")
    return df.select(idx, *chosen)


def matrix_min(df: DataFrame, cols: list[str]) -> Column:
    """Global minimum over all cells (NaN and NULL skipped) as a scalar."""
    return df.select(F.least(*[F.min(_nan_null(F.col(c))) for c in cols]).alias("m")).scalar()


def log_normalize(df: DataFrame, cols: list[str]) -> DataFrame:
    """log2 of every cell; log2(0) (= -inf) becomes the smallest finite log
    value of the whole matrix; negative or NaN cells become NULL."""
    logged = df.select(*[c for c in df.columns if c not in cols],
                       *[F.when(F.col(c) > 0, F.log2(F.col(c))).alias(c) for c in cols],
                       *[(F.col(c) == 0).alias(f"_z_{c}") for c in cols])
    m = matrix_min(logged, cols)
    return logged.select(*[c for c in df.columns if c not in cols],
                         *[F.when(F.col(f"_z_{c}"), m).otherwise(F.col(c)).alias(c) for c in cols]).select(*df.columns)


def shift_to_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add abs(global minimum) to every cell."""
    m = F.abs(matrix_min(df, cols))
    return df.select(*[(F.col(c) + m).alias(c) if c in cols else F.col(c) for c in df.columns])


def major_filter(df: DataFrame, major: str, cols: list[str], cutoff: int = MINOR_CUTOFF) -> DataFrame:
    """Rows of majors whose every column has at least ``cutoff`` non-null values."""
    counts = df.groupBy(major).agg(*[F.count(_nan_null(F.col(c))).alias(c) for c in cols])
    keep = counts.filter(F.least(*[F.col(c) for c in cols]) >= cutoff).select(major)
    return df.join(keep, major, "left_semi")


def variability(df: DataFrame, major: str, cols: list[str]) -> DataFrame:
    """Mean over columns of the sample variance per major (NULLs skipped)."""
    v = df.groupBy(major).agg(*[F.var_samp(_nan_null(F.col(c))).alias(c) for c in cols])
    vals = F.array(*[F.col(c) for c in cols])
    present = F.filter(vals, lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.when(F.size(present) > 0,
                  F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present))
    return v.select(major, mean.alias("variability"))


def rank_pages(var: DataFrame, major: str, page_size: int = PAGE_SIZE, pages: int = N_PAGES) -> DataFrame:
    """Top ``page_size * pages`` majors by variability (desc, NULL last,
    major asc for ties), cut into pages.  The global top-k is a
    ``TakeOrderedAndProject`` (k rows per partition), then ranked."""
    k = page_size * pages
    top = var.orderBy(F.col("variability").desc_nulls_last(), F.col(major).asc()).limit(k)
    w = Window.orderBy(F.col("variability").desc_nulls_last(), F.col(major).asc())
    r = top.withColumn("major_rank", F.row_number().over(w))  # k rows only
    return r.select(major, "variability",
                    F.floor((F.col("major_rank") - 1) / page_size).cast("bigint").alias("page"),
                    F.col("major_rank").cast("bigint").alias("major_rank"))


def major_sums(df: DataFrame, major: str, cols: list[str]) -> DataFrame:
    return df.groupBy(major).agg(*[F.sum(_nan_null(F.col(c))).alias(c) for c in cols])


def nested_pages(df: DataFrame, major: str, minor: str, cols: list[str],
                 cutoff: int = MINOR_CUTOFF) -> DataFrame:
    """Per page: each major's sum row (level 0) followed by its minor rows
    (level 1), majors in variability order.  Returns rows with the sort key
    (page, major_rank, level, minor)."""
    multi = major_filter(df, major, cols, cutoff)
    ranks = rank_pages(variability(multi, major, cols), major)
    detail = multi.join(ranks.select(major, "page", "major_rank"), major)
    sums = major_sums(detail, major, cols).join(ranks.select(major, "page", "major_rank"), major)
    head = sums.select("page", "major_rank", F.lit(0).alias("level"), major,
                       F.lit(None).cast(df.schema[minor].dataType).alias(minor), *cols)
    body = detail.select("page", "major_rank", F.lit(1).alias("level"), major, minor, *cols)
    return head.unionByName(body)


def column_distance(df: DataFrame, cols: list[str]) -> DataFrame:
    """Euclidean distance between every pair of (<= 50) columns over rows
    where both are present: every row gives its <= 1225 squared differences,
    which are summed per pair by a partial aggregate.  A table without rows
    has no pairs."""
    if len(cols) > MAX_COLUMNS:
        raise ValueError("Too many columns")
    n = len(cols)
    if n < 2:
        return df.select(F.lit("").alias("col_a"), F.lit("").alias("col_b"), F.lit(0.0).alias("distance")).limit(0)
    # one expression for all pairs: a plan of the same size for 2 columns and for 50
    at = df.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    gap = lambda i, j: F.pow(F.element_at("v", i) - F.element_at("v", j), F.lit(2.0))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.transform(
        F.sequence(i + 1, F.lit(n)), lambda j: F.struct(i.alias("i"), j.alias("j"), gap(i, j).alias("ss")))))
    sums = at.select(F.inline(pairs)).groupBy("i", "j").agg(F.sum("ss").alias("ss"))
    names = F.array(*[F.lit(c) for c in cols])
    return sums.select(F.element_at(names, F.col("i")).alias("col_a"), F.element_at(names, F.col("j")).alias("col_b"),
                       F.sqrt("ss").alias("distance"))


def average_linkage_order(names: list[str], dist: np.ndarray) -> list[str]:
    """Leaf order of average-linkage (UPGMA) clustering of a small item set.

    Closest pair first (ties: lowest ids); merged clusters get new ids; the
    leaf order visits the lower id child first.
    """
    n = len(names)
    if n <= 1:
        return list(names)
    clusters = {i: [i] for i in range(n)}
    children: dict[int, tuple[int, int]] = {}
    d = {(i, j): float(dist[i, j]) for i in range(n) for j in range(i + 1, n)}
    nxt = n
    while len(clusters) > 1:
        (a, b), _ = min(d.items(), key=lambda kv: (kv[1] if not math.isnan(kv[1]) else math.inf, kv[0]))
        members = clusters.pop(a) + clusters.pop(b)
        children[nxt] = (a, b)
        d = {k: v for k, v in d.items() if a not in k and b not in k}
        for c, mem in clusters.items():
            tot = sum(float(dist[x, y]) for x in members for y in mem)
            d[(c, nxt)] = tot / (len(members) * len(mem))
        clusters[nxt] = members
        nxt += 1

    order: list[int] = []
    stack = [nxt - 1]
    while stack:
        x = stack.pop()
        if x < n:
            order.append(x)
        else:
            a, b = children[x]
            stack.extend([b, a])
    return [names[i] for i in order]


def cluster_order(items: DataFrame, group: str, item: str, cols: list[str]) -> DataFrame:
    """Order of items (e.g. majors of one page, <= 10 rows) inside each group
    by average-linkage clustering of their value rows; one pandas call per
    group via ``applyInPandas`` (groups are bounded by the page size)."""
    key_type = items.schema[item].dataType.simpleString()
    group_type = items.schema[group].dataType.simpleString()

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[cols].astype(float).fillna(0.0).to_numpy()
        dist = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        names = list(pdf[item])
        ordered = average_linkage_order(names, dist)
        return pd.DataFrame({group: pdf[group].iloc[0], item: ordered,
                             "cluster_pos": np.arange(1, len(ordered) + 1, dtype="int64")})

    return items.groupBy(group).applyInPandas(
        order, schema=f"{group} {group_type}, {item} {key_type}, cluster_pos bigint")


def column_cluster_order(df: DataFrame, cols: list[str]) -> list[str]:
    """Clustered order of (<= 50) columns from the distance aggregate.  The
    distance table has at most 1225 rows, so it is small by construction."""
    dist = column_distance(df, cols).collect()
    idx = {c: i for i, c in enumerate(cols)}
    m = np.zeros((len(cols), len(cols)))
    for r in dist:
        i, j = idx[r["col_a"]], idx[r["col_b"]]
        m[i, j] = m[j, i] = r["distance"] if r["distance"] is not None else np.nan
    return average_linkage_order(cols, m)


def gaussian_curve(df: DataFrame, by: str, col: str) -> DataFrame:
    """Per group: mean and |sigma| of ``col`` and the normal density on 100
    evenly spaced points within 4 sigma of the mean."""
    stats = df.groupBy(by).agg(F.avg(col).alias("mu"), F.abs(F.stddev_pop(col)).alias("sigma"))
    i = F.col("i")
    x = F.col("mu") - CURVE_SIGMAS * F.col("sigma") + i * (2 * CURVE_SIGMAS * F.col("sigma")) / (CURVE_POINTS - 1)
    amp = 1 / (F.col("sigma") * math.sqrt(2 * math.pi))
    pts = stats.select(by, "mu", "sigma", F.explode(F.sequence(F.lit(0), F.lit(CURVE_POINTS - 1))).alias("i"))
    return pts.select(by, "mu", "sigma", i.alias("i"), x.alias("x"),
                      (amp * F.exp(-F.pow(x - F.col("mu"), 2) / (2 * F.pow(F.col("sigma"), 2)))).alias("y"))
