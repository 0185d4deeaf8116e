"""Keys of the matrix family."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.operators import matrix as M
from runlake.plans.queries import key
from runlake.sources.tables import MATRIX_COLS

COLS = MATRIX_COLS
WIDE_COLS = [f"d{i}" for i in range(M.MAX_COLUMNS)]        # the limit of the feature


def _r(df, cols, n=6):
    return df.select(*[F.round(F.col(c), n).alias(c) if c in cols else F.col(c) for c in df.columns])


@key("matrix_extremes")
def _matrix_extremes(c):
    m = c.matrix()
    return m.sparkSession.range(1).select(F.round(M.matrix_min(m, COLS), 6).alias("min_value"))


@key("log_normalize")
def _log_normalize(c):
    return _r(M.log_normalize(c.matrix(), COLS), COLS)


@key("shift_to_zero")
def _shift_to_zero(c):
    return _r(M.shift_to_zero(M.log_normalize(c.matrix(), COLS), COLS), COLS)


def _multi(c):
    return M.major_filter(c.matrix(), "major", COLS, 2)


@key("major_counts")
def _major_counts(c):
    return _multi(c).groupBy("major").agg(F.count("*").alias("n_rows"))


@key("major_variability")
def _major_variability(c):
    return _r(M.variability(_multi(c), "major", COLS), ["variability"], 2)


@key("major_sums")
def _major_sums(c):
    return _r(M.major_sums(c.matrix(), "major", COLS), COLS)


@key("rank_pages")
def _rank_pages(c):
    return M.rank_pages(M.variability(_multi(c), "major", COLS), "major").select("major", "page", "major_rank")


@key("nested_page")
def _nested_page(c):
    return _r(M.nested_pages(c.matrix(), "major", "minor", COLS, 2), COLS)


@key("column_distance")
def _column_distance(c):
    return _r(M.column_distance(c.wide(), WIDE_COLS), ["distance"])


@key("cluster_order")
def _cluster_order(c):
    """Majors of each page ordered by average-linkage clustering (rows-only check)."""
    n = M.nested_pages(c.matrix(), "major", "minor", COLS, 2).filter(F.col("level") == 0)
    return M.cluster_order(n.select("page", "major", *COLS), "page", "major", COLS)


@key("gaussian_curve")
def _gaussian_curve(c):
    g = M.gaussian_curve(c.t("events"), "event_type", "value")
    return _r(g.withColumn("i", F.col("i").cast("bigint")), ["mu", "sigma", "x", "y"])


@key("select_columns")
def _select_columns(c):
    return M.select_columns(c.wide(), "1,3,12")


@key("heatmap_table")
def _heatmap_table(c):
    sel = M.select_columns(c.wide(), ",".join(WIDE_COLS))
    return _r(M.log_normalize(sel, WIDE_COLS), WIDE_COLS)


@key("heatmap_columns")
def _heatmap_columns(c):
    """Clustered column order of the heatmap table (rows-only check): the
    distance aggregate has at most 1225 rows, so only it reaches the driver."""
    sel = M.select_columns(c.wide(), ",".join(WIDE_COLS))
    order = M.column_cluster_order(M.log_normalize(sel, WIDE_COLS), WIDE_COLS)
    return c.spark.createDataFrame([(i + 1, col) for i, col in enumerate(order)], "position int, column string")
