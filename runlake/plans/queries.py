"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per key.

Each key binds one operator of the library to the catalog views of a data
folder.  The DuckDB twin of every key lives in ``runlake.oracle``.
Output columns are aliased identically in both, counts are BIGINT and
measures rounded DOUBLE.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runlake.sources.tables import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

FAMILIES = ["jobs", "functions", "scalars", "catalog", "params", "files", "access", "matrix", "sequences",
            "sources", "streams", "registry"]


def key(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Catalog(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


for _family in FAMILIES:
    try:
        importlib.import_module(f"runlake.plans.keys_{_family}")
    except ModuleNotFoundError as exc:
        if exc.name != f"runlake.plans.keys_{_family}":
            raise
