"""How operators join tables that grow with the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is spread by key, whatever its estimated size.

    Spark estimates a side from the bytes of the files it reads.  Rows made by
    generators, collected lists and maps are many times larger than that, and a side
    that is taken for small is gathered on the driver to be broadcast.  Use it where
    a side has a row or more per job, value, script or version."""
    return df.hint("merge")
