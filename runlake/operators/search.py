"""Keyword search over text columns.

A row matches a query when every term of it occurs, in any letter case, in at
least one of the searched columns.  Terms come from the ``search_terms`` column
function.  ``keyword_search`` answers one query in the scan stage, in one pass
over the table; ``search_queries`` answers a whole table of queries through an
n-gram posting index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.functions.text import search_terms

GRAM = 3
SALT_ROWS = 200_000        # postings of one gram that one join task takes


def lowered(fields: list[str]) -> Column:
    return F.array(*[F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields])


def holds_all(shown: Column, wanted: Column) -> Column:
    """Whether every wanted term is part of some shown text; no terms are held by any row."""
    return F.forall(wanted, lambda t: F.exists(shown, lambda x: F.contains(x, t)))


def matches(query: Column, fields: list[str]) -> Column:
    """Whether a row matches; a query without terms matches every row."""
    wanted = search_terms(F.lower(query))
    # the outer exists only names the lower-cased columns, so they are built once per row
    return F.exists(F.array(lowered(fields)), lambda s: holds_all(s, wanted))


def keyword_search(df: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows matching one query."""
    return df.filter(matches(F.lit(query), fields))


def grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters of a text, overlapping, in one linear pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * size}))"), 1)


def query_grams(queries: DataFrame) -> DataFrame:
    """query_id, terms, gram: the grams that every match of a query must hold.

    They are the 3-grams of the terms that have one, else the longest terms
    themselves (one or two characters), else the empty gram that every row holds."""
    terms = F.array_distinct(search_terms(F.lower(F.coalesce(F.col("query"), F.lit("")))))
    asked = queries.select("query_id", F.filter(terms, lambda t: t != "").alias("terms"))
    longest = F.coalesce(F.array_max(F.transform("terms", F.length)), F.lit(0))
    picked = F.when(longest >= GRAM, F.flatten(F.transform("terms", lambda t: grams(t, GRAM)))) \
        .when(longest > 0, F.filter("terms", lambda t: F.length(t) == longest)).otherwise(F.array(F.lit("")))
    return asked.select("query_id", "terms", F.explode(F.array_distinct(picked)).alias("gram"))


def search_queries(df: DataFrame, key: str, queries: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, ``key``) of every row of ``df`` that matches a query of ``queries`` (query_id, query).

    ``key`` identifies a row.  Postings (row, gram) are made only for grams
    that some query holds, and counted per gram by partial aggregates.  Each
    query then looks up one gram, its rarest, so a common gram is only joined
    where a query has no other; such a gram is spread over salted groups.  The
    candidates are narrow (row, query) pairs, and the texts are fetched once
    by key to count the terms found.  There is no limit on either table, and
    neither is ever paired with all of the other.
    """
    asked = query_grams(queries)
    needed = asked.select("gram").distinct()
    short = asked.select(F.coalesce(F.bool_or(F.length("gram").between(1, GRAM - 1)), F.lit(False))).scalar()
    empty = asked.select(F.coalesce(F.bool_or(F.col("gram") == ""), F.lit(False))).scalar()
    none = F.array().cast("array<string>")

    shown = lowered(fields)
    small = F.flatten(F.transform(shown, lambda x: F.concat(grams(x, 1), grams(x, 2))))
    every = F.concat(F.flatten(F.transform(shown, lambda x: grams(x, GRAM))), F.when(short, small).otherwise(none),
                     F.when(empty, F.array(F.lit(""))).otherwise(none))
    rows = df.select(F.col(key).alias("_row"), F.explode(F.array_distinct(every)).alias("gram"))
    postings = rows.join(needed, "gram", "left_semi")
    counted = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counted, "gram", "left").groupBy("query_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"), F.first("terms").alias("terms"))
    rarest = rarest.where("g.n > 0").select("query_id", "terms", "g.gram", F.ceil(F.col("g.n") / SALT_ROWS).cast("long").alias("salts"))
    spread = rarest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    looked = rarest.select("gram", "salts").distinct()
    salted = rows.join(looked, "gram").select("_row", "gram", F.pmod(F.xxhash64("_row"), F.col("salts")).alias("salt"))
    pairs = salted.join(spread, ["gram", "salt"]).select("_row", "query_id", "terms")
    texts = df.select(F.col(key).alias("_row"), shown.alias("shown"))
    found = pairs.join(texts, "_row").withColumn(
        "n_found", F.size(F.filter("terms", lambda t: F.exists("shown", lambda x: F.contains(x, t)))))
    return found.where(F.col("n_found") == F.size("terms")).select("query_id", F.col("_row").alias(key))
