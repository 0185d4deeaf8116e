"""Deletion along foreign keys.

The references between tables are data: rows (child, column, parent, action),
where deleting a parent row deletes its children (``cascade``) or clears their
key (``set_null``).  What goes is found by semi joins from parents to
children, once per table in an order in which parents come first; only tables
that refer to each other in a circle are repeated until nothing new goes.  All
joins are equi-joins with one row per deleted key.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.session import ensure_checkpoint_dir

CASCADE, SET_NULL = "cascade", "set_null"


class Reference(NamedTuple):
    child: str
    column: str
    parent: str
    action: str = CASCADE


def _rings(names: list[str], references: list[Reference]) -> list[list[str]]:
    """Groups of tables that reach each other, parents before children."""
    up = {n: {r.parent for r in references if r.child == n and r.action == CASCADE} for n in names}
    reach = {n: set(up[n]) for n in names}
    for _ in names:
        for n in names:
            for p in list(reach[n]):
                reach[n] |= reach[p]
    out: list[list[str]] = []
    for n in sorted(names, key=lambda n: (len(reach[n] | {n}), n)):
        if not any(n in ring for ring in out):
            out.append([n] + [m for m in names if m != n and m in reach[n] and n in reach[m]])
    return out


def _same(column: str, key: DataFrame) -> DataFrame:
    return key.select(F.col(key.columns[0]).alias(column))


def delete_along(tables: dict[str, tuple[DataFrame, str | None]], references: list[Reference],
                 deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of ``tables`` (name: rows and key column) once the rows with the keys in ``deleted`` are gone.

    ``deleted`` has one key column per table.  A table without a key column cannot be a
    parent.  Null keys refer to nothing; unknown keys delete nothing; rows whose parent does
    not exist stay.  Columns keep their order."""
    names = list(tables)
    gone: dict[str, DataFrame] = {}
    for ring in _rings(names, references):
        into = [r for r in references if r.child in ring and r.action == CASCADE]

        def hit(name: str, edges: list[Reference], parents: dict[str, DataFrame]) -> DataFrame | None:
            rows, key = tables[name]
            found = None
            for e in edges:
                if e.child == name and e.parent in parents:
                    part = rows.join(_same(e.column, parents[e.parent]), e.column, "left_semi").select(F.col(key).alias("k"))
                    found = part if found is None else found.unionByName(part)
            return found

        for name in ring:
            rows, key = tables[name]
            if key is None:
                continue
            start = deleted[name].select(F.col(deleted[name].columns[0]).alias("k")) if name in deleted else None
            above = hit(name, [e for e in into if e.parent not in ring], gone)
            both = [x for x in (start, above) if x is not None]
            if both:
                found = both[0] if len(both) == 1 else both[0].unionByName(both[1])
                gone[name] = found.where("k is not null").distinct()
        inner = [e for e in into if e.parent in ring]
        if inner:
            gone.update(_around(ring, inner, hit, {n: gone[n] for n in ring if n in gone}, tables))
    out = {}
    for name, (rows, key) in tables.items():
        left = rows
        if name in deleted and key is not None:
            left = left.join(_same(key, deleted[name].distinct()), key, "left_anti")
        for e in references:
            if e.child != name or e.parent not in gone:
                continue
            if e.action == CASCADE:
                left = left.join(_same(e.column, gone[e.parent]), e.column, "left_anti")
            else:
                mark = _same(e.column, gone[e.parent]).withColumn("_gone", F.lit(True))
                left = left.join(mark, e.column, "left").withColumn(e.column, F.when(F.col("_gone").isNull(), F.col(e.column))).drop("_gone")
        out[name] = left.select(*rows.columns)
    return out


def _around(ring: list[str], inner: list[Reference], hit, start: dict[str, DataFrame], tables: dict) -> dict[str, DataFrame]:
    """Everything a circle of references takes with it; every round is checkpointed and only follows the rows new in it."""
    seen, new = dict(start), dict(start)
    while new:
        ensure_checkpoint_dir(next(iter(new.values())).sparkSession)
        found = {}
        for name in ring:
            part = hit(name, inner, new)
            if part is None:
                continue
            fresh = part.distinct()
            fresh = fresh.join(seen[name], "k", "left_anti") if name in seen else fresh
            fresh = fresh.checkpoint()
            if not fresh.isEmpty():
                found[name] = fresh
        for name, part in found.items():
            seen[name] = seen[name].unionByName(part).checkpoint() if name in seen else part
        new = found
    return seen
