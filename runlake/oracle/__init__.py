"""Independent DuckDB SQL oracles for the registered queries."""

import importlib

FAMILIES = ["functions", "scalars", "catalog", "params", "files", "access", "matrix", "sequences",
            "sources", "streams", "registry"]


def load_all() -> dict[str, str]:
    from runlake.oracle.sql import all_sql
    for fam in FAMILIES:
        try:
            importlib.import_module(f"runlake.oracle.sql_{fam}")
        except ModuleNotFoundError as exc:
            if exc.name != f"runlake.oracle.sql_{fam}":
                raise
    return all_sql()
