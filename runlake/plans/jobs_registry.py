"""User jobs: named, versioned Python functions ``DataFrame -> DataFrame``
with typed parameters (the unit of user code of the catalog).

``run_job`` validates and coerces the parameter values with the same rules
as submitted values, then builds the function's (lazy) plan; ``run_sweep``
runs one plan per parameter combination and unions them.  Only the
parameter values pass through the driver; the data stays in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.functions.values import BOOLEAN, CHAR, CHOICE, FLOAT, INTEGER


@dataclass
class Param:
    name: str
    form_field: str = CHAR
    required: bool = False
    default: object = None
    choices: tuple = ()


@dataclass
class JobSpec:
    name: str
    version: str
    fn: Callable[..., DataFrame]
    params: list[Param] = field(default_factory=list)


REGISTRY: dict[tuple[str, str], JobSpec] = {}


def job(name: str, version: str = "1", params: list[Param] | None = None):
    def deco(fn):
        REGISTRY[(name, version)] = JobSpec(name, version, fn, list(params or []))
        return fn
    return deco


def coerce(p: Param, value):
    """Submitted value to the parameter's type (same rules as ``coerce_value``)."""
    if value is None:
        return None
    if p.form_field == CHAR:
        return value or None
    if p.form_field == INTEGER:
        return int(value) if isinstance(value, int) or str(value).isdigit() else None
    if p.form_field == BOOLEAN:
        return True if value else None
    if p.form_field == FLOAT:
        return float(value)
    return value


def validate(spec: JobSpec, values: dict) -> dict:
    errors, out = {}, {}
    for p in spec.params:
        v = coerce(p, values.get(p.name, p.default))
        if v is None and p.required:
            errors[p.name] = "This field is required."
        elif p.choices and v is not None and v not in p.choices:
            errors[p.name] = "Select a valid choice."
        out[p.name] = v if v is not None else p.default
    unknown = set(values) - {p.name for p in spec.params}
    for u in sorted(unknown):
        errors[u] = "Unknown parameter."
    if errors:
        raise ValueError(errors)
    return out


def run_job(name: str, version: str, values: dict, df: DataFrame) -> DataFrame:
    spec = REGISTRY[(name, version)]
    return spec.fn(df, **validate(spec, values))


def choice_grid(name: str, version: str, over: list[str]) -> list[dict]:
    """Every combination of the choices that a job declares for the parameters ``over``."""
    choices = {p.name: p.choices for p in REGISTRY[(name, version)].params}
    return [dict(zip(over, values)) for values in product(*(choices[p] for p in over))]


def run_sweep(name: str, version: str, grid: list[dict], df: DataFrame) -> DataFrame:
    """One plan per combination, tagged with the combination's values."""
    plans = []
    for values in grid:
        out = run_job(name, version, values, df)
        for k, v in values.items():
            out = out.withColumn(f"param_{k}", F.lit(v))
        plans.append(out)
    return reduce(lambda a, b: a.unionByName(b), plans)


# ----------------------------------------------------------- bundled jobs
@job("translate", "1", [Param("frame", CHOICE, False, "+1", ("+1", "+2", "+3", "-1", "-2", "-3")),
                        Param("upper", BOOLEAN)])
def _translate(df: DataFrame, frame: str = "+1", upper=None) -> DataFrame:
    from runlake.operators.sequences import translate_sequences
    return translate_sequences(df, frame, upper=bool(upper))


@job("heatmap", "1", [Param("cols", CHAR), Param("log_normalize", BOOLEAN)])
def _heatmap(df: DataFrame, cols=None, log_normalize=None) -> DataFrame:
    from runlake.operators.matrix import log_normalize as lognorm
    from runlake.operators.matrix import select_columns
    sel = select_columns(df, cols)
    return lognorm(sel, sel.columns[1:]) if log_normalize else sel


@job("gaussian", "1", [Param("by", CHAR, True), Param("col", CHAR, True)])
def _gaussian(df: DataFrame, by: str, col: str) -> DataFrame:
    from runlake.operators.matrix import gaussian_curve
    return gaussian_curve(df, by, col)
