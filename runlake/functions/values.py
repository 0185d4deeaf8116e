"""Parameter value column functions: limits, typed coercion, JSON, lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Form field tags of parameter types.
BOOLEAN, CHAR, CHOICE, FILE, FLOAT, INTEGER = (
    "BooleanField", "CharField", "ChoiceField", "FileField", "FloatField", "IntegerField")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _json_int(c) -> Column:
    """Integer value of a JSON scalar (number or digit string), else NULL."""
    j = _c(c)
    txt = F.get_json_object(F.concat(F.lit('{"v":'), j, F.lit("}")), "$.v")
    return F.when(F.trim(txt).rlike(r"^[+-]?[0-9]+$"), F.trim(txt).cast("bigint"))


def max_choices(limit_json) -> Column:
    """JSON null -> 1, an integer -> itself, anything else (``+``, ``*``) -> -1."""
    j = F.trim(_c(limit_json))
    return F.when(j.isNull() | (j == "null"), F.lit(1).cast("bigint")) \
            .when(_json_int(j).isNotNull(), _json_int(j)) \
            .otherwise(F.lit(-1).cast("bigint"))


def multiple_choice(limit_json) -> Column:
    j = F.trim(_c(limit_json))
    return F.when(j.isNull() | (j == "null"), F.lit(False)) \
            .when(_json_int(j).isNotNull(), _json_int(j) > 1) \
            .otherwise(F.lit(True))


def json_string(c) -> Column:
    """JSON text of a string value (quotes and escapes added)."""
    a = F.to_json(F.array(_c(c).cast("string")))
    return F.when(_c(c).isNotNull(), F.substring(a, 2, F.length(a) - 2))


def coerce_value(form_field, raw) -> Column:
    """Stored JSON text of a submitted value, by field type.

    Integer: only all-digit text (so ``-5`` and ``1.5`` become NULL).
    Boolean: NULL stays NULL, any non-empty text (also ``False``) is true,
    the empty text stays as given.  Char: empty becomes NULL.  Float and
    choice values are kept unchanged.  NULL inputs give NULL.
    """
    ff, v = _c(form_field), _c(raw)
    return (F.when(v.isNull(), F.lit(None).cast("string"))
             .when(ff == CHAR, F.when(v == "", F.lit(None)).otherwise(json_string(v)))
             .when(ff == INTEGER, F.when(v.rlike("^[0-9]+$"), v.try_cast("decimal(38,0)").cast("string")))
             .when(ff == BOOLEAN, F.when(v == "", json_string(v)).otherwise(F.lit("true")))
             .otherwise(json_string(v)))


def try_json(c) -> Column:
    """Parsed JSON when valid, else the raw text as a JSON string (round trip)."""
    v = F.try_parse_json(_c(c))
    return F.when(v.isNotNull(), F.to_json(v)).otherwise(json_string(c))


def ensure_list(c) -> Column:
    """NULL -> [], a scalar -> [scalar] (array columns are already lists)."""
    x = _c(c)
    return F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x.cast("string")))


def flatten_list(c) -> Column:
    return F.flatten(_c(c))


def split_properties(c) -> Column:
    return F.split(_c(c), " ")


def range_array(n) -> Column:
    """0 .. n-1; empty for n <= 0 (``sequence(0,-1)`` would be [0,-1])."""
    k = _c(n).cast("int")
    return F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))


def is_output_flag(file_type, upload) -> Column:
    """A parameter is an output when it is a file not uploaded; otherwise
    it is an output when it is not an upload (missing upload = False)."""
    up = _c(upload)
    return F.when((up == F.lit(False)) & (_c(file_type) == "file"), F.lit(True)).otherwise(
        ~F.coalesce(up, F.lit(False)))
