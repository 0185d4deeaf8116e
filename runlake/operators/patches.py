"""Sparse patches of catalog rows, their checks and the version default rules.

Patches arrive as (key, patch MAP<STRING,STRING>): a field absent from the
map is left alone, a present field is applied even when empty.  Each patch
is joined to its row by key; rules needing other rows of the same script
(other active defaults) use one pre-aggregated count per script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.functions.text import default_group

# Error texts of the patch checks and rules.
ERR_REQUIRED = "This field is required."
ERR_EMPTY = "At least one field is required."
ERR_DISABLED_DEFAULT = "A disabled script version cannot be set as default."
ERR_NEED_DEFAULT = "A script must have a default version."

SCRIPT_FIELDS = ["script_name", "group", "script_description", "script_order", "is_active", "save_path"]


def has(patch: Column, field: str) -> Column:
    return F.coalesce(F.map_contains_key(patch, F.lit(field)), F.lit(False))


def null_boolean(v: Column) -> Column:
    """Form null-boolean parsing: true/1 -> true, false/0 -> false, else NULL."""
    return (F.when(v.isin("True", "true", "1"), F.lit(True))
             .when(v.isin("False", "false", "0"), F.lit(False)))


def check_script_patches(patches: DataFrame) -> DataFrame:
    """Errors of script patches: a submitted blank name; an order that is
    not a whole number >= 1; a flag that is not a boolean."""
    p = F.col("patch")
    name = p["script_name"]
    order = p["script_order"]
    errs = F.filter(F.array(
        F.when(has(p, "script_name") & (F.trim(F.coalesce(name, F.lit(""))) == ""), F.lit("script_name: " + ERR_REQUIRED)),
        F.when(has(p, "script_order") & (F.coalesce(order, F.lit("")) != "")
               & ~(F.coalesce(order.try_cast("int"), F.lit(0)) >= 1), F.lit("script_order: invalid")),
        F.when(has(p, "is_active") & (F.coalesce(p["is_active"], F.lit("")) != "")
               & null_boolean(p["is_active"]).isNull(), F.lit("is_active: invalid"))),
        lambda x: x.isNotNull())
    return patches.select("script_id", errs.alias("errors"))


def sparse_patch(scripts: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply valid script patches: only submitted fields change; an empty
    group means the default group, an empty save path means NULL."""
    ok = check_script_patches(patches).filter(F.size("errors") == 0).select("script_id")
    p = patches.join(ok, "script_id", "left_semi")
    j = scripts.join(p, "script_id", "left")
    m = F.col("patch")

    def pick(field, current, value):
        return F.when(has(m, field), value).otherwise(current)

    return j.select(
        "script_id",
        pick("script_name", F.col("script_name"), m["script_name"]).alias("script_name"),
        pick("group", F.col("group_name"), default_group(m["group"])).alias("group_name"),
        pick("script_description", F.col("description"), m["script_description"]).alias("description"),
        pick("script_order", F.col("script_order"),
             F.when(m["script_order"] != "", m["script_order"].try_cast("int"))).alias("script_order"),
        pick("is_active", F.col("is_active"), null_boolean(m["is_active"])).alias("is_active"),
        pick("save_path", F.col("save_path") if "save_path" in scripts.columns else F.lit(None).cast("string"), F.nullif(m["save_path"], F.lit(""))).alias("save_path"),
    )


def version_patch_errors(p: Column) -> Column:
    """Form errors of one version patch: at least one field; a submitted
    field must parse as a boolean."""
    return F.filter(F.array(
        F.when(~has(p, "default_version") & ~has(p, "is_active"), F.lit(ERR_EMPTY)),
        F.when(has(p, "default_version") & null_boolean(p["default_version"]).isNull(),
               F.lit("default_version: " + ERR_REQUIRED)),
        F.when(has(p, "is_active") & null_boolean(p["is_active"]).isNull(), F.lit("is_active: " + ERR_REQUIRED))),
        lambda x: x.isNotNull())


def check_version_patches(patches: DataFrame) -> DataFrame:
    return patches.select("version_id", version_patch_errors(F.col("patch")).alias("errors"))


def apply_version_patches(versions: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """Default/active rules of version patches, evaluated against the
    current catalog:

    * making a disabled version default is an error;
    * removing the default needs another active default in the script,
      unless the same patch disables the version;
    * when one batch takes every default of a script away and makes no new
      one, the last of them (highest id) stays and gets that error;
    * making a version default clears every other default of its script
      (several in one script: the newest version wins);
    * disabling a version clears its own default.

    Returns every version with its new flags and the patch error (if any).
    ``patches=None`` means the versions already carry a ``patch`` column
    (no join needed).
    """
    defaults = (versions.filter(F.col("is_active") & F.col("default_version"))
                        .groupBy("script_id").agg(F.count("*").alias("_n_def")))
    if patches is None:
        v = versions
    else:
        v = versions.join(patches.select("version_id", "patch"), "version_id", "left")
    v = v.withColumn("errors", F.when(F.col("patch").isNotNull(), version_patch_errors(F.col("patch"))))
    v = v.join(defaults, "script_id", "left")
    m = F.col("patch")
    form_ok = F.col("errors").isNotNull() & (F.size("errors") == 0)
    want_def = null_boolean(m["default_version"])
    want_act = null_boolean(m["is_active"])
    others = F.coalesce(F.col("_n_def"), F.lit(0)) - (F.col("is_active") & F.col("default_version")).cast("int")
    disabling = has(m, "is_active") & (want_act == F.lit(False))
    rule_err = (F.when(~form_ok, F.lit(None))
                 .when(has(m, "default_version") & want_def & ~F.col("is_active"), F.lit(ERR_DISABLED_DEFAULT))
                 .when(has(m, "default_version") & ~want_def & (others == 0) & ~disabling, F.lit(ERR_NEED_DEFAULT)))
    applied = form_ok & rule_err.isNull()
    v = v.withColumn("_applied", F.coalesce(applied, F.lit(False))).withColumn(
        "_err", F.when(F.col("errors").isNotNull() & (F.size("errors") > 0), F.array_join("errors", "; "))
                 .otherwise(rule_err))
    v = v.withColumn("_makes_default", F.col("_applied") & has(m, "default_version") & F.coalesce(want_def, F.lit(False)))
    # one pass per script: the new default, and what the batch leaves of the old ones
    held = F.col("is_active") & F.col("default_version")
    removes = F.col("_applied") & has(m, "default_version") & F.coalesce(~want_def, F.lit(False)) & ~disabling
    per_script = v.groupBy("script_id").agg(
        F.max_by("version_id", F.when(F.col("_makes_default"), F.struct("created_date", "version_id"))).alias("_win"),
        F.count_if(held & ~removes & ~(F.col("_applied") & disabling)).alias("_left"),
        F.max(F.when(held & removes, F.col("version_id"))).alias("_last"))
    v = v.join(per_script, "script_id", "left")
    last_kept = F.coalesce((F.col("_left") == 0) & F.col("_win").isNull()
                           & (F.col("version_id") == F.col("_last")), F.lit(False))
    v = v.withColumn("_err", F.when(last_kept, F.lit(ERR_NEED_DEFAULT)).otherwise(F.col("_err")))
    v = v.withColumn("_applied", F.col("_applied") & ~last_kept)
    new_default = (F.when(F.col("_win").isNotNull(), F.col("version_id") == F.col("_win"))
                    .when(F.col("_applied") & has(m, "default_version"), F.coalesce(want_def, F.col("default_version")))
                    .otherwise(F.col("default_version")))
    new_active = F.when(F.col("_applied") & has(m, "is_active"), want_act).otherwise(F.col("is_active"))
    new_default = F.when(F.col("_applied") & disabling, F.lit(False)).otherwise(new_default)
    return v.select("version_id", "script_id", new_default.alias("default_version"),
                    new_active.alias("is_active"), F.col("_err").alias("error"))
