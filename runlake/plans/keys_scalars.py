"""One key per scalar column function (each a projection over a view)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.functions import text as T
from runlake.functions import values as V
from runlake.functions.sequences import complement
from runlake.operators import catalog as C
from runlake.operators import catalog_load as CL
from runlake.operators.jobs import status_label, submitted_text
from runlake.plans.keys_registry import owned_params
from runlake.plans.queries import key



@key("sanitize_name")
def _sanitize_name(c):
    return c.script().select("script_id", T.sanitize_name("script_name").alias("value"))


@key("sanitize_string")
def _sanitize_string(c):
    return c.script().select("script_id", T.sanitize_string(
        F.concat(F.lit('"'), F.col("script_name"), F.lit('" by "'), F.col("group_name"), F.lit('"'))).alias("value"))


@key("status_label")
def _status_label(c):
    return c.job().select("job_id", status_label(F.col("status")).alias("label"))


@key("range_array")
def _range_array(c):
    return c.script().select("script_id", F.array_join(
        V.range_array(F.col("script_order") % 7 - 2).cast("array<string>"), ",").alias("value"))


@key("email_hash")
def _email_hash(c):
    return c.user().select("user_id", T.email_hash(F.concat(F.col("username"), F.lit("@Mail.COM"))).alias("value"))


@key("key_hash")
def _key_hash(c):
    return c.user().select("user_id", T.key_hash("username").alias("value"))


@key("param_limits")
def _param_limits(c):
    s = c.spec()
    return s.select("param_id", V.multiple_choice("choice_limit").alias("multiple_choice"),
                    V.max_choices("choice_limit").alias("max_choices"))


@key("try_json")
def _try_json(c):
    e = c.t("events")
    raw = (F.when(F.col("event_id") % 3 == 0, F.col("props"))
            .when(F.col("event_id") % 3 == 1, F.regexp_replace("props", "}", ""))
            .otherwise(F.get_json_object("props", "$.k")))
    return e.select("event_id", V.try_json(raw).alias("value"))


@key("submitted_text")
def _submitted_text(c):
    return c.job().select("job_id", submitted_text(F.col("created_date")).alias("value"))


@key("age_cutoff")
def _age_cutoff(c):
    as_of = F.lit("2024-01-25 12:00:00").cast("timestamp_ntz")
    return c.job().select("job_id", (F.col("created_date") <= as_of - F.expr("INTERVAL 7 DAYS")).alias("expired"))


@key("complement")
def _complement(c):
    return c.seq().select("seq_id", complement("seq").alias("value"))


@key("object_key")
def _object_key(c):
    return c.file().select("file_id", T.object_key("runlake", "userfile", F.col("file_id")).alias("value"))


@key("version_or_default")
def _version_or_default(c):
    v = c.version()
    k = F.col("version_id") % 4
    txt = (F.when(k == 0, F.col("script_version")).when(k == 1, F.concat(F.col("script_version"), F.lit("rc2")))
            .when(k == 2, F.concat(F.lit("v"), F.col("script_version"), F.lit(" beta")))
            .otherwise(F.lit(None).cast("string")))
    return v.select("version_id", T.version_or_default(txt).alias("value"))


@key("is_output_flag")
def _is_output_flag(c):
    s = c.spec()
    ftype = F.when(F.col("slot") % 2 == 0, F.lit("file")).otherwise(F.col("form_field"))
    upload = (F.when(F.col("script_id") % 3 == 0, F.lit(False)).when(F.col("script_id") % 3 == 1, F.lit(True))
               .otherwise(F.lit(None).cast("boolean")))
    return s.select("param_id", V.is_output_flag(ftype, upload).alias("is_output"))


@key("default_group")
def _default_group(c):
    return c.script().select("script_id", T.default_group("script_group").alias("value"))


@key("audit_stamp")
def _audit_stamp(c):
    v = c.version()
    created = F.when(F.col("version_id") % 3 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("u"), F.col("script_id").cast("string")))
    return v.select("version_id", T.audit_stamp(created, F.lit("editor")).alias("created_by"),
                    F.lit("editor").alias("modified_by"))


@key("bridge_join")
def _bridge_join(c):
    bridge = CL.backfill_bridge(owned_params(c))
    return C.version_params(c.version(), bridge, c.spec().select("param_id", "name")).select(
        "version_id", "param_id", "name", "script_version")
