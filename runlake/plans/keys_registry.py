"""Keys of the catalog loads, patches, job commands and user-job registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.operators import catalog_load as CL
from runlake.operators import commands as CM
from runlake.operators import patches as PT
from runlake.operators.joins import shuffled
from runlake.plans import jobs_registry as R
from runlake.plans.queries import key


def _script_patches(c):
    s = c.script()
    k = F.col("script_id") % 5
    patch = (F.when(k == 0, F.create_map(F.lit("script_name"), F.upper("script_name")))
              .when(k == 1, F.create_map(F.lit("group"), F.lit("")))
              .when(k == 2, F.create_map(F.lit("save_path"), F.lit(""), F.lit("script_order"), F.lit("5")))
              .when(k == 3, F.create_map(F.lit("script_name"), F.lit("  ")))
              .otherwise(F.create_map(F.lit("is_active"), F.lit("maybe"), F.lit("script_order"), F.lit("0"))))
    return s.select("script_id", patch.alias("patch"))


@key("patch_checks")
def _patch_checks(c):
    return PT.check_script_patches(_script_patches(c)).select("script_id", F.array_join("errors", "|").alias("errors"))


@key("sparse_patch")
def _sparse_patch(c):
    return PT.sparse_patch(c.script(), _script_patches(c))


def _version_patches(c):
    v = c.version()
    k = F.col("version_id") % 6
    t, f = F.lit("true"), F.lit("false")
    patch = (F.when(k == 0, F.create_map(F.lit("default_version"), t))
              .when(k == 1, F.create_map(F.lit("default_version"), f))
              .when(k == 2, F.create_map(F.lit("is_active"), f))
              .when(k == 3, F.create_map(F.lit("default_version"), f, F.lit("is_active"), f))
              .when(k == 4, F.create_map().cast("map<string,string>"))
              .otherwise(F.create_map(F.lit("is_active"), F.lit("maybe"))))
    return v.withColumn("patch", patch)


@key("version_patch_rules")
def _version_patch_rules(c):
    # every version carries its patch: one version table, no patch join
    return PT.apply_version_patches(_version_patches(c))


def _command_log(c):
    e = c.t("events")
    cmds = F.array(*[F.lit(x) for x in ("resubmit", "rerun", "delete", "stop", "bogus")])
    k = F.col("event_id")
    return e.select(k.alias("cmd_id"), F.when(k % 17 == 0, -1 - k).otherwise(k.bitwiseXOR(k % 2 * 4)).alias("job_id"),
                    F.when(F.col("event_id") % 9 == 0, F.lit(None).cast("bigint")).otherwise(F.col("user_id"))
                     .alias("user_id"),
                    F.element_at(cmds, (F.col("event_id") % 5 + 1).cast("int")).alias("command"))


@key("apply_job_commands")
def _apply_job_commands(c):
    jobs, resub, errs = CM.apply_commands(c.job().select("job_id", "user_id", "status", "script_id"), _command_log(c),
                                          c.user(), c.script())
    jobs = jobs.drop("script_id")
    a = jobs.select(F.lit("job").alias("kind"), F.col("job_id").alias("id"), "status",
                    F.col("reruns").cast("bigint").alias("n"))
    b = resub.select(F.lit("resubmit").alias("kind"), F.col("cmd_id").alias("id"), F.lit(None).cast("string")
                     .alias("status"), F.col("job_id").alias("n"))
    e = errs.select(F.lit("error").alias("kind"), F.col("cmd_id").alias("id"), F.col("error").alias("status"),
                    F.lit(None).cast("bigint").alias("n"))
    return a.unionByName(b).unionByName(e)


@key("clone_jobs")
def _clone_jobs(c):
    o = c.t("orders")
    req = o.filter(F.col("o_orderstatus") == "P").select(
        (F.col("o_orderkey") * 2).alias("request_id"), F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("requester_id"))
    base = o.select(F.max("o_orderkey")).scalar()
    jobs = o.select(F.col("o_orderkey").alias("job_id"))
    params = c.param().select("job_id", "pos", "name", "raw")
    cloned, new_params = CM.clone_jobs(jobs, params, req, base)
    return new_params.join(shuffled(cloned.select(F.col("new_job_id").alias("job_id"), "source_job_id", "user_id")), "job_id")


def _command_spec(c):
    """Specification of every script as the parser reads it."""
    return c.spec().select(
        "script_id", F.col("parser_name").alias("parser"), F.col("name").alias("dest"), F.col("short_param").alias("flag"),
        F.when(F.col("form_field") == "BooleanField", "0").when(F.col("choice_limit") == '"+"', "+")
         .when(F.col("choice_limit") != "null", "*").otherwise("1").alias("nargs"), "required",
        F.when(F.col("name") == "priority", "3-MEDIUM").alias("default"), F.col("param_order").alias("position"))


def _command_lines(c):
    """A command per order: quoting, abbreviations, a sub-parser, and commands that are wrong in three ways."""
    k, text = F.col("o_orderkey"), F.format_string
    s, p, who = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string")
    total = (F.floor("o_totalprice") - 200000).cast("bigint").cast("string")
    command = F.when(k % 6 == 0, text("--customer %s 7 --status '%s' \"%s\" sub --total %s -5 --flag", who, s, p, total)) \
        .when(k % 6 == 1, text("--status=%s  --customer=%s\t%s", s, who, F.replace(p, F.lit(" "), F.lit("\\ ")))) \
        .when(k % 6 == 2, F.concat(text("--sta %s --cust %s 8 ''9", s, who),
                                   F.when(k % 7 == 0, "").otherwise(text(" -- \"%s\"", p)))) \
        .when(k % 6 == 3, text("--status %s '%s'", s, p)) \
        .when(k % 6 == 4, text("--status %s --customer %s --bogus '%s'", s, who, p)) \
        .otherwise(text("--status %s --customer %s \"%s", s, who, p))
    return c.t("orders").select(k.alias("job_id"), F.col("o_custkey").alias("script_id"), command.alias("command"))


@key("parse_commands")
def _parse_commands(c):
    """One command per job against the specification of its script."""
    return CM.parse_commands(_command_lines(c), _command_spec(c))


def _registration_batch(c):
    """Files of known scripts (a half of them known, too) and of new ones, some of which come twice."""
    k, new = F.col("p_partkey"), F.col("p_partkey") % 5 == 0
    tenth = F.floor(k / 10).cast("string")
    return c.t("part").select(
        k.alias("batch_id"), F.when(new, F.concat("p_brand", F.lit("-"), tenth)).otherwise(F.col("p_name")).alias("script_name"),
        F.when(new, F.sha1(F.floor(k / 15).cast("string"))).when(
            k % 2 == 0, F.sha1(F.concat(k.cast("string"), F.lit("|"), (k % 7).cast("string"))))
         .otherwise(F.sha1(F.concat((k % 300).cast("string"), F.lit("|new")))).alias("checksum"),
        F.when(k % 4 == 0, F.lit("2.0-beta1")).when(k % 4 == 1, F.lit("not a version!")).when(k % 4 == 2, F.lit("1!2.0+x")).alias("version_text"),
        F.when(k % 6 == 0, F.lit("")).otherwise(F.col("p_type")).alias("description"), (F.col("p_size") % 9 == 0).alias("set_default"))


@key("register_versions")
def _register_versions(c):
    rows, scripts, unset = CL.register_versions(c.version(), c.script(), _registration_batch(c))
    null = F.lit(None)
    a = rows.select(F.col("outcome").alias("kind"), F.col("batch_id").alias("id"), "script_id", "version_id", "script_version", "iteration",
                    F.col("default_version").alias("flag"), null.cast("string").alias("text"))
    b = scripts.select(F.lit("script").alias("kind"), F.col("script_id").alias("id"), "script_id", null.cast("bigint").alias("version_id"),
                       null.cast("string").alias("script_version"), null.cast("bigint").alias("iteration"), F.col("created").alias("flag"),
                       F.col("description").alias("text"))
    d = unset.select(F.lit("unset").alias("kind"), F.col("version_id").alias("id"), "script_id", "version_id",
                     null.cast("string").alias("script_version"), null.cast("bigint").alias("iteration"), F.lit(False).alias("flag"),
                     null.cast("string").alias("text"))
    return a.unionByName(b).unionByName(d)


@key("build_file_catalog")
def _build_file_catalog(c):
    f = c.file()
    return CL.build_file_catalog(c.user_file(), f, f.select("file_id", "checksum"))


def owned_params(c):
    """Parameters as they were before the bridge: each with the key of one version, the first or, for every third, the last."""
    v = c.version().groupBy("script_id").agg(F.min("version_id").alias("first"), F.max("version_id").alias("last"))
    return c.spec().join(v, "script_id", "left").select("param_id", "script_id", "name", F.when(
        F.col("param_id") % 3 == 0, F.col("last")).otherwise(F.col("first")).alias("version_id"))


@key("backfill_versions_bridge")
def _backfill_versions_bridge(c):
    return CL.backfill_bridge(owned_params(c))


@key("backfill_uuid")
def _backfill_uuid(c):
    return CL.backfill_uuid(c.job())


@key("backfill_parser")
def _backfill_parser(c):
    return CL.backfill_parser(c.spec(), c.version())


@key("scan_catalog")
def _scan_catalog(c):
    """Row count of every catalog view (full scans)."""
    names = ["job", "script", "version", "user", "key", "request", "param", "file", "user_file", "local", "remote",
             "favorite", "toggle", "chunk", "line", "fasta_line", "seq", "matrix", "wide", "html", "spec"]
    parts = [getattr(c, n)().select(F.lit(f"v_{n}").alias("view"), F.count("*").alias("n_rows")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@key("run_job")
def _run_job(c):
    return R.run_job("translate", "1", {"frame": "+3"}, c.seq()).select("seq_id", "protein")


@key("run_sweep")
def _run_sweep(c):
    """All choices of the frame, over all sequences."""
    return R.run_sweep("translate", "1", R.choice_grid("translate", "1", ["frame"]), c.seq()).select("param_frame", "seq_id", "protein")


