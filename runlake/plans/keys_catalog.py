"""Keys of the script / version catalog family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from runlake.operators import catalog as C
from runlake.operators.deletion import SET_NULL, Reference, delete_along
from runlake.plans.queries import key


def version_requests(c):
    """Version lookups: one per job, some with version text and/or iteration."""
    j = c.job()
    jid = F.col("job_id")
    return j.select(
        jid.alias("request_id"), "script_id",
        F.when(jid % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat((jid % 7 + 1).cast("string"), F.lit("."), (jid % 50).cast("string"))).alias("version"),
        F.when(jid % 3 == 0, F.lit(None).cast("int")).otherwise((jid % 5 + 1).cast("int")).alias("iteration"))


@key("fk_join")
def _fk_join(c):
    return C.with_parents(c.version(), c.script()).select(
        "version_id", "script_id", "script_name", "script_version", "iteration")


@key("fk_left_join")
def _fk_left_join(c):
    return C.with_optional(c.job(), c.user()).select("job_id", "user_id", "username")


@key("semi_join_exists")
def _semi_join_exists(c):
    return C.has_default(c.script(), c.version()).select("script_id", "script_name")


@key("anti_join_no_default")
def _anti_join_no_default(c):
    return C.without_default(c.version()).select("version_id", "script_id")


@key("current_scripts")
def _current_scripts(c):
    return C.current_scripts(c.script(), c.version()).select("script_id", "script_name")


@key("select_version")
def _select_version(c):
    return C.select_version(c.version(), version_requests(c))


@key("latest_version")
def _latest_version(c):
    return C.latest_version(c.version())


@key("flip_default")
def _flip_default(c):
    v = c.version()
    new = v.filter((F.col("iteration") == 5) & F.col("is_active")).select("version_id")
    return C.flip_default(v, new)


def _new_versions(c):
    j = c.job()
    return j.select(F.col("job_id").alias("new_id"), "script_id",
                    F.concat((F.col("job_id") % 7 + 1).cast("string"), F.lit("."),
                             (F.col("job_id") % 50).cast("string")).alias("script_version"))


@key("next_iteration")
def _next_iteration(c):
    return C.next_iteration(c.version(), _new_versions(c), "max")


@key("next_iteration_count")
def _next_iteration_count(c):
    return C.next_iteration(c.version(), _new_versions(c), "count")


@key("duplicate_version")
def _duplicate_version(c):
    return C.find_duplicates(c.version(), c.script())


@key("script_report")
def _script_report(c):
    r = C.script_report(c.script(), c.version())
    return r.withColumn("issues", F.array_join("issues", "|"))


@key("script_issues")
def _script_issues(c):
    cnt = C.version_counts(c.version())
    s = c.script().select("script_id").join(cnt, "script_id", "left")
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    return s.select("script_id", F.array_join(C.script_issues(z("n_versions"), z("n_active"), z("n_defaults")),
                                              "|").alias("issues"))


@key("version_history")
def _version_history(c):
    return C.version_history(c.version()).select(
        "script_id", "script_version", "block", F.col("text").alias("iterations"), "n")


@key("version_labels")
def _version_labels(c):
    return C.version_labels(c.version(), c.script()).select("checksum", "block", F.col("text").alias("labels"), "n")


@key("sort_versions")
def _sort_versions(c):
    return C.order_versions(c.version(), "parsed").select("version_id", "script_id", "version_rank")


@key("sort_catalog")
def _sort_catalog(c):
    return C.catalog_order(c.script()).select("script_id", "group_name", "position")


@key("group_by_name_versions")
def _group_by_name_versions(c):
    return C.build_versions(c.script())


@key("unique_slug")
def _unique_slug(c):
    return C.unique_slugs(c.script(), "script_name", "script_id")


REFERENCES = [Reference("versions", "script_id", "scripts"), Reference("jobs", "script_id", "scripts"),
              Reference("jobs", "user_id", "users", SET_NULL), Reference("values", "job_id", "jobs"),
              Reference("user_files", "job_id", "jobs"), Reference("user_files", "file_id", "files"),
              Reference("favorites", "user_id", "users"), Reference("api_keys", "user_id", "users")]


@key("cascade_delete")
def _cascade_delete(c):
    """All rows that are left once some scripts, users and files are deleted."""
    tables = {
        "scripts": (c.script().select("script_id"), "script_id"), "versions": (c.version().select("version_id", "script_id"), "version_id"),
        "jobs": (c.job().select("job_id", "script_id", "user_id"), "job_id"), "values": (c.param().select("job_id", "pos"), None),
        "files": (c.file().select("file_id"), "file_id"), "user_files": (c.user_file().select("file_id", "job_id"), None),
        "users": (c.user().select("user_id"), "user_id"), "favorites": (c.favorite().select("user_id", "object_id"), None),
        "api_keys": (c.key().select("key_id", "user_id"), "key_id")}
    left = delete_along(tables, REFERENCES, {
        "scripts": c.script().filter(F.col("script_order") > 45).select("script_id"),
        "users": c.user().filter("not is_active").select("user_id"),
        "files": c.file().filter(F.col("filename").endswith(".zip")).select("file_id")})
    shown = {"scripts": ("script_id", None), "versions": ("version_id", "script_id"), "jobs": ("job_id", "user_id"), "values": ("job_id", "pos"),
             "files": ("file_id", None), "user_files": ("file_id", "job_id"), "users": ("user_id", None),
             "favorites": ("user_id", "object_id"), "api_keys": ("key_id", "user_id")}
    parts = [left[t].select(F.lit(t).alias("table"), F.col(a).cast("bigint").alias("id"),
                            (F.col(b) if b else F.lit(None)).cast("bigint").alias("other")) for t, (a, b) in shown.items()]
    return reduce(lambda x, y: x.unionByName(y), parts)


