"""Keys of the scalar function families (one wide query per family)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.functions import paths as P
from runlake.functions import sequences as S
from runlake.functions import text as T
from runlake.functions import values as V
from runlake.operators.jobs import submitted_text
from runlake.plans.queries import key


def _r(c, n=6):
    return F.round(c, n)


@key("text_functions")
def _text_functions(c):
    s = c.script()
    sid = F.col("script_id")
    ver = (F.when(sid % 4 == 0, F.concat(F.col("script_order").cast("string"), F.lit("."), (sid % 10).cast("string")))
            .when(sid % 4 == 1, F.col("description"))
            .when(sid % 4 == 2, F.lit(None).cast("string"))
            .otherwise(F.concat(F.col("script_order").cast("string"), F.lit("rc1"))))
    slug = T.form_slug(F.col("script_order"), T.sanitize_name("script_name"))
    return s.select(
        "script_id",
        T.sanitize_name("script_name").alias("safe_name"),
        T.sanitize_string(F.concat(F.col("script_name"), F.lit('"'), F.col("group_name"))).alias("escaped"),
        slug.alias("form_slug"),
        T.strip_form_prefix(slug).alias("param_slug"),
        T.ends_with("script_name", "bolt").alias("ends_bolt"),
        T.concat_text("script_name", "script_order").alias("joined"),
        T.object_key("runlake", "script", sid).alias("object_key"),
        T.version_or_default(ver).alias("version"),
        T.default_group("script_group").alias("group_or_default"),
        T.audit_stamp(F.col("description"), F.col("group_name")).alias("created_by"),
    )


@key("hash_functions")
def _hash_functions(c):
    u = c.user()
    return u.select(
        "user_id",
        T.email_hash(F.concat(F.col("username"), F.lit("@Example.COM"))).alias("email_hash"),
        T.key_hash("username").alias("key_hash"),
    )


@key("content_checksum")
def _content_checksum(c):
    f = c.file()
    return f.select("file_id",
                    T.content_checksum("content").alias("plain"),
                    T.content_checksum("content", "job_id", "path", F.lit("output")).alias("salted"))


def _ref(f):
    fid = F.col("file_id") % 6
    return (F.when(fid == 0, F.col("path"))
             .when(fid == 1, F.concat(F.lit("  "), F.replace(F.col("path"), F.lit("/"), F.lit("\\")), F.lit(" ")))
             .when(fid == 2, F.concat(F.lit("../"), F.col("path")))
             .when(fid == 3, F.concat(F.col("path"), F.lit("/../x")))
             .when(fid == 4, F.lit(""))
             .otherwise(F.concat(F.lit("./"), F.col("job_id").cast("string"), F.lit("//"), F.col("filename"))))


@key("path_functions")
def _path_functions(c):
    f = c.file()
    user = F.when(F.col("file_id") % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("user "), (F.col("file_id") % 10).cast("string")))
    save = F.when(F.col("file_id") % 4 == 0, F.lit("custom dir")).otherwise(F.lit(None).cast("string"))
    ref = _ref(f)
    return f.select(
        "file_id",
        P.basename("path").alias("basename"),
        P.stem("path").alias("stem"),
        P.extension("path").alias("extension"),
        P.upload_path("checksum", "filename").alias("upload_path"),
        P.output_path(user, F.col("filename"), save, F.col("job_id")).alias("output_path"),
        P.relative_path(F.concat(F.lit("/srv/media/"), F.col("path")), F.lit("jobs/")).alias("relative_path"),
        P.ref_matches(ref, F.col("path")).alias("ref_matches"),
    )


@key("json_functions")
def _json_functions(c):
    e = c.t("events")
    eid = F.col("event_id")
    lim = (F.when(eid % 6 == 0, F.lit("null")).when(eid % 6 == 1, F.lit("2"))
            .when(eid % 6 == 2, F.lit('"+"')).when(eid % 6 == 3, F.lit('"*"'))
            .when(eid % 6 == 4, F.lit("1")).otherwise(F.lit('"3"')))
    raw = F.when(eid % 4 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return e.select(
        "event_id",
        V.max_choices(lim).alias("max_choices"),
        V.multiple_choice(lim).alias("multiple_choice"),
        V.try_json(raw).alias("stored"),
    )


@key("coerce_value")
def _coerce_value(c):
    p = c.param()
    return p.select("job_id", "pos", V.coerce_value("form_field", "raw").alias("value"))


@key("array_functions")
def _array_functions(c):
    s = c.script()
    a = F.split(F.col("script_name"), " ")
    b = F.split(F.concat_ws(" ", F.col("group_name"), F.col("description"), F.element_at(a, 1)), " ")
    return s.select(
        "script_id",
        F.array_join(V.ensure_list("description"), ",").alias("as_list"),
        F.size(V.range_array(F.col("script_order") % 5 - 1)).cast("bigint").alias("range_size"),
        F.array_join(V.range_array(F.col("script_order") % 5 - 1).cast("array<string>"), ",").alias("range_text"),
        F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("merged"),
        F.array_join(F.array_sort(F.array_intersect(a, b)), ",").alias("common"),
        F.array_join(V.flatten_list(F.array(a, b)), ",").alias("flat"),
        F.size(V.split_properties("script_name")).cast("bigint").alias("n_props"),
    )


@key("math_functions")
def _math_functions(c):
    m = c.matrix()
    return m.select(
        "major", "minor", "c1", "c3",
        _r(F.when(F.col("c3") > 0, F.log2("c3"))).alias("log2_c3"),
        _r(F.abs(F.col("c3") - 0.05)).alias("abs_c3"),
        _r(F.sqrt("c2")).alias("sqrt_c2"),
        _r(F.exp(-F.col("c3"))).alias("exp_c3"),
        _r(F.pow("c1", 2)).alias("pow_c1"),
        _r(T.divide("c1", "c3")).alias("div_c1_c3"),
    )


@key("date_functions")
def _date_functions(c):
    j = c.job()
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return j.select(
        "job_id",
        submitted_text(F.col("created_date")).alias("submitted"),
        (F.col("created_date") <= as_of - F.expr("INTERVAL 7 DAYS")).alias("is_old"),
    )


@key("sequence_functions")
def _sequence_functions(c):
    s = c.seq()
    frame = F.element_at(F.array(*[F.lit(f) for f in S.FRAMES]), (F.col("seq_id") % 6 + 1).cast("int"))
    return s.select(
        "seq_id", frame.alias("frame"),
        F.md5(S.complement("seq")).alias("complement_md5"),
        S.translate_frame(F.col("seq"), frame).alias("protein"),
    )


@key("search_terms")
def _search_terms(c):
    s = c.script()
    sid = F.col("script_id")
    q = (F.when(sid % 3 == 0, F.col("script_name"))
          .when(sid % 3 == 1, F.concat(F.lit('"'), F.col("script_name"), F.lit('"  x')))
          .otherwise(F.concat(F.lit("  "), F.col("group_name"), F.lit('   "a   b " c'))))
    return s.select("script_id", F.posexplode(T.search_terms(q)).alias("term_no", "term")).select(
        "script_id", F.col("term_no").cast("bigint").alias("term_no"), "term")


@key("attribute_map")
def _attribute_map(c):
    h = c.html()
    return h.select("page_id", F.explode(T.attribute_map("html")).alias("key", "value"))


@key("merge_attributes")
def _merge_attributes(c):
    h = c.html()
    m = T.merge_attributes(F.lit("custom-property lang"), F.col("html"), F.element_at(
        F.split(F.col("url"), "/"), 3))
    return h.select("page_id", F.explode(m).alias("key", "value"))
