"""Parameter operators: command assembly, validation, prefill, layout.

Submitted values are long rows (job_id, pos, name, form_field, short_param,
collapse, raw[, parser_name]).  A job's command is one ordered fold of its
own rows, so the per-job groups are bounded by the job's command line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlake.functions.values import (BOOLEAN, CHAR, FILE, FLOAT, INTEGER, coerce_value, max_choices)
from runlake.operators.files import resolve_refs
from runlake.operators.jobs import SUBMITTED
from runlake.operators.joins import shuffled
from runlake.operators.ranking import row_number_by

# Validation messages.
ERR_REQUIRED = "This field is required."
ERR_CHOICE = "Select a valid choice."
ERR_INTEGER = "Enter a whole number."
ERR_TOO_MANY = "Too many values."
ERR_NUMBER = "Enter a number."
ERR_PARSER = "A sub-command must be chosen."
ERR_FILE_UNKNOWN = "Referenced file could not be found."
ERR_FILE_FORBIDDEN = "You are not permitted to access this file."

# Texts a form accepts as a whole number (zero decimals allowed) and as a finite number.
INTEGER_TEXT = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"
FLOAT_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def subprocess_value(form_field: Column, raw: Column) -> Column:
    """Text a value contributes to a command: NULL when skipped, '' for a
    boolean flag (flag alone), the normalized integer, else the text."""
    # the same rules as ``coerce_value`` without building JSON text
    return (F.when(raw.isNull(), F.lit(None).cast("string"))
             .when(form_field == CHAR, F.when(raw != "", raw))
             .when(form_field == INTEGER, F.when(raw.rlike("^[0-9]+$"), raw.try_cast("decimal(38,0)").cast("string")))
             .when(form_field == BOOLEAN, F.lit(""))
             .otherwise(raw))


def assemble_commands(values: DataFrame) -> DataFrame:
    """Fold value rows into the ordered token list of each job.

    Base-parser values first, then sub-parser values; tokens grouped by flag
    alone in first-seen order, and the last value's parameter says which
    parser the flag belongs to and whether it collapses; a flag without values
    is emitted alone; a collapsing flag is written once, otherwise before
    every value; a positional (empty) flag writes values only; the sub-parser
    name comes once before its first token.

    One shuffle: rows are hash-partitioned by job once; the per-flag and the
    per-job aggregation both reuse that partitioning (a job's values are
    bounded by its command line).  The ordering key is one BIGINT so the
    aggregates stay hash-based.
    """
    has_parser = "parser_name" in values.columns
    v = values.withColumn("parser_name", F.col("parser_name") if has_parser else F.lit(""))
    v = v.withColumn("_val", subprocess_value(F.col("form_field"), F.col("raw"))).filter(F.col("_val").isNotNull())
    order = (F.col("parser_name") != "").cast("bigint") * F.lit(1 << 32) + F.col("pos").cast("bigint")
    v = v.withColumn("_ord", order).repartition("job_id")
    per_flag = v.groupBy("job_id", F.col("short_param").alias("flag")).agg(
        F.min("_ord").alias("first"), F.max_by("parser_name", "_ord").alias("parser_name"),
        F.max_by("collapse", "_ord").alias("collapse"),
        F.array_sort(F.collect_list(F.when(F.col("_val") != "", F.struct("_ord", "_val")))).alias("vals"))
    flag, vals = F.col("flag"), F.transform(F.col("vals"), lambda x: x["_val"])
    toks = F.when((flag != "") & (F.size(vals) == 0), F.array(flag)).otherwise(
        F.flatten(F.transform(vals, lambda x, i: F.when((flag != "") & (~F.col("collapse") | (i == 0)),
                                                        F.array(flag, x)).otherwise(F.array(x)))))
    per_job = per_flag.groupBy("job_id").agg(F.array_sort(F.collect_list(
        F.struct("first", F.col("parser_name").alias("parser"), toks.alias("toks")))).alias("_e"))
    e = F.filter("_e", lambda x: F.size(x["toks"]) > 0)
    parsers = F.transform(e, lambda x: x["parser"])
    # the sub-parser name goes before the first entry of its parser
    with_parser = F.transform(e, lambda x, i: F.when(
        (x["parser"] != "") & (F.array_position(parsers, x["parser"]) == i + 1),
        F.concat(F.array(x["parser"]), x["toks"])).otherwise(x["toks"]))
    return per_job.select("job_id", F.flatten(with_parser).alias("tokens"))


def command_tokens(values: DataFrame) -> DataFrame:
    """The same command as ``assemble_commands`` as a token table
    (job_id, token_pos, token) that never gathers a job's values.

    Entries are (job, flag) groups: their first position, parser, collapse
    flag and value count come from partial aggregates; entry order and
    token offsets use windows over the entries of one job (one row per
    distinct flag).  Each value's index inside its flag group comes from
    ``row_number_by``, which splits a hot (job, flag) group, so a job with
    very many values is laid out in parallel.
    """
    has_parser = "parser_name" in values.columns
    v = values.withColumn("parser_name", F.col("parser_name") if has_parser else F.lit(""))
    v = v.withColumn("_val", subprocess_value(F.col("form_field"), F.col("raw"))).filter(F.col("_val").isNotNull())
    v = v.withColumn("_ord", (F.col("parser_name") != "").cast("bigint") * F.lit(1 << 32)
                     + F.col("pos").cast("bigint")).withColumn("flag", F.col("short_param"))
    key = ["job_id", "flag"]
    ent = v.groupBy(*key).agg(F.min("_ord").alias("first"), F.max_by("parser_name", "_ord").alias("parser_name"),
                              F.max_by("collapse", "_ord").alias("collapse"), F.count_if(F.col("_val") != "").alias("n_vals"))
    has_flag = F.col("flag") != ""
    n_tok = (F.when(has_flag & (F.col("n_vals") == 0), F.lit(1))
              .when(has_flag & F.col("collapse"), F.col("n_vals") + 1)
              .when(has_flag, F.col("n_vals") * 2)
              .otherwise(F.col("n_vals")))
    by_job = Window.partitionBy("job_id").orderBy("first")
    first_of_parser = F.col("first") == F.min("first").over(Window.partitionBy("job_id", "parser_name"))
    lead = (first_of_parser & (F.col("parser_name") != "")).cast("long")
    ent = ent.filter(n_tok > 0).withColumn("_lead", lead).withColumn("_n", n_tok + F.col("_lead"))
    ent = ent.withColumn("_off", F.coalesce(F.sum("_n").over(by_job.rowsBetween(Window.unboundedPreceding, -1)),
                                            F.lit(0)))
    # parser names and flags written once per entry
    heads = ent.select("job_id", (F.col("_off") + 1).alias("token_pos"), F.col("parser_name").alias("token")) \
               .where(F.col("_lead") == 1)
    alone = ent.filter(has_flag & ((F.col("n_vals") == 0) | F.col("collapse"))).select(
        "job_id", (F.col("_off") + F.col("_lead") + 1).alias("token_pos"), F.col("flag").alias("token"))
    vals = row_number_by(v.filter(F.col("_val") != "").select(*key, "_ord", "_val"), key, ["_ord"], name="_j")
    vals = vals.join(shuffled(ent.select(*key, F.col("collapse").alias("_coll"), "_lead", "_off")), key)
    base = F.col("_off") + F.col("_lead")
    j = F.col("_j")
    value_pos = (F.when(has_flag & F.col("_coll"), base + 1 + j)
                  .when(has_flag, base + 2 * j)
                  .otherwise(base + j))
    repeated = vals.filter(has_flag & ~F.col("_coll")).select(
        "job_id", (base + 2 * j - 1).alias("token_pos"), F.col("flag").alias("token"))
    value_toks = vals.select("job_id", value_pos.alias("token_pos"), F.col("_val").alias("token"))
    out = heads.unionByName(alone).unionByName(repeated).unionByName(value_toks)
    return out.select("job_id", F.col("token_pos").cast("bigint").alias("token_pos"), "token")


def explode_values(jobs: DataFrame, col: str = "values") -> DataFrame:
    """One row per value of a multi-valued parameter, with its position."""
    return jobs.select(*[c for c in jobs.columns if c != col],
                       F.posexplode(F.col(col)).alias("value_pos", "value"))


def prefill_from_job(values: DataFrame, spec: DataFrame, job_script: DataFrame) -> DataFrame:
    """Form prefill from an earlier job: per (job, form slug) the non-null
    values in submitted order."""
    v = (values.join(shuffled(job_script), "job_id")
               .join(shuffled(spec.select("script_id", "name", "param_id")), ["script_id", "name"]))
    v = v.withColumn("_stored", coerce_value(F.col("form_field"), F.col("raw"))).filter(F.col("_stored").isNotNull())
    slug = F.concat_ws("-", F.col("param_id").cast("string"), F.col("name"))
    return v.groupBy("job_id", slug.alias("form_slug")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "_stored"))), lambda x: x["_stored"]).alias("values"))


def first_seen(values: DataFrame, by: str, key: str, pos: str = "pos") -> DataFrame:
    """Order of keys inside each group by first appearance."""
    f = values.groupBy(by, key).agg(F.min(pos).alias("_first"))
    w = Window.partitionBy(by).orderBy("_first", key)
    return f.select(by, key, F.row_number().over(w).cast("bigint").alias("first_seen_rank"))


def number_params(spec: DataFrame) -> DataFrame:
    """Running parameter index per script across parsers then groups then order."""
    w = Window.partitionBy("script_id").orderBy("parser_name", "group_name", "param_order", "param_id")
    return spec.select("param_id", "script_id", F.row_number().over(w).cast("bigint").alias("param_index"))


def order_params(spec: DataFrame) -> DataFrame:
    return spec.orderBy("param_order", "param_id")


def visible_params(spec: DataFrame) -> DataFrame:
    """Drop hidden parameters and parameters of hidden groups."""
    return spec.filter(~F.col("hidden") & ~F.col("group_hidden"))


def params_by_parser(spec: DataFrame) -> DataFrame:
    """Parameters grouped by parser, sorted by (name, order)."""
    return spec.groupBy("script_id", "parser_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("name", "param_order", "param_id"))),
                    lambda x: x["name"]).alias("params"))


def spec_report(spec: DataFrame) -> DataFrame:
    """Layout per (script, parser): group ``Required`` first, then groups in
    order of their first parameter; empty groups removed; parsers without
    visible parameters kept with an empty layout."""
    vis = visible_params(spec)
    groups = vis.groupBy("script_id", "parser_name", "group_name").agg(
        F.min("param_order").alias("_first"),
        F.transform(F.array_sort(F.collect_list(F.struct("param_order", "param_id", "name"))),
                    lambda x: x["name"]).alias("params"))
    g = F.struct((F.col("group_name") != "Required").alias("_r"), F.col("_first"), F.col("group_name"))
    layout = groups.groupBy("script_id", "parser_name").agg(
        F.array_sort(F.collect_list(F.struct(g.alias("k"), F.col("group_name"), F.col("params")))).alias("_g"))
    parsers = spec.select("script_id", "parser_name").distinct()
    out = parsers.join(layout, ["script_id", "parser_name"], "left")
    return out.select("script_id", "parser_name",
                      F.coalesce(F.transform("_g", lambda x: F.struct(x["group_name"].alias("group"),
                                                                       x["params"].alias("params"))),
                                 F.array().cast("array<struct<group:string,params:array<string>>>")).alias("layout"))


def add_missing_parsers(layout: DataFrame, parsers: DataFrame) -> DataFrame:
    """Parsers without any parameter are added with an empty layout."""
    missing = parsers.join(layout.select("script_id", "parser_name"), ["script_id", "parser_name"], "left_anti")
    return layout.unionByName(missing.select(
        "script_id", "parser_name", F.array().cast(layout.schema["layout"].dataType).alias("layout")))


def scope_params(values: DataFrame, spec: DataFrame, job_script: DataFrame, chosen: DataFrame,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """Keep values of the chosen parser or of the base parser ('').

    ``chosen``: (job_id, parser_name).  Without a choice a script's only
    parser is chosen; a job of a script with several parsers, the base one
    counted, gets one error row (pos, name, parser_name NULL) and no values.
    ``carry`` names value columns to keep.
    """
    parsers = spec.groupBy("script_id").agg(F.countDistinct("parser_name").alias("_n"),
                                            F.min("parser_name").alias("_only"))
    c = chosen.select("job_id", F.col("parser_name").alias("_asked"))
    jobs = job_script.join(shuffled(c), "job_id", "left").join(shuffled(parsers), "script_id", "left").select(
        "job_id", "script_id", F.coalesce("_asked", F.when(F.col("_n") == 1, F.col("_only"))).alias("_chosen"),
        (F.col("_asked").isNull() & (F.coalesce("_n", F.lit(0)) > 1)).alias("_unchosen"))
    s = spec.select("script_id", "name", "parser_name")
    v = (values.select("job_id", "pos", "name", *carry).join(shuffled(jobs.filter(~F.col("_unchosen"))), "job_id")
               .join(shuffled(s), ["script_id", "name"]))
    kept = v.filter((F.col("parser_name") == "") | (F.col("parser_name") == F.col("_chosen"))).select(
        "job_id", "pos", "name", "parser_name", F.lit(None).cast("string").alias("error"), *carry)
    errors = jobs.filter("_unchosen").select("job_id", F.lit(ERR_PARSER).alias("error"))
    return kept.unionByName(errors, allowMissingColumns=True)


def validate(values: DataFrame, spec: DataFrame, job_script: DataFrame, file_errors: DataFrame | None = None,
             names: DataFrame | None = None) -> DataFrame:
    """Errors per (job, field): required, choice, type, count, file and job name rules.

    Every field a job's script expects is joined to the job's values once, so
    that one aggregate over (job, field) finds wrong, too many and missing
    values.  ``file_errors`` (job_id, name, error) are the files that could
    not be used (see ``file_value_errors``); a field with such an error is not
    called missing as well.  ``names`` (job_id, job_name) are the job names, which may not be blank.
    """
    # choice lists and limits are parsed once per specification row, not per value
    sp = spec.select("script_id", "name", "form_field", "required",
                     F.from_json(F.col("choices"), "array<string>").alias("_choices"),
                     max_choices(F.col("choice_limit")).alias("_max"))
    fields = job_script.select("job_id", "script_id").join(shuffled(sp), "script_id")
    v = fields.join(shuffled(values.select("job_id", "name", "raw")), ["job_id", "name"], "left")
    present = F.col("raw").isNotNull() & (F.col("raw") != "")
    per_field = v.groupBy("job_id", "name").agg(
        F.count_if(present).alias("n"), F.bool_or("required").alias("required"), F.max("_max").alias("_max"),
        F.count_if(present & (F.col("form_field") == INTEGER) & ~F.col("raw").rlike(INTEGER_TEXT)).alias("bad_int"),
        F.count_if(present & (F.col("form_field") == FLOAT) & ~F.col("raw").rlike(FLOAT_TEXT)).alias("bad_float"),
        F.count_if(present & F.col("_choices").isNotNull()
                   & ~F.array_contains(F.col("_choices"), F.col("raw"))).alias("bad_choice"))
    lim = F.col("_max")
    errs = F.filter(F.array(
        F.when(F.col("bad_choice") > 0, F.lit(ERR_CHOICE)),
        F.when(F.col("bad_int") > 0, F.lit(ERR_INTEGER)),
        F.when(F.col("bad_float") > 0, F.lit(ERR_NUMBER)),
        F.when((lim != -1) & (F.col("n") > lim), F.lit(ERR_TOO_MANY)),
        F.when(F.col("required") & (F.col("n") == 0), F.lit(ERR_REQUIRED))), lambda x: x.isNotNull())
    found = per_field.select("job_id", "name", F.explode(errs).alias("error"))
    if file_errors is not None:
        found = found.unionByName(file_errors.select("job_id", "name", "error").distinct())
    if names is not None:
        blank = F.btrim(F.coalesce("job_name", F.lit(""))) == ""
        nameless = job_script.select("job_id").join(shuffled(names.select("job_id", "job_name")), "job_id", "left").filter(blank)
        found = found.unionByName(nameless.select("job_id", F.lit("job_name").alias("name"), F.lit(ERR_REQUIRED).alias("error")))
    return found


def file_value_errors(values: DataFrame, owners: DataFrame, user_files: DataFrame, files: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, name, error) of file values (job_id, pos, name, form_field, raw) that do not resolve for the job's user.

    A value names a file of an earlier job; it is found, unknown, or belongs to somebody else (``owners``: job_id, user_id)."""
    asked = values.filter((F.col("form_field") == FILE) & (F.coalesce("raw", F.lit("")) != ""))
    asked = asked.join(shuffled(owners.select("job_id", F.col("user_id").alias("viewer_id"))), "job_id", "left").withColumn(
        "ref_id", F.struct("job_id", "pos", "name"))
    found = resolve_refs(asked.select("ref_id", "viewer_id", F.col("raw").alias("ref")), user_files, files, jobs)
    error = F.when(F.col("outcome") == "not found", ERR_FILE_UNKNOWN).when(F.col("outcome") == "not permitted", ERR_FILE_FORBIDDEN)
    return found.select("ref_id.job_id", "ref_id.name", error.alias("error")).filter(F.col("error").isNotNull())


def create_jobs(requests: DataFrame, values: DataFrame, spec: DataFrame, last_id) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs and stored values for submissions (request_id, user_id, script_id, parser_name or null, job_name, job_description).

    A script with several parsers, the base one counted, needs a chosen one;
    without it the submission is an error.  New ids follow ``last_id`` in order
    of request.  A job starts as submitted, with empty logs and no task.  The
    values (request_id, pos, name, form_field, raw) of the chosen and of the
    base parser are stored as JSON by the type of their parameter, each as a row of its own;
    others are not.  Returns (jobs, values, errors)."""
    parsers = spec.groupBy("script_id").agg(F.count_distinct("parser_name").alias("_n"), F.min("parser_name").alias("_only"))
    r = requests.join(shuffled(parsers), "script_id", "left")
    several = F.col("parser_name").isNull() & (F.coalesce("_n", F.lit(0)) > 1)
    errors = r.filter(several).select("request_id", F.lit(ERR_PARSER).alias("error"))
    good = r.filter(~several).select("request_id", "user_id", "script_id", "job_name", "job_description",
                                     F.coalesce("parser_name", F.when(F.col("_n") == 1, F.col("_only"))).alias("_chosen"))
    ids = row_number_by(good.select("request_id"), [], ["request_id"], name="_k")
    ids = ids.select("request_id", (F.col("_k") + F.coalesce(last_id, F.lit(0))).alias("job_id"))
    made = good.join(shuffled(ids), "request_id")
    jobs = made.select("job_id", "request_id", "user_id", "script_id", "job_name", F.coalesce("job_description", F.lit("")).alias("job_description"),
                       F.lit(SUBMITTED).alias("status"), F.lit("").alias("stdout"), F.lit("").alias("stderr"), F.lit(None).cast("string").alias("celery_id"))
    known = spec.select("script_id", "name", F.col("parser_name").alias("_of"), F.col("form_field").alias("_field"), "param_id", "param_order")
    stored = (values.select("request_id", "pos", "name", "raw").join(shuffled(made.select("request_id", "job_id", "script_id", "_chosen")), "request_id")
                    .join(shuffled(known), ["script_id", "name"])
                    .filter((F.col("_of") == "") | (F.col("_of") == F.col("_chosen"))))
    stored = stored.select("job_id", "param_id", "param_order", "pos", coerce_value(F.col("_field"), F.col("raw")).alias("value"))
    return jobs, stored, errors


def merge_values(a, b) -> Column:
    """Union of previously chosen and newly supplied values, distinct."""
    return F.array_union(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def reuse_params(old: DataFrame, new: DataFrame, attrs: list[str], key: str = "version_id") -> DataFrame:
    """Parameters of the definitions ``new`` of versions (``key``, script_id,
    position and attributes), loaded in order of version and position.

    A definition uses the parameter of its script, parser and group that is
    equal in flag and all ``attrs`` (nulls are equal); a positional one must
    also have its position.  The parameter may come from ``old`` (its lowest
    id) or from an earlier definition; otherwise it is made, with the next id in order.
    Gives (``key``, position, param_id, is_new).

    Equal definitions share a parameter, so all that counts is the distinct
    tuples: both sides are reduced to them by partial aggregates, and
    identical definitions never multiply the join.
    """
    place = F.when(F.coalesce("short_param", F.lit("")) == "", F.col("position"))
    parts = ["script_id", "parser_name", "group_name", "short_param", *attrs]
    # nulls as a marked text: tuples become join keys that hash and sort alike
    tuples = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(f"c{i}") for i, c in enumerate(parts)],
                                F.coalesce(place.cast("string"), F.lit("")).alias("place")))
    found = old.groupBy(tuples.alias("_t")).agg(F.min("param_id").alias("_old_id"))
    n = new.select(key, "position", tuples.alias("_t"))
    firsts = n.groupBy("_t").agg(F.min(F.struct(key, "position")).alias("_f"))
    made = row_number_by(firsts.join(shuffled(found), "_t", "left_anti").select("_t", F.col(f"_f.{key}").alias("_v"), F.col("_f.position").alias("_p")),
                         [], ["_v", "_p"], name="_k")
    ids = made.select("_t", "_v", "_p", (F.col("_k") + F.coalesce(old.select(F.max("param_id")).scalar(), F.lit(0))).alias("_made_id"))
    return n.join(shuffled(found), "_t", "left").join(shuffled(ids), "_t", "left").select(
        key, "position", F.coalesce("_old_id", "_made_id").alias("param_id"),
        F.coalesce((F.col("_v") == F.col(key)) & (F.col("_p") == F.col("position")), F.lit(False)).alias("is_new"))


def distinct_matches(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)
