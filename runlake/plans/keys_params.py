"""Keys of the parameter family."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.functions.values import FILE, FLOAT
from runlake.operators import params as PR
from runlake.operators.joins import shuffled
from runlake.plans.queries import key

# attributes besides script, parser, group and flag in which a definition must equal a known parameter
REUSE_ATTRS = ["name", "is_output", "required", "form_field", "input_type", "choices", "choice_limit", "param_help", "is_checked",
               "collapse", "default"]


def _parsed_values(c):
    """Submitted values with their parser: a sub-parser has the switch and one of the two parameters that share a flag."""
    return c.param().withColumn("parser_name", F.when(F.col("pos").isin(4, 5) & (F.col("job_id") % 3 != 0), "sub").otherwise(""))


@key("assemble_command")
def _assemble_command(c):
    t = PR.assemble_commands(_parsed_values(c))
    return t.select("job_id", F.array_join("tokens", " ").alias("command"),
                    F.size("tokens").cast("bigint").alias("n_tokens"))


def _prefill(c):
    return PR.prefill_from_job(c.param(), c.spec(), c.job_script())


@key("prefill_from_job")
def _prefill_from_job(c):
    return _prefill(c).select("job_id", "form_slug", F.array_join("values", "|").alias("values"))


@key("explode_values")
def _explode_values(c):
    return PR.explode_values(_prefill(c), "values").select(
        "job_id", "form_slug", F.col("value_pos").cast("bigint").alias("value_pos"), "value")


@key("first_seen_order")
def _first_seen_order(c):
    return PR.first_seen(c.param(), "job_id", "short_param")


@key("param_order")
def _param_order(c):
    return PR.number_params(c.spec())


@key("sort_params")
def _sort_params(c):
    return PR.order_params(c.spec()).select("param_id", "param_order")


@key("visible_params")
def _visible_params(c):
    return PR.visible_params(c.spec()).select("param_id", "script_id", "name")


@key("group_by_parser")
def _group_by_parser(c):
    return PR.params_by_parser(c.spec()).select("script_id", "parser_name",
                                                F.array_join("params", ",").alias("params"))


def _layout_text(col):
    return F.array_join(F.transform(col, lambda g: F.concat(g["group"], F.lit(":"), F.array_join(g["params"], ","))),
                        ";")


@key("spec_report")
def _spec_report(c):
    r = PR.spec_report(c.spec())
    return r.select("script_id", "parser_name", _layout_text(F.col("layout")).alias("layout"))


@key("parser_coverage")
def _parser_coverage(c):
    spec = c.spec()
    vis = PR.visible_params(spec)
    layout = vis.groupBy("script_id", "parser_name").agg(
        F.array_sort(F.collect_set("group_name")).alias("groups")).select(
        "script_id", "parser_name", F.transform("groups", lambda g: F.struct(
            g.alias("group"), F.array().cast("array<string>").alias("params"))).alias("layout"))
    parsers = spec.select("script_id", "parser_name").distinct()
    out = PR.add_missing_parsers(layout, parsers)
    return out.select("script_id", "parser_name", F.size("layout").cast("bigint").alias("n_groups"))


def _chosen(c):
    o = c.t("orders")
    return o.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("job_id"),
                                                         F.lit("sub").alias("parser_name"))


@key("subparser_scope")
def _subparser_scope(c):
    return PR.scope_params(c.param(), c.spec(), c.job_script(), _chosen(c))


def _full_spec(c):
    """Specification with a number and a file parameter besides the others."""
    cols = ["script_id", "name", "form_field", "required", "choices", "choice_limit", "parser_name", "param_id", "param_order"]
    extra = c.t("part").select(F.col("p_partkey").alias("script_id"), F.inline(F.array(*[F.struct(
        F.lit(n).alias("name"), F.lit(ff).alias("form_field"), rq.alias("required"), F.lit(None).cast("string").alias("choices"),
        F.lit("null").alias("choice_limit"), F.lit("").alias("parser_name"), (F.col("p_partkey") * 10 + k).alias("param_id"),
        F.lit(k).alias("param_order")) for k, n, ff, rq in ((7, "infile", FILE, F.col("p_partkey") % 2 == 0), (8, "ratio", FLOAT, F.lit(False)))])))
    return c.spec().select(*cols).unionByName(extra)


def _submitted(c):
    """Submitted values, with a file of an earlier job (some unknown, some missing) and a number (some wrong)."""
    k = F.col("o_orderkey")
    row = lambda pos, name, ff, raw: [k.alias("job_id"), F.lit(pos).alias("pos"), F.lit(name).alias("name"),
                                      F.lit(ff).alias("form_field"), raw.alias("raw")]
    files = c.t("orders").join(shuffled(c.file().select("file_id", "path")), k == F.col("file_id"), "left").select(
        *row(7, "infile", FILE, F.when(k % 3 != 0, F.coalesce("path", F.lit("jobs/0/none.txt")))))
    ratio = F.element_at(F.array(*[F.lit(x) for x in ("0.5", "abc", "-1e3", "nan", "")]), (k % 5 + 1).cast("int"))
    return c.param().select("job_id", "pos", "name", "form_field", "raw").unionByName(files).unionByName(
        c.t("orders").select(*row(8, "ratio", FLOAT, ratio)))


def _requests(c):
    """A submission per order; those in status F choose the sub-parser, every ninth has no name."""
    k = F.col("o_orderkey")
    return c.t("orders").select(
        k.alias("request_id"), F.col("o_custkey").alias("user_id"), F.col("o_custkey").alias("script_id"),
        F.when(F.col("o_orderstatus") == "F", "sub").alias("parser_name"),
        F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit("order "), k.cast("string"))).alias("job_name"),
        F.lit(None).cast("string").alias("job_description"))


@key("create_jobs")
def _create_jobs(c):
    """Jobs, stored values and refused submissions."""
    values = _submitted(c).withColumnRenamed("job_id", "request_id")
    jobs, stored, errors = PR.create_jobs(_requests(c), values, _full_spec(c), c.job().select(F.max("job_id")).scalar())
    no = lambda t: F.lit(None).cast(t)
    a = jobs.select(F.lit("job").alias("kind"), "job_id", "request_id", "user_id", no("bigint").alias("param_id"), no("int").alias("pos"),
                    F.concat_ws("|", "job_name", "job_description", "status", "stdout", "stderr").alias("text"))
    b = stored.select(F.lit("value").alias("kind"), "job_id", no("bigint").alias("request_id"), no("bigint").alias("user_id"), "param_id", "pos",
                      F.col("value").alias("text"))
    d = errors.select(F.lit("error").alias("kind"), no("bigint").alias("job_id"), "request_id", no("bigint").alias("user_id"),
                      no("bigint").alias("param_id"), no("int").alias("pos"), F.col("error").alias("text"))
    return a.unionByName(b).unionByName(d)


@key("validate_submission")
def _validate_submission(c):
    values, owners = _submitted(c), _requests(c).select(F.col("request_id").alias("job_id"), "user_id", "job_name")
    wrong = PR.file_value_errors(values, owners, c.user_file(), c.file(), c.job())
    return PR.validate(values, _full_spec(c), c.job_script(), wrong, owners)


@key("merge_values")
def _merge_values(c):
    cl = c.cells()
    return cl.select("file_id", "row_no", F.array_join(F.array_sort(
        PR.merge_values(F.col("cells"), F.split(F.lower(F.array_join("cells", ",")), ","))), "|").alias("merged"))


def _definitions(c):
    """Parameter definitions with all attributes; a script's text differs by script."""
    k = F.col("script_id")
    return c.spec().withColumns({
        "position": F.col("param_order") + 1, "is_output": F.col("slot") == 3, "is_checked": F.col("slot") == 4,
        "input_type": F.when(F.col("form_field") == "IntegerField", "int").otherwise("str"),
        "param_help": F.concat(F.lit("about "), F.col("name"), F.lit(" "), (k % 3).cast("string")),
        "default": F.when(F.col("slot") == 1, (k % 2).cast("string"))})


@key("reuse_params")
def _reuse_params(c):
    """Two new versions of every script: one in the known order, one in reverse order with a changed help text here and there."""
    s = _definitions(c)
    k = F.col("script_id")
    same = s.withColumn("version_id", k * 2)
    turned = s.withColumns({"version_id": k * 2 + 1, "position": F.lit(5) - F.col("param_order"), "param_help": F.when(
        (k % 4 == 0) & (F.col("slot") == 2), "new text").otherwise(F.col("param_help"))})
    return PR.reuse_params(s.filter(F.col("parser_name") == ""), same.unionByName(turned), REUSE_ATTRS)


@key("distinct_rows")
def _distinct_rows(c):
    v = c.param().join(shuffled(c.job_script()), "job_id")
    return PR.distinct_matches(v.select("script_id", "name"), ["script_id", "name"])


@key("command_tokens")
def _command_tokens(c):
    return PR.command_tokens(_parsed_values(c))
