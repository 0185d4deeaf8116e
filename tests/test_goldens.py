"""Literal expectations of the reference's own tests, on tiny DataFrames."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from runlake.functions import text as T
from runlake.functions import values as V
from runlake.functions.sequences import complement, translate_frame, translate_frame_native
from runlake.operators import access as A
from runlake.operators import catalog as C
from runlake.operators import catalog_load as CL
from runlake.operators import commands as CM
from runlake.operators import files as FL
from runlake.operators import jobs as J
from runlake.operators import params as PR
from runlake.operators import patches as PT
from runlake.operators import search as search_ops
from runlake.operators.search import keyword_search, search_queries


def _one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


# ------------------------------------------------------------------ commands
def _values(spark, rows):
    schema = "job_id long, pos int, name string, form_field string, short_param string, collapse boolean, raw string"
    return spark.createDataFrame(rows, schema)


def test_repeated_flag_not_collapsed(spark):
    v = _values(spark, [(1, 0, "n", "IntegerField", "--need-at-least-one-numbers", False, "1"),
                        (1, 1, "n", "IntegerField", "--need-at-least-one-numbers", False, "2")])
    toks = PR.assemble_commands(v).first()["tokens"]
    assert " ".join(toks) == "--need-at-least-one-numbers 1 --need-at-least-one-numbers 2"


def test_collapsed_flag(spark):
    v = _values(spark, [(1, i, "c", "ChoiceField", "--choices-str", True, str(i + 1)) for i in range(3)])
    assert " ".join(PR.assemble_commands(v).first()["tokens"]) == "--choices-str 1 2 3"


def test_positional_order(spark):
    v = _values(spark, [(1, 0, "link", "CharField", "", True, "alink"),
                        (1, 1, "name", "CharField", "", True, "aname")])
    assert " ".join(PR.assemble_commands(v).first()["tokens"]) == "alink aname"


def test_boolean_flag_alone_and_nulls_skipped(spark):
    v = _values(spark, [(1, 0, "f", "BooleanField", "--flag", True, "True"),
                        (1, 1, "g", "BooleanField", "--off", True, None),
                        (1, 2, "i", "IntegerField", "--int", True, "-5")])
    assert PR.assemble_commands(v).first()["tokens"] == ["--flag"]


def test_subparser_name_once_before_first_token(spark):
    schema = ("job_id long, pos int, name string, form_field string, short_param string, collapse boolean, "
              "raw string, parser_name string")
    v = spark.createDataFrame([(1, 0, "a", "IntegerField", "--sp", True, "3", "sub1"),
                               (1, 1, "b", "FloatField", "--base", True, "2.3", ""),
                               (1, 2, "c", "IntegerField", "--sq", True, "4", "sub1")], schema)
    assert PR.assemble_commands(v).first()["tokens"] == ["--base", "2.3", "sub1", "--sp", "3", "--sq", "4"]


def test_a_flag_of_two_parsers_belongs_to_the_last(spark):
    schema = ("job_id long, pos int, name string, form_field string, short_param string, collapse boolean, "
              "raw string, parser_name string")
    v = spark.createDataFrame([(1, 0, "a", "CharField", "--x", False, "1", ""), (1, 1, "b", "CharField", "--x", True, "2", "sub"),
                               (1, 2, "c", "CharField", "--y", True, "3", ""),
                               (2, 0, "p", "BooleanField", "", True, "True", "sub"), (2, 1, "q", "CharField", "--z", True, "4", "sub")], schema)
    got = {r["job_id"]: r["tokens"] for r in PR.assemble_commands(v).collect()}
    assert got == {1: ["sub", "--x", "1", "2", "--y", "3"], 2: ["sub", "--z", "4"]}
    rows = PR.command_tokens(v).orderBy("job_id", "token_pos").collect()
    assert {k: [r["token"] for r in rows if r["job_id"] == k] for k in got} == got


# ------------------------------------------------------------ value rules
def test_choice_limits(spark):
    got = [_one(spark, F.struct(V.multiple_choice(F.lit(j)), V.max_choices(F.lit(j))))
           for j in ("2", "null", '"*"', '"+"', "1")]
    assert [tuple(g) for g in got] == [(True, 2), (False, 1), (True, -1), (True, -1), (False, 1)]


def test_coerce_value(spark):
    cases = [("IntegerField", "-5", None), ("IntegerField", "1.5", None), ("IntegerField", "12", "12"),
             ("BooleanField", "False", "true"), ("BooleanField", None, None), ("CharField", "", None),
             ("CharField", 'a"b', '"a\\"b"'), ("ChoiceField", "x", '"x"')]
    for ff, raw, want in cases:
        assert _one(spark, V.coerce_value(F.lit(ff), F.lit(raw).cast("string"))) == want, (ff, raw)


def test_value_order_kept(spark):
    v = _values(spark, [(1, 0, "customer", "IntegerField", "--c", True, "2"),
                        (1, 1, "customer", "IntegerField", "--c", True, "1"),
                        (1, 2, "customer", "IntegerField", "--c", True, "3")])
    spec = spark.createDataFrame([(10, 7, "customer", "IntegerField")],
                                 "param_id long, script_id long, name string, form_field string")
    js = spark.createDataFrame([(1, 7)], "job_id long, script_id long")
    out = PR.prefill_from_job(v, spec, js).first()
    assert out["values"] == ["2", "1", "3"]


# --------------------------------------------------------------- text rules
def test_widget_attributes(spark):
    m = _one(spark, T.merge_attributes(F.lit("custom-property"), F.lit('attr1="custom1" attr2="custom2"'),
                                       F.lit("custom-class")))
    assert m == {"custom-property": "true", "attr1": "custom1", "attr2": "custom2", "class": "custom-class"}


def test_attribute_last_key_wins(spark):
    assert _one(spark, T.attribute_map(F.lit('a="1" b="2" a="3"'))) == {"a": "3", "b": "2"}


def test_email_hash_golden(spark):
    assert _one(spark, T.email_hash(F.lit("a@a.com"))) == "d10ca8d11301c2f4993ac2279ce4b930"


def test_search_terms(spark):
    q = '  some random  words "with   quotes  " and   spaces'
    want = ["some", "random", "words", "with quotes", "and", "spaces"]
    assert _one(spark, T.search_terms(F.lit(q))) == want


def test_keyword_search_one_and_many(spark):
    rows = spark.createDataFrame([(1, "A  big Red fox", None), (2, "red", "BIG dog"), (3, None, None)],
                                 "id int, name string, note string")

    def found(query):
        return [r["id"] for r in keyword_search(rows, query, ["name", "note"]).orderBy("id").collect()]

    assert found("big red") == [1, 2] and found('"red fox"') == [1] and found("") == [1, 2, 3] and found("cat") == []


@pytest.mark.parametrize("salt_rows", [200_000, 1])
def test_search_for_a_table_of_queries(spark, monkeypatch, salt_rows):
    """Long, short and empty terms, phrases, terms across columns, hot grams in salted groups."""
    monkeypatch.setattr(search_ops, "SALT_ROWS", salt_rows)
    rows = [(1, "A  big Red fox", None), (2, "red", "BIG dog"), (3, None, None), (4, "\u00c9t\u00e9 in caf\u00e9\nnew line", "x"),
            (5, "redo the dog", "abc"), (6, "aaab", "")] + [(i, f"common red {i}", "ab") for i in range(10, 40)]
    asked = [(7, "dog"), (8, "red"), (9, None), (10, ""), (11, "a b"), (12, "re ed dog"), (13, '"red fox" big'), (14, "zzz red"),
             (15, "\u00c9T\u00c9"), (16, "ab"), (17, "aaa aab"), (18, "red red"), (19, "common 1"), (8, "abc")]
    df = spark.createDataFrame(rows, "id int, name string, note string")
    queries = spark.createDataFrame(asked, "query_id int, query string").where("query_id <> 8 or query = 'red'")
    got = sorted((r["query_id"], r["id"]) for r in search_queries(df, "id", queries, ["name", "note"]).collect())
    want = sorted((k, r["id"]) for k, q in asked if (k, q) != (8, "abc")
                  for r in keyword_search(df, q or "", ["name", "note"]).collect())
    assert got == want
    assert search_queries(df, "id", queries.limit(0), ["name"]).count() == 0
    assert search_queries(df.limit(0), "id", queries, ["name"]).count() == 0


def test_bearer_token(spark):
    assert _one(spark, T.bearer_token(F.lit("Bearer abc"))) == "abc"
    assert _one(spark, T.bearer_token(F.lit("Bearer"))) is None
    assert _one(spark, T.bearer_token(F.lit("Basic abc"))) is None


def test_sanitize(spark):
    assert _one(spark, T.sanitize_name(F.lit("a b-c"))) == "a_b_c"
    assert _one(spark, T.sanitize_string(F.lit('say "hi"'))) == 'say \\"hi\\"'


def test_range_array_guard(spark):
    assert _one(spark, V.range_array(F.lit(0))) == []
    assert _one(spark, V.range_array(F.lit(3))) == [0, 1, 2]


# ------------------------------------------------------------- sequences
def test_translate_frames(spark):
    assert _one(spark, translate_frame(F.lit("ATATATATATA"), "+3")) == "IYI"
    assert _one(spark, translate_frame(F.lit("ATGTAA"), "+1")) == "M*"
    assert _one(spark, translate_frame(F.lit("atgtaa"), "+1")) == "XX"
    assert _one(spark, complement(F.lit("ACGTxa"))) == "TGCANt"
    for seq, fr in (("ATGNNNTTTGA", "+1"), ("CCGTAGA", "-2"), ("AC", "+1")):
        assert _one(spark, translate_frame(F.lit(seq), fr)) == _one(spark, translate_frame_native(F.lit(seq), fr))


# ------------------------------------------------------------------ files
def test_available_names(spark):
    req = spark.createDataFrame([("d", "a_file", "txt"), ("d", "x", "txt")], "folder string, name string, ext string")
    ex = spark.createDataFrame([("d", "x.txt")], "folder string, filename string")
    got = {r["name"]: r["available"] for r in FL.available_names(req, ex).collect()}
    assert got == {"a_file": "a_file.txt", "x": "x_1.txt"}
    ex2 = spark.createDataFrame([("d", "x.txt"), ("d", "x_1.txt")], "folder string, filename string")
    assert FL.available_names(req.filter("name = 'x'"), ex2).first()["available"] == "x_2.txt"


def test_bundle_entries(spark):
    refs = spark.createDataFrame([(1, 1, True), (2, 1, True)], "file_id long, job_id long, is_output boolean")
    files = spark.createDataFrame([(1, "test_file", 3), (2, "test_dir/test_file", 4)],
                                  "file_id long, filename string, size_bytes long")
    names = spark.createDataFrame([(1, "abc")], "job_id long, job_name string")
    got = sorted(r["entry"] for r in FL.bundle_manifest(refs, files, names).collect())
    assert got == ["abc/", "abc/test_dir/test_file", "abc/test_file"]


def test_previews(spark):
    lines = ["Header1\tHeader2\tHeader3", "data1\tdata2\tdata3", "data4\tdata5\tdata6", "data7\tdata8\tdata9"]
    cells = spark.createDataFrame([(1, i + 1, l.split("\t")) for i, l in enumerate(lines)],
                                  "file_id long, row_no int, cells array<string>")
    assert FL.preview(cells).count() == 4
    many = spark.createDataFrame([(2, i, [str(i)]) for i in range(1, 21)], "file_id long, row_no int, cells array<string>")
    rows = sorted(FL.preview(many).collect(), key=lambda r: r["slot"])
    assert [r["row_no"] for r in rows] == [1, 2, 3, 4, 5, None, 16, 17, 18, 19, 20]
    fa = spark.createDataFrame([(1, i + 1, l) for i, l in enumerate([">abc", "ABC", ">abc123", "ABCCCC"])],
                               "file_id long, line_no int, line string")
    recs = sorted(FL.preview_fasta(fa).collect(), key=lambda r: r["rec_order"])
    assert [(r["header"], r["seq"]) for r in recs] == [(">abc", "ABC"), (">abc123", "ABCCCC")]
    notfa = spark.createDataFrame([(1, 1, "hello"), (1, 2, ">x"), (1, 3, "A")], "file_id long, line_no int, line string")
    assert FL.preview_fasta(notfa).count() == 0


def test_upload_dedup(spark):
    files = spark.createDataFrame([(1, "abc123", False), (2, "abc123", False), (3, "abc123", True)],
                                  "file_id long, checksum string, is_output boolean")
    m = {r["file_id"]: (r["keeper_id"], r["to_delete"]) for r in FL.dedup_uploads(files).collect()}
    assert m == {1: (1, False), 2: (1, True)}
    fav = spark.createDataFrame([(9, "userfile", 2)], "user_id long, content_type string, object_id long")
    assert FL.repoint_favorites(fav, FL.dedup_uploads(files)).first()["object_id"] == 1


# ------------------------------------------------------------------- jobs
def _jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id long, user_id long, status string, created_date timestamp_ntz, "
                                       "celery_id string")


def test_empty_queues(spark):
    jobs = _jobs(spark, [])
    users = spark.createDataFrame([(1,)], "user_id long")
    t = J.queue_totals(jobs, users).filter("user_id = 1").first()
    assert (t["global_total"], t["user_total"], t["results_total"]) == (0, 0, 0)


def test_retention(spark):
    now = datetime(2024, 1, 1, 12, 0, 0)
    jobs = _jobs(spark, [(1, None, "completed", datetime(2024, 1, 1, 11, 59, 59), None),
                         (2, 5, "completed", datetime(2024, 1, 1, 11, 59, 59), None)])
    keep = lambda a, u: sorted(r["job_id"] for r in J.surviving_jobs(jobs, str(now), a, u).collect())
    assert keep("1 hour", "1 hour") == [1, 2]
    assert keep("1 microsecond", "1 hour") == [2]
    assert keep("1 microsecond", "1 microsecond") == []


def test_dead_jobs(spark):
    jobs = _jobs(spark, [(1, None, "running", datetime(2024, 1, 1), "task-1"),
                         (2, None, "running", datetime(2024, 1, 1), "task-2"),
                         (3, None, "running", datetime(2024, 1, 1), None)])
    assert J.dead_jobs(jobs, None).filter("status = 'running'").count() == 3
    active = spark.createDataFrame([("task-2",)], "celery_id string")
    st = {r["job_id"]: r["status"] for r in J.dead_jobs(jobs, active).collect()}
    assert st == {1: "FAILURE", 2: "running", 3: "FAILURE"}


def test_visibility_rule(spark):
    assert _one(spark, J.job_visible(F.lit(None).cast("long"), F.lit(5).cast("long"))) is True
    assert _one(spark, J.job_visible(F.lit(5).cast("long"), F.lit(5).cast("long"))) is True
    assert _one(spark, J.job_visible(F.lit(5).cast("long"), F.lit(None).cast("long"))) is False


# --------------------------------------------------------------- access
def test_access_matrix(spark):
    users = spark.createDataFrame([(1, "g1"), (2, "g2")], "user_id long, user_group string")
    scripts = spark.createDataFrame([(10, True, "g1", "", True), (11, True, "", "", True), (12, False, "", "", True),
                                     (13, True, "", "", False), (14, True, "g1", "g1", False)],
                                    "script_id long, is_active boolean, script_group string, parent_group string, group_active boolean")
    req = spark.createDataFrame([(1, 1, 10), (2, 2, 10), (3, None, 11), (4, None, 10), (5, None, 12), (6, 1, 12), (7, 1, 13),
                                 (8, None, 13), (9, 1, 14)], "request_id long, user_id long, script_id long")
    checked = A.access_check(req, users, scripts).collect()
    got = {r["request_id"]: r["valid"] for r in checked if r["request_id"] < 7}
    # an inactive group blocks users, also members; only restricted objects say why
    assert {r["request_id"]: r["valid"] for r in checked if r["request_id"] > 6} == {7: False, 8: True, 9: False}
    told = A.FORBIDDEN
    assert {r["request_id"]: r["error"] for r in checked} == {1: None, 2: told, 3: None, 4: told, 5: None, 6: "", 7: "", 8: None, 9: told}
    # member ok, non-member blocked, anonymous on open script ok, anonymous on
    # restricted blocked, anonymous ignores is_active, inactive blocks users
    assert got == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}


def test_command_log_outcomes(spark):
    users = spark.createDataFrame([(1, "g1"), (2, "g2")], "user_id long, user_group string")
    scripts = spark.createDataFrame([(10, True, "g1", "", True), (11, True, "", "", True)],
                                    "script_id long, is_active boolean, script_group string, parent_group string, group_active boolean")
    jobs = spark.createDataFrame([(1, 1, "running", 10), (2, 2, "running", 11), (3, None, "running", 11), (4, 2, "running", 10)],
                                 "job_id long, user_id long, status string, script_id long")
    log = spark.createDataFrame([(1, 1, 1, "stop"), (2, 2, 1, "stop"), (3, 3, None, "rerun"), (4, 4, 2, "delete"), (5, 9, 1, "stop"),
                                 (6, 1, 1, "bogus"), (7, 4, 2, "bogus"), (8, 1, 1, "resubmit"), (9, 3, 1, "delete")],
                                "cmd_id long, job_id long, user_id long, command string")
    after, resubmits, errors = CM.apply_commands(jobs, log, users, scripts)
    assert {r["job_id"]: (r["status"], r["reruns"]) for r in after.collect()} == {
        1: (J.REVOKED, 0), 2: ("running", 0), 3: (J.DELETED, 1), 4: ("running", 0)}
    assert [r["cmd_id"] for r in resubmits.collect()] == [8]
    # 2: not the owner, 4 and 7: no access to the script (said first), 5: no such job
    assert {r["cmd_id"]: r["error"] for r in errors.collect()} == {
        2: "", 4: A.FORBIDDEN, 5: CM.ERR_JOB, 6: CM.ERR_UNKNOWN, 7: A.FORBIDDEN}


def test_toggle_favorites(spark):
    fav = spark.createDataFrame([(1, "script", 7)], "user_id long, content_type string, object_id long")
    log = spark.createDataFrame([(1, "script", 7), (1, "script", 8), (1, "script", 8), (2, "script", 7)],
                                "user_id long, content_type string, object_id long")
    got = sorted((r["user_id"], r["object_id"]) for r in A.toggle_favorites(fav, log).collect())
    assert got == [(2, 7)]


# --------------------------------------------------------------- patches
def test_version_patch_rules(spark):
    v = spark.createDataFrame([
        (1, 1, True, True, datetime(2024, 1, 1)), (2, 1, False, False, datetime(2024, 1, 2)),
        (3, 1, True, False, datetime(2024, 1, 3)), (4, 2, True, True, datetime(2024, 1, 1))],
        "version_id long, script_id long, is_active boolean, default_version boolean, created_date timestamp_ntz")
    p = spark.createDataFrame([(2, {"default_version": "true"}), (3, {"default_version": "true"}),
                               (4, {"default_version": "false"}), (1, {})],
                              "version_id long, patch map<string,string>")
    out = {r["version_id"]: (r["default_version"], r["is_active"], r["error"])
           for r in PT.apply_version_patches(v, p).collect()}
    assert out[2][2] == "A disabled script version cannot be set as default."
    assert out[3][:2] == (True, True) and out[1][0] is False        # new default clears the old one
    assert out[4][2] == "A script must have a default version."
    assert PT.check_version_patches(p.filter("version_id = 1")).first()["errors"] == [
        "At least one field is required."]


def test_token_table_equals_token_array(spark):
    schema = ("job_id long, pos int, name string, form_field string, short_param string, collapse boolean, "
              "raw string, parser_name string")
    v = spark.createDataFrame([
        (1, 0, "a", "IntegerField", "--sp", True, "3", "sub1"), (1, 1, "b", "FloatField", "--base", True, "2.3", ""),
        (1, 2, "c", "IntegerField", "--sq", False, "4", "sub1"), (1, 3, "c", "IntegerField", "--sq", False, "5", "sub1"),
        (2, 0, "p", "CharField", "", True, "x", ""), (2, 1, "f", "BooleanField", "--flag", True, "True", ""),
        (2, 2, "n", "IntegerField", "--n", True, "1", ""), (2, 3, "n", "IntegerField", "--n", True, "2", "")], schema)
    arrays = {r["job_id"]: r["tokens"] for r in PR.assemble_commands(v).collect()}
    rows = PR.command_tokens(v).collect()
    table = {}
    for r in sorted(rows, key=lambda r: (r["job_id"], r["token_pos"])):
        table.setdefault(r["job_id"], []).append(r["token"])
    assert table == arrays
    assert arrays[1] == ["--base", "2.3", "sub1", "--sp", "3", "--sq", "4", "--sq", "5"]
    assert arrays[2] == ["x", "--flag", "--n", "1", "2"]


def test_fasta_blocks_split_long_records(spark):
    from runlake.operators.sequences import fasta_blocks, fasta_records
    lines = [">r1", "AC", "GT", "TT", ">r2", "G", ">r3"]
    df = spark.createDataFrame([(1, i + 1, l) for i, l in enumerate(lines)], "file_id long, line_no long, line string")
    blocks = sorted((r["rec_no"], r["block"], r["seq"]) for r in fasta_blocks(df, block_lines=2).collect())
    assert blocks == [(1, 0, "ACGT"), (1, 1, "TT"), (2, 0, "G")]
    whole = {r["header"]: r["seq"] for r in fasta_records(df).collect()}
    assert whole == {">r1": "ACGTTT", ">r2": "G"}


def test_effective_output_keeps_every_block(spark):
    from runlake.operators import jobs as J
    chunks = spark.createDataFrame([(1, "stdout", i, "x") for i in range(3000)] + [(2, "stdout", 0, "y")],
                                   "job_id long, channel string, seq long, chunk string")
    table = spark.createDataFrame([(1, "running", "old", ""), (2, "completed", "old", "")],
                                  "job_id long, status string, stdout string, stderr string")
    out = J.effective_output(table, J.concat_output(chunks)).collect()
    assert sum(len(r["text"]) for r in out if r["job_id"] == 1 and r["channel"] == "stdout") == 3000
    assert [(r["block"], r["text"]) for r in out if r["job_id"] == 2 and r["channel"] == "stdout"] == [(0, "old")]


# ------------------------------------------- names, purges, scopes, batches
def test_available_names_exact(spark):
    ex = spark.createDataFrame([("d", f) for f in (
        "x.txt", "x_01.txt", "y_0.txt", "z.tar.gz", "w.txt", "w_2.txt", "w_99999999999999999999.txt")],
        "folder string, filename string")
    req = spark.createDataFrame([("d", "x", "txt"), ("d", "y", "txt"), ("d", "z", "tar.gz"), ("d", "w", "txt"),
                                 ("d", "w", "txt"), ("e", "w", "txt")], "folder string, name string, ext string")
    got = sorted((r["folder"], r["available"]) for r in FL.available_names(req, ex).collect())
    assert got == [("d", "w_1.txt"), ("d", "w_3.txt"), ("d", "x_1.txt"), ("d", "y.txt"), ("d", "z_1.tar.gz"),
                   ("e", "w.txt")]
    assert FL.available_names(req.limit(0), ex).count() == 0
    assert FL.available_names(req, ex.limit(0)).count() == 6


def test_unique_slugs_never_repeat(spark):
    names = ["a", "a", "a 2", "a", "a-3", "b", "a 2"]
    df = spark.createDataFrame(list(enumerate(names)), "script_id long, script_name string")
    got = {r["script_id"]: r["slug"] for r in C.unique_slugs(df, "script_name", "script_id").collect()}
    assert got == {0: "a", 1: "a-4", 2: "a-2", 3: "a-5", 4: "a-3", 5: "b", 6: "a-2-2"}


def test_purge_of_all_holders_drops_the_file(spark):
    refs = spark.createDataFrame([(1, 1, None, True), (1, 2, None, True), (2, 1, None, True), (2, 3, "in", False)],
                                 "file_id long, job_id long, param string, is_output boolean")
    jobs = spark.createDataFrame([(1,), (2,)], "job_id long")
    got = sorted((r["file_id"], r["job_id"], r["drop_file"]) for r in FL.purge_plan(refs, jobs).collect())
    assert got == [(1, 1, True), (1, 2, True), (2, 1, False)]


def test_sync_one_action_per_file(spark):
    local = spark.createDataFrame([(1, "p", 5), (2, "q", 5), (3, "r", 5)], "file_id long, path string, size_bytes long")
    remote = spark.createDataFrame([(1, "p", 7), (9, "p", 5), (2, "q", 0)], local.schema)
    got = sorted((r["file_id"], r["action"]) for r in FL.sync_plan(local, remote).collect())
    assert got == [(1, "skip"), (2, "replace"), (3, "upload")]


def test_scope_needs_a_choice(spark):
    spec = spark.createDataFrame([(1, "a", ""), (1, "b", "sub"), (2, "c", "only")],
                                 "script_id long, name string, parser_name string")
    jobs = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "job_id long, script_id long")
    values = spark.createDataFrame([(j, i, n) for j in (10, 11, 12) for i, n in enumerate("abc")],
                                   "job_id long, pos int, name string")
    chosen = spark.createDataFrame([(10, "sub")], "job_id long, parser_name string")
    got = sorted(((r["job_id"], r["name"] or "", r["error"]) for r in
                  PR.scope_params(values, spec, jobs, chosen).collect()), key=lambda x: x[:2])
    assert got == [(10, "a", None), (10, "b", None), (11, "", "A sub-command must be chosen."), (12, "c", None)]


def test_number_fields(spark):
    spec = spark.createDataFrame([(1, "i", "IntegerField"), (1, "f", "FloatField")],
                                 "script_id long, name string, form_field string") \
        .selectExpr("*", "false AS required", "CAST(NULL AS STRING) AS choices", "'-1' AS choice_limit")
    rows = [(1, "i", "-5"), (2, "i", "5.5"), (3, "f", "abc"), (4, "f", "-2.5e3"), (5, "i", " 7 ")]
    values = spark.createDataFrame(rows, "job_id long, name string, raw string")
    jobs = spark.createDataFrame([(j, 1) for j, *_ in rows], "job_id long, script_id long")
    got = sorted((r["job_id"], r["error"]) for r in PR.validate(values, spec, jobs).collect())
    assert got == [(2, "Enter a whole number."), (3, "Enter a number.")]


def test_batch_keeps_a_default(spark):
    v = spark.createDataFrame([(i, s, True, True, datetime(2024, 1, i)) for i, s in ((1, 1), (2, 1), (3, 2), (4, 2))],
                              "version_id long, script_id long, is_active boolean, default_version boolean, "
                              "created_date timestamp_ntz")
    p = spark.createDataFrame([(1, {"default_version": "false"}), (2, {"default_version": "false"}),
                               (3, {"default_version": "false"})], "version_id long, patch map<string,string>")
    got = {r["version_id"]: (r["default_version"], r["error"]) for r in PT.apply_version_patches(v, p).collect()}
    assert got == {1: (False, None), 2: (True, "A script must have a default version."), 3: (False, None),
                   4: (True, None)}


def test_version_spellings(spark):
    order = ["1.0.dev3", "1.0a", "1.0-alpha2.post1", "1.0-beta", "1.0_B_1", "1.0c1", "1.0preview2", "1.0", "1.0+local.2", "1.0+local.10",
             "1.0-1", "1.0.rev2", "1.1.dev1", "v2", "1!0.5"]
    v = spark.createDataFrame([(i, 1, t, 1) for i, t in enumerate(order)],
                              "version_id long, script_id long, script_version string, iteration int")
    got = [r["script_version"] for r in C.order_versions(v).orderBy(F.desc("version_rank")).collect()]
    assert got == order
    same = spark.createDataFrame([("1.0-beta", "1.0b0"), ("1.0-1", "v1.post1"), ("1.0ALPHA3", "1a3"), (" 1.0.r ", "1.0.post0"), ("0!1", "1.0.0")],
                                 "a string, b string").select((C.version_key("a") == C.version_key("b")).alias("e"))
    assert all(r["e"] for r in same.collect())
    texts = {"1.0-beta": True, "1.0+x": True, "1!2.0": True, "1.0.dev": True, " 1.0 ": True, "1.0 beta": False, "x": False, "": False,
             "1..0": False, "1.0+": False, "1.0rc": True, "1.0-1.dev2+a.b-c": True}
    df = spark.createDataFrame(list(texts), "string").select("value", T.version_or_default("value").alias("v"))
    assert {r["value"]: r["v"] == r["value"] for r in df.collect()} == texts


def test_version_order(spark):
    texts = ["1", "1.0", "1.0rc1", "1.0.0", "1.10", "1.9", "20240101123000", "1.0.dev3", "1.0.post1", "1.0b2"]
    v = spark.createDataFrame([(i, 1, x, i) for i, x in enumerate(texts)],
                              "version_id long, script_id long, script_version string, iteration int")
    got = [r["script_version"] for r in C.order_versions(v).orderBy("version_rank").collect()]
    assert got == ["20240101123000", "1.10", "1.9", "1.0.post1", "1.0.0", "1.0", "1", "1.0rc1", "1.0b2", "1.0.dev3"]


def test_fasta_text_before_first_header(spark):
    from runlake.operators.sequences import fasta_blocks, fasta_records
    df = spark.createDataFrame([(1, 1, "AC"), (1, 2, "GT"), (1, 3, ">h"), (1, 4, "TT")],
                               "file_id long, line_no long, line string")
    for made in (fasta_records(df), fasta_blocks(df)):
        assert sorted((r["rec_no"], r["header"], r["seq"]) for r in made.collect()) == [(0, "", "ACGT"), (1, ">h", "TT")]


def test_heatmap_columns_reads_fifty_columns(spark):
    import numpy as np

    import __spark_entry__ as entry
    from runlake.operators import matrix as M
    from runlake.sources.tables import v_wide
    got = sorted((r["position"], r["column"]) for r in entry.queries()["heatmap_columns"](spark, "/root/testdata/sf0.001").collect())
    cols = [f"d{i}" for i in range(50)]
    assert [p for p, _ in got] == list(range(1, 51)) and sorted(c for _, c in got) == sorted(cols)
    wide = v_wide(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    x = wide.select(*cols).toPandas().to_numpy()
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(x > 0, np.log2(x), np.where(x == 0, -np.inf, np.nan))
    x[np.isneginf(x)] = x[np.isfinite(x)].min()
    dist = np.sqrt(np.nansum((x[:, :, None] - x[:, None, :]) ** 2, axis=0))
    assert [c for _, c in got] == M.average_linkage_order(cols, dist)


# ---------------------------------------------------------- registration
def test_ordered_batch_registration(spark):
    """Two new scripts, copies inside the batch, defaults forced and flipped, descriptions filled once."""
    versions = spark.createDataFrame([(100, 5, "1", 1, True, "c0"), (101, 5, "2.0", 3, False, "c1"), (102, 6, "1", 1, True, "d0")],
                                     "version_id long, script_id long, script_version string, iteration int, default_version boolean, "
                                     "checksum string")
    scripts = spark.createDataFrame([(5, "old", ""), (6, "kept", "has one")], "script_id long, script_name string, description string")
    batch = spark.createDataFrame([
        (1, "new a", "x1", "1.0-beta", "", False), (2, "new b", "x1", None, "b text", False), (3, "new a", "x1", "9", "copy", True),
        (4, "new a", "x2", "1.0-beta", "a text", True), (5, "old", "c0", "3", "dup", True), (6, "old", "c2", "2.0", "first", True),
        (7, "old", "c3", "2.0", "second", False), (8, "kept", "d1", "bad version!", "other", False), (9, "old", "c2", "2.0", "x", True)],
        "batch_id long, script_name string, checksum string, version_text string, description string, set_default boolean")
    made, after, unset = CL.register_versions(versions, scripts, batch)
    got = {r["batch_id"]: (r["outcome"], r["script_id"], r["version_id"], r["script_version"], r["iteration"], r["default_version"])
           for r in made.collect()}
    assert got == {1: ("new", 7, 103, "1.0-beta", 1, False), 2: ("new", 8, 104, "1", 1, True), 3: ("duplicate", 7, 103, None, None, None),
                   4: ("new", 7, 105, "1.0-beta", 2, True), 5: ("duplicate", 5, 100, None, None, None),
                   6: ("new", 5, 106, "2.0", 4, True), 7: ("new", 5, 107, "2.0", 5, False), 8: ("new", 6, 108, "1", 1 + 1, False),
                   9: ("duplicate", 5, 106, None, None, None)}
    assert {(r["script_id"], r["description"], r["created"]) for r in after.collect()} == {
        (7, "a text", True), (8, "b text", True), (5, "first", False), (6, "has one", False)}
    assert [r["version_id"] for r in unset.collect()] == [100]


def test_parameters_are_reused_from_version_to_version(spark):
    """v1 has --one, v2 adds a positional and --two, v3 drops --two and moves the positional."""
    cols = "script_id long, version_id long, position int, parser_name string, group_name string, short_param string, name string, " \
           "required boolean, default string"
    base = spark.createDataFrame([(1, 10, 1, "", "g", "--one", "one", True, None)], cols).withColumn("param_id", F.lit(50).cast("long"))
    new = spark.createDataFrame([
        (1, 20, 1, "", "g", "", "pos", True, None), (1, 20, 2, "", "g", "--one", "one", True, None), (1, 20, 3, "", "g", "--two", "two", False, None),
        (1, 30, 1, "", "g", "--one", "one", True, None), (1, 30, 2, "", "g", "", "pos", True, None), (1, 30, 3, "", "h", "--two", "two", False, None),
        (2, 40, 1, "", "g", "--one", "one", True, None), (1, 50, 1, "", "g", "--one", "one", True, ""), (1, 50, 2, "sub", "g", "--two", "two", False, None)],
        cols)
    attrs = ["name", "required", "default"]
    got = {(r["version_id"], r["position"]): (r["param_id"], r["is_new"]) for r in PR.reuse_params(base, new, attrs).collect()}
    # keyword parameters are found whatever their order; a positional only at the same place; script, group and parser must be the same
    assert got == {(20, 1): (51, True), (20, 2): (50, False), (20, 3): (52, True), (30, 1): (50, False), (30, 2): (53, True),
                   (30, 3): (54, True), (40, 1): (55, True), (50, 1): (56, True), (50, 2): (57, True)}


def test_submission_rules_and_jobs(spark):
    spec = spark.createDataFrame([
        (1, "n", "IntegerField", True, None, "null", "", 1, 1), (1, "f", "FileField", True, None, "null", "", 2, 2),
        (1, "s", "CharField", False, None, "null", "sub", 3, 3), (2, "c", "CharField", True, None, "null", "", 4, 1)],
        "script_id long, name string, form_field string, required boolean, choices string, choice_limit string, parser_name string, "
        "param_id long, param_order int")
    rows = [(10, 0, "n", "IntegerField", "4"), (10, 1, "f", "FileField", "jobs/1/a.txt"), (11, 0, "f", "FileField", "jobs/1/a.txt"),
            (12, 0, "n", "IntegerField", "x"), (12, 1, "f", "FileField", "jobs/9/none.txt"), (13, 0, "c", "CharField", ""),
            (10, 2, "s", "CharField", "text")]
    values = spark.createDataFrame(rows, "job_id long, pos int, name string, form_field string, raw string")
    requests = spark.createDataFrame([(10, 5, 1, "sub", "a job", None), (11, 6, 1, None, "", "d"), (12, 6, 1, "sub", None, "d"), (13, 7, 2, None, "x", "")],
                                     "request_id long, user_id long, script_id long, parser_name string, job_name string, job_description string")
    files = spark.createDataFrame([(100, "a.txt", "jobs/1/a.txt")], "file_id long, filename string, path string")
    user_files = spark.createDataFrame([(100, 1)], "file_id long, job_id long")
    old = spark.createDataFrame([(1, 5)], "job_id long, user_id long")
    owners = requests.withColumnRenamed("request_id", "job_id")
    wrong = PR.file_value_errors(values, owners, user_files, files, old)
    got = sorted((r["job_id"], r["name"], r["error"]) for r in PR.validate(
        values, spec, owners.select("job_id", "script_id"), wrong, owners).collect())
    assert got == [(11, "f", PR.ERR_FILE_FORBIDDEN), (11, "job_name", PR.ERR_REQUIRED), (11, "n", PR.ERR_REQUIRED),
                   (12, "f", PR.ERR_FILE_UNKNOWN), (12, "job_name", PR.ERR_REQUIRED), (12, "n", PR.ERR_INTEGER), (13, "c", PR.ERR_REQUIRED)]
    jobs, stored, errors = PR.create_jobs(requests, values.withColumnRenamed("job_id", "request_id"), spec, F.lit(50))
    assert {r["request_id"]: (r["job_id"], r["user_id"], r["status"], r["job_description"]) for r in jobs.collect()} == {
        10: (51, 5, "submitted", ""), 12: (52, 6, "submitted", "d"), 13: (53, 7, "submitted", "")}
    assert sorted((r["job_id"], r["param_id"], r["value"]) for r in stored.collect() if r["value"] is not None) == [
        (51, 1, "4"), (51, 2, '"jobs/1/a.txt"'), (51, 3, '"text"'), (52, 2, '"jobs/9/none.txt"')]
    assert [(r["request_id"], r["error"]) for r in errors.collect()] == [(11, PR.ERR_PARSER)]
