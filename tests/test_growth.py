"""Joins of tables that grow with the catalog are spread by key, long keys alone are cut, streams work on rows."""

import hashlib
import tempfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from runlake.operators import catalog as C
from runlake.operators import catalog_load as CL
from runlake.operators import commands as CM
from runlake.operators import params as PR
from runlake.operators.ranking import row_number_by
from runlake.sources import readers
from runlake.streaming import stateful as SF
from runlake.streaming import streams as ST

SPEC = ("script_id long, name string, form_field string, required boolean, choices string, choice_limit string, parser_name string, "
        "param_id long, param_order int, group_name string, short_param string, position int")
VALUES = "job_id long, pos int, name string, form_field string, short_param string, collapse boolean, raw string"
VERSIONS = ("version_id long, script_id long, script_version string, iteration int, is_active boolean, default_version boolean, "
            "checksum string, created_date date")


def tables(spark):
    t = {
        "spec": spark.createDataFrame([(1, "n", "IntegerField", True, None, "null", "", 10, 0, "g", "--n", 1),
                                       (1, "m", "CharField", False, None, "null", "sub", 11, 1, "g", "", 2)], SPEC),
        "values": spark.createDataFrame([(5, 0, "n", "IntegerField", "--n", True, "4"), (5, 1, "m", "CharField", "", True, "x")], VALUES),
        "scripts": spark.createDataFrame([(1, "s", None), (2, "s", "d")], "script_id long, script_name string, description string"),
        "versions": spark.createDataFrame([(7, 1, "1", 1, True, True, "c", None), (8, 2, "1", 2, True, False, "c", None)], VERSIONS),
        "job_script": spark.createDataFrame([(5, 1)], "job_id long, script_id long"),
        "chosen": spark.createDataFrame([(5, "sub")], "job_id long, parser_name string"),
        "requests": spark.createDataFrame([(5, 3, 1, "sub", "j", None)], "request_id long, user_id long, script_id long, parser_name string, "
                                                                      "job_name string, job_description string"),
        "names": spark.createDataFrame([(5, " ")], "job_id long, job_name string"),
        "commands": spark.createDataFrame([(5, 1, "--n 4")], "job_id long, script_id long, command string"),
        "lookups": spark.createDataFrame([(1, 1, "1", None), (2, 1, None, None)], "request_id long, script_id long, version string, iteration int"),
        "batch": spark.createDataFrame([(1, "s", "c", "1", "", True), (2, "new", "d", None, "", False)],
                                       "batch_id long, script_name string, checksum string, version_text string, description string, set_default boolean"),
        "clones": spark.createDataFrame([(1, 5, 3)], "request_id long, job_id long, requester_id long")}
    t["options"] = t["spec"].select("script_id", F.col("parser_name").alias("parser"), F.col("name").alias("dest"), F.col("short_param").alias("flag"),
                                    F.lit("1").alias("nargs"), "required", F.lit(None).cast("string").alias("default"), "position")
    return t


def created(t):
    return PR.create_jobs(t["requests"], t["values"].withColumnRenamed("job_id", "request_id"), t["spec"], F.lit(0))[1].select("job_id", "param_id", "value")


JOINS = {
    "create_jobs": (created, {(1, 10, "4"), (1, 11, '"x"')}),
    "clone_jobs": (lambda t: CM.clone_jobs(t["job_script"].select("job_id"), t["values"].select("job_id", "name", "raw"), t["clones"], F.lit(9))[1],
                   {(10, "n", "4"), (10, "m", "x")}),
    "command_tokens": (lambda t: PR.command_tokens(t["values"]), {(5, 1, "--n"), (5, 2, "4"), (5, 3, "x")}),
    "parse_commands": (lambda t: CM.parse_commands(t["commands"], t["options"]).select("dest", "value"), {("n", "4")}),
    "register_versions": (lambda t: CL.register_versions(t["versions"], t["scripts"], t["batch"])[0].select("batch_id", "outcome", "version_id"),
                          {(1, "duplicate", 8), (2, "new", 9)}),
    "reuse_params": (lambda t: PR.reuse_params(t["spec"], t["spec"].withColumn("version_id", F.lit(1)), ["name"]).select("param_id", "is_new"),
                     {(10, False), (11, False)}),
    "validate": (lambda t: PR.validate(t["values"], t["spec"], t["job_script"], None, t["names"]), {(5, "job_name", PR.ERR_REQUIRED)}),
    "prefill_from_job": (lambda t: PR.prefill_from_job(t["values"], t["spec"], t["job_script"]).select("job_id", "form_slug"), {(5, "10-n"), (5, "11-m")}),
    "scope_params": (lambda t: PR.scope_params(t["values"], t["spec"], t["job_script"], t["chosen"]).select("name", "parser_name"), {("n", ""), ("m", "sub")}),
    "select_version": (lambda t: C.select_version(t["versions"], t["lookups"]), {(1, 7), (2, 7)}),
    "find_duplicates": (lambda t: C.find_duplicates(t["versions"], t["scripts"]).select("script_name", "n_versions", "existing_id"), {("s", 2, 8)}),
}


@pytest.mark.parametrize("name", JOINS)
def test_joins_of_growing_tables_are_not_broadcast(spark, name):
    make, want = JOINS[name]
    df = make(tables(spark))
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    # the slices of long keys are few by nature, and all that is broadcast
    assert not [line for line in plan if "BroadcastHashJoin" in line and "_slice#" not in line and "_b0#" not in line]
    assert {tuple(r) for r in df.collect()} == want


def test_only_long_keys_are_cut(spark):
    """A key's figures are joined for long keys alone, so that the rows are shuffled once."""
    df = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 3), (None, 12)) for i in range(n)], "k int, i int")
    assert {(r["k"], r["i"], r["rn"]) for r in row_number_by(df, ["k"], ["i"], slice_rows=10).collect()} == {
        (r["k"], r["i"], r["i"] + 1) for r in df.collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in row_number_by(df, ["k"], ["i"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


class State:
    """A value state and timers that count their calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_favorite_is_toggled_by_rows():
    state, toggle, key = State(), SF.Toggle(), (1, "f", 2)
    toggle.init(state)
    row = Row(user_id=1, content_type="f", object_id=2)
    got = [list(toggle.handleInputRows(key, iter([row] * n), None)) for n in (1, 2, 3)]
    assert got == [[Row(**row.asDict(), is_favorite=True)], [], [Row(**row.asDict(), is_favorite=False)]]
    assert state.calls == 4            # one read and one write per change


def test_a_beat_moves_the_only_timer():
    state, dead = State(), SF.Deadline(100)
    dead.init(state)
    beat = lambda ms, status="running": Row(job_id=1, status=status, ts=None, ts_ms=ms)
    assert list(dead.handleInputRows((1,), iter([beat(5), beat(9)]), None)) == [] and state.timers == {109}
    assert list(dead.handleInputRows((1,), iter([beat(7)]), None)) == [] and state.timers == {109}
    assert list(dead.handleInputRows((1,), iter([beat(20)]), None)) == [] and state.timers == {120}
    assert list(dead.handleExpiredTimer((1,), None, None)) == [Row(job_id=1, status=SF.FAILED, dead_at_ms=120)] and state.value is None


def test_records_cross_slices_of_lines(spark, monkeypatch):
    monkeypatch.setattr(readers, "SLICE_BITS", 1)
    cells = [[str(i), "a\n\nb" * (i % 3), 'q"' * (i % 2) + "z"] for i in range(50)]
    path = tempfile.mkdtemp(prefix="runlake-rec-")
    with open(f"{path}/x.csv", "w") as f:
        f.write("".join(",".join('"' + c.replace('"', '""') + '"' for c in r) + "\n" for r in cells))
    got = readers.read_records(spark, path, ",").orderBy("row_no").collect()
    assert [r["cells"] for r in got] == cells and [r["row_no"] for r in got] == [*range(1, 51)]


def test_contents_are_not_shuffled_into_the_file_catalog(spark):
    """Checksum and type are taken where a file is read; repeated ids, null paths and null contents give the rows they always gave."""
    files = spark.createDataFrame(
        [(1, 7, "a.txt", ">h\nACGT", 7), (1, 7, "b.zip", "x", 1), (2, 7, "c.txt", "y", 1), (3, 8, "a.txt", "y", 1), (4, 8, None, "z", 1),
         (5, 9, "d.txt", None, None), (None, 9, "e.txt", "y", 1)], "file_id long, job_id long, path string, content string, size_bytes long").withColumn(
        "filename", F.col("path"))
    refs = spark.createDataFrame([(1, "out"), (1, "out"), (2, "in"), (2, None), (None, "out")], "file_id long, param string")
    old = "9" * 40
    df = CL.build_file_catalog(refs, files, spark.createDataFrame([(20, old), (30, None)], "file_id long, checksum string"))

    def shuffled(node):
        children = node.children()
        own = [node.output().mkString(" ")] if "Exchange" in node.nodeName() else []
        return own + [x for i in range(children.size()) for x in shuffled(children.apply(i))]

    moved = shuffled(df._jdf.queryExecution().executedPlan().initialPlan())
    assert moved and not [x for x in moved if "content#" in x]
    sha = lambda job, path, content: hashlib.sha1(f"{job}{path}output{content}".encode()).hexdigest()
    # the two rows of file 1 meet each other's type
    want = [(7, 1, "a.txt", "parameter", g, sha(7, "a.txt", ">h\nACGT")) for g in ("fasta", "all")] + [
        (7, 1, "b.zip", "parameter", "archives", sha(7, "b.zip", "x"))] * 2 + [(7, 2, "c.txt", "walked", "all", sha(7, "c.txt", "y"))]
    # each of the two meets both of the matches of its checksum
    want = want[:2] * 2 + want[2:4] * 2 + want[4:] + [(8, 4, None, "walked", "all", sha(8, "", "z"))]
    got = df.collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, want))
    new = sorted({r["checksum"] for r in got})
    # ids follow the largest one; the null checksum of file 5 takes the first
    assert all(r["created"] and r["stored_id"] == 32 + new.index(r["checksum"]) for r in got)


def test_favorites_of_a_bucket_share_one_state():
    """However many favorites are toggled, a bucket costs one read and one write, and none that is off is kept."""
    state, toggle, favorite = State(), SF.Toggle(), lambda i: Row(user_id=i, content_type=None, object_id=2)
    toggle.init(state)
    toggle.handleInitialState((0,), Row(favorites=[favorite(i).asDict() for i in range(3)]), None)
    state.calls = 0
    got = {(r["user_id"], r["is_favorite"]) for r in toggle.handleInputRows((0,), iter(map(favorite, [0, 1, 1, *range(3, 50)])), None)}
    assert got == {(0, False), *((i, True) for i in range(3, 50))} and state.calls == 2
    got = {(r["user_id"], r["is_favorite"]) for r in toggle.handleInputRows((0,), iter(map(favorite, range(1, 50))), None)}
    assert got == {(i, False) for i in range(1, 50)} and state.value is None


def test_favorites_are_grouped_by_bucket_and_not_broadcast(spark):
    schema = "user_id long, content_type string, object_id long"
    favorites = spark.createDataFrame([(1, "f", 1), (1, "f", 1), (None, "f", 2)], schema)
    folder = tempfile.mkdtemp(prefix="runlake-fav-")
    spark.createDataFrame([(1, "f", 1), (None, "f", 2), (None, "f", 3), (4, None, 4), (4, None, 4)], schema).write.mode("overwrite").parquet(folder)
    stream = SF.stream_favorites(spark.readStream.schema(schema).parquet(folder), favorites)
    assert "TransformWithStateInPySpark" in str(stream._jdf.queryExecution().analyzed()) and "bucket#" in str(stream._jdf.queryExecution().analyzed())
    changes = ST.run_stream(stream, "fav", "append")
    assert {tuple(r) for r in changes.collect()} == {(1, "f", 1, False), (None, "f", 2, False), (None, "f", 3, True)}
    after = SF.favorites_after(favorites, changes)
    assert "BroadcastHashJoin" not in after._jdf.queryExecution().executedPlan().toString()
    # a null key is never equal in the join, as before
    assert {tuple(r) for r in after.collect()} == {(None, "f", 2), (None, "f", 3)}
