"""Plan and contract checks: registered keys run, SQL-checked keys stay in
the JVM (no Python UDF) and never build a cartesian product, and the hot
key row numbering equals the plain window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from runlake.operators.ranking import free_numbers, row_number_by

from .conftest import SF_SMALL

# op1_url_filter probes a memory-mapped array, which its method asks for
PYTHON_OK = {"sequence_functions", "translate_sequences", "translate_upper", "run_job", "run_sweep", "op1_url_filter"}


def test_contract_shapes():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 140


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["queue", "viewer_id", "rank", "job_id", "status"]


SAMPLE = ["queue_totals", "queue_top10", "user_queue", "select_version", "script_report", "access_check",
          "assemble_command", "validate_submission", "preview_fasta", "nested_page", "keyword_search",
          "match_or_insert", "resolve_keys", "log_normalize", "column_distance", "sort_favorites_first"]


@pytest.mark.parametrize("key", SAMPLE)
def test_no_product_no_python(spark, key):
    df = entry.queries()[key](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key
    if key not in PYTHON_OK:
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan, key


def test_pushdown_and_pruning(spark):
    df = entry.queries()["keyword_search"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string,p_type:string>" in plan


ORDERS = [["o", "id"], ["-o", "id"], ["t", "id"], ["-t", "-id"], ["day", "id"], ["ts", "id"], ["one", "id"], ["arr", "id"],
          ["odd", "id"]]


@pytest.mark.parametrize("slice_rows", [50, 10**9])
@pytest.mark.parametrize("by", [["k"], []])
@pytest.mark.parametrize("order", ORDERS, ids=lambda o: o[0])
def test_row_number_by_matches_window(spark, slice_rows, by, order):
    o = F.col("id") * 7919 % 1009
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("k"), "id",
        F.when(F.col("id") % 11 != 0, o).alias("o"), F.lit("x").alias("one"), F.array(o).alias("arr"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("common é"), F.chr(65 + o % 60), o.cast("string"))).alias("t"),
        F.date_add(F.lit("2020-01-01"), (o % 97).cast("int")).alias("day"), F.timestamp_seconds(o * 1000).alias("ts"),
        F.when(F.col("id") % 7 == 0, float("nan")).when(F.col("id") % 5 == 0, float("-inf")).otherwise(o / 7).alias("odd"))
    key = F.col(by[0]) if by else F.lit(0)
    w = Window.partitionBy(key).orderBy(*[F.col(c[1:]).desc() if c[0] == "-" else F.col(c) for c in order])
    a = row_number_by(df, by, order, slice_rows=slice_rows).select("id", "rn")
    b = df.select("id", F.row_number().over(w).cast("bigint").alias("rn"))
    assert sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("slice_rows", [10**6, 7, 1])
def test_free_numbers_of_a_hot_name(spark, slice_rows):
    """One name asked 400 times beside others, with runs of taken numbers, against a plain loop; no window per name alone."""
    import random
    rng = random.Random(6)
    taken = {"hot": set(rng.sample(range(600), 250)) | set(range(100, 160)), "a": {0, 1, 2, 5}, "b": set(), None: {1, 3}, "idle": {4}}
    asked = {"hot": 400, "a": 5, "b": 3, None: 4}
    want, rows = {}, []
    for k, n in asked.items():
        free = (i for i in range(10_000) if i not in taken[k])
        for r in range(1, n + 1):
            rows.append((k, r, f"x{r}"))
            want[k, r] = next(free)
    requests = spark.createDataFrame(rows, "name string, r int, note string")
    held = spark.createDataFrame([(k, i) for k, t in taken.items() for i in t] + [("a", 5)], "name string, i int")
    out = free_numbers(requests, held, ["name"], "i", "r", "no", slice_rows=slice_rows)
    assert out.columns == ["name", "r", "note", "no"]
    assert {(x["name"], x["r"]): x["no"] for x in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(name#" not in plan.replace(" ", "") or "_slice" in plan


@pytest.mark.parametrize("key", ["sort_versions", "version_history", "version_labels", "sort_catalog", "unique_slug",
                                 "group_by_name_versions", "next_iteration", "match_or_insert", "available_name",
                                 "sort_favorites_first", "clone_jobs", "register_versions", "build_file_catalog",
                                 "command_tokens"])
def test_building_a_numbered_plan_runs_nothing_but_schema_reads(spark, key):
    reads = []

    class Reader:
        def __getattr__(self, name):
            reads.append(name)
            return getattr(spark.read, name)

    class Session:
        read = Reader()

        def __getattr__(self, name):
            return getattr(spark, name)

    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = jobs()
    entry.queries()[key](Session(), SF_SMALL)
    assert jobs() - before <= len(reads), key


def test_stream_equals_batch(spark):
    q = entry.queries()
    stream = q["stream_status"](spark, SF_SMALL)
    batch = q["job_timeline"](spark, SF_SMALL)
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


@pytest.mark.parametrize("stream_key,batch_key", [("stream_output", "concat_output"),
                                                  ("stream_expiry", "expire_jobs"),
                                                  ("stream_uploads", "write_content_addressed")])
def test_more_streams_equal_batch(spark, stream_key, batch_key):
    q = entry.queries()
    s = q[stream_key](spark, SF_SMALL)
    b = q[batch_key](spark, SF_SMALL)
    if stream_key == "stream_uploads":
        b = b.select("checksum")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_all_sql_keys_plans(spark):
    """Every SQL-checked key (except streams and file round trips, which run
    jobs while building) plans without products and without Python."""
    q, s = entry.queries(), entry.oracle_sql()
    skip = {k for k in s if k.startswith("stream_")} | {"read_delimited", "write_fasta", "write_tsv"}
    bad = []
    for k in sorted(set(s) - skip):
        plan = q[k](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            bad.append((k, "product"))
        if k not in PYTHON_OK and ("ArrowEvalPython" in plan or "BatchEvalPython" in plan):
            bad.append((k, "python"))
    assert bad == []
