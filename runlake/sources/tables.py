"""Catalog views over the shared parquet tables.

Each view is one projection (or one aggregation for ``v_version``) of a
driver table, so every operator's work grows with the input.  The same
expressions exist as DuckDB CTEs in ``runlake.oracle.views``.

All readers are lazy: ``spark.read.parquet`` plus projections, so Catalyst
prunes columns and pushes filters of the calling operator into the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _json_k(col: str = "props") -> Column:
    return F.get_json_object(F.col(col), "$.k")


def acgt(c: Column) -> Column:
    """Keep only the letters A, C, G, T of the upper-cased text."""
    return F.regexp_replace(F.upper(c), "[^ACGT]", "")


# --------------------------------------------------------------- job views
def v_job(events: DataFrame) -> DataFrame:
    e = F.col("event_type")
    status = (F.when(e == "purchase", "completed")
              .when(e == "view", "running")
              .when(e == "click", "submitted")
              .when(e == "signup", "deleted")
              .when(e == "error", F.when(F.col("event_id") % 2 == 0, "error").otherwise("FAILURE")))
    return events.select(
        F.col("event_id").alias("job_id"),
        F.when(F.col("user_id") % 10 == 0, F.lit(None)).otherwise(F.col("user_id")).cast("bigint").alias("user_id"),
        _json_k().cast("int").alias("script_id"),
        status.alias("status"),
        F.col("ts").alias("created_date"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("task-"), F.col("event_id").cast("string"))).alias("celery_id"),
        F.col("value").alias("score"),
    )


def v_active(jobs: DataFrame) -> DataFrame:
    return (jobs.filter((F.col("status") == "running") & (F.col("job_id") % 3 == 0)
                        & F.col("celery_id").isNotNull())
                .select("celery_id"))


def v_job_request(events: DataFrame) -> DataFrame:
    """Viewers opening job pages: anonymous for every 5th event, unknown jobs for every 13th."""
    e = F.col("event_id")
    return events.select(
        e.alias("request_id"),
        F.when(e % 5 == 0, F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias("viewer_id"),
        F.when(e % 13 == 0, -1 - e).otherwise(e.bitwiseXOR(e % 3)).alias("job_id"),
        (e % 11 == 0).alias("by_uuid"))


def v_status_event(events: DataFrame) -> DataFrame:
    """Status changes of jobs: ten events per job, two attempts."""
    e = F.col("event_id")
    return v_job(events).select(
        F.floor(F.col("job_id") / 10).cast("bigint").alias("job_id"),
        (F.col("job_id") % 2).alias("attempt"),
        F.col("created_date").alias("ts"), F.col("job_id").alias("seq"), "status")


# ------------------------------------------------------------ script views
def v_script(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        k.alias("script_id"),
        F.col("p_name").alias("script_name"),
        F.col("p_brand").alias("group_name"),
        F.when(k % 9 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("description"),
        F.col("p_size").alias("script_order"),
        (F.col("p_size") % 7 != 0).alias("is_active"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, "BUILDING").otherwise("MACHINERY").alias("script_group"),
        F.when(F.col("p_brand") == "Brand#2", "BUILDING").otherwise("").alias("parent_group"),
        (~F.col("p_brand").isin("Brand#2", "Brand#7", "Brand#19")).alias("group_active"),
    )


def v_version(lineitem: DataFrame) -> DataFrame:
    """Script versions: one row per (l_partkey, l_suppkey).

    A partial (map-side) aggregate runs before the shuffle, so a hot
    part key only ships one partial row per input partition.
    """
    # max(flag) <> 'R' and min(status) = 'F' are computed from boolean
    # aggregates: string min/max have no fixed-width buffer and would turn
    # the whole aggregation into a sort-based one.
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    g = lineitem.groupBy("l_partkey", "l_suppkey").agg(
        F.min("l_linenumber").alias("_ln"),
        F.max("l_quantity").alias("_q"),
        F.bool_or(rf == "R").alias("_r_eq"), F.bool_or(rf > "R").alias("_r_gt"),
        F.bool_or(ls == "F").alias("_f_eq"), F.bool_or(ls < "F").alias("_f_lt"),
        F.min("l_shipdate").alias("created_date"),
    )
    s = F.col("l_suppkey")
    max_is_r = F.col("_r_eq") & ~F.col("_r_gt")
    min_is_f = F.col("_f_eq") & ~F.col("_f_lt")
    return g.select(
        (F.col("l_partkey") * 100000 + s).alias("version_id"),
        F.col("l_partkey").alias("script_id"),
        F.concat(F.col("_ln").cast("string"), F.lit("."),
                 F.floor(F.col("_q")).cast("int").cast("string")).alias("script_version"),
        (s % 5 + 1).cast("int").alias("iteration"),
        (~max_is_r).alias("is_active"),
        (min_is_f & (s % 20 == 0)).alias("default_version"),
        F.sha1(F.concat(F.col("l_partkey").cast("string"), F.lit("|"), (s % 7).cast("string"))).alias("checksum"),
        F.col("created_date"),
    )


# -------------------------------------------------------------- user views
def v_user(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("user_group"),
        (F.col("c_acctbal") > 9000).alias("is_staff"),
        (F.col("c_acctbal") > 0).alias("is_active"),
    )


def v_key(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("key_id"),
        F.col("c_custkey").alias("user_id"),
        F.sha2(F.col("c_name"), 256).alias("key_hash"),
        (F.col("c_acctbal") > -500).alias("active"),
    )


def v_request(events: DataFrame) -> DataFrame:
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"))
    m = F.col("event_id") % 4
    header = (F.when(m == 0, F.concat(F.lit("Basic "), name))
              .when(m == 1, F.lit("Bearer"))
              .otherwise(F.concat(F.lit("Bearer "), name)))
    return events.select(F.col("event_id").alias("request_id"), "ts", header.alias("auth_header"))


# --------------------------------------------------------- parameter view
PARAM_SLOTS = [
    # (pos, name, form_field, short_param, collapse)
    (0, "status", "ChoiceField", "--status", True),
    (1, "priority", "CharField", "", True),
    (2, "customer", "IntegerField", "--customer", True),
    (3, "total", "IntegerField", "--total", False),
    (4, "flag", "BooleanField", "--flag", True),
    (5, "total", "IntegerField", "--total", False),
    (6, "customer", "IntegerField", "--customer", True),
]


def v_param(orders: DataFrame) -> DataFrame:
    """Submitted parameter values, seven long rows per order (job)."""
    k = F.col("o_orderkey")
    raws = [
        F.col("o_orderstatus"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.col("o_orderpriority")),
        F.col("o_custkey").cast("string"),
        (F.floor(F.col("o_totalprice")) - 200000).cast("bigint").cast("string"),
        F.when(k % 2 == 0, F.lit("True")).otherwise(F.lit(None).cast("string")),
        (k % 5).cast("string"),
        (k % 3).cast("string"),
    ]
    slots = F.array(*[
        F.struct(F.lit(p).alias("pos"), F.lit(n).alias("name"), F.lit(ff).alias("form_field"),
                 F.lit(sp).alias("short_param"), F.lit(c).alias("collapse"), r.alias("raw"))
        for (p, n, ff, sp, c), r in zip(PARAM_SLOTS, raws)
    ])
    return (orders.select(k.alias("job_id"), F.inline(slots)))


# Parameter specification per script: five slots, built like ``v_param``.
SPEC_SLOTS = [
    # (slot, name, form_field, short_param, collapse, required, choices, choice_limit, group, parser)
    (0, "status", "ChoiceField", "--status", True, True, '["F","O","P"]', "null", "Required", ""),
    (1, "priority", "CharField", "", True, False, None, "null", "Optional", ""),
    (2, "customer", "IntegerField", "--customer", True, True, None, '"+"', "Required", ""),
    (3, "total", "IntegerField", "--total", False, False, None, "2", "Numbers", "sub"),
    (4, "flag", "BooleanField", "--flag", True, False, None, "null", "Optional", "sub"),
]


def v_spec(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    slots = F.array(*[
        F.struct(F.lit(i).alias("slot"), F.lit(n).alias("name"), F.lit(ff).alias("form_field"),
                 F.lit(sp).alias("short_param"), F.lit(co).alias("collapse"), F.lit(rq).alias("required"),
                 F.lit(ch).cast("string").alias("choices"), F.lit(cl).alias("choice_limit"),
                 F.lit(g).alias("group_name"), F.lit(pn).alias("parser_name"))
        for (i, n, ff, sp, co, rq, ch, cl, g, pn) in SPEC_SLOTS])
    return part.select(k.alias("script_id"), F.col("p_size").alias("_size"), F.inline(slots)).select(
        (F.col("script_id") * 10 + F.col("slot")).alias("param_id"), "script_id", "slot", "name", "form_field",
        "short_param", "collapse", "required", "choices", "choice_limit", "group_name", "parser_name",
        (F.col("_size") % 5 == F.col("slot")).alias("hidden"),
        ((F.col("group_name") == "Numbers") & (F.col("script_id") % 4 == 0)).alias("group_hidden"),
        F.col("slot").alias("param_order"))


def v_job_script(orders: DataFrame) -> DataFrame:
    """Script of each parameter-carrying job (orders): the customer key."""
    return orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("script_id"))


# -------------------------------------------------------------- file views
def v_file(documents: DataFrame) -> DataFrame:
    d = F.col("doc_id")
    job = F.floor(d / 11).cast("bigint")
    filename = F.concat(F.col("source"), F.lit("_"), F.col("lang"),
                        F.when(d % 13 == 0, F.lit(".zip")).otherwise(F.lit(".txt")))
    return documents.select(
        d.alias("file_id"),
        job.alias("job_id"),
        filename.alias("filename"),
        F.concat(F.lit("jobs/"), job.cast("string"), F.lit("/"), filename).alias("path"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        F.sha1(F.col("text")).alias("checksum"),
        (d % 2 == 0).alias("is_output"),
        F.when(d % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("out")).alias("param"),
    )


def v_user_file(files: DataFrame) -> DataFrame:
    base = files.select("file_id", "job_id", "is_output", "param")
    extra = (files.filter(F.col("file_id") % 4 == 0)
                  .select("file_id", (F.col("job_id") + 1).alias("job_id"),
                          F.lit(False).alias("is_output"), F.lit("in").alias("param")))
    return base.unionByName(extra)


def v_local(files: DataFrame) -> DataFrame:
    return files.filter(F.col("file_id") % 5 != 0).select("file_id", "path", "size_bytes")


def v_remote(files: DataFrame) -> DataFrame:
    return (files.filter(F.col("file_id") % 3 != 0)
                 .select("file_id", "path",
                         F.when(F.col("file_id") % 7 == 0, F.lit(0).cast("bigint"))
                          .otherwise(F.col("size_bytes")).alias("size_bytes")))


def v_favorite(labels: DataFrame) -> DataFrame:
    return (labels.filter(F.col("quality") == 1)
                  .select(F.floor(F.col("doc_id") / 9).cast("bigint").alias("user_id"), F.lit("userfile").alias("content_type"),
                          F.col("doc_id").alias("object_id")))


def v_toggle(events: DataFrame) -> DataFrame:
    return events.select("user_id", _json_k().cast("int").alias("object_id"), "ts")


def v_chunk(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"),
        F.when(F.col("role") == "assistant", "stdout").otherwise("stderr").alias("channel"),
        F.col("text").alias("chunk"))


def v_line(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("_p", "line")) \
                    .select("doc_id", (F.col("_p") + 1).cast("bigint").alias("line_no"), "line")


def v_cells(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("doc_id").alias("file_id"), F.col("line_no").alias("row_no"),
                        F.split(F.col("line"), ",").alias("cells"))


def v_fasta_line(lines: DataFrame) -> DataFrame:
    hdr = F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit("_"), F.col("line_no").cast("string"))
    return lines.select(F.col("doc_id").alias("file_id"), "line_no",
                        F.when(F.col("line_no") % 4 == 1, hdr).otherwise(acgt(F.col("line"))).alias("line"))


def v_seq(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("seq_id"), acgt(F.col("text")).alias("seq"))


MATRIX_COLS = ["c1", "c2", "c3", "c4"]


def v_matrix(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_partkey").alias("major"), F.col("l_suppkey").alias("minor"),
        F.col("l_quantity").alias("c1"), F.col("l_extendedprice").alias("c2"),
        F.col("l_discount").alias("c3"), F.col("l_tax").alias("c4"))


WIDE_DIMS = 64


def v_wide(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(
        "vec_id", "label",
        *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(WIDE_DIMS)])


def v_html(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html")


class Catalog:
    """Lazy access to the tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def t(self, name: str) -> DataFrame:
        # one relation per table: branches of a plan share the same scan, so
        # Spark can reuse its exchanges instead of re-reading the files
        if name not in self._tables:
            self._tables[name] = table(self.spark, self.sf_dir, name)
        return self._tables[name]

    # views
    def job(self): return v_job(self.t("events"))
    def active(self): return v_active(self.job())
    def job_request(self): return v_job_request(self.t("events"))
    def status_event(self): return v_status_event(self.t("events"))
    def script(self): return v_script(self.t("part"))
    def version(self): return v_version(self.t("lineitem"))
    def user(self): return v_user(self.t("customer"))
    def key(self): return v_key(self.t("customer"))
    def request(self): return v_request(self.t("events"))
    def param(self): return v_param(self.t("orders"))
    def spec(self): return v_spec(self.t("part"))
    def job_script(self): return v_job_script(self.t("orders"))
    def file(self): return v_file(self.t("documents"))
    def user_file(self): return v_user_file(self.file())
    def local(self): return v_local(self.file())
    def remote(self): return v_remote(self.file())
    def favorite(self): return v_favorite(self.t("labels"))
    def toggle(self): return v_toggle(self.t("events"))
    def chunk(self): return v_chunk(self.t("conversations"))
    def line(self): return v_line(self.t("documents"))
    def cells(self): return v_cells(self.line())
    def fasta_line(self): return v_fasta_line(self.line())
    def seq(self): return v_seq(self.t("documents"))
    def matrix(self): return v_matrix(self.t("lineitem"))
    def wide(self): return v_wide(self.t("embeddings"))
    def html(self): return v_html(self.t("pages"))


def load_views(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, sf_dir)
