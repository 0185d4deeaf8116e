"""Job table operators: queues, visibility, details, dead jobs, retention.

Per-user questions are answered for *all* users at once.  A public
(unowned) job is visible to every viewer, so results that would repeat the
public jobs for each user are returned as two blocks: the viewer's own rows
and one shared public block with ``viewer_id`` NULL and ``scope='public'``.
Nothing is ever multiplied out to users x public jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Job status codes and their groupings.
COMPLETED, DELETED, FAILED, ERROR, RUNNING, SUBMITTED = (
    "completed", "deleted", "FAILURE", "error", "running", "submitted")
REVOKED, PENDING = "REVOKED", "PENDING"
TERMINAL_STATES = [COMPLETED, FAILED, ERROR]
QUEUED_STATES = [RUNNING, SUBMITTED]
HIDDEN_FROM_RESULTS = [RUNNING, SUBMITTED, DELETED]

# Status -> label shown in job listings; unknown codes pass through.
STATUS_LABELS = {
    COMPLETED: "Success",
    RUNNING: "Executing",
    PENDING: "Queued",
    REVOKED: "Halted",
    FAILED: "Failure",
    SUBMITTED: "Waiting",
}

SUBMITTED_FORMAT = "MMM dd yyyy, HH:mm:ss"
QUEUE_ITEMS = 10


# ------------------------------------------------------------ predicates
def is_complete(status: Column) -> Column:
    """Terminal flag used by the status API: completed, FAILURE or error."""
    return status.isin(*TERMINAL_STATES)


def is_finished(status: Column) -> Column:
    """Template rule: completed or revoked (differs from ``is_complete``)."""
    return status.isin(COMPLETED, REVOKED)


def job_visible(owner: Column, viewer: Column) -> Column:
    """A job is visible when it has no owner or the viewer owns it."""
    return owner.isNull() | (viewer.isNotNull() & (owner == viewer))


def status_label(status: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    return F.coalesce(m[status], status)


def submitted_text(ts: Column) -> Column:
    return F.date_format(ts, SUBMITTED_FORMAT)


def _newest(*cols) -> list[Column]:
    return [F.col("created_date").desc(), F.col("job_id").desc()]


# --------------------------------------------------------------- queues
def global_queue(jobs: DataFrame) -> DataFrame:
    """Running or submitted jobs, newest first (distributed range sort)."""
    return jobs.filter(F.col("status").isin(*QUEUED_STATES)).orderBy(*_newest())


def newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(*_newest())


def _own_and_public(jobs: DataFrame, users: DataFrame, cond: Column) -> DataFrame:
    sel = jobs.filter(cond)
    own = (sel.filter(F.col("user_id").isNotNull())
              .join(users.select(F.col("user_id")), "user_id", "left_semi")
              .select(F.col("user_id").alias("viewer_id"), F.lit("own").alias("scope"), *[
                  c for c in sel.columns]))
    public = sel.filter(F.col("user_id").isNull()).select(
        F.lit(None).cast("bigint").alias("viewer_id"), F.lit("public").alias("scope"), *sel.columns)
    return own.unionByName(public)


def user_queue(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """Running jobs per viewer: own block per user + one shared public block."""
    return _own_and_public(jobs, users, F.col("status") == RUNNING)


def user_results(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """Finished jobs per viewer (status not running/submitted/deleted)."""
    st = F.col("status")
    return _own_and_public(jobs, users, st.isNull() | ~st.isin(*HIDDEN_FROM_RESULTS))


def visible_jobs(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """All jobs each viewer may see (``job_visible``), in the two-block form."""
    return _own_and_public(jobs, users, F.lit(True))


def queue_totals(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """Sizes of the three queues for every user plus the anonymous viewer.

    One pass over the jobs: owned counts are a partial-aggregated group by
    owner; the public counts are one scalar subquery (a single value, no
    join) added to every user's own counts.
    """
    st = F.col("status")
    running = st == RUNNING
    results = st.isNull() | ~st.isin(*HIDDEN_FROM_RESULTS)
    totals = jobs.select(
        F.count_if(st.isin(*QUEUED_STATES)).alias("g"),
        F.count_if(running & F.col("user_id").isNull()).alias("pu"),
        F.count_if(results & F.col("user_id").isNull()).alias("pr"),
    )
    g, pu, pr = (totals.select(c).scalar() for c in ("g", "pu", "pr"))
    own = (jobs.filter(F.col("user_id").isNotNull())
               .groupBy("user_id")
               .agg(F.count_if(running).alias("own_user"), F.count_if(results).alias("own_results")))
    per_user = (users.select("user_id").join(own, "user_id", "left")
                .select("user_id",
                        g.alias("global_total"),
                        (pu + F.coalesce(F.col("own_user"), F.lit(0))).alias("user_total"),
                        (pr + F.coalesce(F.col("own_results"), F.lit(0))).alias("results_total")))
    anon = jobs.sparkSession.range(1).select(
        F.lit(None).cast("bigint").alias("user_id"), g.alias("global_total"),
        pu.alias("user_total"), pr.alias("results_total"))
    return per_user.unionByName(anon)


def _top(df: DataFrame, by: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*_newest())
    # row_number <= n is planned with a partial WindowGroupLimit before the
    # shuffle, so a hot owner ships at most n rows per input partition.
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def queue_top(jobs: DataFrame, users: DataFrame, n: int = QUEUE_ITEMS) -> DataFrame:
    """Newest ``n`` items of each queue for each viewer.

    Output rows: (queue, viewer_id, rank, job_id, status, created_date).
    ``global`` has viewer NULL.  For ``user`` / ``results`` each viewer's
    list merges its own top ``n`` with the public top ``n``; the public top
    ``n`` is a bounded array (at most ``n`` structs) computed once as a
    scalar subquery, so no users x jobs product exists.
    """
    cols = ["job_id", "status", "created_date"]
    st = F.col("status")
    glob = (jobs.filter(st.isin(*QUEUED_STATES)).orderBy(*_newest()).limit(n)
                .select(*cols))
    glob = _top(glob.withColumn("_g", F.lit(1)), ["_g"], n).drop("_g").select(
        F.lit("global").alias("queue"), F.lit(None).cast("bigint").alias("viewer_id"), "rank", *cols)
    out = [glob]
    conds = {"user": st == RUNNING, "results": st.isNull() | ~st.isin(*HIDDEN_FROM_RESULTS)}
    for q, cond in conds.items():
        sel = jobs.filter(cond)
        key = F.struct(F.col("created_date"), F.col("job_id"), F.col("status"))
        public_top = sel.filter(F.col("user_id").isNull()).orderBy(*_newest()).limit(n)
        public_arr = public_top.select(F.collect_list(key).alias("a")).scalar()
        own = _top(sel.filter(F.col("user_id").isNotNull())
                      .join(users.select("user_id"), "user_id", "left_semi"), ["user_id"], n)
        own_arr = own.groupBy("user_id").agg(F.collect_list(key).alias("own"))  # <= n per user
        viewers = users.select("user_id").join(own_arr, "user_id", "left")
        merged = viewers.select(
            F.col("user_id").alias("viewer_id"),
            F.slice(F.sort_array(F.concat(F.coalesce(F.col("own"), F.array().cast(
                "array<struct<created_date:timestamp_ntz,job_id:bigint,status:string>>")), public_arr),
                asc=False), 1, n).alias("items"))
        per_user = merged.select("viewer_id", F.posexplode("items").alias("p", "it")).select(
            F.lit(q).alias("queue"), "viewer_id", (F.col("p") + 1).alias("rank"),
            F.col("it.job_id").alias("job_id"), F.col("it.status").alias("status"),
            F.col("it.created_date").alias("created_date"))
        anon = _top(sel.filter(F.col("user_id").isNull()).withColumn("_g", F.lit(1)), ["_g"], n).select(
            F.lit(q).alias("queue"), F.lit(None).cast("bigint").alias("viewer_id"), "rank", *cols)
        out += [per_user, anon]
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.withColumn("rank", F.col("rank").cast("bigint"))


def job_listing(jobs: DataFrame, scripts: DataFrame) -> DataFrame:
    """Listing projection: id, script name, description, submitted text, label."""
    s = scripts.select("script_id", "script_name")
    return jobs.join(s, "script_id", "inner").select(
        "job_id",
        F.concat(F.lit("job-"), F.col("job_id").cast("string")).alias("job_name"),
        "script_name",
        F.concat(F.lit("Script: "), F.col("script_name"), F.lit("\nNone")).alias("description"),
        submitted_text(F.col("created_date")).alias("submitted"),
        status_label(F.col("status")).alias("status_label"),
    )


def job_status(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", "status", is_complete(F.col("status")).alias("is_complete"),
                       is_finished(F.col("status")).alias("is_finished"))


def job_requests(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Resolve (viewer, job) requests: visible or 'not permitted'."""
    j = jobs.select("job_id", F.col("user_id").alias("owner_id"), "status")
    r = requests.join(j, "job_id", "left")
    vis = job_visible(F.col("owner_id"), F.col("viewer_id"))
    return r.select(
        "request_id", "viewer_id", "job_id",
        F.when(F.col("status").isNull(), "missing").when(vis, "ok").otherwise("forbidden").alias("outcome"),
        F.when(vis, F.col("status")).alias("status"),
        F.when(vis, is_complete(F.col("status"))).alias("is_complete"))


def page_visible(jobs: DataFrame, requests: DataFrame, users: DataFrame,
                 user_files: DataFrame, favorites: DataFrame) -> DataFrame:
    """Detail-page rule: unowned, owner, superuser, or opened by shared uuid.

    For a visible page, the number of the job's files the viewer marked as
    favorite: favorites are joined to the file references and counted per
    (viewer, job) first, then joined to the requests (no request x file
    product).
    """
    j = jobs.select("job_id", F.col("user_id").alias("owner_id"))
    u = users.select(F.col("user_id").alias("viewer_id"), F.col("is_staff").alias("superuser"))
    fav = (favorites.filter(F.col("content_type") == "userfile")
                    .select(F.col("user_id").alias("viewer_id"), F.col("object_id").alias("file_id")).distinct()
                    .join(user_files.select("file_id", "job_id").distinct(), "file_id")
                    .groupBy("viewer_id", "job_id").agg(F.count("*").alias("_nfav")))
    r = (requests.join(j, "job_id", "inner").join(u, "viewer_id", "left")
                 .join(fav, ["viewer_id", "job_id"], "left"))
    ok = F.coalesce(F.col("owner_id").isNull() | (F.col("owner_id") == F.col("viewer_id"))
                    | F.coalesce(F.col("superuser"), F.lit(False)) | F.col("by_uuid"), F.lit(False))
    return r.select("request_id", "viewer_id", "job_id", ok.alias("visible"),
                    F.when(ok, F.coalesce(F.col("_nfav"), F.lit(0))).cast("bigint").alias("favorite_files"))


def job_details(jobs: DataFrame, user_files: DataFrame, files: DataFrame) -> DataFrame:
    """Status, terminal flag and asset list; assets only for terminal jobs.

    Assets are returned as rows (job_id, asset) rather than one array per job,
    so a job with very many outputs is never gathered into one row.
    """
    term = is_complete(F.col("status"))
    head = jobs.select("job_id", "status", term.alias("is_complete"))
    # only terminal jobs bring their references along: a running job is one row
    refs = (user_files.join(files.select("file_id", "filename", "path"), "file_id", "inner")
                      .join(head.filter("is_complete").select("job_id"), "job_id", "left_semi")
                      .select("job_id", "filename", "path"))
    return (head.join(refs, "job_id", "left")
                .select("job_id", "status", "is_complete",
                        F.when(F.col("is_complete"), F.col("filename")).alias("asset_name"),
                        F.when(F.col("is_complete"), F.col("path")).alias("asset_path")))


def effective_output(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """Output text per (job, channel, block): live blocks (see ``concat_output``)
    while the job is not terminal and a channel has live text, else the stored
    text as block 0.  No block is dropped, however long the output is."""
    stored = jobs.select("job_id", "status", F.explode(F.create_map(
        F.lit("stdout"), F.col("stdout"), F.lit("stderr"), F.col("stderr"))).alias("channel", "stored"))
    running = stored.filter(~is_complete(F.col("status"))).select("job_id", "channel")
    shown = live.filter(F.col("text") != "").join(running, ["job_id", "channel"], "left_semi")
    return (stored.join(shown.select("job_id", "channel", "block", "text"), ["job_id", "channel"], "left")
                  .select("job_id", "status", "channel", F.coalesce("block", F.lit(0)).cast("bigint").alias("block"),
                          F.coalesce("text", "stored").alias("text")))


def dead_jobs(jobs: DataFrame, active: DataFrame | None) -> DataFrame:
    """Running jobs whose task id is not in the worker's active set get FAILURE.

    ``active=None`` (worker list unknown) changes nothing.  A NULL task id
    counts as dead: ``left_anti`` keeps NULL keys, unlike ``NOT IN``.
    Returns the whole job table with the new status.
    """
    if active is None:
        return jobs
    act = active.select(F.col("celery_id").alias("_cid")).filter(F.col("_cid").isNotNull()).distinct()
    running = jobs.filter(F.col("status") == RUNNING)
    dead = (running.join(act, running["celery_id"] == act["_cid"], "left_anti")
                   .select("job_id", F.lit(True).alias("_dead")))
    out = jobs.join(dead, "job_id", "left")
    return out.withColumn("status", F.when(F.col("_dead"), F.lit(FAILED)).otherwise(F.col("status"))).drop("_dead")


def expire_jobs(jobs: DataFrame, as_of, anon_ttl=None, user_ttl=None) -> DataFrame:
    """Jobs older than their lifetime (anonymous vs owned); None keeps all.

    ``as_of`` is a timestamp literal string; ttls are interval strings
    such as ``'1 hour'``.  Returns the expired rows.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    cond = F.lit(False)
    if anon_ttl is not None:
        cond = cond | (F.col("user_id").isNull()
                       & (F.col("created_date") <= now - F.expr(f"INTERVAL {anon_ttl}")))
    if user_ttl is not None:
        cond = cond | (F.col("user_id").isNotNull()
                       & (F.col("created_date") <= now - F.expr(f"INTERVAL {user_ttl}")))
    return jobs.filter(cond)


def surviving_jobs(jobs: DataFrame, as_of, anon_ttl=None, user_ttl=None) -> DataFrame:
    exp = expire_jobs(jobs, as_of, anon_ttl, user_ttl).select("job_id")
    return jobs.join(exp, "job_id", "left_anti")


def job_timeline(events: DataFrame) -> DataFrame:
    """Per (job, attempt): ordered status path and the effective status.

    The first terminal status of an attempt sticks; otherwise the latest.
    Events: (job_id, attempt, ts, seq, status).
    """
    term = is_complete(F.col("status"))
    order = F.struct("ts", "seq")
    return events.groupBy("job_id", "attempt").agg(
        F.count("*").alias("n_events"),
        # min_by skips rows whose ordering value is NULL: first terminal status
        F.coalesce(F.min_by("status", F.when(term, order)), F.max_by("status", order)).alias("final_status"),
        F.max_by("status", order).alias("last_status"),
        F.min("ts").alias("first_ts"),
    )


def concat_output(chunks: DataFrame, block_size: int = 1024) -> DataFrame:
    """Ordered concatenation of output chunks per (job, channel).

    Text is assembled per block of ``block_size`` consecutive sequence
    numbers, so one very long job spreads over many rows / tasks instead of
    one unbounded group; the full text is the blocks in ``block`` order.
    """
    b = F.floor(F.col("seq") / F.lit(block_size)).cast("bigint")
    return (chunks.withColumn("block", b)
                  .groupBy("job_id", "channel", "block")
                  .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))),
                                                lambda x: x["chunk"]), "").alias("text"),
                       F.count("*").alias("n_chunks")))
