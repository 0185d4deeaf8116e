"""Keys of the job-table family."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlake.operators import jobs as J
from runlake.plans.queries import key

AS_OF = "2024-01-31 00:00:00"


@key("global_queue")
def _global_queue(c):
    return J.global_queue(c.job()).select("job_id", "user_id", "status")


@key("sort_newest")
def _sort_newest(c):
    return J.newest_first(c.job()).select("job_id", "status")


@key("user_queue")
def _user_queue(c):
    return J.user_queue(c.job(), c.user()).select("viewer_id", "scope", "job_id", "status")


@key("user_results")
def _user_results(c):
    return J.user_results(c.job(), c.user()).select("viewer_id", "scope", "job_id", "status")


@key("job_visible")
def _job_visible(c):
    return J.visible_jobs(c.job(), c.user()).select("viewer_id", "scope", "job_id")


@key("queue_totals")
def _queue_totals(c):
    return J.queue_totals(c.job(), c.user())


@key("queue_top10")
def _queue_top10(c):
    return J.queue_top(c.job(), c.user(), 10).select("queue", "viewer_id", "rank", "job_id", "status")


@key("limit_n")
def _limit_n(c):
    return J.global_queue(c.job()).limit(10).select("job_id", "status")


@key("job_listing")
def _job_listing(c):
    return J.job_listing(c.job(), c.script())


@key("job_status")
def _job_status(c):
    return J.job_requests(c.job(), c.job_request())


@key("job_page_visible")
def _job_page_visible(c):
    return J.page_visible(c.job(), c.job_request(), c.user(), c.user_file(), c.favorite())


@key("job_details")
def _job_details(c):
    return J.job_details(c.job(), c.user_file(), c.file())


@key("effective_output")
def _effective_output(c):
    jobs = c.job().select("job_id", "status",
                          F.concat(F.lit("stored out "), F.col("job_id").cast("string")).alias("stdout"),
                          F.lit("").alias("stderr"))
    return J.effective_output(jobs, J.concat_output(c.chunk()))


@key("dead_jobs")
def _dead_jobs(c):
    return J.dead_jobs(c.job(), c.active()).select("job_id", "status")


@key("expire_jobs")
def _expire_jobs(c):
    return J.expire_jobs(c.job(), AS_OF, anon_ttl="10 days", user_ttl="20 days").select("job_id", "user_id")


@key("job_timeline")
def _job_timeline(c):
    return J.job_timeline(c.status_event()).drop("first_ts")


@key("concat_output")
def _concat_output(c):
    return J.concat_output(c.chunk())


@key("is_finished")
def _is_finished(c):
    return J.job_status(c.job())
