"""DuckDB oracle SQL per registered key (views expanded by ``with_views``)."""

from __future__ import annotations

from runlake.oracle.views import with_views

_RAW: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    _RAW[name] = sql


def all_sql() -> dict[str, str]:
    return {k: with_views(v) for k, v in _RAW.items()}


# ------------------------------------------------------------------ jobs
_RESULTS = "(status IS NULL OR status NOT IN ('running', 'submitted', 'deleted'))"
_TERM = "status IN ('completed', 'FAILURE', 'error')"

oracle("global_queue", "SELECT job_id, user_id, status FROM v_job WHERE status IN ('running', 'submitted')")
oracle("sort_newest", "SELECT job_id, status FROM v_job")


def _own_public(cond: str, cols: str) -> str:
    return f"""
    SELECT j.user_id AS viewer_id, 'own' AS scope, {cols} FROM v_job j
    WHERE {cond} AND j.user_id IS NOT NULL AND j.user_id IN (SELECT user_id FROM v_user)
    UNION ALL
    SELECT CAST(NULL AS BIGINT) AS viewer_id, 'public' AS scope, {cols} FROM v_job j
    WHERE {cond} AND j.user_id IS NULL"""


oracle("user_queue", _own_public("status = 'running'", "job_id, status"))
oracle("user_results", _own_public(_RESULTS, "job_id, status"))
oracle("job_visible", _own_public("true", "job_id"))

oracle("queue_totals", f"""
WITH tot AS (
  SELECT count(*) FILTER (WHERE status IN ('running', 'submitted')) AS g,
         count(*) FILTER (WHERE status = 'running' AND user_id IS NULL) AS pu,
         count(*) FILTER (WHERE {_RESULTS} AND user_id IS NULL) AS pr
  FROM v_job),
own AS (
  SELECT user_id, count(*) FILTER (WHERE status = 'running') AS own_user,
         count(*) FILTER (WHERE {_RESULTS}) AS own_results
  FROM v_job WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT u.user_id, tot.g AS global_total, tot.pu + coalesce(own.own_user, 0) AS user_total,
       tot.pr + coalesce(own.own_results, 0) AS results_total
FROM v_user u LEFT JOIN own ON u.user_id = own.user_id CROSS JOIN tot
UNION ALL
SELECT NULL, g, pu, pr FROM tot""")

oracle("queue_top10", f"""
WITH g AS (
  SELECT 'global' AS queue, CAST(NULL AS BIGINT) AS viewer_id, job_id, status,
         row_number() OVER (ORDER BY created_date DESC, job_id DESC) AS rank
  FROM v_job WHERE status IN ('running', 'submitted')),
q AS (
  SELECT 'user' AS queue, job_id, status, user_id, created_date FROM v_job WHERE status = 'running'
  UNION ALL
  SELECT 'results', job_id, status, user_id, created_date FROM v_job WHERE {_RESULTS}),
per_user AS (
  SELECT q.queue, u.user_id AS viewer_id, q.job_id, q.status,
         row_number() OVER (PARTITION BY q.queue, u.user_id ORDER BY q.created_date DESC, q.job_id DESC) AS rank
  FROM v_user u JOIN q ON q.user_id IS NULL OR q.user_id = u.user_id),
anon AS (
  SELECT queue, CAST(NULL AS BIGINT) AS viewer_id, job_id, status,
         row_number() OVER (PARTITION BY queue ORDER BY created_date DESC, job_id DESC) AS rank
  FROM q WHERE user_id IS NULL)
SELECT queue, viewer_id, CAST(rank AS BIGINT) AS rank, job_id, status FROM g WHERE rank <= 10
UNION ALL SELECT queue, viewer_id, CAST(rank AS BIGINT), job_id, status FROM per_user WHERE rank <= 10
UNION ALL SELECT queue, viewer_id, CAST(rank AS BIGINT), job_id, status FROM anon WHERE rank <= 10""")

oracle("limit_n", """
SELECT job_id, status FROM v_job WHERE status IN ('running', 'submitted')
ORDER BY created_date DESC, job_id DESC LIMIT 10""")

oracle("job_listing", """
SELECT j.job_id, 'job-' || CAST(j.job_id AS VARCHAR) AS job_name, s.script_name,
       'Script: ' || s.script_name || chr(10) || 'None' AS description,
       strftime(j.created_date, '%b %d %Y, %H:%M:%S') AS submitted,
       CASE j.status WHEN 'completed' THEN 'Success' WHEN 'running' THEN 'Executing'
            WHEN 'PENDING' THEN 'Queued' WHEN 'REVOKED' THEN 'Halted' WHEN 'FAILURE' THEN 'Failure'
            WHEN 'submitted' THEN 'Waiting' ELSE j.status END AS status_label
FROM v_job j JOIN v_script s ON j.script_id = s.script_id""")

oracle("job_status", f"""
SELECT r.request_id, r.viewer_id, r.job_id,
       CASE WHEN j.status IS NULL THEN 'missing'
            WHEN j.user_id IS NULL OR j.user_id = r.viewer_id THEN 'ok' ELSE 'forbidden' END AS outcome,
       CASE WHEN j.user_id IS NULL OR j.user_id = r.viewer_id THEN j.status END AS status,
       CASE WHEN j.user_id IS NULL OR j.user_id = r.viewer_id THEN j.{_TERM} END AS is_complete
FROM v_job_request r LEFT JOIN v_job j ON r.job_id = j.job_id""")

oracle("job_page_visible", """
WITH fav AS (
  SELECT f.user_id AS viewer_id, uf.job_id, count(*) AS nfav
  FROM (SELECT DISTINCT user_id, object_id FROM v_favorite WHERE content_type = 'userfile') f
  JOIN (SELECT DISTINCT file_id, job_id FROM v_user_file) uf ON uf.file_id = f.object_id
  GROUP BY f.user_id, uf.job_id)
SELECT r.request_id, r.viewer_id, r.job_id,
       coalesce(j.user_id IS NULL OR j.user_id = r.viewer_id OR coalesce(u.is_staff, false) OR r.by_uuid, false)
           AS visible,
       CASE WHEN coalesce(j.user_id IS NULL OR j.user_id = r.viewer_id OR coalesce(u.is_staff, false) OR r.by_uuid,
                          false)
            THEN CAST(coalesce(fav.nfav, 0) AS BIGINT) END AS favorite_files
FROM v_job_request r JOIN v_job j ON r.job_id = j.job_id
LEFT JOIN v_user u ON u.user_id = r.viewer_id
LEFT JOIN fav ON fav.viewer_id = r.viewer_id AND fav.job_id = r.job_id""")

oracle("job_details", f"""
SELECT j.job_id, j.status, j.{_TERM} AS is_complete, f.filename AS asset_name, f.path AS asset_path
FROM v_job j LEFT JOIN (v_user_file uf JOIN v_file f ON uf.file_id = f.file_id)
  ON uf.job_id = j.job_id AND j.{_TERM}""")

oracle("effective_output", f"""
WITH live AS (
  SELECT job_id, channel, CAST(seq // 1024 AS BIGINT) AS block, string_agg(chunk, '' ORDER BY seq) AS text
  FROM v_chunk GROUP BY ALL HAVING string_agg(chunk, '') <> ''),
stored AS (
  SELECT job_id, status, 'stdout' AS channel, 'stored out ' || CAST(job_id AS VARCHAR) AS text FROM v_job
  UNION ALL SELECT job_id, status, 'stderr', '' FROM v_job)
SELECT s.job_id, s.status, s.channel, coalesce(l.block, 0) AS block, coalesce(l.text, s.text) AS text
FROM stored s LEFT JOIN live l ON l.job_id = s.job_id AND l.channel = s.channel AND NOT s.{_TERM}""")

oracle("dead_jobs", """
SELECT job_id,
       CASE WHEN status = 'running'
             AND (celery_id IS NULL OR celery_id NOT IN (SELECT celery_id FROM v_active)) THEN 'FAILURE'
            ELSE status END AS status
FROM v_job""")

oracle("expire_jobs", """
SELECT job_id, user_id FROM v_job
WHERE (user_id IS NULL AND created_date <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY)
   OR (user_id IS NOT NULL AND created_date <= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY)""")

oracle("job_timeline", f"""
SELECT job_id, attempt, count(*) AS n_events,
       coalesce(arg_min(status, (ts, seq)) FILTER (WHERE {_TERM}), arg_max(status, (ts, seq))) AS final_status,
       arg_max(status, (ts, seq)) AS last_status
FROM v_status_event GROUP BY job_id, attempt""")

oracle("concat_output", """
SELECT job_id, channel, CAST(floor(seq / 1024) AS BIGINT) AS block,
       string_agg(chunk, '' ORDER BY seq) AS text, count(*) AS n_chunks
FROM v_chunk GROUP BY job_id, channel, CAST(floor(seq / 1024) AS BIGINT)""")

oracle("is_finished", f"""
SELECT job_id, status, {_TERM} AS is_complete, status IN ('completed', 'REVOKED') AS is_finished FROM v_job""")
