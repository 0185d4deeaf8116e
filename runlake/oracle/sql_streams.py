"""Oracle SQL for the streaming family (batch twins)."""

from runlake.oracle.sql import _RAW, oracle

_TERM = "status IN ('completed', 'FAILURE', 'error')"

oracle("stream_output", _RAW["concat_output"])
oracle("stream_status", _RAW["job_timeline"])

oracle("stream_dead_jobs", """
WITH e AS (SELECT user_id AS job_id, ts FROM events),
g AS (
  SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY job_id ORDER BY ts) IS NULL
                  OR ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts) >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk
  FROM e),
s AS (SELECT *, sum(brk) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
w AS (SELECT job_id, min(ts) AS first_beat, max(ts) + INTERVAL 6 HOUR AS dead_at, count(*) AS beats
      FROM s GROUP BY job_id, sid)
SELECT job_id, epoch_us(first_beat) AS first_beat_us, epoch_us(dead_at) AS dead_at_us, beats FROM w
WHERE dead_at <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR""")

oracle("stream_queue_depth", f"""
SELECT epoch_us(date_trunc('day', created_date)) AS window_start_us, count(*) AS n_jobs,
       count(*) FILTER (WHERE status = 'running') AS running,
       count(*) FILTER (WHERE status = 'submitted') AS submitted,
       count(*) FILTER (WHERE {_TERM}) AS finished
FROM v_job GROUP BY date_trunc('day', created_date)""")

oracle("stream_favorites", _RAW["toggle_favorites"])

oracle("stream_output_blocks", """
WITH c AS (SELECT *, CAST(floor(seq / 2) AS BIGINT) AS block, job_id * 60 + seq AS s FROM v_chunk),
b AS (SELECT job_id, channel, block, string_agg(coalesce(chunk, ''), '' ORDER BY seq) AS text, count(*) AS n_chunks,
             count(*) >= 2 AS "full", max(s) AS last FROM c GROUP BY job_id, channel, block)
SELECT job_id, channel, block, text, n_chunks, "full" FROM b
WHERE "full" OR last + 600.5 <= (SELECT max(s) FROM c) - 600""")

oracle("stream_dead_status", f"""
WITH j AS (SELECT job_id, max(epoch_us(ts) // 1000) AS last, bool_or({_TERM}) AS ended FROM v_status_event GROUP BY job_id)
SELECT job_id, 'FAILURE' AS status, last + 21600500 AS dead_at_ms FROM j
WHERE NOT ended AND last + 21600500 <= (SELECT max(epoch_us(ts) // 1000) FROM v_status_event) - 21600000""")

oracle("stream_catalog", """
WITH f AS (SELECT checksum, arg_min(file_id, (-file_id, file_id)) AS stored_id FROM v_file GROUP BY checksum)
SELECT v.file_id, v.checksum, f.stored_id, v.file_id = f.stored_id AS created
FROM v_file v JOIN f ON v.checksum IS NOT DISTINCT FROM f.checksum""")

oracle("stream_uploads", "SELECT DISTINCT checksum FROM v_file")

oracle("stream_last_used", """
WITH t AS (
  SELECT ts, sha256(CASE WHEN len(string_split(auth_header, ' ')) = 2 AND string_split(auth_header, ' ')[1] = 'Bearer'
                         THEN string_split(auth_header, ' ')[2] END) AS key_hash FROM v_request)
SELECT k.key_id, k.user_id, count(*) AS n_requests, epoch_us(max(t.ts)) AS last_used_us
FROM t JOIN v_key k ON t.key_hash = k.key_hash JOIN v_user u ON u.user_id = k.user_id
WHERE k.active AND u.is_active GROUP BY k.key_id, k.user_id""")

oracle("stream_expiry", _RAW["expire_jobs"])

oracle("stream_output_stateful", f"""
SELECT c.job_id, c.channel, string_agg(coalesce(c.chunk, ''), '' ORDER BY c.seq) AS text, count(*) AS n_chunks,
       coalesce(bool_or(j.{_TERM}), false) AS closed
FROM v_chunk c LEFT JOIN v_job j ON c.job_id = j.job_id GROUP BY c.job_id, c.channel""")
