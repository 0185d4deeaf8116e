"""Oracle SQL for the single scalar-function keys."""

from runlake.functions.text import VERSION_PATTERN
from runlake.oracle.sql import oracle

oracle("sanitize_name", "SELECT script_id, translate(script_name, ' -', '__') AS value FROM v_script")

oracle("sanitize_string", r"""
SELECT script_id, replace('"' || script_name || '" by "' || group_name || '"', '"', '\"') AS value FROM v_script""")

oracle("status_label", """
SELECT job_id, CASE status WHEN 'completed' THEN 'Success' WHEN 'running' THEN 'Executing'
                           WHEN 'PENDING' THEN 'Queued' WHEN 'REVOKED' THEN 'Halted' WHEN 'FAILURE' THEN 'Failure'
                           WHEN 'submitted' THEN 'Waiting' ELSE status END AS label
FROM v_job""")

oracle("range_array", """
SELECT script_id, CASE WHEN script_order % 7 - 2 > 0 THEN array_to_string(range(0, script_order % 7 - 2), ',')
                       ELSE '' END AS value
FROM v_script""")

oracle("email_hash", "SELECT user_id, md5(lower(username || '@Mail.COM')) AS value FROM v_user")
oracle("key_hash", "SELECT user_id, sha256(username) AS value FROM v_user")

oracle("param_limits", """
WITH p AS (
  SELECT param_id, choice_limit AS lim,
         CASE WHEN regexp_matches(trim(json_extract_string(choice_limit, '$')), '^[+-]?[0-9]+$')
              THEN CAST(trim(json_extract_string(choice_limit, '$')) AS BIGINT) END AS n
  FROM v_spec)
SELECT param_id,
       CASE WHEN lim = 'null' THEN false WHEN n IS NOT NULL THEN n > 1 ELSE true END AS multiple_choice,
       CASE WHEN lim = 'null' THEN 1 WHEN n IS NOT NULL THEN n ELSE -1 END AS max_choices
FROM p""")

oracle("try_json", """
WITH e AS (
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN replace(props, '}', '')
                                     ELSE json_extract_string(props, '$.k') END AS raw
  FROM events)
SELECT event_id,
       CASE WHEN json_valid(raw) THEN CAST(json(raw) AS VARCHAR) ELSE CAST(to_json(raw) AS VARCHAR) END AS value
FROM e""")

oracle("submitted_text", "SELECT job_id, strftime(created_date, '%b %d %Y, %H:%M:%S') AS value FROM v_job")

oracle("age_cutoff", """
SELECT job_id, created_date <= TIMESTAMP '2024-01-25 12:00:00' - INTERVAL 7 DAY AS expired FROM v_job""")

oracle("complement", """
SELECT seq_id, translate(regexp_replace(seq, '[^ACGTNacgtn]', 'N', 'g'), 'ACGTNacgtn', 'TGCANtgcan') AS value
FROM v_seq""")

oracle("object_key", "SELECT file_id, 'runlake-userfile-' || CAST(file_id AS VARCHAR) AS value FROM v_file")

oracle("version_or_default", f"""
WITH v AS (
  SELECT version_id, CASE version_id % 4 WHEN 0 THEN script_version WHEN 1 THEN script_version || 'rc2'
                                          WHEN 2 THEN 'v' || script_version || ' beta' END AS txt
  FROM v_version)
SELECT version_id, CASE WHEN txt IS NOT NULL AND regexp_matches(txt, '{VERSION_PATTERN}') THEN txt ELSE '1' END
           AS value
FROM v""")

oracle("is_output_flag", """
WITH s AS (
  SELECT param_id, CASE WHEN slot % 2 = 0 THEN 'file' ELSE form_field END AS ftype,
         CASE script_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS upload
  FROM v_spec)
SELECT param_id, CASE WHEN upload = false AND ftype = 'file' THEN true ELSE NOT coalesce(upload, false) END
           AS is_output
FROM s""")

oracle("default_group", "SELECT script_id, coalesce(nullif(script_group, ''), 'Scripts') AS value FROM v_script")

oracle("audit_stamp", """
SELECT version_id,
       coalesce(CASE WHEN version_id % 3 = 0 THEN NULL ELSE 'u' || CAST(script_id AS VARCHAR) END, 'editor')
           AS created_by,
       'editor' AS modified_by
FROM v_version""")

oracle("bridge_join", """
WITH b AS (SELECT CASE WHEN s.param_id % 3 = 0 THEN max(v.version_id) ELSE min(v.version_id) END AS version_id, s.param_id, s.name
           FROM v_version v JOIN v_spec s ON v.script_id = s.script_id GROUP BY s.param_id, s.name)
SELECT b.version_id, b.param_id, b.name, v.script_version FROM b JOIN v_version v ON v.version_id = b.version_id""")
