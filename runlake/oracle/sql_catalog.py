"""Oracle SQL for the catalog family."""

from runlake.oracle.sql import oracle

_REQ = """
  SELECT job_id AS request_id, script_id,
         CASE WHEN job_id % 4 = 0 THEN NULL
              ELSE CAST(job_id % 7 + 1 AS VARCHAR) || '.' || CAST(job_id % 50 AS VARCHAR) END AS version,
         CASE WHEN job_id % 3 = 0 THEN NULL ELSE CAST(job_id % 5 + 1 AS INTEGER) END AS iteration
  FROM v_job"""

_NEW = """
  SELECT job_id AS new_id, script_id,
         CAST(job_id % 7 + 1 AS VARCHAR) || '.' || CAST(job_id % 50 AS VARCHAR) AS script_version
  FROM v_job"""

oracle("fk_join", """
SELECT v.version_id, v.script_id, s.script_name, v.script_version, v.iteration
FROM v_version v JOIN v_script s ON v.script_id = s.script_id""")

oracle("fk_left_join", """
SELECT j.job_id, j.user_id, coalesce(u.username, '') AS username
FROM v_job j LEFT JOIN v_user u ON j.user_id = u.user_id""")

oracle("semi_join_exists", """
SELECT script_id, script_name FROM v_script s
WHERE EXISTS (SELECT 1 FROM v_version v WHERE v.script_id = s.script_id AND v.is_active AND v.default_version)""")

oracle("anti_join_no_default", """
SELECT version_id, script_id FROM v_version v
WHERE is_active AND NOT EXISTS (SELECT 1 FROM v_version d
                                WHERE d.script_id = v.script_id AND d.is_active AND d.default_version)""")

oracle("current_scripts", """
SELECT script_id, script_name FROM v_script s
WHERE EXISTS (SELECT 1 FROM v_version v WHERE v.script_id = s.script_id AND v.is_active)""")

oracle("select_version", f"""
WITH r AS ({_REQ})
SELECT r.request_id,
  CASE WHEN r.version IS NULL AND r.iteration IS NULL THEN
         (SELECT arg_min(v.version_id, (v.script_version, v.iteration, v.version_id)) FROM v_version v
          WHERE v.script_id = r.script_id AND v.is_active AND v.default_version)
       ELSE
         (SELECT arg_max(v.version_id, (v.script_version, v.iteration, v.version_id)) FROM v_version v
          WHERE v.script_id = r.script_id AND v.is_active
            AND (r.version IS NULL OR v.script_version = r.version)
            AND (r.iteration IS NULL OR v.iteration = r.iteration)) END AS version_id
FROM r""")

oracle("latest_version", """
SELECT script_id,
       arg_max(version_id, (script_version, iteration, version_id)) AS last_version_id,
       arg_max(version_id, (created_date, version_id)) FILTER (WHERE is_active AND default_version)
           AS default_version_id
FROM v_version GROUP BY script_id""")

oracle("flip_default", """
WITH w AS (
  SELECT script_id, arg_max(version_id, (created_date, version_id)) AS win FROM v_version
  WHERE iteration = 5 AND is_active GROUP BY script_id)
SELECT v.version_id, v.script_id,
       CASE WHEN w.win IS NULL THEN v.default_version ELSE v.version_id = w.win END AS default_version
FROM v_version v LEFT JOIN w ON v.script_id = w.script_id""")

for _name, _agg in (("next_iteration", "max(iteration)"), ("next_iteration_count", "count(*)")):
    oracle(_name, f"""
WITH n AS ({_NEW}),
b AS (SELECT script_id, script_version, CAST({_agg} AS BIGINT) AS base FROM v_version
      GROUP BY script_id, script_version)
SELECT n.new_id, n.script_id, n.script_version,
       CAST(coalesce(b.base, 0) + row_number() OVER (PARTITION BY n.script_id, n.script_version ORDER BY n.new_id)
            AS BIGINT) AS iteration
FROM n LEFT JOIN b ON n.script_id = b.script_id AND n.script_version = b.script_version""")

oracle("duplicate_version", """
SELECT s.script_name, v.checksum, count(*) AS n_versions,
       arg_max(v.version_id, (v.script_version, v.iteration, v.version_id)) AS existing_id
FROM v_version v JOIN v_script s ON v.script_id = s.script_id
GROUP BY s.script_name, v.checksum HAVING count(*) > 1""")

_COUNTS = """
  SELECT script_id, count(*) AS n_versions, count(*) FILTER (WHERE is_active) AS n_active,
         count(*) FILTER (WHERE is_active AND default_version) AS n_defaults,
         arg_max(version_id, (created_date, version_id)) FILTER (WHERE is_active AND default_version)
             AS default_version_id
  FROM v_version GROUP BY script_id"""

_ISSUES = """concat_ws('|',
    CASE WHEN coalesce(c.n_versions, 0) = 0 THEN 'This script does not have any script versions.'
         WHEN coalesce(c.n_active, 0) = 0 THEN 'This script does not have any active script versions.' END,
    CASE WHEN coalesce(c.n_versions, 0) > 0 AND coalesce(c.n_defaults, 0) = 0
              THEN 'This script does not have a default version.'
         WHEN coalesce(c.n_defaults, 0) > 1 THEN 'This script has multiple default versions.' END)"""

oracle("script_report", f"""
WITH c AS ({_COUNTS})
SELECT s.script_id, s.script_name, coalesce(s.group_name, '') AS "group",
       coalesce(s.description, '') AS script_description, s.script_order,
       CAST(coalesce(c.n_versions, 0) AS BIGINT) AS versions_count,
       {_ISSUES} AS issues, c.default_version_id
FROM v_script s LEFT JOIN c ON s.script_id = c.script_id""")

oracle("script_issues", f"""
WITH c AS ({_COUNTS})
SELECT s.script_id, {_ISSUES} AS issues FROM v_script s LEFT JOIN c ON s.script_id = c.script_id""")

oracle("version_history", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY script_id, script_version ORDER BY iteration, version_id) AS i
           FROM v_version)
SELECT script_id, script_version, CAST(floor((i - 1) / 1000) AS BIGINT) AS block,
       string_agg(CAST(iteration AS VARCHAR), ',' ORDER BY i) AS iterations, count(*) AS n
FROM r GROUP BY script_id, script_version, CAST(floor((i - 1) / 1000) AS BIGINT)""")

oracle("version_labels", """
WITH l AS (SELECT v.checksum, v.version_id, s.script_name || ': ' || CAST(v.iteration AS VARCHAR) AS lab
           FROM v_version v JOIN v_script s ON v.script_id = s.script_id),
r AS (SELECT *, row_number() OVER (PARTITION BY checksum ORDER BY lab, version_id) AS i FROM l)
SELECT checksum, CAST(floor((i - 1) / 1000) AS BIGINT) AS block, string_agg(lab, ', ' ORDER BY i) AS labels,
       count(*) AS n
FROM r GROUP BY checksum, CAST(floor((i - 1) / 1000) AS BIGINT)""")

oracle("sort_versions", r"""
SELECT version_id, script_id,
       CAST(row_number() OVER (PARTITION BY script_id ORDER BY
           list_transform(string_split(regexp_replace(regexp_extract(script_version, '^v?([0-9]+(\.[0-9]+)*)', 1),
                                                  '(\.0+)+$', ''), '.'), lambda x: TRY_CAST(x AS HUGEINT)) DESC,
           CASE WHEN regexp_matches(script_version, '[0-9]a[0-9]') THEN -3
                WHEN regexp_matches(script_version, '[0-9]b[0-9]') THEN -2
                WHEN regexp_matches(script_version, '[0-9]rc[0-9]') THEN -1
                WHEN contains(script_version, '.post') THEN 1 WHEN contains(script_version, '.dev') THEN -4 ELSE 0 END DESC,
           coalesce(TRY_CAST(regexp_extract(script_version, '[0-9](a|b|rc)([0-9]+)', 2) AS HUGEINT), 0) DESC,
           coalesce(TRY_CAST(regexp_extract(script_version, '\.post([0-9]+)', 1) AS HUGEINT), -1) DESC,
           TRY_CAST(regexp_extract(script_version, '\.dev([0-9]+)', 1) AS HUGEINT) DESC NULLS FIRST,
           iteration DESC, version_id DESC) AS BIGINT) AS version_rank
FROM v_version""")

oracle("sort_catalog", """
SELECT script_id, group_name,
       CAST(row_number() OVER (PARTITION BY group_name ORDER BY script_order, script_id) AS BIGINT) AS position
FROM v_script""")

oracle("group_by_name_versions", """
SELECT script_id, script_name,
       CAST(row_number() OVER (PARTITION BY script_name ORDER BY script_id) AS BIGINT) AS version_no,
       max(script_id) OVER (PARTITION BY script_name) AS target_id,
       script_id = max(script_id) OVER (PARTITION BY script_name) AS default_version
FROM v_script""")

oracle("unique_slug", r"""
WITH s AS (
  SELECT script_id, script_name,
         regexp_replace(regexp_replace(lower(trim(script_name)), '[^a-z0-9\s_-]', '', 'g'), '[\s_-]+', '-', 'g')
             AS base
  FROM v_script),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY script_id) AS n FROM s),
b AS (SELECT base, count(*) AS n FROM s GROUP BY base),
t AS (SELECT regexp_extract(base, '^(.*)-([1-9][0-9]*)$', 1) AS stem, count(*) AS n_taken FROM b GROUP BY stem),
k AS (
  SELECT b.base, unnest(generate_series(2, b.n + coalesce(t.n_taken, 0))) AS k
  FROM b LEFT JOIN t ON t.stem = b.base WHERE b.n > 1),
free AS (
  SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) + 1 AS n
  FROM k WHERE base || '-' || CAST(k AS VARCHAR) NOT IN (SELECT base FROM b WHERE base IS NOT NULL))
SELECT script_id, script_name, CASE WHEN r.n = 1 THEN r.base ELSE r.base || '-' || CAST(free.k AS VARCHAR) END AS slug
FROM r LEFT JOIN free ON free.base = r.base AND free.n = r.n""")

oracle("cascade_delete", """
WITH s AS (SELECT script_id FROM v_script WHERE script_order > 45), u AS (SELECT user_id FROM v_user WHERE NOT is_active),
f AS (SELECT file_id FROM v_file WHERE ends_with(filename, '.zip')),
j AS (SELECT job_id FROM v_job WHERE script_id IN (SELECT script_id FROM s))
SELECT 'scripts' AS "table", script_id AS id, CAST(NULL AS BIGINT) AS other FROM v_script WHERE script_order <= 45
UNION ALL SELECT 'versions', version_id, script_id FROM v_version WHERE script_id NOT IN (SELECT script_id FROM s)
UNION ALL SELECT 'jobs', job_id, CASE WHEN user_id IN (SELECT user_id FROM u) THEN NULL ELSE user_id END FROM v_job
          WHERE job_id NOT IN (SELECT job_id FROM j)
UNION ALL SELECT 'values', job_id, pos FROM v_param WHERE job_id NOT IN (SELECT job_id FROM j)
UNION ALL SELECT 'files', file_id, NULL FROM v_file WHERE file_id NOT IN (SELECT file_id FROM f)
UNION ALL SELECT 'user_files', file_id, job_id FROM v_user_file
          WHERE job_id NOT IN (SELECT job_id FROM j) AND file_id NOT IN (SELECT file_id FROM f)
UNION ALL SELECT 'users', user_id, NULL FROM v_user WHERE is_active
UNION ALL SELECT 'favorites', user_id, object_id FROM v_favorite WHERE user_id NOT IN (SELECT user_id FROM u)
UNION ALL SELECT 'api_keys', key_id, user_id FROM v_key WHERE user_id NOT IN (SELECT user_id FROM u)""")
