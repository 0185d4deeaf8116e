"""Oracle SQL for catalog loads, patches, job commands and user jobs."""

from runlake.functions.text import VERSION_PATTERN
from runlake.oracle.sql import oracle
from runlake.oracle.sql_files import _TYPED
from runlake.oracle.sql_sequences import _translate

oracle("patch_checks", """
SELECT script_id,
       CASE script_id % 5 WHEN 3 THEN 'script_name: This field is required.'
                          WHEN 4 THEN 'script_order: invalid|is_active: invalid' ELSE '' END AS errors
FROM v_script""")

oracle("sparse_patch", """
WITH p AS (SELECT script_id, script_id % 5 AS k FROM v_script)
SELECT s.script_id,
       CASE WHEN p.k = 0 THEN upper(s.script_name) ELSE s.script_name END AS script_name,
       CASE WHEN p.k = 1 THEN 'Scripts' ELSE s.group_name END AS group_name,
       s.description,
       CASE WHEN p.k = 2 THEN 5 ELSE s.script_order END AS script_order,
       s.is_active,
       CAST(NULL AS VARCHAR) AS save_path
FROM v_script s LEFT JOIN p ON s.script_id = p.script_id""")

oracle("version_patch_rules", """
WITH p AS (SELECT version_id, version_id % 6 AS k FROM v_version),
d AS (SELECT script_id, count(*) AS n_def FROM v_version WHERE is_active AND default_version GROUP BY script_id),
x AS (
  SELECT v.*, p.k, coalesce(d.n_def, 0) - CAST(v.is_active AND v.default_version AS INTEGER) AS others
  FROM v_version v LEFT JOIN p ON v.version_id = p.version_id LEFT JOIN d ON v.script_id = d.script_id),
y AS (
  SELECT *,
    CASE WHEN k = 4 THEN 'At least one field is required.'
         WHEN k = 5 THEN 'is_active: This field is required.'
         WHEN k = 0 AND NOT is_active THEN 'A disabled script version cannot be set as default.'
         WHEN k = 1 AND others = 0 THEN 'A script must have a default version.' END AS error
  FROM x),
z0 AS (SELECT *, error IS NULL AS applied FROM y),
g AS (
  SELECT script_id,
         count(*) FILTER (WHERE is_active AND default_version AND NOT (applied AND k IN (1, 2, 3))) AS n_left,
         count(*) FILTER (WHERE applied AND k = 0) AS n_new,
         max(version_id) FILTER (WHERE is_active AND default_version AND applied AND k = 1) AS last_out
  FROM z0 GROUP BY script_id),
z AS (
  SELECT z0.* EXCLUDE (applied, error),
         CASE WHEN n_left = 0 AND n_new = 0 AND version_id = last_out
              THEN 'A script must have a default version.' ELSE error END AS error,
         applied AND NOT coalesce(n_left = 0 AND n_new = 0 AND version_id = last_out, false) AS applied
  FROM z0 JOIN g ON z0.script_id = g.script_id),
w AS (SELECT script_id, arg_max(version_id, (created_date, version_id)) AS win FROM z
      WHERE applied AND k = 0 GROUP BY script_id)
SELECT z.version_id, z.script_id,
       CASE WHEN applied AND k IN (2, 3) THEN false
            WHEN w.win IS NOT NULL THEN z.version_id = w.win
            WHEN applied AND k IN (1, 3) THEN false
            ELSE default_version END AS default_version,
       CASE WHEN applied AND k IN (2, 3) THEN false ELSE is_active END AS is_active,
       error
FROM z LEFT JOIN w ON z.script_id = w.script_id""")

oracle("apply_job_commands", """
WITH lg AS (
  SELECT event_id AS cmd_id,
         CASE WHEN event_id % 17 = 0 THEN -1 - event_id ELSE xor(event_id, event_id % 2 * 4) END AS job_id,
         CASE WHEN event_id % 9 = 0 THEN NULL ELSE user_id END AS user_id,
         ['resubmit', 'rerun', 'delete', 'stop', 'bogus'][event_id % 5 + 1] AS command
  FROM events),
x AS (
  SELECT lg.*, j.job_id IS NOT NULL AS found,
         lg.user_id IS NULL AND s.script_id IS NOT NULL AND s.script_group = '' AND s.parent_group = '' AS anonymous_ok,
         coalesce(s.is_active AND ((s.script_group = '' AND s.parent_group = '')
                                   OR coalesce(u.user_group IN (nullif(s.script_group, ''), nullif(s.parent_group, '')), false)),
                  false) OR anonymous_ok AS permitted,
         coalesce(s.script_group, '') <> '' OR coalesce(s.parent_group, '') <> '' AS grouped,
         j.user_id IS NULL OR (lg.user_id IS NOT NULL AND lg.user_id = j.user_id) AS owned,
         lg.command IN ('resubmit', 'rerun', 'delete', 'stop') AS known,
         found AND permitted AND owned AND known AS done
  FROM lg LEFT JOIN v_job j ON lg.job_id = j.job_id LEFT JOIN v_script s ON s.script_id = j.script_id
  LEFT JOIN v_user u ON u.user_id = lg.user_id),
st AS (
  SELECT job_id,
         arg_max(CASE command WHEN 'rerun' THEN 'submitted' WHEN 'delete' THEN 'deleted' ELSE 'REVOKED' END, cmd_id)
             AS new_status,
         count(*) FILTER (WHERE command = 'rerun') AS reruns
  FROM x WHERE done AND command <> 'resubmit' GROUP BY job_id)
SELECT 'job' AS kind, j.job_id AS id, coalesce(st.new_status, j.status) AS status,
       CAST(coalesce(st.reruns, 0) AS BIGINT) AS n
FROM v_job j LEFT JOIN st ON j.job_id = st.job_id
UNION ALL
SELECT 'resubmit', cmd_id, CAST(NULL AS VARCHAR), job_id FROM x WHERE done AND command = 'resubmit'
UNION ALL
SELECT 'error', cmd_id, CASE WHEN NOT found THEN 'Unknown Job'
                            WHEN NOT permitted THEN CASE WHEN grouped THEN 'You are not permitted to use this script' ELSE '' END
                            WHEN NOT owned THEN '' ELSE 'Unknown Command' END,
       CAST(NULL AS BIGINT)
FROM x WHERE NOT done""")

oracle("clone_jobs", """
WITH r AS (
  SELECT o_orderkey * 2 AS request_id, o_orderkey AS job_id, o_custkey AS requester_id FROM orders
  WHERE o_orderstatus = 'P'),
n AS (
  SELECT r.*, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY request_id) AS new_job_id FROM r)
SELECT n.new_job_id AS job_id, p.pos, p.name, p.raw, n.job_id AS source_job_id, n.requester_id AS user_id
FROM n JOIN v_param p ON p.job_id = n.job_id""")

oracle("register_versions", f"""
WITH b AS (
  SELECT p_partkey AS batch_id,
         CASE WHEN p_partkey % 5 = 0 THEN p_brand || '-' || CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS VARCHAR) ELSE p_name END AS script_name,
         CASE WHEN p_partkey % 5 = 0 THEN sha1(CAST(CAST(floor(p_partkey / 15) AS BIGINT) AS VARCHAR))
              WHEN p_partkey % 2 = 0 THEN sha1(CAST(p_partkey AS VARCHAR) || '|' || CAST(p_partkey % 7 AS VARCHAR))
              ELSE sha1(CAST(p_partkey % 300 AS VARCHAR) || '|new') END AS checksum,
         CASE p_partkey % 4 WHEN 0 THEN '2.0-beta1' WHEN 2 THEN '1!2.0+x' ELSE '1' END AS script_version,
         CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_type END AS description, p_size % 9 = 0 AS set_default
  FROM part),
named AS (SELECT v.*, s.script_name FROM v_version v JOIN v_script s ON v.script_id = s.script_id),
ex AS (SELECT script_name, checksum, arg_max(version_id, (script_version, iteration, version_id)) AS existing_id
       FROM named GROUP BY script_name, checksum),
sid AS (SELECT script_name, min(script_id) AS script_id FROM v_script GROUP BY script_name),
made AS (SELECT script_name, min(batch_id) AS made_by,
                (SELECT max(script_id) FROM v_script) + row_number() OVER (ORDER BY min(batch_id)) AS script_id
         FROM b WHERE script_name NOT IN (SELECT script_name FROM sid) GROUP BY script_name),
bb AS (
  SELECT b.*, ex.existing_id, coalesce(sid.script_id, made.script_id) AS script_id, coalesce(made.made_by = b.batch_id, false) AS creates,
         min(batch_id) OVER (PARTITION BY b.script_name, b.checksum) AS first_id
  FROM b LEFT JOIN ex ON b.script_name = ex.script_name AND b.checksum = ex.checksum
  LEFT JOIN sid ON b.script_name = sid.script_name LEFT JOIN made ON b.script_name = made.script_name),
base AS (SELECT script_id, script_version, max(iteration) AS mx FROM v_version GROUP BY script_id, script_version),
nw AS (SELECT *, row_number() OVER (PARTITION BY script_id, script_version ORDER BY batch_id) AS k,
              (SELECT max(version_id) FROM v_version) + row_number() OVER (ORDER BY batch_id) AS version_id,
              max(CASE WHEN set_default AND NOT creates THEN batch_id END) OVER (PARTITION BY script_id) AS taken
       FROM bb WHERE existing_id IS NULL AND batch_id = first_id),
t AS (SELECT script_id, arg_min(nullif(description, ''), batch_id) AS told, bool_or(creates) AS created, max(taken) AS taken
      FROM nw GROUP BY script_id)
SELECT 'new' AS kind, nw.batch_id AS id, nw.script_id, nw.version_id, nw.script_version, CAST(coalesce(base.mx, 0) + nw.k AS BIGINT) AS iteration,
       (creates OR set_default) AND (taken IS NULL OR batch_id >= taken) AS flag, CAST(NULL AS VARCHAR) AS text
FROM nw LEFT JOIN base ON nw.script_id = base.script_id AND nw.script_version = base.script_version
UNION ALL
SELECT 'duplicate', bb.batch_id, bb.script_id, coalesce(bb.existing_id, nw.version_id), NULL, NULL, NULL, NULL
FROM bb LEFT JOIN nw ON nw.batch_id = bb.first_id WHERE bb.existing_id IS NOT NULL OR bb.batch_id <> bb.first_id
UNION ALL
SELECT 'script', t.script_id, t.script_id, NULL, NULL, NULL, created, coalesce(nullif(s.description, ''), told, '')
FROM t LEFT JOIN v_script s ON s.script_id = t.script_id
UNION ALL
SELECT 'unset', v.version_id, v.script_id, v.version_id, NULL, NULL, false, NULL
FROM v_version v JOIN t ON t.script_id = v.script_id WHERE v.default_version AND t.taken IS NOT NULL""")

oracle("build_file_catalog", f"""
WITH known AS (
  SELECT '/srv/media/' || f.path AS known_path FROM v_user_file uf JOIN v_file f ON uf.file_id = f.file_id
  WHERE uf.param = 'out'),
named AS (
  SELECT f.*, 'parameter' AS source FROM v_file f
  WHERE f.file_id IN (SELECT file_id FROM v_user_file WHERE param = 'out')),
walked AS (
  SELECT f.*, 'walked' AS source FROM v_file f
  WHERE NOT EXISTS (SELECT 1 FROM known k WHERE ends_with(k.known_path, f.path))),
a AS (SELECT * FROM named UNION ALL SELECT * FROM walked),
t AS ({_TYPED}),
s AS (
  SELECT a.job_id, a.file_id, a.path, a.source,
         CASE WHEN ends_with(a.path, '.tar.gz') OR ends_with(a.path, '.zip') THEN 'archives'
              ELSE coalesce(t.filetype, 'all') END AS "group",
         sha1(CAST(a.job_id AS VARCHAR) || a.path || 'output' || a.content) AS checksum
  FROM a JOIN t ON a.file_id = t.file_id),
ex AS (SELECT checksum, min(file_id) AS existing_id FROM v_file GROUP BY checksum),
fresh AS (
  SELECT checksum, (SELECT max(file_id) FROM v_file) + row_number() OVER (ORDER BY checksum) AS new_id
  FROM (SELECT DISTINCT checksum FROM s WHERE checksum NOT IN (SELECT checksum FROM ex)))
SELECT s.job_id, s.file_id, s.path, s.source, s."group", s.checksum,
       coalesce(ex.existing_id, fresh.new_id) AS stored_id, ex.existing_id IS NULL AS created
FROM s LEFT JOIN ex ON s.checksum = ex.checksum LEFT JOIN fresh ON s.checksum = fresh.checksum""")

oracle("backfill_versions_bridge", """
SELECT CASE WHEN s.param_id % 3 = 0 THEN max(v.version_id) ELSE min(v.version_id) END AS version_id, s.param_id
FROM v_version v JOIN v_spec s ON v.script_id = s.script_id GROUP BY s.param_id""")

oracle("backfill_uuid", """
WITH h AS (SELECT job_id, sha256('job:' || CAST(job_id AS VARCHAR)) AS h FROM v_job)
SELECT job_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4)
               || '-' || substr(h, 21, 12) AS uuid
FROM h""")

oracle("backfill_parser", """
WITH l AS (SELECT script_id, arg_max(version_id, (script_version, iteration, version_id)) AS last_version_id
           FROM v_version GROUP BY script_id)
SELECT s.param_id, s.script_id, s.parser_name, l.last_version_id
FROM v_spec s LEFT JOIN l ON s.script_id = l.script_id""")

_VIEWS = ["job", "script", "version", "user", "key", "request", "param", "file", "user_file", "local", "remote",
          "favorite", "toggle", "chunk", "line", "fasta_line", "seq", "matrix", "wide", "html", "spec"]
oracle("scan_catalog", "\nUNION ALL\n".join(
    f"SELECT 'v_{n}' AS view, count(*) AS n_rows FROM v_{n}" for n in _VIEWS))

oracle("run_job", f"SELECT seq_id, {_translate('seq', 2)} AS protein FROM v_seq")

_COMPLEMENT = "translate(regexp_replace(seq, '[^ACGTNacgtn]', 'N', 'g'), 'ACGTNacgtn', 'TGCANtgcan')"
oracle("run_sweep", "\nUNION ALL\n".join(
    f"SELECT '{sign}{i + 1}' AS param_frame, seq_id, {_translate(strand, i)} AS protein FROM v_seq"
    for sign, strand in (("+", "seq"), ("-", _COMPLEMENT)) for i in range(3)))

oracle("parse_commands", """
WITH o AS (SELECT o_orderkey AS job_id, o_orderkey % 6 AS kind, o_orderkey % 7 = 0 AS short, o_orderstatus AS s, o_orderpriority AS p,
                  CAST(o_custkey AS VARCHAR) AS who, CAST(CAST(floor(o_totalprice) - 200000 AS BIGINT) AS VARCHAR) AS total
           FROM orders),
r AS (
  SELECT job_id, 'status' AS dest, 1 AS position, s AS value, 'command' AS origin FROM o WHERE kind < 3
  UNION ALL SELECT job_id, 'customer', 1, who, 'command' FROM o WHERE kind < 3
  UNION ALL SELECT job_id, 'customer', 2, CASE kind WHEN 0 THEN '7' ELSE '8' END, 'command' FROM o WHERE kind IN (0, 2)
  UNION ALL SELECT job_id, 'customer', 3, '9', 'command' FROM o WHERE kind = 2
  UNION ALL SELECT job_id, 'priority', 1, p, 'command' FROM o WHERE kind < 2 OR (kind = 2 AND NOT short)
  UNION ALL SELECT job_id, 'priority', 1, '3-MEDIUM', 'default' FROM o WHERE kind = 2 AND short
  UNION ALL SELECT job_id, 'subparser', 1, 'sub', 'command' FROM o WHERE kind = 0
  UNION ALL SELECT job_id, 'total', 1, total, 'command' FROM o WHERE kind = 0
  UNION ALL SELECT job_id, 'total', 2, '-5', 'command' FROM o WHERE kind = 0
  UNION ALL SELECT job_id, 'flag', 1, 'True', 'command' FROM o WHERE kind = 0
  UNION ALL SELECT job_id, NULL, 0, CASE kind WHEN 3 THEN 'the following arguments are required: --customer'
                                              WHEN 4 THEN 'unrecognized arguments: --bogus'
                                              ELSE 'No closing quotation' END, 'error' FROM o WHERE kind > 2)
SELECT job_id, dest, CAST(position AS INTEGER) AS position, value, origin FROM r""")
