"""Oracle SQL for the sources / sinks family."""

from runlake.oracle.sql import oracle

oracle("read_delimited", """
SELECT major, minor, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3, round(c4, 6) AS c4
FROM v_matrix""")

oracle("read_sniffed", """
SELECT ',' AS delimiter, doc_id AS id, coalesce(source, '') AS name, coalesce(text, '') AS content, CAST(3 AS BIGINT) AS n_cells
FROM documents
UNION ALL
SELECT chr(9), event_id, event_type, props, CAST(3 AS BIGINT) FROM events""")

oracle("read_records", """
SELECT page_id, CAST(3 AS BIGINT) AS n_cells, sha1(coalesce(html, '')) AS html_sha1 FROM pages""")

oracle("write_fasta", r"""
WITH r AS (
  SELECT *, sum(CASE WHEN line LIKE '>%' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS rec_no
  FROM v_fasta_line),
rec AS (
  SELECT coalesce(arg_min(line, line_no) FILTER (WHERE line LIKE '>%'), '') AS header,
         coalesce(string_agg(CASE WHEN line NOT LIKE '>%' THEN trim(line, ' ' || chr(9) || chr(13)) END, ''
                             ORDER BY line_no), '') AS seq
  FROM r GROUP BY file_id, rec_no HAVING seq <> '')
SELECT substr(header, 2) AS header, seq FROM rec""")

oracle("scan_scripts", """
WITH p AS (
  SELECT doc_id, 'scripts/' || source || '_' || CAST(doc_id AS VARCHAR) ||
         ['.py', '.pyc', '/__init__.py', '.txt'][doc_id % 4 + 1] AS path
  FROM documents)
SELECT doc_id, path FROM p WHERE ends_with(path, '.py') AND NOT contains(path, '__init__')""")

oracle("read_json_params", """
WITH b AS (
  SELECT event_id, json_extract_string(props, '$.k') AS k, props, event_id % 2 = 0 AS is_json FROM events),
j AS (SELECT event_id, 'k' AS key, k AS value FROM b WHERE is_json),
f AS (
  SELECT event_id, 'k' AS key, CAST(CAST(k AS INTEGER) + 1 AS VARCHAR) AS value FROM b WHERE NOT is_json
  UNION ALL SELECT event_id, 'x', 'a b!' FROM b WHERE NOT is_json)
SELECT * FROM j UNION ALL SELECT * FROM f""")

oracle("read_query_string", """
WITH q AS (
  SELECT page_id, CASE WHEN strpos(url, '?') > 0
                       THEN regexp_replace(substr(url, strpos(url, '?') + 1), '#.*$', '') ELSE '' END AS qs
  FROM v_html),
p AS (
  SELECT page_id, i AS pos, string_split(qs, '&')[i] AS part
  FROM q, generate_series(1, len(string_split(qs, '&'))) AS g(i)),
kv AS (
  SELECT page_id, pos, url_decode(split_part(part, '=', 1)) AS key,
         url_decode(CASE WHEN contains(part, '=') THEN substr(part, strpos(part, '=') + 1) ELSE '' END) AS value
  FROM p WHERE part <> '')
SELECT page_id, key AS name,
       CASE WHEN key = 'ref' THEN string_agg(value, '|' ORDER BY pos) ELSE arg_max(value, pos) END AS "values"
FROM kv WHERE key IN ('page', 'ref') GROUP BY page_id, key""")

oracle("write_tsv", "SELECT script_id, script_name, script_order FROM v_script")

_RESULTS = "(status IS NULL OR status NOT IN ('running', 'submitted', 'deleted'))"

oracle("write_json", f"""
WITH tot AS (
  SELECT count(*) FILTER (WHERE status IN ('running', 'submitted')) AS g,
         count(*) FILTER (WHERE status = 'running' AND user_id IS NULL) AS pu,
         count(*) FILTER (WHERE {_RESULTS} AND user_id IS NULL) AS pr
  FROM v_job),
own AS (
  SELECT user_id, count(*) FILTER (WHERE status = 'running') AS own_user,
         count(*) FILTER (WHERE {_RESULTS}) AS own_results
  FROM v_job WHERE user_id IS NOT NULL GROUP BY user_id),
totals AS (
  SELECT u.user_id AS viewer_id, tot.g, tot.pu + coalesce(own.own_user, 0) AS ut, tot.pr + coalesce(own.own_results, 0) AS rt
  FROM v_user u LEFT JOIN own ON u.user_id = own.user_id CROSS JOIN tot
  UNION ALL SELECT NULL, g, pu, pr FROM tot),
gl AS (
  SELECT list(job_id ORDER BY created_date DESC, job_id DESC) AS g FROM (
    SELECT job_id, created_date FROM v_job WHERE status IN ('running', 'submitted')
    ORDER BY created_date DESC, job_id DESC LIMIT 10)),
q AS (
  SELECT 'user' AS queue, job_id, user_id, created_date FROM v_job WHERE status = 'running'
  UNION ALL SELECT 'results', job_id, user_id, created_date FROM v_job WHERE {_RESULTS}),
viewers AS (SELECT user_id AS viewer_id FROM v_user UNION ALL SELECT NULL),
per AS (
  SELECT v.viewer_id, q.queue, q.job_id,
         row_number() OVER (PARTITION BY v.viewer_id, q.queue ORDER BY q.created_date DESC, q.job_id DESC) AS rk
  FROM viewers v JOIN q ON q.user_id IS NULL OR q.user_id IS NOT DISTINCT FROM v.viewer_id),
items AS (
  SELECT viewer_id,
         coalesce(list(job_id ORDER BY rk) FILTER (WHERE queue = 'user' AND rk <= 10), []) AS ui,
         coalesce(list(job_id ORDER BY rk) FILTER (WHERE queue = 'results' AND rk <= 10), []) AS ri
  FROM per GROUP BY viewer_id)
SELECT t.viewer_id,
       '{{"totals":{{"global":' || t.g || ',"user":' || t.ut || ',"results":' || t.rt || '}},"items":{{"global":'
       || CAST(to_json(gl.g) AS VARCHAR) || ',"user":' || CAST(to_json(coalesce(i.ui, [])) AS VARCHAR)
       || ',"results":' || CAST(to_json(coalesce(i.ri, [])) AS VARCHAR) || '}}}}' AS document
FROM totals t CROSS JOIN gl LEFT JOIN items i ON t.viewer_id IS NOT DISTINCT FROM i.viewer_id""")
