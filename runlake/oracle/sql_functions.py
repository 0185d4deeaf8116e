"""Oracle SQL for the scalar function families."""

from runlake.functions.sequences import CODON_TABLE
from runlake.functions.text import VERSION_PATTERN
from runlake.oracle.sql import oracle

oracle("text_functions", f"""
WITH s AS (
  SELECT *, CAST(script_order AS VARCHAR) || '-' || translate(script_name, ' -', '__') AS fslug,
         CASE script_id % 4 WHEN 0 THEN CAST(script_order AS VARCHAR) || '.' || CAST(script_id % 10 AS VARCHAR)
                            WHEN 1 THEN description WHEN 2 THEN NULL
                            ELSE CAST(script_order AS VARCHAR) || 'rc1' END AS ver
  FROM v_script)
SELECT script_id, translate(script_name, ' -', '__') AS safe_name,
       replace(script_name || '"' || group_name, '"', '\\"') AS escaped,
       fslug AS form_slug,
       CASE WHEN strpos(fslug, '-') > 0 THEN substr(fslug, strpos(fslug, '-') + 1) ELSE fslug END AS param_slug,
       ends_with(script_name, 'bolt') AS ends_bolt,
       script_name || CAST(script_order AS VARCHAR) AS joined,
       'runlake-script-' || CAST(script_id AS VARCHAR) AS object_key,
       CASE WHEN ver IS NOT NULL AND regexp_matches(ver, '{VERSION_PATTERN}') THEN ver ELSE '1' END AS version,
       coalesce(nullif(script_group, ''), 'Scripts') AS group_or_default,
       coalesce(description, group_name) AS created_by
FROM s""")

oracle("hash_functions", """
SELECT user_id, md5(lower(username || '@Example.COM')) AS email_hash, sha256(username) AS key_hash FROM v_user""")

oracle("content_checksum", """
SELECT file_id, sha1(content) AS plain,
       sha1(CAST(job_id AS VARCHAR) || path || 'output' || content) AS salted
FROM v_file""")

oracle("path_functions", r"""
WITH f AS (
  SELECT *,
    CASE file_id % 6 WHEN 0 THEN path WHEN 1 THEN '  ' || replace(path, '/', '\') || ' '
                     WHEN 2 THEN '../' || path WHEN 3 THEN path || '/../x' WHEN 4 THEN ''
                     ELSE './' || CAST(job_id AS VARCHAR) || '//' || filename END AS ref,
    CASE WHEN file_id % 5 = 0 THEN 'anonymous' ELSE 'user_' || CAST(file_id % 10 AS VARCHAR) END AS uname,
    CASE WHEN file_id % 4 = 0 THEN 'custom_dir' ELSE filename END AS folder,
    '/srv/media/' || path AS abs_path
  FROM v_file)
SELECT file_id,
       string_split(path, '/')[-1] AS basename,
       CASE WHEN regexp_matches(string_split(path, '/')[-1], '\.[^.]*$')
            THEN regexp_extract(string_split(path, '/')[-1], '^(.*)\.[^.]*$', 1)
            ELSE string_split(path, '/')[-1] END AS stem,
       regexp_extract(string_split(path, '/')[-1], '\.([^.]*)$', 1) AS extension,
       'job_files/' || substr(checksum, 1, 2) || '/' || substr(checksum, -2, 2) || '/' || checksum || '/'
           || filename AS upload_path,
       'job_files/' || uname || '/' || folder || '/' || CAST(job_id AS VARCHAR) AS output_path,
       ltrim(substr(abs_path, strpos(abs_path, 'jobs/')), '/') AS relative_path,
       trim(ref) <> '' AND (trim(ref) = path OR replace(trim(ref), '\', '/') = path) AS ref_matches
FROM f""")

oracle("json_functions", """
WITH e AS (
  SELECT event_id,
    CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN '2' WHEN 2 THEN '"+"' WHEN 3 THEN '"*"'
                      WHEN 4 THEN '1' ELSE '"3"' END AS lim,
    CASE WHEN event_id % 4 = 0 THEN '{' || props ELSE props END AS raw
  FROM events),
p AS (
  SELECT *, CASE WHEN regexp_matches(trim(json_extract_string(lim, '$')), '^[+-]?[0-9]+$')
                 THEN CAST(trim(json_extract_string(lim, '$')) AS BIGINT) END AS n
  FROM e)
SELECT event_id,
       CASE WHEN lim = 'null' THEN 1 WHEN n IS NOT NULL THEN n ELSE -1 END AS max_choices,
       CASE WHEN lim = 'null' THEN false WHEN n IS NOT NULL THEN n > 1 ELSE true END AS multiple_choice,
       CASE WHEN json_valid(raw) THEN CAST(json(raw) AS VARCHAR) ELSE CAST(to_json(raw) AS VARCHAR) END AS stored
FROM p""")

oracle("coerce_value", """
SELECT job_id, pos,
  CASE WHEN raw IS NULL THEN NULL
       WHEN form_field = 'CharField' THEN CASE WHEN raw = '' THEN NULL ELSE CAST(to_json(raw) AS VARCHAR) END
       WHEN form_field = 'IntegerField' THEN
            CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN CAST(CAST(raw AS HUGEINT) AS VARCHAR) END
       WHEN form_field = 'BooleanField' THEN CASE WHEN raw = '' THEN '""' ELSE 'true' END
       ELSE CAST(to_json(raw) AS VARCHAR) END AS value
FROM v_param""")

oracle("array_functions", """
WITH s AS (
  SELECT *, string_split(script_name, ' ') AS a,
         string_split(concat_ws(' ', group_name, description, string_split(script_name, ' ')[1]), ' ') AS b,
         script_order % 5 - 1 AS k
  FROM v_script)
SELECT script_id,
       coalesce(description, '') AS as_list,
       CAST(CASE WHEN k > 0 THEN k ELSE 0 END AS BIGINT) AS range_size,
       CASE WHEN k > 0 THEN array_to_string(range(0, k), ',') ELSE '' END AS range_text,
       array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS merged,
       array_to_string(list_sort(list_distinct(list_intersect(a, b))), ',') AS common,
       array_to_string(list_concat(a, b), ',') AS flat,
       CAST(len(string_split(script_name, ' ')) AS BIGINT) AS n_props
FROM s""")

oracle("math_functions", """
SELECT major, minor, c1, c3,
       round(CASE WHEN c3 > 0 THEN log2(c3) END, 6) AS log2_c3,
       round(abs(c3 - 0.05), 6) AS abs_c3,
       round(sqrt(c2), 6) AS sqrt_c2,
       round(exp(-c3), 6) AS exp_c3,
       round(pow(c1, 2), 6) AS pow_c1,
       round(CASE WHEN c3 = 0 THEN NULL ELSE c1 / c3 END, 6) AS div_c1_c3
FROM v_matrix""")

oracle("date_functions", """
SELECT job_id, strftime(created_date, '%b %d %Y, %H:%M:%S') AS submitted,
       created_date <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY AS is_old
FROM v_job""")

_CODON_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CODON_TABLE.items()) + "}"

oracle("sequence_functions", f"""
WITH s AS (
  SELECT seq_id, seq, ['+1', '+2', '+3', '-1', '-2', '-3'][seq_id % 6 + 1] AS frame FROM v_seq),
t AS (
  SELECT *, translate(regexp_replace(seq, '[^ACGTNacgtn]', 'N', 'g'), 'ACGTNacgtn', 'TGCANtgcan') AS comp
  FROM s)
SELECT seq_id, frame, md5(comp) AS complement_md5,
       array_to_string(list_transform(
           range(CAST(substr(frame, 2, 1) AS INTEGER) - 1, length(seq) - 2, 3),
           lambda i: coalesce({_CODON_MAP}[substr(CASE WHEN frame LIKE '-%' THEN comp ELSE seq END, i + 1, 3)], 'X')),
           '') AS protein
FROM t""")

oracle("search_terms", r"""
WITH s AS (
  SELECT script_id,
    CASE script_id % 3 WHEN 0 THEN script_name WHEN 1 THEN '"' || script_name || '"  x'
         ELSE '  ' || group_name || '   "a   b " c' END AS q
  FROM v_script),
m AS (
  SELECT script_id, regexp_extract_all(q, '"([^"]+)"|(\S+)', 1) AS ph,
         regexp_extract_all(q, '"([^"]+)"|(\S+)', 2) AS wd
  FROM s)
SELECT script_id, CAST(i - 1 AS BIGINT) AS term_no,
       regexp_replace(trim(CASE WHEN ph[i] <> '' THEN ph[i] ELSE wd[i] END), '\s{2,}', ' ', 'g') AS term
FROM m, generate_series(1, len(ph)) AS g(i)""")

oracle("attribute_map", r"""
WITH m AS (
  SELECT page_id, regexp_extract_all(html, '(\w+)="([^"]+)"', 1) AS k,
         regexp_extract_all(html, '(\w+)="([^"]+)"', 2) AS v
  FROM v_html),
e AS (SELECT page_id, k[i] AS key, v[i] AS value, i FROM m, generate_series(1, len(k)) AS g(i))
SELECT page_id, key, arg_max(value, i) AS value FROM e GROUP BY page_id, key""")

oracle("merge_attributes", r"""
WITH m AS (
  SELECT page_id, regexp_extract_all(html, '(\w+)="([^"]+)"', 1) AS k,
         regexp_extract_all(html, '(\w+)="([^"]+)"', 2) AS v,
         string_split(url, '/')[3] AS cls
  FROM v_html),
e AS (
  SELECT page_id, 'custom-property' AS key, 'true' AS value, 1 AS i FROM m
  UNION ALL SELECT page_id, 'lang', 'true', 2 FROM m
  UNION ALL SELECT page_id, k[j], v[j], 2 + j FROM m, generate_series(1, len(k)) AS g(j)
  UNION ALL SELECT page_id, 'class', cls, 100000 FROM m WHERE coalesce(cls, '') <> '')
SELECT page_id, key, arg_max(value, i) AS value FROM e GROUP BY page_id, key""")
