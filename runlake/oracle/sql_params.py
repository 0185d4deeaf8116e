"""Oracle SQL for the parameter family."""

from runlake.oracle.sql import oracle


def coerced(ff: str = "form_field", raw: str = "raw") -> str:
    return f"""(CASE WHEN {raw} IS NULL THEN NULL
       WHEN {ff} = 'CharField' THEN CASE WHEN {raw} = '' THEN NULL ELSE CAST(to_json({raw}) AS VARCHAR) END
       WHEN {ff} = 'IntegerField' THEN
            CASE WHEN regexp_matches({raw}, '^[0-9]+$') THEN CAST(CAST({raw} AS HUGEINT) AS VARCHAR) END
       WHEN {ff} = 'BooleanField' THEN CASE WHEN {raw} = '' THEN '""' ELSE 'true' END
       ELSE CAST(to_json({raw}) AS VARCHAR) END)"""


_TOKENS = f"""WITH v AS (
  SELECT job_id, short_param AS flag, collapse, CASE WHEN pos IN (4, 5) AND job_id % 3 <> 0 THEN 'sub' ELSE '' END AS parser,
         CASE WHEN pos IN (4, 5) AND job_id % 3 <> 0 THEN 100 ELSE 0 END + pos AS ord,
         CASE WHEN {coerced()} IS NULL THEN NULL WHEN form_field = 'BooleanField' THEN ''
              WHEN form_field = 'IntegerField' THEN {coerced()} ELSE raw END AS val
  FROM v_param),
f AS (
  SELECT job_id, flag, min(ord) AS first, arg_max(collapse, ord) AS collapse, arg_max(parser, ord) AS parser,
         list(val ORDER BY ord) FILTER (WHERE val <> '') AS vals
  FROM v WHERE val IS NOT NULL GROUP BY job_id, flag),
t AS (
  SELECT job_id, first, parser,
         CASE WHEN flag <> '' AND len(coalesce(vals, [])) = 0 THEN [flag]
              ELSE flatten(list_transform(coalesce(vals, []), lambda x, i:
                   CASE WHEN flag <> '' AND (NOT collapse OR i = 1) THEN [flag, x] ELSE [x] END)) END AS toks
  FROM f),
p AS (SELECT job_id, first, CASE WHEN parser <> '' AND row_number() OVER (PARTITION BY job_id, parser ORDER BY first) = 1
             THEN list_concat([parser], toks) ELSE toks END AS toks
      FROM t WHERE len(toks) > 0),
a AS (SELECT job_id, flatten(list(toks ORDER BY first)) AS tokens FROM p GROUP BY job_id)"""

oracle("assemble_command", f"""
{_TOKENS}
SELECT job_id, array_to_string(tokens, ' ') AS command, CAST(len(tokens) AS BIGINT) AS n_tokens FROM a""")

_PREFILL = f"""
  SELECT v.job_id, CAST(s.param_id AS VARCHAR) || '-' || v.name AS form_slug, v.pos,
         {coerced('v.form_field', 'v.raw')} AS stored
  FROM v_param v JOIN v_job_script js ON v.job_id = js.job_id
  JOIN v_spec s ON s.script_id = js.script_id AND s.name = v.name"""

oracle("prefill_from_job", f"""
WITH p AS ({_PREFILL})
SELECT job_id, form_slug, array_to_string(list(stored ORDER BY pos), '|') AS "values"
FROM p WHERE stored IS NOT NULL GROUP BY job_id, form_slug""")

oracle("explode_values", f"""
WITH p AS ({_PREFILL}),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, form_slug ORDER BY pos) - 1 AS value_pos
      FROM p WHERE stored IS NOT NULL)
SELECT job_id, form_slug, CAST(value_pos AS BIGINT) AS value_pos, stored AS value FROM r""")

oracle("first_seen_order", """
WITH f AS (SELECT job_id, short_param, min(pos) AS first FROM v_param GROUP BY job_id, short_param)
SELECT job_id, short_param,
       CAST(row_number() OVER (PARTITION BY job_id ORDER BY first, short_param) AS BIGINT) AS first_seen_rank
FROM f""")

oracle("param_order", """
SELECT param_id, script_id,
       CAST(row_number() OVER (PARTITION BY script_id ORDER BY parser_name, group_name, param_order, param_id)
            AS BIGINT) AS param_index
FROM v_spec""")

oracle("sort_params", "SELECT param_id, param_order FROM v_spec")

oracle("visible_params", "SELECT param_id, script_id, name FROM v_spec WHERE NOT hidden AND NOT group_hidden")

oracle("group_by_parser", """
SELECT script_id, parser_name, array_to_string(list(name ORDER BY name, param_order, param_id), ',') AS params
FROM v_spec GROUP BY script_id, parser_name""")

oracle("spec_report", """
WITH g AS (
  SELECT script_id, parser_name, group_name, min(param_order) AS first,
         array_to_string(list(name ORDER BY param_order, param_id, name), ',') AS params
  FROM v_spec WHERE NOT hidden AND NOT group_hidden GROUP BY script_id, parser_name, group_name),
l AS (
  SELECT script_id, parser_name,
         string_agg(group_name || ':' || params, ';' ORDER BY group_name <> 'Required', first, group_name) AS layout
  FROM g GROUP BY script_id, parser_name),
p AS (SELECT DISTINCT script_id, parser_name FROM v_spec)
SELECT p.script_id, p.parser_name, coalesce(l.layout, '') AS layout
FROM p LEFT JOIN l ON p.script_id = l.script_id AND p.parser_name = l.parser_name""")

oracle("parser_coverage", """
WITH g AS (
  SELECT script_id, parser_name, count(DISTINCT group_name) AS n FROM v_spec
  WHERE NOT hidden AND NOT group_hidden GROUP BY script_id, parser_name),
p AS (SELECT DISTINCT script_id, parser_name FROM v_spec)
SELECT p.script_id, p.parser_name, CAST(coalesce(g.n, 0) AS BIGINT) AS n_groups
FROM p LEFT JOIN g ON p.script_id = g.script_id AND p.parser_name = g.parser_name""")

_JOBS = """
  SELECT js.job_id, js.script_id, ch.job_id IS NOT NULL AS asked,
         CASE WHEN ch.job_id IS NOT NULL THEN 'sub' WHEN np.n = 1 THEN np.only_parser END AS chosen,
         coalesce(np.n, 0) AS n
  FROM v_job_script js
  LEFT JOIN (SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'F') ch ON ch.job_id = js.job_id
  LEFT JOIN (SELECT script_id, count(DISTINCT parser_name) AS n, min(parser_name) AS only_parser FROM v_spec
             GROUP BY script_id) np ON np.script_id = js.script_id"""
_SCOPE = f"""
  SELECT v.job_id, v.pos, v.name, s.parser_name, v.form_field, v.raw
  FROM v_param v JOIN ({_JOBS}) j ON v.job_id = j.job_id
  JOIN v_spec s ON s.script_id = j.script_id AND s.name = v.name
  WHERE (j.asked OR j.n <= 1) AND (s.parser_name = '' OR s.parser_name = j.chosen)"""

oracle("subparser_scope", f"""
SELECT job_id, pos, name, parser_name, CAST(NULL AS VARCHAR) AS error FROM ({_SCOPE})
UNION ALL
SELECT job_id, NULL, NULL, NULL, 'A sub-command must be chosen.' FROM ({_JOBS}) WHERE NOT asked AND n > 1""")

_SUBMITTED = """
p AS (
  SELECT job_id, pos, name, raw FROM v_param
  UNION ALL SELECT o_orderkey, 7, 'infile', CASE WHEN o_orderkey % 3 <> 0 THEN coalesce(f.path, 'jobs/0/none.txt') END
            FROM orders LEFT JOIN v_file f ON f.file_id = o_orderkey
  UNION ALL SELECT o_orderkey, 8, 'ratio', ['0.5', 'abc', '-1e3', 'nan', ''][o_orderkey % 5 + 1] FROM orders),
sp AS (
  SELECT script_id, name, form_field, required, choices, choice_limit, parser_name, param_id FROM v_spec
  UNION ALL SELECT p_partkey, 'infile', 'FileField', p_partkey % 2 = 0, NULL, 'null', '', p_partkey * 10 + 7 FROM part
  UNION ALL SELECT p_partkey, 'ratio', 'FloatField', false, NULL, 'null', '', p_partkey * 10 + 8 FROM part)"""

oracle("create_jobs", f"""
WITH {_SUBMITTED.strip()},
j AS (SELECT o_orderkey AS request_id, o_custkey AS user_id, (SELECT max(job_id) FROM v_job) + row_number() OVER (ORDER BY o_orderkey) AS job_id,
             CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE 'order ' || CAST(o_orderkey AS VARCHAR) END AS job_name
      FROM orders WHERE o_orderstatus = 'F')
SELECT 'job' AS kind, job_id, request_id, user_id, CAST(NULL AS BIGINT) AS param_id, CAST(NULL AS INTEGER) AS pos,
       job_name || '||submitted||' AS text FROM j
UNION ALL
SELECT 'value', j.job_id, NULL, NULL, sp.param_id, p.pos, {coerced('sp.form_field', 'p.raw')}
FROM j JOIN p ON p.job_id = j.request_id JOIN sp ON sp.script_id = j.user_id AND sp.name = p.name
UNION ALL
SELECT 'error', NULL, o_orderkey, NULL, NULL, NULL, 'A sub-command must be chosen.' FROM orders WHERE o_orderstatus <> 'F'""")

oracle("validate_submission", f"""
WITH {_SUBMITTED.strip()},
vs AS (
  SELECT v.job_id, js.script_id, v.name, v.raw, s.form_field, s.choices, s.choice_limit
  FROM p v JOIN v_job_script js ON v.job_id = js.job_id
  JOIN sp s ON s.script_id = js.script_id AND s.name = v.name),
pf AS (
  SELECT job_id, script_id, name,
         count(*) FILTER (WHERE raw IS NOT NULL AND raw <> '') AS n,
         any_value(choice_limit) AS lim,
         count(*) FILTER (WHERE raw IS NOT NULL AND raw <> '' AND form_field = 'IntegerField'
                          AND NOT regexp_matches(raw, '^\\s*[+-]?[0-9]+(\\.0*)?\\s*$')) AS bad_int,
         count(*) FILTER (WHERE raw IS NOT NULL AND raw <> '' AND form_field = 'FloatField'
                          AND (TRY_CAST(raw AS DOUBLE) IS NULL OR NOT isfinite(TRY_CAST(raw AS DOUBLE)))) AS bad_float,
         count(*) FILTER (WHERE raw IS NOT NULL AND raw <> '' AND choices IS NOT NULL
                          AND NOT list_contains(CAST(json(choices) AS VARCHAR[]), raw)) AS bad_choice
  FROM vs GROUP BY job_id, script_id, name),
lim AS (
  SELECT *, CASE WHEN lim = 'null' THEN 1
                 WHEN regexp_matches(trim(json_extract_string(lim, '$')), '^[+-]?[0-9]+$')
                      THEN CAST(trim(json_extract_string(lim, '$')) AS BIGINT)
                 ELSE -1 END AS max_n
  FROM pf),
own AS (SELECT f.path, j.user_id AS owner_id FROM v_user_file u JOIN v_file f ON u.file_id = f.file_id LEFT JOIN v_job j ON u.job_id = j.job_id),
seen AS (SELECT path, bool_or(owner_id IS NULL) AS pub, list(DISTINCT owner_id) AS owners FROM own GROUP BY path),
file_errors AS (
  SELECT p.job_id, CASE WHEN seen.path IS NULL THEN 'Referenced file could not be found.'
                        WHEN NOT seen.pub AND NOT list_contains(seen.owners, o.o_custkey) THEN 'You are not permitted to access this file.' END AS error
  FROM p JOIN orders o ON o.o_orderkey = p.job_id LEFT JOIN seen ON seen.path = p.raw WHERE p.name = 'infile' AND p.raw IS NOT NULL)
SELECT job_id, name, 'Select a valid choice.' AS error FROM lim WHERE bad_choice > 0
UNION ALL SELECT job_id, name, 'Enter a whole number.' FROM lim WHERE bad_int > 0
UNION ALL SELECT job_id, name, 'Enter a number.' FROM lim WHERE bad_float > 0
UNION ALL SELECT job_id, name, 'Too many values.' FROM lim WHERE max_n <> -1 AND n > max_n
UNION ALL SELECT job_id, 'infile', error FROM file_errors WHERE error IS NOT NULL
UNION ALL SELECT o_orderkey, 'job_name', 'This field is required.' FROM orders WHERE o_orderkey % 9 = 0
UNION ALL
SELECT js.job_id, s.name, 'This field is required.' FROM v_job_script js JOIN sp s ON s.script_id = js.script_id
WHERE s.required AND NOT EXISTS (SELECT 1 FROM lim WHERE lim.job_id = js.job_id AND lim.name = s.name AND lim.n > 0)""")

oracle("merge_values", """
SELECT file_id, row_no,
       array_to_string(list_sort(list_distinct(list_concat(cells, string_split(lower(array_to_string(cells, ',')), ',')))), '|') AS merged
FROM v_cells""")

oracle("reuse_params", """
WITH s AS (
  SELECT *, param_order + 1 AS position, slot = 3 AS is_output, slot = 4 AS is_checked,
         CASE WHEN form_field = 'IntegerField' THEN 'int' ELSE 'str' END AS input_type,
         'about ' || name || ' ' || CAST(script_id % 3 AS VARCHAR) AS param_help,
         CASE WHEN slot = 1 THEN CAST(script_id % 2 AS VARCHAR) END AS "default"
  FROM v_spec),
n AS (
  SELECT script_id * 2 AS version_id, * FROM s
  UNION ALL BY NAME
  SELECT script_id * 2 + 1 AS version_id, * REPLACE (5 - param_order AS position,
         CASE WHEN script_id % 4 = 0 AND slot = 2 THEN 'new text' ELSE param_help END AS param_help) FROM s),
o AS (
  SELECT script_id, parser_name, group_name, short_param, name, is_output, required, form_field, input_type, choices, choice_limit,
         param_help, is_checked, collapse, "default", CASE WHEN short_param = '' THEN position END AS place, min(param_id) AS old_id
  FROM s WHERE parser_name = '' GROUP BY ALL),
m AS (
  SELECT n.version_id, n.position, o.old_id, dense_rank() OVER (ORDER BY n.script_id, n.parser_name, n.group_name, n.short_param, n.name,
         n.is_output, n.required, n.form_field, n.input_type, n.choices, n.choice_limit, n.param_help, n.is_checked, n.collapse, n."default",
         CASE WHEN n.short_param = '' THEN n.position END) AS t
  FROM n LEFT JOIN o ON n.script_id = o.script_id AND n.parser_name = o.parser_name AND n.group_name = o.group_name
   AND n.short_param = o.short_param AND n.name = o.name AND n.is_output = o.is_output AND n.required = o.required
   AND n.form_field = o.form_field AND n.input_type = o.input_type AND n.choices IS NOT DISTINCT FROM o.choices
   AND n.choice_limit = o.choice_limit AND n.param_help = o.param_help AND n.is_checked = o.is_checked AND n.collapse = o.collapse
   AND n."default" IS NOT DISTINCT FROM o."default"
   AND CASE WHEN n.short_param = '' THEN n.position END IS NOT DISTINCT FROM o.place),
f AS (SELECT t, min((version_id, position)) AS first FROM m WHERE old_id IS NULL GROUP BY t),
g AS (SELECT t, first, (SELECT max(param_id) FROM s WHERE parser_name = '') + row_number() OVER (ORDER BY first) AS made FROM f)
SELECT m.version_id, m.position, coalesce(m.old_id, g.made) AS param_id,
       coalesce(g.first = (m.version_id, m.position), false) AS is_new
FROM m LEFT JOIN g ON m.t = g.t""")

oracle("distinct_rows", """
SELECT DISTINCT js.script_id, v.name FROM v_param v JOIN v_job_script js ON v.job_id = js.job_id""")


oracle("command_tokens", f"""
{_TOKENS}
SELECT job_id, CAST(i AS BIGINT) AS token_pos, tokens[i] AS token FROM a, generate_series(1, len(tokens)) AS g(i)""")
