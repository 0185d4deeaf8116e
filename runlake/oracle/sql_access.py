"""Oracle SQL for the access, favorites and search families."""

from runlake.oracle.sql import oracle

_REQ = """
  SELECT r.request_id, r.user_id, r.script_id, s.is_active, s.group_active, r.user_id IS NOT NULL AS auth,
         CASE WHEN s.script_group = '' THEN []::VARCHAR[] ELSE [s.script_group] END AS own,
         CASE WHEN s.parent_group = '' THEN []::VARCHAR[] ELSE [s.parent_group] END AS parent,
         CASE WHEN u.user_id IS NULL THEN []::VARCHAR[] ELSE [u.user_group] END AS ug
  FROM (SELECT job_id AS request_id, user_id, script_id FROM v_job) r
  LEFT JOIN v_user u ON r.user_id = u.user_id
  JOIN v_script s ON r.script_id = s.script_id"""


def _rule(groups: str, active: str) -> str:
    return f"""((NOT auth AND len({groups}) = 0) OR (len({groups}) = 0 AND {active})
              OR ({active} AND len(list_intersect(ug, {groups})) > 0))"""


oracle("access_check", f"""
WITH x AS ({_REQ}), y AS (SELECT *, list_distinct(list_concat(own, parent)) AS allg FROM x)
SELECT request_id, user_id, script_id,
       {_rule('allg', 'is_active')} AND {_rule('parent', 'group_active')} AS valid,
       CASE WHEN NOT {_rule('allg', 'is_active')} THEN
                 CASE WHEN len(allg) > 0 THEN 'You are not permitted to use this script' ELSE '' END
            WHEN NOT {_rule('parent', 'group_active')} THEN
                 CASE WHEN len(parent) > 0 THEN 'You are not permitted to use this script' ELSE '' END END AS error,
       'disabled' AS display
FROM y""")

oracle("group_access", """
SELECT r.request_id,
       array_to_string(list_sort(list_distinct(list_intersect([u.user_group],
           list_distinct(list_concat(CASE WHEN s.script_group = '' THEN []::VARCHAR[] ELSE [s.script_group] END,
                                     CASE WHEN s.parent_group = '' THEN []::VARCHAR[] ELSE [s.parent_group] END))))),
           ',') AS common,
       len(list_intersect([u.user_group],
           list_concat(CASE WHEN s.script_group = '' THEN []::VARCHAR[] ELSE [s.script_group] END,
                       CASE WHEN s.parent_group = '' THEN []::VARCHAR[] ELSE [s.parent_group] END))) > 0 AS overlap
FROM (SELECT job_id AS request_id, user_id, script_id FROM v_job) r
JOIN v_user u ON r.user_id = u.user_id JOIN v_script s ON r.script_id = s.script_id""")

oracle("group_intersection", """
SELECT script_id,
       array_to_string(list_sort(list_distinct(list_intersect([script_group, parent_group], ['BUILDING', group_name]))),
                       ',') AS common
FROM v_script""")

_TOKEN = """CASE WHEN len(string_split(auth_header, ' ')) = 2 AND string_split(auth_header, ' ')[1] = 'Bearer'
                 THEN string_split(auth_header, ' ')[2] END"""

oracle("bearer_token", f"SELECT request_id, {_TOKEN} AS token FROM v_request")

oracle("resolve_keys", f"""
WITH t AS (SELECT request_id, ts, sha256({_TOKEN}) AS key_hash FROM v_request)
SELECT k.key_id, k.user_id, count(*) AS n_requests,
       strftime(max(t.ts), '%Y-%m-%d %H:%M:%S.%f') AS last_used
FROM t JOIN v_key k ON t.key_hash = k.key_hash JOIN v_user u ON u.user_id = k.user_id
WHERE k.active AND u.is_active AND t.key_hash IS NOT NULL
GROUP BY k.key_id, k.user_id""")


def _toggled(kind: str) -> str:
    return f"""
  SELECT coalesce(i.user_id, o.user_id) AS user_id, coalesce(i.content_type, o.content_type) AS content_type,
         coalesce(i.object_id, o.object_id) AS object_id
  FROM (SELECT DISTINCT user_id, content_type, CAST(object_id AS BIGINT) AS object_id FROM v_favorite) i
  FULL OUTER JOIN (SELECT user_id, '{kind}' AS content_type, CAST(object_id AS BIGINT) AS object_id,
                          count(*) % 2 = 1 AS odd
                   FROM v_toggle GROUP BY user_id, object_id) o
    ON i.user_id = o.user_id AND i.content_type = o.content_type AND i.object_id = o.object_id
  WHERE (i.user_id IS NOT NULL) <> coalesce(o.odd, false)"""


oracle("toggle_favorites", _toggled("userfile"))

oracle("favorite_count", f"""
SELECT user_id, content_type, count(*) AS n_favorites FROM ({_toggled('userfile')}) GROUP BY user_id, content_type""")

oracle("polymorphic_join", """
SELECT f.user_id, f.object_id, v.filename FROM v_favorite f JOIN v_file v ON f.object_id = v.file_id
WHERE f.content_type = 'userfile'""")

oracle("sort_favorites_first", f"""
WITH f AS (
  SELECT DISTINCT t.user_id, s.script_id, s.script_name FROM ({_toggled('script')}) t
  JOIN v_script s ON s.script_id = t.object_id WHERE t.content_type = 'script')
SELECT user_id, script_id, 'favorite' AS block,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY script_name, script_id) AS BIGINT) AS position
FROM f
UNION ALL
SELECT CAST(NULL AS BIGINT), script_id, 'all',
       CAST(row_number() OVER (ORDER BY script_name, script_id) AS BIGINT)
FROM v_script""")

oracle("keyword_search", """
SELECT script_id, script_name FROM v_script
WHERE (coalesce(contains(lower(script_name), 'bolt'), false) OR coalesce(contains(lower(description), 'bolt'), false))
  AND (coalesce(contains(lower(script_name), 'economy'), false)
       OR coalesce(contains(lower(description), 'economy'), false))""")

oracle("keyword_search_docs", """
SELECT doc_id FROM documents
WHERE (coalesce(contains(lower(text), 'the and'), false) OR coalesce(contains(lower(source), 'the and'), false))
  AND (coalesce(contains(lower(text), 'of'), false) OR coalesce(contains(lower(source), 'of'), false))""")

oracle("keyword_search_queries", r"""
WITH w AS (SELECT item_id, string_split(trim(regexp_replace(text, '[^\p{L}]+', ' ', 'g')), ' ') AS w FROM benchmark),
q AS (SELECT item_id AS query_id, regexp_replace(trim(coalesce(w[1], '') || ' ' || coalesce(w[2], '')), ' +', ' ', 'g') AS phrase,
             lower(coalesce(w[5], '')) AS a, lower(coalesce(w[8], '')) AS b FROM w),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(coalesce(source, '')) AS s FROM documents)
SELECT query_id, doc_id FROM q JOIN d
  ON (contains(t, lower(phrase)) OR contains(s, lower(phrase))) AND (contains(t, a) OR contains(s, a))
 AND (contains(t, b) OR contains(s, b))""")

oracle("keyword_search_users", """
WITH q AS (SELECT s_suppkey AS query_id, substr(s_name, 12, 7) AS a,
                  CASE s_suppkey % 3 WHEN 0 THEN 'u' WHEN 1 THEN 'ure' ELSE '' END AS b FROM supplier),
u AS (SELECT user_id, lower(username) AS n, lower(user_group) AS g FROM v_user)
SELECT query_id, user_id FROM q JOIN u
  ON (contains(n, a) OR contains(g, a)) AND (contains(n, b) OR contains(g, b))""")
