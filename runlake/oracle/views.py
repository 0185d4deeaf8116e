"""DuckDB twins of the catalog views in ``runlake.sources.tables``.

The driver registers the parquet tables as DuckDB views; every oracle query
starts with the CTEs it needs, built by ``with_views``.
"""

from __future__ import annotations

import re

JSON_K = "json_extract_string(props, '$.k')"


def _acgt(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^ACGT]', '', 'g')"


VIEW_SQL: dict[str, str] = {
    "v_job": f"""
        SELECT event_id AS job_id,
               CAST(CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS BIGINT) AS user_id,
               CAST({JSON_K} AS INTEGER) AS script_id,
               CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'running'
                    WHEN 'click' THEN 'submitted' WHEN 'signup' THEN 'deleted'
                    WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'FAILURE' END END AS status,
               ts AS created_date,
               CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'task-' || CAST(event_id AS VARCHAR) END AS celery_id,
               value AS score
        FROM events""",
    "v_active": """
        SELECT celery_id FROM v_job
        WHERE status = 'running' AND job_id % 3 = 0 AND celery_id IS NOT NULL""",
    "v_job_request": """
        SELECT event_id AS request_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END AS viewer_id,
               CASE WHEN event_id % 13 = 0 THEN -1 - event_id ELSE xor(event_id, event_id % 3) END AS job_id, event_id % 11 = 0 AS by_uuid
        FROM events""",
    "v_status_event": """
        SELECT CAST(floor(job_id / 10) AS BIGINT) AS job_id, job_id % 2 AS attempt, created_date AS ts,
               job_id AS seq, status
        FROM v_job""",
    "v_script": """
        SELECT p_partkey AS script_id, p_name AS script_name, p_brand AS group_name,
               CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS description,
               p_size AS script_order, p_size % 7 <> 0 AS is_active,
               CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'BUILDING' ELSE 'MACHINERY' END AS script_group,
               CASE WHEN p_brand = 'Brand#2' THEN 'BUILDING' ELSE '' END AS parent_group,
               p_brand NOT IN ('Brand#2', 'Brand#7', 'Brand#19') AS group_active
        FROM part""",
    "v_version": """
        SELECT l_partkey * 100000 + l_suppkey AS version_id, l_partkey AS script_id,
               CAST(min(l_linenumber) AS VARCHAR) || '.' || CAST(CAST(floor(max(l_quantity)) AS INTEGER) AS VARCHAR)
                   AS script_version,
               CAST(l_suppkey % 5 + 1 AS INTEGER) AS iteration,
               max(l_returnflag) <> 'R' AS is_active,
               (min(l_linestatus) = 'F' AND l_suppkey % 20 = 0) AS default_version,
               sha1(CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey % 7 AS VARCHAR)) AS checksum,
               min(l_shipdate) AS created_date
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "v_user": """
        SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS user_group,
               c_acctbal > 9000 AS is_staff, c_acctbal > 0 AS is_active
        FROM customer""",
    "v_key": """
        SELECT c_custkey AS key_id, c_custkey AS user_id, sha256(c_name) AS key_hash,
               c_acctbal > -500 AS active
        FROM customer""",
    "v_request": """
        SELECT event_id AS request_id, ts,
               CASE event_id % 4 WHEN 0 THEN 'Basic Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0')
                                 WHEN 1 THEN 'Bearer'
                                 ELSE 'Bearer Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS auth_header
        FROM events""",
    "v_param": """
        SELECT o_orderkey AS job_id, s.pos, s.name, s.form_field, s.short_param, s.collapse,
               CASE s.pos WHEN 0 THEN o_orderstatus
                          WHEN 1 THEN CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END
                          WHEN 2 THEN CAST(o_custkey AS VARCHAR)
                          WHEN 3 THEN CAST(CAST(floor(o_totalprice) - 200000 AS BIGINT) AS VARCHAR)
                          WHEN 4 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'True' END
                          WHEN 5 THEN CAST(o_orderkey % 5 AS VARCHAR)
                          ELSE CAST(o_orderkey % 3 AS VARCHAR) END AS raw
        FROM orders CROSS JOIN (VALUES
            (0, 'status', 'ChoiceField', '--status', true),
            (1, 'priority', 'CharField', '', true),
            (2, 'customer', 'IntegerField', '--customer', true),
            (3, 'total', 'IntegerField', '--total', false),
            (4, 'flag', 'BooleanField', '--flag', true),
            (5, 'total', 'IntegerField', '--total', false),
            (6, 'customer', 'IntegerField', '--customer', true)) AS s(pos, name, form_field, short_param, collapse)""",
    "v_spec": """
        SELECT p_partkey * 10 + s.slot AS param_id, p_partkey AS script_id, s.*,
               p_size % 5 = s.slot AS hidden,
               (s.group_name = 'Numbers' AND p_partkey % 4 = 0) AS group_hidden,
               s.slot AS param_order
        FROM part CROSS JOIN (VALUES
            (0, 'status', 'ChoiceField', '--status', true, true, '["F","O","P"]', 'null', 'Required', ''),
            (1, 'priority', 'CharField', '', true, false, NULL, 'null', 'Optional', ''),
            (2, 'customer', 'IntegerField', '--customer', true, true, NULL, '"+"', 'Required', ''),
            (3, 'total', 'IntegerField', '--total', false, false, NULL, '2', 'Numbers', 'sub'),
            (4, 'flag', 'BooleanField', '--flag', true, false, NULL, 'null', 'Optional', 'sub'))
            AS s(slot, name, form_field, short_param, collapse, required, choices, choice_limit, group_name,
                 parser_name)""",
    "v_job_script": "SELECT o_orderkey AS job_id, o_custkey AS script_id FROM orders",
    "v_file": """
        SELECT doc_id AS file_id, CAST(floor(doc_id / 11) AS BIGINT) AS job_id,
               source || '_' || lang || CASE WHEN doc_id % 13 = 0 THEN '.zip' ELSE '.txt' END AS filename,
               'jobs/' || CAST(CAST(floor(doc_id / 11) AS BIGINT) AS VARCHAR) || '/' || source || '_' || lang
                   || CASE WHEN doc_id % 13 = 0 THEN '.zip' ELSE '.txt' END AS path,
               text AS content, CAST(strlen(text) AS BIGINT) AS size_bytes, sha1(text) AS checksum,
               doc_id % 2 = 0 AS is_output,
               CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'out' END AS param
        FROM documents""",
    "v_user_file": """
        SELECT file_id, job_id, is_output, param FROM v_file
        UNION ALL
        SELECT file_id, job_id + 1 AS job_id, false AS is_output, 'in' AS param
        FROM v_file WHERE file_id % 4 = 0""",
    "v_local": "SELECT file_id, path, size_bytes FROM v_file WHERE file_id % 5 <> 0",
    "v_remote": """
        SELECT file_id, path, CASE WHEN file_id % 7 = 0 THEN CAST(0 AS BIGINT) ELSE size_bytes END AS size_bytes
        FROM v_file WHERE file_id % 3 <> 0""",
    "v_favorite": """
        SELECT CAST(floor(doc_id / 9) AS BIGINT) AS user_id, 'userfile' AS content_type, doc_id AS object_id
        FROM labels WHERE quality = 1""",
    "v_toggle": f"SELECT user_id, CAST({JSON_K} AS INTEGER) AS object_id, ts FROM events",
    "v_chunk": """
        SELECT conv_id AS job_id, turn AS seq,
               CASE WHEN role = 'assistant' THEN 'stdout' ELSE 'stderr' END AS channel, text AS chunk
        FROM conversations""",
    "v_line": """
        SELECT doc_id, CAST(i AS BIGINT) AS line_no, string_split(text, chr(10))[i] AS line
        FROM documents, generate_series(1, len(string_split(text, chr(10)))) AS g(i)""",
    "v_cells": "SELECT doc_id AS file_id, line_no AS row_no, string_split(line, ',') AS cells FROM v_line",
    "v_fasta_line": f"""
        SELECT doc_id AS file_id, line_no,
               CASE WHEN line_no % 4 = 1 THEN '>' || CAST(doc_id AS VARCHAR) || '_' || CAST(line_no AS VARCHAR)
                    ELSE {_acgt('line')} END AS line
        FROM v_line""",
    "v_seq": f"SELECT doc_id AS seq_id, {_acgt('text')} AS seq FROM documents",
    "v_matrix": """
        SELECT l_partkey AS major, l_suppkey AS minor, l_quantity AS c1, l_extendedprice AS c2,
               l_discount AS c3, l_tax AS c4
        FROM lineitem""",
    "v_wide": "SELECT vec_id, label, " + ", ".join(
        f"CAST(embedding[{i + 1}] AS DOUBLE) AS d{i}" for i in range(64)) + " FROM embeddings",
    "v_html": "SELECT page_id, url, html FROM pages",
}

_DEPENDS = {name: [d for d in VIEW_SQL if d != name and re.search(rf"\b{d}\b", sql)]
            for name, sql in VIEW_SQL.items()}


def _closure(names):
    seen: list[str] = []

    def visit(n):
        for d in _DEPENDS[n]:
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(sql: str) -> str:
    """Prefix ``sql`` with CTEs for every ``v_*`` view it mentions."""
    used = [n for n in VIEW_SQL if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in _closure(used))
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
