"""DuckDB SQL twins of the queries of this subpackage that SQL can express.

The classifiers, tokenizers, hashes and seeded draws of the others have no SQL
form; tests hold those queries against brute force or held-out labels.
"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": rf"""
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
                   FROM pages),
        r AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS raw FROM u),
        h AS (SELECT page_id, translate(raw, {_LOWER}) AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^([^?#]*)', 1) AS path FROM r),
        m AS (SELECT *, '.' || host AS dotted FROM h),
        j AS (SELECT page_id, host, path,
            CASE WHEN ends_with(dotted, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN ends_with(dotted, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN ends_with(dotted, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN ends_with(dotted, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN ends_with(dotted, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule,
            nullif(regexp_extract(dotted,
                '\.((ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.example\.(com|net|org))$', 1), '') AS listed
            FROM m)
        SELECT page_id, host, path, rule,
            CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                 WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, listed
        FROM j""",
    "op5_preference_pairs": r"""
        WITH t AS (SELECT conv_id AS pair_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS said
                   FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
        l AS (SELECT pair_id, max(turn) AS turn FROM t WHERE said.role = 'assistant' GROUP BY 1),
        a AS (SELECT pair_id, turn, said.text AS text FROM t JOIN l USING (pair_id, turn)),
        o AS (SELECT pair_id, turn, coalesce(lead(text) OVER (ORDER BY pair_id),
                                             first_value(text) OVER (ORDER BY pair_id)) AS other FROM a),
        x AS (SELECT t.pair_id, t.turn, said.role AS role, said.text AS yes,
                     CASE WHEN t.turn = o.turn THEN other ELSE said.text END AS no
              FROM t JOIN o ON t.pair_id = o.pair_id),
        f AS (SELECT pair_id, min(CASE WHEN yes <> no THEN turn END) AS first FROM x GROUP BY 1),
        p AS (SELECT pair_id, 'prompt' AS part, turn, role, yes AS text FROM x JOIN f USING (pair_id)
              WHERE first IS NULL OR turn < first
              UNION ALL SELECT pair_id, 'chosen', turn, role, yes FROM x JOIN f USING (pair_id) WHERE turn >= first
              UNION ALL SELECT pair_id, 'rejected', turn, role, no FROM x JOIN f USING (pair_id) WHERE turn >= first),
        s AS (SELECT pair_id, part, turn, role,
                     '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment FROM p)
        SELECT pair_id, part, turn, role, segment,
            CAST(coalesce(sum(length(segment)) OVER (PARTITION BY pair_id, part ORDER BY turn
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
            part <> 'prompt' AND role = 'assistant' AS trained
        FROM s""",
    "op10_minhash_neardup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                                 '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5
                  THEN [array_to_string(ws, ' ')]
                  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
              GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
              WHERE 100 * i >= 75 * (nx.n + ny.n - i)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
        FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op12_dual_tree_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                       {_TERM}) AS ts FROM documents),
        i AS (SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
                       {_TERM})) AS t FROM benchmark),
        q AS (SELECT k, item_id, t, count(*) AS c FROM i GROUP BY ALL),
        g AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS words FROM d WHERE len(ts) > 0),
        f AS (SELECT k, doc_id, len(ts) AS n, unnest(ts) AS t FROM d),
        v AS (SELECT k, doc_id, t, any_value(n) AS n, count(*) AS tf FROM f WHERE t IN (SELECT t FROM q) GROUP BY ALL),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM v, g GROUP BY t),
        s AS (SELECT q.k AS ik, q.item_id, v.k AS dk, v.doc_id, CAST(sum(q.c * w.w * ((1000000000 * v.tf) // (1000 * v.tf + 12 * (75 + (25 * v.n * g.docs) // g.words)))) AS BIGINT) AS score
              FROM q JOIN v USING (t) JOIN w USING (t), g GROUP BY ALL),
        r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY ik ORDER BY score DESC, doc_id, dk) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20""",
}
