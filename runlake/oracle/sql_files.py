"""Oracle SQL for the file inventory family."""

from runlake.oracle.sql import oracle

# text rules of the type test: fasta within the first 30 lines (no images in text files)
_TYPED = r"""
  SELECT f.file_id, f.path, f.size_bytes,
    CASE WHEN fa.file_id IS NOT NULL THEN 'fasta' END AS filetype
  FROM v_file f LEFT JOIN (
    SELECT file_id FROM (
      SELECT f2.file_id, g.i AS line_no, string_split(f2.content, chr(10))[g.i] AS line
      FROM v_file f2, generate_series(1, least(30, len(string_split(f2.content, chr(10))))) AS g(i)) x
    WHERE regexp_matches(line, '\S')
    GROUP BY file_id
    HAVING min(line_no) FILTER (WHERE line LIKE '>%') = min(line_no) FILTER (WHERE line NOT LIKE ';%')
       AND max(line_no) FILTER (WHERE line NOT LIKE '>%') > min(line_no) FILTER (WHERE line LIKE '>%')
  ) fa ON fa.file_id = f.file_id"""

_GROUP = """CASE WHEN ends_with(path, '.tar.gz') OR ends_with(path, '.zip') THEN 'archives'
                 ELSE coalesce(filetype, 'all') END"""

oracle("classify_files", r"""
WITH c AS (SELECT file_id, CASE WHEN file_id % 3 = 0 THEN content ELSE regexp_replace(
             regexp_replace(content, '[,\t"]', ' ', 'g'), '(?m)^([^ \n]+) ?',
             CASE WHEN file_id % 3 = 1 THEN '\1,"a, ""b"" c",' ELSE '\1' || chr(9) || 'x' || chr(9) END, 'g') END AS content FROM v_file),
l AS (SELECT file_id, i AS line_no, string_split(content, chr(10))[i] AS line
      FROM c, generate_series(1, least(30, len(string_split(content, chr(10))))) AS g(i)),
fa AS (SELECT file_id FROM l WHERE regexp_matches(line, '\S') GROUP BY file_id
       HAVING min(line_no) FILTER (WHERE line LIKE '>%') = min(line_no) FILTER (WHERE line NOT LIKE ';%')
          AND max(line_no) FILTER (WHERE line NOT LIKE '>%') > min(line_no) FILTER (WHERE line LIKE '>%')),
h AS (SELECT file_id, length(content) <= 16384 AS whole,
             string_split(regexp_replace(substr(content, 1, 16384), '(^|[,\t\n])"(?:[^"]|"")*(?:"|$)', '\1', 'g'), chr(10)) AS ls
      FROM c WHERE file_id NOT IN (SELECT file_id FROM fa)),
k AS (SELECT file_id, unnest(CASE WHEN whole OR len(ls) = 1 THEN ls ELSE ls[1:len(ls) - 1] END) AS line FROM h),
n AS (SELECT file_id, d.k, d.d, length(line) - length(replace(line, d.d, '')) AS cells
      FROM k CROSS JOIN (VALUES (0, ','), (-1, chr(9))) AS d(k, d) WHERE rtrim(line, chr(13)) <> ''),
a AS (SELECT file_id, k, d, cells, count(*) AS lines, sum(count(*)) OVER (PARTITION BY file_id, k, d) AS total
      FROM n GROUP BY file_id, k, d, cells),
b AS (SELECT file_id, d, row_number() OVER (PARTITION BY file_id ORDER BY lines DESC, cells DESC, k DESC) AS r
      FROM (SELECT *, row_number() OVER (PARTITION BY file_id, k ORDER BY lines DESC, cells DESC) AS best FROM a WHERE cells > 0)
      WHERE best = 1 AND lines >= 0.9 * total)
SELECT c.file_id, CASE WHEN fa.file_id IS NOT NULL THEN 'fasta' WHEN b.d IS NOT NULL THEN 'tabular' END AS filetype,
       b.d AS delimiter
FROM c LEFT JOIN fa ON fa.file_id = c.file_id LEFT JOIN b ON b.file_id = c.file_id AND b.r = 1""")

oracle("classify_group", f"""
WITH t AS ({_TYPED}),
g AS (SELECT file_id, size_bytes, {_GROUP} AS grp FROM t),
e AS (SELECT file_id, size_bytes, grp AS "group" FROM g
      UNION ALL SELECT file_id, size_bytes, 'all' FROM g WHERE grp <> 'all')
SELECT "group", count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM e GROUP BY "group" """)

oracle("ungrouped_files", f"""
WITH t AS ({_TYPED}) SELECT file_id, path FROM t WHERE {_GROUP} = 'all'""")

oracle("file_previews", f"""
WITH t AS ({_TYPED}),
u AS (
  SELECT uf.job_id, uf.file_id, f.filename AS name, uf.param AS slug, f.size_bytes,
         CASE WHEN ends_with(t.path, '.tar.gz') OR ends_with(t.path, '.zip') THEN 'archives'
              ELSE coalesce(t.filetype, 'all') END AS grp
  FROM v_user_file uf JOIN v_file f ON uf.file_id = f.file_id JOIN t ON t.file_id = uf.file_id)
SELECT job_id, file_id, name, slug, size_bytes, grp AS "group" FROM u
UNION ALL SELECT job_id, file_id, name, slug, size_bytes, 'all' FROM u WHERE grp <> 'all'""")

oracle("preview_head_tail", """
WITH n AS (SELECT file_id, max(row_no) AS n FROM v_cells GROUP BY file_id)
SELECT c.file_id,
       CAST(CASE WHEN n.n > 10 AND c.row_no > 5 THEN c.row_no - n.n + 11 ELSE c.row_no END AS BIGINT) AS slot,
       CAST(c.row_no AS BIGINT) AS row_no, array_to_string(c.cells, ',') AS cells
FROM v_cells c JOIN n ON c.file_id = n.file_id
WHERE n.n <= 10 OR c.row_no <= 5 OR c.row_no > n.n - 5
UNION ALL
SELECT file_id, CAST(6 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM n WHERE n > 10""")

oracle("preview_fasta", r"""
WITH h AS (SELECT * FROM v_fasta_line WHERE line_no <= 30 AND regexp_matches(line, '\S')),
i AS (
  SELECT file_id, min(line_no) FILTER (WHERE line LIKE '>%') AS caret,
         min(line_no) FILTER (WHERE line NOT LIKE '>%' AND line NOT LIKE ';%') AS bad
  FROM h GROUP BY file_id),
b AS (
  SELECT h.* FROM h JOIN i ON h.file_id = i.file_id
  WHERE i.caret IS NOT NULL AND (i.bad IS NULL OR i.bad > i.caret) AND h.line_no >= i.caret),
r AS (
  SELECT *, sum(CASE WHEN line LIKE '>%' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS rec
  FROM b),
recs AS (
  SELECT file_id, rec, min(line_no) AS pos,
         arg_min(line, line_no) AS header,
         coalesce(string_agg(CASE WHEN line NOT LIKE '>%' THEN line END, '' ORDER BY line_no), '') AS seq
  FROM r GROUP BY file_id, rec),
per AS (
  SELECT file_id, header, arg_max(seq, pos) AS seq, min(pos) AS first FROM recs WHERE seq <> ''
  GROUP BY file_id, header)
SELECT file_id, header, seq,
       CAST(row_number() OVER (PARTITION BY file_id ORDER BY first) AS BIGINT) AS rec_order
FROM per""")

oracle("record_number", """
SELECT file_id, line_no,
       CAST(sum(CASE WHEN line LIKE '>%' THEN 1 ELSE 0 END)
            OVER (PARTITION BY file_id ORDER BY line_no) AS BIGINT) AS rec_no
FROM v_fasta_line""")

oracle("first_per_checksum", """
SELECT file_id, checksum, min(file_id) OVER (PARTITION BY checksum) AS keeper_id,
       file_id <> min(file_id) OVER (PARTITION BY checksum) AS to_delete
FROM v_file WHERE NOT is_output""")

oracle("match_or_insert", """
WITH s AS (SELECT * FROM v_file WHERE is_output),
n AS (SELECT * FROM v_file WHERE NOT is_output),
ex AS (SELECT checksum, min(file_id) AS existing_id FROM s GROUP BY checksum),
fresh AS (
  SELECT checksum, (SELECT coalesce(max(file_id), 0) FROM s) + row_number() OVER (ORDER BY checksum) AS new_id
  FROM (SELECT DISTINCT checksum FROM n WHERE checksum NOT IN (SELECT checksum FROM ex)))
SELECT n.file_id AS upload_id, n.checksum, coalesce(ex.existing_id, fresh.new_id) AS stored_id,
       ex.existing_id IS NULL AS created
FROM n LEFT JOIN ex ON n.checksum = ex.checksum LEFT JOIN fresh ON n.checksum = fresh.checksum""")

oracle("unreferenced_files", """
WITH p AS (
  SELECT * FROM v_user_file
  WHERE job_id IN (SELECT job_id FROM v_job WHERE status = 'deleted') AND (param IS NULL OR is_output))
SELECT p.file_id, p.job_id, true AS drop_ref,
       NOT EXISTS (SELECT 1 FROM v_user_file o WHERE o.file_id = p.file_id
                   AND o.job_id NOT IN (SELECT job_id FROM v_job WHERE status = 'deleted')) AS drop_file
FROM p""")

oracle("sync_plan", """
SELECT l.file_id, l.path,
       CASE WHEN r.path IS NULL THEN 'upload' WHEN r.size_bytes = 0 THEN 'replace'
            WHEN r.size_bytes <> l.size_bytes THEN 'upload_variant' ELSE 'skip' END AS action
FROM v_local l
LEFT JOIN (SELECT path, arg_max(size_bytes, file_id) AS size_bytes FROM v_remote GROUP BY path) r ON l.path = r.path""")

oracle("storage_diff", """
WITH c AS (SELECT path, arg_max(checksum, file_id) AS checksum FROM v_file GROUP BY path),
l AS (
  SELECT l.path,
         arg_max(CASE WHEN l.file_id % 7 = 0 THEN sha1(f.content || 'x') ELSE f.checksum END, l.file_id) AS checksum
  FROM v_local l JOIN v_file f ON l.file_id = f.file_id GROUP BY l.path)
SELECT c.path,
       CASE WHEN l.checksum IS NULL THEN 'fetch' WHEN l.checksum <> c.checksum THEN 'stale' ELSE 'ok' END AS action
FROM c LEFT JOIN l ON c.path = l.path""")

oracle("write_content_addressed", """
WITH f AS (SELECT checksum, arg_min(filename, file_id) AS filename FROM v_file GROUP BY checksum)
SELECT checksum,
       'job_files/' || substr(checksum, 1, 2) || '/' || substr(checksum, -2, 2) || '/' || checksum || '/'
           || filename AS stored_path,
       substr(checksum, 1, 2) AS prefix, substr(checksum, -2, 2) AS suffix
FROM f""")

oracle("bundle_manifest", """
WITH jn AS (
  SELECT DISTINCT job_id, CASE WHEN job_id % 10 = 0 THEN 'src0_en' ELSE 'job-' || CAST(job_id AS VARCHAR) END
      AS job_name FROM v_user_file),
f AS (
  SELECT uf.job_id, jn.job_name, f.filename, f.size_bytes
  FROM v_user_file uf JOIN v_file f ON uf.file_id = f.file_id JOIN jn ON jn.job_id = uf.job_id
  WHERE uf.is_output AND f.filename NOT IN (jn.job_name || '.tar.gz', jn.job_name || '.zip'))
SELECT job_id, job_name || '/' || filename AS entry, size_bytes FROM f
UNION ALL
SELECT job_id, job_name || '/', CAST(0 AS BIGINT) FROM jn WHERE job_id IN (SELECT job_id FROM f)""")

oracle("unlisted_outputs", """
WITH k AS (
  SELECT '/srv/media/' || f.path AS known_path FROM v_user_file uf JOIN v_file f ON uf.file_id = f.file_id
  WHERE uf.param = 'out')
SELECT file_id, path FROM v_file f
WHERE NOT EXISTS (SELECT 1 FROM k WHERE ends_with(k.known_path, f.path))""")

oracle("distinct_by_name", """
SELECT job_id, filename, min(file_id) AS file_id FROM v_file GROUP BY job_id, filename""")

oracle("available_name", """
WITH ex AS (
  SELECT job_id AS folder, string_split(filename, '_')[1] AS name,
         CASE WHEN file_id % 3 = 0 THEN 0 ELSE file_id % 3 END AS idx
  FROM v_file),
req AS (SELECT DISTINCT job_id AS folder, string_split(filename, '_')[1] AS name FROM v_file),
k AS (
  SELECT r.folder, r.name,
         (SELECT min(x) FROM generate_series(0, 10) AS g(x)
          WHERE x NOT IN (SELECT idx FROM ex WHERE ex.folder = r.folder AND ex.name = r.name)) AS k
  FROM req r)
SELECT folder, name, 'txt' AS ext,
       CASE WHEN k = 0 THEN name || '.txt' ELSE name || '_' || CAST(k AS VARCHAR) || '.txt' END AS available
FROM k""")

_NORMALIZE = """CASE WHEN trim(ref) = '' OR ref IS NULL OR starts_with(replace(trim(ref), chr(92), '/'), '/') THEN NULL
  ELSE (SELECT CASE WHEN s.bad THEN NULL ELSE array_to_string(s.st, '/') END FROM (SELECT list_reduce(
      list_filter(string_split(replace(trim(ref), chr(92), '/'), '/'), lambda x: x <> '' AND x <> '.'),
      lambda acc, x: CASE WHEN x = '..'
                          THEN {'st': CASE WHEN len(acc.st) > 0 THEN acc.st[1:len(acc.st) - 1] ELSE acc.st END,
                                'bad': acc.bad OR len(acc.st) = 0}
                          ELSE {'st': list_append(acc.st, x), 'bad': acc.bad} END,
      {'st': []::VARCHAR[], 'bad': false}) AS s)) END"""

oracle("resolve_file_ref", f"""
WITH refs AS (
  SELECT file_id AS ref_id, CAST(floor(file_id / 7) AS BIGINT) AS viewer_id,
         CASE file_id % 6 WHEN 0 THEN path WHEN 1 THEN '  ' || replace(path, '/', chr(92)) || ' '
                          WHEN 2 THEN '../' || path WHEN 3 THEN path || '/../x' WHEN 4 THEN ''
                          ELSE './' || CAST(job_id AS VARCHAR) || '//' || filename END AS ref
  FROM v_file),
r AS (
  SELECT *, trim(ref) AS raw, replace(trim(ref), chr(92), '/') AS slash,
         string_split(replace(trim(ref), chr(92), '/'), '/')[-1] AS base, {_NORMALIZE} AS norm
  FROM refs),
cand AS (
  SELECT f.path, f.filename, j.user_id AS owner_id
  FROM v_user_file uf JOIN v_file f ON uf.file_id = f.file_id LEFT JOIN v_job j ON uf.job_id = j.job_id),
m AS (
  SELECT r.ref_id, r.viewer_id, c.path, c.owner_id, 0 AS rule FROM r JOIN cand c ON c.path = r.norm AND c.filename = r.base
  UNION ALL
  SELECT r.ref_id, r.viewer_id, c.path, c.owner_id, 1 FROM r JOIN cand c ON c.path = r.raw AND c.filename = r.base
  UNION ALL
  SELECT r.ref_id, r.viewer_id, c.path, c.owner_id, 1 FROM r JOIN cand c ON c.path = r.slash AND c.filename = r.base),
b AS (SELECT ref_id, min(rule) AS best FROM m GROUP BY ref_id),
mm AS (SELECT m.* FROM m JOIN b ON m.ref_id = b.ref_id AND m.rule = b.best),
a AS (
  SELECT ref_id, bool_or(owner_id IS NULL OR (viewer_id IS NOT NULL AND owner_id = viewer_id)) AS anyvis,
         min(path) AS path
  FROM mm GROUP BY ref_id)
SELECT refs.ref_id,
       CASE WHEN a.anyvis IS NULL THEN 'not found' WHEN NOT a.anyvis THEN 'not permitted' ELSE 'found' END AS outcome,
       CASE WHEN a.anyvis THEN a.path END AS path
FROM refs LEFT JOIN a ON refs.ref_id = a.ref_id""")
