"""Oracle SQL for the matrix family."""

from runlake.oracle.sql import oracle

_C = ["c1", "c2", "c3", "c4"]
_W = [f"d{i}" for i in range(50)]


def _least_min(cols):
    return "least(" + ", ".join(f"min({c})" for c in cols) + ")"


oracle("matrix_extremes", f"SELECT round({_least_min(_C)}, 6) + 0.0 AS min_value FROM v_matrix")


def _log(cols, src, keys):
    logs = ", ".join(f"CASE WHEN {c} > 0 THEN log2({c}) END AS {c}, {c} = 0 AS z_{c}" for c in cols)
    return f"SELECT {keys}, {logs} FROM {src}"


def _fixed(cols, shift=""):
    return ", ".join(f"round(CASE WHEN z_{c} THEN m.m ELSE l.{c} END{shift}, 6) AS {c}" for c in cols)


oracle("log_normalize", f"""
WITH l AS ({_log(_C, 'v_matrix', 'major, minor')}),
m AS (SELECT {_least_min(_C)} AS m FROM l)
SELECT l.major, l.minor, {_fixed(_C)} FROM l, m""")

oracle("shift_to_zero", f"""
WITH l AS ({_log(_C, 'v_matrix', 'major, minor')}),
m AS (SELECT {_least_min(_C)} AS m FROM l)
SELECT l.major, l.minor, {_fixed(_C, ' + abs(m.m)')} FROM l, m""")

_MULTI = f"""
  SELECT * FROM v_matrix WHERE major IN (
    SELECT major FROM v_matrix GROUP BY major
    HAVING least({', '.join(f'count({c})' for c in _C)}) >= 2)"""

_VAR = f"""
  SELECT major,
    ({' + '.join(f'coalesce(v_{c}, 0)' for c in _C)})
      / nullif({' + '.join(f'CAST(v_{c} IS NOT NULL AS INTEGER)' for c in _C)}, 0) AS variability
  FROM (SELECT major, {', '.join(f'var_samp({c}) AS v_{c}' for c in _C)} FROM multi GROUP BY major)"""

_PAGES = """
  SELECT major, CAST(floor((rk - 1) / 10) AS BIGINT) AS page, CAST(rk AS BIGINT) AS major_rank FROM (
    SELECT major, row_number() OVER (ORDER BY variability DESC NULLS LAST, major) AS rk FROM v) WHERE rk <= 110"""

oracle("major_counts", f"WITH multi AS ({_MULTI}) SELECT major, count(*) AS n_rows FROM multi GROUP BY major")

oracle("major_variability", f"""
WITH multi AS ({_MULTI}), v AS ({_VAR}) SELECT major, round(variability, 2) AS variability FROM v""")

oracle("major_sums", f"""
SELECT major, {', '.join(f'round(sum({c}), 6) AS {c}' for c in _C)} FROM v_matrix GROUP BY major""")

oracle("rank_pages", f"""
WITH multi AS ({_MULTI}), v AS ({_VAR}), p AS ({_PAGES}) SELECT major, page, major_rank FROM p""")

oracle("nested_page", f"""
WITH multi AS ({_MULTI}), v AS ({_VAR}), p AS ({_PAGES})
SELECT p.page, p.major_rank, 0 AS level, m.major, CAST(NULL AS BIGINT) AS minor,
       {', '.join(f'round(sum(m.{c}), 6) AS {c}' for c in _C)}
FROM multi m JOIN p ON m.major = p.major GROUP BY p.page, p.major_rank, m.major
UNION ALL
SELECT p.page, p.major_rank, 1, m.major, m.minor, {', '.join(f'round(m.{c}, 6)' for c in _C)}
FROM multi m JOIN p ON m.major = p.major""")

_PAIRS = [(a, b) for i, a in enumerate(_W) for b in _W[i + 1:]]

oracle("column_distance", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(sqrt(sum(pow({a} - {b}, 2))), 6) AS distance FROM v_wide"
    for a, b in _PAIRS))

oracle("gaussian_curve", """
WITH s AS (SELECT event_type, avg(value) AS mu, abs(stddev_pop(value)) AS sigma FROM events GROUP BY event_type),
p AS (SELECT s.*, CAST(i AS BIGINT) AS i, mu - 4 * sigma + i * (8 * sigma) / 99 AS x
      FROM s, range(0, 100) AS g(i))
SELECT event_type, round(mu, 6) AS mu, round(sigma, 6) AS sigma, i, round(x, 6) AS x,
       round((1 / (sigma * sqrt(2 * pi()))) * exp(-pow(x - mu, 2) / (2 * pow(sigma, 2))), 6) AS y
FROM p""")

oracle("select_columns", "SELECT vec_id, label, d1, d10 FROM v_wide")

oracle("heatmap_table", f"""
WITH l AS ({_log(_W, 'v_wide', 'vec_id')}),
m AS (SELECT {_least_min(_W)} AS m FROM l)
SELECT l.vec_id, {_fixed(_W)} FROM l, m""")
