"""SQL of the shared inputs: observations, baseline, metric streams, and the ordered fold of change-point tests."""

from __future__ import annotations

OBS = """
e AS MATERIALIZED (
  SELECT vec_id, label, vec_id // 25 AS step, vec_id % 25 AS sample, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z
  FROM embeddings WHERE embedding IS NOT NULL),
cut AS (SELECT 0.6 * count(*) AS c FROM e)"""

OUT = OBS + """,
cen AS (
  SELECT label, list(m ORDER BY d) AS c
  FROM (SELECT label, d, avg(z[d]) AS m FROM e, range(1, 65) r(d) WHERE vec_id < (SELECT c FROM cut) GROUP BY label, d) GROUP BY label),
lg AS (SELECT vec_id, list(100 * list_dot_product(z, c) ORDER BY cen.label) AS l FROM e, cen GROUP BY vec_id),
ex AS (SELECT vec_id, list_transform(l, lambda x: exp(x - list_max(l))) AS x FROM lg),
dist AS (SELECT vec_id, list_transform(x, lambda y: y / list_sum(x)) AS p FROM ex),
pb AS MATERIALIZED (
  SELECT e.*, p, greatest(0, -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-12))))) AS h FROM e JOIN dist USING (vec_id)),
base AS (SELECT * FROM pb WHERE vec_id < (SELECT c FROM cut)),
q0 AS (SELECT c AS class, avg(p[c + 1]) AS q FROM base, range(0, 10) r(c) GROUP BY c),
q AS (SELECT class, q / (SELECT sum(q) FROM q0) AS q FROM q0)"""

BINS = 16
HIST = OUT + f""",
edge AS (SELECT CAST(i AS INTEGER) AS i, i * ln(10) / {BINS} AS e FROM range(0, {BINS + 1}) r(i)),
hist AS (
  SELECT CAST(r.b AS INTEGER) AS bin, count(h) AS n FROM range(0, {BINS}) r(b)
  LEFT JOIN base ON least(CAST(floor(least(greatest(h, 0), ln(10)) / (ln(10) / {BINS})) AS INTEGER), {BINS - 1}) = r.b GROUP BY r.b)"""

COV = OUT + """,
mu AS (SELECT list(m ORDER BY d) AS mu FROM (SELECT d, avg(z[d]) AS m FROM base, range(1, 65) r(d) GROUP BY d)),
cov AS MATERIALIZED (SELECT i, j, covar_samp(z[i], z[j]) AS c FROM base, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j),
lam AS (SELECT 1e-4 * max(c) AS l FROM cov WHERE i = j),
aug AS (
  SELECT list(r ORDER BY i) AS m FROM (
    SELECT i, list_concat(list(c + CASE WHEN i = j THEN l ELSE 0 END ORDER BY j), list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0 END ORDER BY j)) AS r
    FROM cov, lam GROUP BY i)),
gj AS (
  SELECT 1 AS k, m FROM aug
  UNION ALL
  SELECT k + 1, list_transform(range(1, 65), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda x: x / m[k][k])
    ELSE list_transform(range(1, 129), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END)
  FROM gj WHERE k <= 64),
prec AS MATERIALIZED (SELECT list_transform(range(1, 65), lambda i: m[i][65:128]) AS p FROM gj WHERE k = 65),
mah AS MATERIALIZED (
  SELECT vec_id, step, sqrt(greatest(0, list_dot_product(list_transform(prec.p, lambda r: list_dot_product(r, d)), d))) AS distance
  FROM (SELECT vec_id, step, list_transform(list_zip(z, mu), lambda t: t[1] - t[2]) AS d FROM pb, mu), prec)"""


def stream(seconds: int = 21_600) -> str:
    return f"""
ev AS (
  SELECT event_type AS metric, CAST(floor(epoch(ts) / {seconds}) AS BIGINT) AS bucket, avg(value) AS mean, count(*) AS n
  FROM events GROUP BY ALL),
st AS MATERIALIZED (
  SELECT metric, bucket - (SELECT min(bucket) FROM ev) AS step, CASE WHEN n % 17 = 0 THEN CAST('nan' AS DOUBLE) ELSE mean END AS value FROM ev)"""


def fold(method: str, threshold: str, delta: str, debounce: int = 1, cooldown: int = 0, target: str | None = None, source: str = "st") -> str:
    """CTEs ``x`` and ``f``: every finite value of ``source`` with statistic and alarm."""
    page = method == "page_hinkley"
    total = f"c + x1 - m1 - ({delta})" if page else f"greatest(0, c + x1 - {target or 'm1'} - ({delta}))"
    stat = "c1 - least(mn, c1)" if page else "c1"
    return f"""
x AS (SELECT metric, step, value, row_number() OVER (PARTITION BY metric ORDER BY step) AS k FROM {source} WHERE isfinite(value)),
f AS (
  SELECT metric, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS step, 0::DOUBLE AS value, 0::DOUBLE AS n, 0::DOUBLE AS m, 0::DOUBLE AS c,
    0::DOUBLE AS mn, 0 AS run, 0 AS cool, 0::DOUBLE AS statistic, false AS alarm FROM (SELECT DISTINCT metric FROM x)
  UNION ALL
  SELECT metric, k1, step1, x1, {'CASE WHEN fired THEN 0 ELSE n1 END' if page else 'n1'}, {'CASE WHEN fired THEN 0 ELSE m1 END' if page else 'm1'},
    CASE WHEN fired THEN 0 ELSE c1 END, {'CASE WHEN fired THEN 0 ELSE least(mn, c1) END' if page else '0'},
    CASE WHEN fired THEN 0 ELSE run1 END, CASE WHEN fired THEN {cooldown} WHEN cool > 0 THEN cool - 1 ELSE 0 END, stat, fired
  FROM (
    SELECT *, cool = 0 AND run1 >= {debounce} AS fired FROM (
      SELECT *, CASE WHEN cool > 0 THEN 0 WHEN stat > ({threshold}) THEN run + 1 ELSE 0 END AS run1 FROM (
        SELECT *, {stat} AS stat FROM (
          SELECT *, {total} AS c1 FROM (
            SELECT f.metric, x.k AS k1, x.step AS step1, x.value AS x1, n + 1 AS n1, m + (x.value - m) / (n + 1) AS m1, c, mn, run, cool
            FROM f JOIN x ON f.metric = x.metric AND x.k = f.k + 1))))))"""
