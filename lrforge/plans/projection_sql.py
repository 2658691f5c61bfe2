"""The projection onto coherent ratios as a recursive query for DuckDB: damped Newton steps over lists, a row a finding."""

from __future__ import annotations

STEPS, RIDGE = 60, 1e-6


def _each(body: str, n: str = "n") -> str:
    return f"list_transform(range(1, {n} + 1), lambda i: {body})"


def _dot(a: str, b: str) -> str:
    return f"list_sum({_each(f'd[i] * {a}[i] * {b}[i]')})"


def _objective(r: str, s: str) -> str:
    return f"0.5 * list_sum(list_transform({r}, lambda x: x * x)) + {RIDGE / 2} * list_sum(list_transform({s}, lambda x: x * x))"


RESIDUAL = "ln({q}[i]) - ln(1 - {q}[i]) - goal[i]"
SHARES = "list_transform({e}, lambda x: x / list_sum({e}))"

#: After ratios: vec has the vectors of a finding, fin the fitted ones with posterior q, residuals r and the objective before (v0) and after (v).
PROJECTED_SQL = f"""
vec AS (SELECT scenario_id, finding, list(category ORDER BY category_order) AS cats, list(prior ORDER BY category_order) AS pr, list(raw ORDER BY category_order) AS lam, count(*) AS n
  FROM ratios GROUP BY scenario_id, finding),
fix AS (SELECT *, {_each("ln(p[i]) - ln(1 - p[i]) + ln(lam[i])")} AS goal, list_position(list_transform(p, lambda x: x >= list_max(p) * (1 - 1e-9)), true) AS base FROM (SELECT *, list_transform(pr, lambda x: x / list_sum(pr)) AS p FROM vec)),
start0 AS (SELECT *, {_each("-ln(1 + exp(-goal[i])) - ln(p[i])")} AS t FROM fix),
start1 AS (SELECT *, {_each("t[i] - t[base]")} AS s FROM start0),
start2 AS (SELECT *, {_each("exp(s[i]) * p[i]")} AS e FROM start1),
start3 AS (SELECT *, {SHARES.format(e="e")} AS q FROM start2),
start4 AS (SELECT *, {_each(RESIDUAL.format(q="q"))} AS r FROM start3),
sol AS (
  SELECT scenario_id, finding, 0 AS step, s, q, r, {_objective("r", "s")} AS v, 1.0::DOUBLE AS mu FROM start4
  UNION ALL
  SELECT scenario_id, finding, step + 1, CASE WHEN ok THEN s2 ELSE s END, CASE WHEN ok THEN q2 ELSE q END, CASE WHEN ok THEN r2 ELSE r END, CASE WHEN ok THEN v2 ELSE v END, CASE WHEN ok THEN greatest(mu / 10, 1e-12) ELSE mu * 10 END
  FROM (SELECT *, v2 <= v * (1 + 1e-14) AS ok FROM (
    SELECT *, {_objective("r2", "s2")} AS v2 FROM (
    SELECT *, {_each(RESIDUAL.format(q="q2"))} AS r2 FROM (
    SELECT *, {SHARES.format(e="e2")} AS q2 FROM (
    SELECT *, {_each("exp(s2[i]) * p[i]")} AS e2 FROM (
    SELECT *, {_each("s[i] + least(greatest(m[i], -5), 5)")} AS s2 FROM (
    SELECT *, {_each("d[i] * (b[i] * (qq * bg - (bq - 1) * qg) / det + q[i] * ((bb - sb - sc) * qg - (bq - 1) * bg) / det - g[i])")} AS m FROM (
    SELECT *, (bb - sb - sc) * qq - (bq - 1) * (bq - 1) AS det FROM (
    SELECT *, {_dot("b", "b")} AS bb, {_dot("b", "q")} AS bq, {_dot("q", "q")} AS qq, {_dot("b", "g")} AS bg, {_dot("q", "g")} AS qg FROM (
    SELECT *, {_each(f"CASE WHEN i = base THEN 0 ELSE c[i] - q[i] * sc + {RIDGE} * s[i] END")} AS g, {_each(f"CASE WHEN i = base THEN 0 ELSE 1 / (b[i] - q[i] * sc + {RIDGE} + mu) END")} AS d FROM (
    SELECT *, list_sum(b) AS sb, list_sum(c) AS sc FROM (
    SELECT *, {_each("r[i] / (1 - q[i])")} AS c, {_each("(1 + r[i] * q[i]) / (1 - q[i]) / (1 - q[i])")} AS b FROM sol JOIN fix USING (scenario_id, finding) WHERE step < {STEPS})))))))))))) ),
fin AS (
  SELECT x.scenario_id, x.finding, cats, pr, lam, n, x.q, x.r, x.s, x.v, a.v AS v0, {_each("exp(x.r[i] + ln(lam[i]))")} AS fit, {_each("1 / (1 + exp(-goal[i]))")} AS q0
  FROM sol x JOIN sol a ON a.scenario_id = x.scenario_id AND a.finding = x.finding AND a.step = 0 JOIN fix f ON f.scenario_id = x.scenario_id AND f.finding = x.finding WHERE x.step = {STEPS}),
flat AS (SELECT scenario_id, finding, unnest(range(1, n + 1)) AS i, * EXCLUDE (scenario_id, finding) FROM fin)
"""
