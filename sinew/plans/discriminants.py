"""SQL of fitted discriminants: class moments, elimination as a recursion, and posteriors."""

from __future__ import annotations


def eliminated(name: str, source: str, size: int, width: int) -> str:
    """``name(g, m)``: Gauss-Jordan elimination of the positive definite left ``size`` columns of each matrix of ``source(g, m)``."""
    pivot = "m[step + 1][step + 1]"
    return f"""{name}_r AS (
  SELECT g, 0 AS step, m FROM {source}
  UNION ALL
  SELECT g, step + 1, list_transform(range(1, {size + 1}), lambda i: CASE WHEN i = step + 1
    THEN list_transform(m[i], lambda x: x / {pivot})
    ELSE list_transform(range(1, {width + 1}), lambda j: m[i][j] - m[i][step + 1] / {pivot} * m[step + 1][j]) END)
  FROM {name}_r WHERE step < {size}),
{name} AS MATERIALIZED (SELECT g, m FROM {name}_r WHERE step = {size})"""


def moments(train: str, size: int) -> str:
    """Class sizes and means, and centred vectors, of ``train(g, label, f)``."""
    return f"""{train}_l AS MATERIALIZED (SELECT g, label, unnest(range(1, {size + 1})) AS a, unnest(f) AS v FROM {train}),
{train}_m AS MATERIALIZED (SELECT g, label, list(mu ORDER BY a) AS mu, any_value(n) AS n FROM
  (SELECT g, label, a, avg(v) AS mu, count(*) AS n FROM {train}_l GROUP BY ALL) GROUP BY ALL),
{train}_d AS MATERIALIZED (SELECT t.g, t.label, list_transform(range(1, {size + 1}), lambda i: t.f[i] - c.mu[i]) AS d
  FROM {train} t JOIN {train}_m c ON c.g = t.g AND c.label = t.label),
{train}_p AS (SELECT unnest(range(1, {size + 1})) AS a)"""


def pooled(train: str, size: int, classes: int) -> str:
    """``{train}_w(g, m)``: the pooled covariance solved for all class means, a column per class in order."""
    return f"""{moments(train, size)},
{train}_c AS MATERIALIZED (SELECT g, x.a, y.a AS b, sum(d[x.a] * d[y.a]) AS s FROM {train}_d, {train}_p x, {train}_p y GROUP BY ALL),
{train}_n AS MATERIALIZED (SELECT g, sum(n) AS n, count(*) AS k FROM {train}_m GROUP BY g),
{train}_u AS MATERIALIZED (SELECT g, list(mu ORDER BY label) AS mu, list(n ORDER BY label) AS n FROM {train}_m GROUP BY g),
{train}_s AS MATERIALIZED (SELECT g, list(row ORDER BY a) AS m FROM (
  SELECT c.g, c.a, list_concat(list(c.s / (t.n - t.k) ORDER BY c.b), any_value(list_transform(u.mu, lambda v: v[c.a]))) AS row
  FROM {train}_c c JOIN {train}_n t ON t.g = c.g JOIN {train}_u u ON u.g = c.g GROUP BY c.g, c.a) GROUP BY g),
{eliminated(f"{train}_w", f"{train}_s", size, size + classes)}"""


def posterior(name: str, train: str, rows: str, size: int, classes: int) -> str:
    """``name``: rows of ``rows(g, …, f)`` with ``p``, the posteriors of the fitted linear discriminant of their g."""
    weight = f"w.m[i][{size} + c]"
    score = (
        f"list_transform(range(1, {classes + 1}), lambda c: list_sum(list_transform(range(1, {size + 1}), lambda i: (x.f[i] - 0.5e0 * u.mu[c][i]) * {weight}))"
        " + ln(u.n[c] / t.n))"
    )
    return f"""{name}_s AS MATERIALIZED (SELECT x.*, {score} AS s FROM {rows} x JOIN {train}_w w ON w.g = x.g JOIN {train}_u u ON u.g = x.g JOIN {train}_n t ON t.g = x.g),
{name}_e AS MATERIALIZED (SELECT *, list_transform(s, lambda v: exp(v - list_max(s))) AS e FROM {name}_s),
{name} AS MATERIALIZED (SELECT * EXCLUDE (s, e), list_transform(e, lambda v: v / list_sum(e)) AS p FROM {name}_e)"""


def quadratic(name: str, train: str, rows: str, size: int, classes: int, reg: float) -> str:
    """``name``: posteriors of classes with covariances of their own, shrunk towards the unit matrix by ``reg``."""
    pivots = f"SELECT g, step, m[step + 1][step + 1] AS p FROM {name}_w_r WHERE step < {size}"
    return f"""{moments(train, size)},
{name}_v AS (SELECT label AS g, x.a, y.a AS b, sum(d[x.a] * d[y.a]) / (count(*) - 1) AS s FROM {train}_d, {train}_p x, {train}_p y GROUP BY ALL),
{name}_c AS MATERIALIZED (SELECT g, a, b, s * (1 - {reg}e0) + CASE WHEN a = b THEN {reg}e0 ELSE 0e0 END AS s FROM {name}_v),
{name}_m AS MATERIALIZED (SELECT g, list(row ORDER BY a) AS m FROM (
  SELECT g, a, list_concat(list(s ORDER BY b), list_transform(range(1, {size + 1}), lambda j: CASE WHEN j = a THEN 1e0 ELSE 0e0 END)) AS row
  FROM {name}_c GROUP BY g, a) GROUP BY g),
{eliminated(f"{name}_w", f"{name}_m", size, 2 * size)},
{name}_d AS MATERIALIZED (SELECT g, sum(ln(p)) AS logdet FROM ({pivots}) GROUP BY g),
{name}_x AS MATERIALIZED (SELECT r.session_id, r.k, r.label, c.label AS class, c.n, list_transform(range(1, {size + 1}), lambda i: r.f[i] - c.mu[i]) AS z FROM {rows} r, {train}_m c),
{name}_q AS MATERIALIZED (SELECT x.session_id, x.k, x.label, x.class,
  ln(x.n / (SELECT sum(n) FROM {train}_m)) - 0.5e0 * (l.logdet + list_sum(list_transform(range(1, {size + 1}), lambda i: x.z[i] * list_sum(list_transform(range(1, {size + 1}), lambda j: w.m[i][{size} + j] * x.z[j]))))) AS s
  FROM {name}_x x JOIN {name}_w w ON w.g = x.class JOIN {name}_d l ON l.g = x.class),
{name}_s AS MATERIALIZED (SELECT session_id, k, label, list(s ORDER BY class) AS s FROM {name}_q GROUP BY ALL),
{name}_e AS MATERIALIZED (SELECT *, list_transform(s, lambda v: exp(v - list_max(s))) AS e FROM {name}_s),
{name} AS MATERIALIZED (SELECT session_id, k, label, list_transform(e, lambda v: v / list_sum(e)) AS p FROM {name}_e)"""
