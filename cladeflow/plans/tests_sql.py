"""SQL of correlation tests and adjusted p-values, which the statistics are held against.

Tails are computed here by other means than in the operators: Student's by the finite sums for whole degrees of freedom, the
normal one by its series, and the null distributions of rank correlations by counting permutations set by set.
"""

from __future__ import annotations

#: Null distributions: of Spearman's sum of squared rank differences up to 9 values, of concordant pairs up to 49.
NULLS = """perm AS (
  SELECT n, 0 AS i, 0 AS mask, 0 AS s, 1::DOUBLE AS c FROM (SELECT unnest(range(2, 10)) AS n)
  UNION ALL
  SELECT n, i + 1, mask | (1 << j), s + (i - j) * (i - j), sum(c) FROM perm, (SELECT unnest(range(0, 9)) AS j) WHERE i < n AND j < n AND mask & (1 << j) = 0 GROUP BY ALL
), prho AS (
  SELECT n, s, sum(c) OVER (PARTITION BY n ORDER BY s DESC) / sum(c) OVER (PARTITION BY n) AS ge, sum(c) OVER (PARTITION BY n ORDER BY s) / sum(c) OVER (PARTITION BY n) AS le
  FROM (SELECT n, s, sum(c) AS c FROM perm WHERE i = n GROUP BY ALL)
), inv AS (
  SELECT 1 AS n, 0 AS q, 1::DOUBLE AS c
  UNION ALL
  SELECT n + 1, q + j, sum(c / (n + 1)) FROM inv, (SELECT unnest(range(0, 49)) AS j) WHERE n < 49 AND j <= n GROUP BY ALL
), ptau AS (
  SELECT n, q, sum(c) OVER (PARTITION BY n ORDER BY q DESC) AS ge, sum(c) OVER (PARTITION BY n ORDER BY q) AS le FROM inv
)"""


def _t_two_sided(r: str, n: str) -> str:
    """Of t = r sqrt((n - 2) / (1 - r^2)) with n - 2 degrees of freedom; the square of the cosine is 1 - r^2."""
    even = f"abs({r}) * coalesce(list_sum(list_transform(range(0, ({n} - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow(1 - {r} * {r}, k))), 0)"
    odd = f"""2 / pi() * (asin(abs({r})) + abs({r}) * sqrt(1 - {r} * {r})
      * coalesce(list_sum(list_transform(range(0, ({n} - 3) // 2), lambda k: exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) * pow(1 - {r} * {r}, k))), 0))"""
    return f"greatest(0, 1 - CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END)"


def _upper(x: str) -> str:
    """P(Z > x)."""
    series = f"list_sum(list_transform(range(0, 160), lambda k: exp((2 * k + 1) * ln(abs({x})) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2))))"
    return f"CASE WHEN {x} = 0 THEN 0.5 WHEN {x} > 8 THEN 0 WHEN {x} < -8 THEN 1 ELSE 0.5 - sign({x}) * exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {series} END"


def _series(s: str) -> str:
    """P(S >= s) of Spearman's S by the published series; ``n`` is a column."""
    x = f"((6 * ({s} - 1) / n / (n * n - 1) - 1) * sqrt(n - 1))"
    return f"""(SELECT least(1, greatest(0, x / n * exp(-y / 2) * (0.2274 + (0.2531 + 0.1745 / n) / n + y * (-0.0758 + (0.1033 + 0.3932 / n) / n
      - y / n * (0.0879 + 0.0151 / n - y * (0.0072 - 0.0831 / n + y / n * (0.0131 - 4.6e-4 * y))))) + {_upper("x")})) FROM (SELECT x, x * x AS y FROM (SELECT {x} AS x)))"""


def _both(x: str, y: str, rows: str) -> str:
    return f"(SELECT *, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM {rows} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"


def spearman(name: str, rows: str, keys: str, x: str, y: str) -> str:
    """CTEs up to ``name``: ``keys``, ``r`` and the two-sided ``p``."""
    rank = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2"
    ties = lambda c: f"count(*) OVER (PARTITION BY {keys}, {c})"
    return f"""{name}_m AS (
  SELECT {keys}, count(*)::BIGINT AS n, max(greatest(ta, tb)) > 1 AS tied, corr(a, b) AS r
  FROM (SELECT {keys}, {rank("x")} AS a, {rank("y")} AS b, {ties("x")} AS ta, {ties("y")} AS tb FROM {_both(x, y, rows)}) GROUP BY {keys}
), {name}_s AS (
  SELECT {keys}, n, tied, r, round((n * n * n - n) * (1 - r) / 6)::BIGINT AS s FROM (SELECT {keys}, n, tied, CASE WHEN n < 2 OR isnan(r) THEN NULL WHEN abs(r) > 1 - 1e-12 THEN sign(r) ELSE r END AS r FROM {name}_m)
), {name} AS (
  SELECT {keys}, r, CASE WHEN r IS NULL THEN NULL WHEN NOT tied AND n <= 9 THEN least(1, 2 * least(e.ge, e.le))
    WHEN NOT tied AND n < 1290 THEN least(1, 2 * CASE WHEN m.s > (n * n * n - n) / 6 THEN {_series("m.s")} ELSE 1 - {_series("(m.s + 2)")} END)
    WHEN n > 2 THEN {_t_two_sided("r", "n")} END AS p
  FROM {name}_s m LEFT JOIN prho e USING (n, s)
)"""


def pearson(name: str, rows: str, keys: str, x: str, y: str) -> str:
    return f"""{name}_m AS (
  SELECT {keys}, n, CASE WHEN n < 2 OR isnan(r) THEN NULL WHEN abs(r) > 1 - 1e-12 THEN sign(r) ELSE r END AS r FROM (SELECT {keys}, count(*)::BIGINT AS n, corr(x, y) AS r FROM {_both(x, y, rows)} GROUP BY {keys})
), {name} AS (
  SELECT {keys}, r, CASE WHEN r IS NOT NULL AND n > 2 THEN {_t_two_sided("r", "n")} END AS p FROM {name}_m
)"""


def kendall(name: str, rows: str, keys: str, x: str, y: str) -> str:
    """By looking at every pair of values of a group."""
    same = " AND ".join(f"a.{k.strip()} IS NOT DISTINCT FROM b.{k.strip()}" for k in keys.split(","))
    tied = lambda c: f"""(SELECT {keys}, sum(t * (t - 1)) AS pairs_{c}, sum(t * (t - 1) * (t - 2)) AS triples_{c}, sum(t * (t - 1) * (2 * t + 5)) AS spread_{c}, max(t) AS most_{c}
    FROM (SELECT {keys}, {c}, count(*)::DOUBLE AS t FROM {name}_v GROUP BY ALL) GROUP BY {keys}) AS of_{c}"""  # noqa: E731
    on = lambda c: " AND ".join(f"d.{k.strip()} IS NOT DISTINCT FROM of_{c}.{k.strip()}" for k in keys.split(","))
    shown = ", ".join(f"d.{k.strip()}" for k in keys.split(","))
    return f"""{name}_v AS (
  SELECT {keys}, x, y, row_number() OVER () AS i FROM {_both(x, y, rows)}
), {name}_d AS (
  SELECT {keys}, count(*)::DOUBLE AS n FROM {name}_v GROUP BY {keys}
), {name}_p AS (
  SELECT {", ".join(f"a.{k.strip()}" for k in keys.split(","))}, sum(sign(a.x - b.x) * sign(a.y - b.y))::DOUBLE AS s FROM {name}_v a JOIN {name}_v b ON {same} AND a.i < b.i GROUP BY ALL
), {name}_m AS (
  SELECT {shown}, n, coalesce(s, 0) AS s, greatest(most_x, most_y) > 1 AS tied, (n * (n - 1) * (2 * n + 5) - spread_x - spread_y) / 18 + pairs_x * pairs_y / (2 * n * (n - 1))
    + CASE WHEN n > 2 THEN triples_x * triples_y / (9 * n * (n - 1) * (n - 2)) ELSE 0 END AS var,
    CASE WHEN n >= 2 AND n * (n - 1) > pairs_x AND n * (n - 1) > pairs_y THEN 2 * s / sqrt((n * (n - 1) - pairs_x) * (n * (n - 1) - pairs_y)) END AS r
  FROM {name}_d d JOIN {tied("x")} ON {on("x")} JOIN {tied("y")} ON {on("y")} LEFT JOIN {name}_p AS of_p ON {on("p")}
), {name}_z AS (
  SELECT *, round((r + 1) * n * (n - 1) / 4)::BIGINT AS q, CASE WHEN r IS NOT NULL THEN s / sqrt(var) END AS z FROM {name}_m
), {name} AS (
  SELECT {keys}, r, CASE WHEN r IS NULL THEN NULL WHEN m.n < 50 AND NOT tied THEN least(1, 2 * least(e.ge, e.le)) ELSE least(1, 2 * (SELECT least(u, 1 - u) FROM (SELECT {_upper("z")} AS u))) END AS p
  FROM {name}_z m LEFT JOIN ptau e ON e.n = m.n AND e.q = m.q
)"""


def adjusted(p: str, by: str, method: str) -> str:
    """Window expression of BH or BY by ``by``, over rows numbered ``i`` of ``n`` in order of ``p``."""
    scale = " * list_sum(list_transform(range(1, n + 1), lambda k: 1 / k))" if method == "BY" else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"least(1, min({p} * n / i{scale}) OVER ({part}ORDER BY i DESC ROWS UNBOUNDED PRECEDING))"
