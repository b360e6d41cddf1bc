"""Least squares in plain SQL: normal equations, elimination, back substitution."""

from __future__ import annotations

from collections.abc import Sequence


def least_squares_sql(
    rows: str, x: Sequence[str], y: Sequence[str], keys: Sequence[str] = (), name: str = "ls"
) -> str:
    """CTEs that end in ``name``: one row per key with columns w_<target>_<i>.
    The inputs must be independent of each other."""
    n, m = len(x), len(y)
    upper = [(i, j) for i in range(n) for j in range(i, n)]
    key = "".join(f"{k}, " for k in keys)
    sums = [f"sum(({x[i]}) * ({x[j]})) AS a_{i}_{j}" for i, j in upper]
    sums += [f"sum(({x[i]}) * ({y[t]})) AS b_{t}_{i}" for t in range(m) for i in range(n)]
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    ctes = [f"{name}_0 AS (SELECT {key}{', '.join(sums)} FROM {rows}{group})"]
    for k in range(n - 1):
        cells = [
            f"a_{i}_{j} - a_{k}_{i} * a_{k}_{j} / a_{k}_{k} AS a_{i}_{j}" if i > k else f"a_{i}_{j}"
            for i, j in upper
        ]
        cells += [
            f"b_{t}_{i} - a_{k}_{i} * b_{t}_{k} / a_{k}_{k} AS b_{t}_{i}" if i > k else f"b_{t}_{i}"
            for t in range(m)
            for i in range(n)
        ]
        ctes.append(f"{name}_{k + 1} AS (SELECT {key}{', '.join(cells)} FROM {name}_{k})")
    last = f"{name}_{n - 1}"
    for k in reversed(range(n)):
        known = {
            t: "".join(f" - a_{k}_{j} * w_{t}_{j}" for j in range(k + 1, n)) for t in range(m)
        }
        cells = [f"(b_{t}_{k}{known[t]}) / a_{k}_{k} AS w_{t}_{k}" for t in range(m)]
        ctes.append(f"{name}_w{k} AS (SELECT *, {', '.join(cells)} FROM {last})")
        last = f"{name}_w{k}"
    weights = ", ".join(f"w_{t}_{i}" for t in range(m) for i in range(n))
    ctes.append(f"{name} AS (SELECT {key}{weights} FROM {last})")
    return ",\n".join(ctes)


def product_sql(x: Sequence[str], target: int) -> str:
    """The forecast of one target, not below 0."""
    terms = " + ".join(f"w_{target}_{i} * ({c})" for i, c in enumerate(x))
    return f"greatest({terms}, 0.0)"
