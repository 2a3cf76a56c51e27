"""Pieces of SQL for DuckDB that the oracles are built of: tail probabilities in closed form, and least squares by sweeping."""

from __future__ import annotations

import math
from collections.abc import Iterable

_DENSITY = "(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()))"


def normal_sf(z: str) -> str:
    """Upper tail for z >= 0: a power series below 3, a continued fraction above."""
    series = f"0.5 - {_DENSITY} * list_sum(list_transform(range(0, 80), lambda n: exp((2 * n + 1) * ln(greatest({{z}}, 1e-300)) - (n + 1) * ln(2.0::DOUBLE) - lgamma(n + 1.5) + 0.5 * ln(pi()))))"
    fraction = f"{_DENSITY} / list_reduce(range(80, 0, -1)::DOUBLE[], lambda f, k: ({{z}}) + k / f)"
    return f"(CASE WHEN ({z}) < 3 THEN {series.format(z=z)} ELSE {fraction.format(z=z)} END)"


def normal_p(z: str) -> str:
    return f"(2 * {normal_sf(f'abs({z})')})"


def normal_cdf(z: str) -> str:
    return f"(CASE WHEN ({z}) > 0 THEN 1 - {normal_sf(f'abs({z})')} ELSE {normal_sf(f'abs({z})')} END)"


def chi2_p(x: str, df: int) -> str:
    """Upper tail of chi-squared with a whole number of degrees of freedom."""
    x = f"greatest({x}, 0)"
    if df % 2 == 0:
        terms = " + ".join(f"pow(({x}) / 2, {j}) / {float(math.factorial(j))}" for j in range(df // 2))
        return f"(exp(-({x}) / 2) * ({terms}))"
    terms = "".join(f" + exp(-({x}) / 2) * pow(({x}) / 2, {j - 0.5}::DOUBLE) / {math.gamma(j + 0.5)!r}" for j in range(1, (df + 1) // 2))
    return f"({normal_p(f'sqrt({x})')}{terms})"


def t_p(t: str, df: str) -> str:
    """Two-sided tail of Student's t with a whole number of degrees of freedom."""
    c2, s = f"(({df}) / (({df}) + ({t}) * ({t}))::DOUBLE)", f"(abs({t}) / sqrt(({df}) + ({t}) * ({t})))"
    even = f"{s} * list_sum(list_transform(range(0, (({df}) // 2)::BIGINT), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - 0.5 * ln(pi()) + j * ln({c2}))))"
    odd = f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {s} * coalesce(list_sum(list_transform(range(0, ((({df}) - 1) // 2)::BIGINT), lambda j: exp(0.5 * ln(pi()) - ln(2.0::DOUBLE) + lgamma(j + 1) - lgamma(j + 1.5) + (j + 0.5) * ln({c2})))), 0))"
    return f"(CASE WHEN ({df}) % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END)"


def f_p(f: str, d1: int, d2: str) -> str:
    """Upper tail of F(d1, d2), d1 a number."""
    x, a = f"(({d2}) / (({d2}) + {d1} * ({f}))::DOUBLE)", f"(({d2}) / 2.0::DOUBLE)"
    if d1 % 2 == 0:
        return f"(pow({x}, {a}) * (" + " + ".join(f"exp(lgamma({a} + {j}) - lgamma({a})) / {float(math.factorial(j))} * pow(1 - {x}, {j})" for j in range(d1 // 2)) + "))"
    terms = "".join(f" + pow({x}, {a}) * pow(1 - {x}, {j + 0.5}::DOUBLE) * exp(lgamma({a} + {j + 0.5}::DOUBLE) - lgamma({a})) / {math.gamma(j + 1.5)!r}" for j in range((d1 - 1) // 2))
    return f"({t_p(f'sqrt({d1} * ({f}))', d2)}{terms})"


def unit_root_p(t: str, surface: tuple) -> str:
    """By a response surface of functions.distributions."""
    switch, _, most, small, large = surface
    poly = lambda c: "(" + " + ".join(f"{x!r} * pow({t}, {i})" for i, x in enumerate(c)) + ")"
    over = f"WHEN ({t}) > {most} THEN 1.0 " if math.isfinite(most) else ""
    return f"(CASE {over}WHEN ({t}) <= {switch} THEN {normal_cdf(poly(small))} ELSE {normal_cdf(poly(large))} END)"


def least_squares(name: str, rows: str, keys: Iterable[str], xs: list[str], y: str, const: bool = True) -> str:
    """CTEs that end in `name`: keys, n, b_i and v_i (diagonal of the inverse) for the constant (0, if there is one) and each x, ssr and sst.

    The augmented cross products are swept for one regressor after the other.
    """
    cols, by = [*(["1.0::DOUBLE"] if const else []), *[f"({x})::DOUBLE" for x in xs], f"({y})::DOUBLE"], ", ".join(keys)
    k, lead = len(cols) - 1, f"{by}, " if by else ""
    whole = " AND ".join(f"({c}) IS NOT NULL" for c in [*xs, y])
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = ", ".join(f"sum({cols[i]} * {cols[j]}) AS g_{i}_{j}" for i, j in cells)
    group = f" GROUP BY {by}" if by else ""
    out = [f"{name}_0 AS (SELECT {lead}count(*) AS n, {sums} FROM {rows} WHERE {whole}{group})"]
    at = lambda i, j: f"g_{min(i, j)}_{max(i, j)}"
    for p in range(k):
        d = at(p, p)
        swept = [f"-1 / {d} AS {d}" if i == j == p else f"{at(i, j)} / {d} AS {at(i, j)}" if p in (i, j) else f"{at(i, j)} - {at(i, p)} * {at(p, j)} / {d} AS {at(i, j)}" for i, j in cells]
        first = f", {at(k, k)} - {at(0, k)} * {at(0, k)} / n AS sst" if p == 0 else ", sst"
        out.append(f"{name}_{p + 1} AS (SELECT {lead}n{first}, {', '.join(swept)} FROM {name}_{p})")
    found = ", ".join(f"{at(i, k)} AS b_{i}, -{at(i, i)} AS v_{i}" for i in range(k))
    out.append(f"{name} AS (SELECT {lead}n, {found}, {at(k, k)} AS ssr, sst FROM {name}_{k})")
    return ", ".join(out)


def terms(name: str, keys: Iterable[str], names: list[str], digits: int) -> str:
    """The rows of operators.gram.ols() from a fit of least_squares()."""
    k, lead = len(names), "".join(f"{c}, " for c in keys)
    r = lambda x, c: f"round({x}, {digits}) AS {c}"
    parts = []
    for i, term in enumerate(names):
        se = f"sqrt(v_{i} * ssr / (n - {k}))"
        parts.append(
            f"SELECT {lead}'{term}' AS term, {r(f'b_{i}', 'estimate')}, {r(se, 'std_error')}, {r(f'b_{i} / {se}', 't_stat')}, {r(t_p(f'(b_{i} / {se})', f'(n - {k})'), 'p_value')}, n AS nobs, "
            f"{r('ssr', 'ssr')}, {r('1 - ssr / sst', 'r2')}, {r(f'1 - (ssr / sst) * (n - 1) / (n - {k})', 'r2_adjusted')} FROM {name}"
        )
    return " UNION ALL ".join(parts)


def residual_products(name: str, rows: str, xs: list[str], ys: list[str]) -> str:
    """CTEs that end in `name`: n, and s_i_j, the sums of products of the residuals of ys on a constant and xs: what sweeping leaves of them."""
    cols, k = ["1.0::DOUBLE", *[f"({x})::DOUBLE" for x in [*xs, *ys]]], len(xs) + 1
    cells = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    out = [f"{name}_0 AS (SELECT count(*) AS n, {', '.join(f'sum({cols[i]} * {cols[j]}) AS g_{i}_{j}' for i, j in cells)} FROM {rows})"]
    at = lambda i, j: f"g_{min(i, j)}_{max(i, j)}"
    for p in range(k):
        left = [(i, j) for i, j in cells if i > p]
        out.append(f"{name}_{p + 1} AS (SELECT n, {', '.join(f'{at(i, j)} - {at(i, p)} * {at(p, j)} / {at(p, p)} AS {at(i, j)}' for i, j in left)} FROM {name}_{p})")
    held = ", ".join(f"{at(k + i, k + j)} AS s_{i}_{j}" for i in range(len(ys)) for j in range(i, len(ys)))
    out.append(f"{name} AS (SELECT n, {held} FROM {name}_{k})")
    return ", ".join(out)


def last_coefficient(name: str, rows: str, key: str, xs: list[str], y: str) -> str:
    """CTEs that end in `name`: key, n, b and v (estimate and diagonal of the inverse) of the last of xs, and ssr, with a constant; by elimination."""
    cols, k = ["1.0::DOUBLE", *[f"({x})::DOUBLE" for x in [*xs, y]]], len(xs)
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [*xs, y])
    cells = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    out = [f"{name}_0 AS (SELECT {key}, count(*) AS n, {', '.join(f'sum({cols[i]} * {cols[j]}) AS g_{i}_{j}' for i, j in cells)} FROM {rows} WHERE {whole} GROUP BY {key})"]
    at = lambda i, j: f"g_{min(i, j)}_{max(i, j)}"
    for p in range(k):
        out.append(f"{name}_{p + 1} AS (SELECT {key}, n, {', '.join(f'{at(i, j)} - {at(i, p)} * {at(p, j)} / {at(p, p)} AS {at(i, j)}' for i, j in cells if i > p)} FROM {name}_{p})")
    x, z = at(k, k), at(k, k + 1)
    out.append(f"{name} AS (SELECT {key}, n, {z} / {x} AS b, 1 / {x} AS v, {at(k + 1, k + 1)} - {z} * {z} / {x} AS ssr FROM {name}_{k})")
    return ", ".join(out)
