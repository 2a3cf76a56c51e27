"""Least squares from one pass: Spark sums the cross products, each group's small system is solved from its row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_p

CONST = "const"


def cross_products(names: list[str]) -> list[Column]:
    """Sums of products of every two columns, the constant included, and the number of rows."""
    value = {n: F.lit(1.0) if n == CONST else F.col(n).cast("double") for n in names}
    return [F.sum(value[a] * value[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]


def matrix(row, k: int) -> np.ndarray:
    """The symmetric matrix of a row of cross_products()."""
    out = np.empty((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"{i}_{j}"]
    return out


def _moments(names: list[str], const: bool) -> list[Column]:
    """What ols() needs: means, and products about them (with a constant) or about zero. Spark's covariance doesn't cancel."""
    v = [F.col(n).cast("double") for n in names]
    pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
    product = (lambda i, j: F.covar_pop(v[i], v[j]) * F.count("*")) if const else (lambda i, j: F.sum(v[i] * v[j]))
    return [*[F.avg(x).alias(f"m_{i}") for i, x in enumerate(v)], *[product(i, j).alias(f"{i}_{j}") for i, j in pairs]]


def _stacked(pdf: pd.DataFrame, k: int) -> np.ndarray:
    """matrix() of every row: rows x k x k."""
    out = np.empty((len(pdf), k, k))
    for i in range(k):
        for j in range(i, k):
            out[:, i, j] = out[:, j, i] = pdf[f"{i}_{j}"].to_numpy(dtype=float)
    return out


def _solvable(xx: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Which of the stacked matrices have full rank, their rows and columns scaled."""
    good = np.isfinite(xx).all((1, 2)) & (scale > 0).all(1)
    if good.any() and xx.shape[1]:
        good[good] = np.linalg.matrix_rank(xx[good] / (scale[good][:, :, None] * scale[good][:, None, :]), tol=1e-10) == xx.shape[1]
    return good


def ols(df: DataFrame, y: str, xs: list[str], by: list[str] | None = None, const: bool = True) -> DataFrame:
    """Per group and term: estimate, std_error, t_stat, p_value; and nobs, ssr, r2, r2_adjusted of the fit.

    Rows with a null in y or xs are left out. Groups without more rows than terms, and singular ones, are left out.
    """
    by = by or []
    rows = df.na.drop(subset=[*xs, y]).groupBy(*by).agg(*_moments([*xs, y], const), F.count("*").alias("nobs"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name in by}
    names = "term string, estimate double, std_error double, t_stat double, nobs long, ssr double, r2 double, r2_adjusted double"
    schema = ", ".join([*[f"{b} {kinds[b]}" for b in by], names])
    k, terms = len(xs), [*([CONST] if const else []), *xs]

    def solve(batches):
        for pdf in batches:
            g, n = _stacked(pdf, k + 1), pdf["nobs"].to_numpy(dtype=np.int64)
            scale = np.sqrt(np.maximum(np.einsum("gii->gi", g[:, :k, :k]), 0))
            # a column without spread about its mean is left with rounding only
            size = np.sqrt(n)[:, None] * np.abs(pdf[[f"m_{i}" for i in range(k)]].to_numpy(dtype=float)) if const else 0 * scale
            good = (n > len(terms)) & (scale > 1e-10 * size).all(1)
            good[good] = _solvable(g[good][:, :k, :k], scale[good])
            pdf, g, n, scale = pdf[good], g[good], n[good], scale[good]
            outer = scale[:, :, None] * scale[:, None, :]
            inverse = np.linalg.inv(g[:, :k, :k] / outer) / outer
            b = np.einsum("gij,gj->gi", inverse, g[:, :k, k])
            ssr = np.maximum(0.0, g[:, k, k] - np.einsum("gi,gi->g", b, g[:, :k, k]))
            spread = np.einsum("gii->gi", inverse)
            if const:
                mean = pdf[[f"m_{i}" for i in range(k)]].to_numpy(dtype=float).reshape(len(pdf), k)
                b = np.column_stack([pdf[f"m_{k}"].to_numpy(dtype=float) - np.einsum("gi,gi->g", b, mean), b])
                spread = np.column_stack([1 / n + np.einsum("gi,gij,gj->g", mean, inverse, mean), spread])
            se = np.sqrt(spread * (ssr / (n - len(terms)))[:, None])
            total = g[:, k, k]
            r2 = np.where(total > 0, 1 - ssr / np.where(total > 0, total, 1), np.nan)
            adjusted = 1 - (1 - r2) * (n - const) / (n - len(terms))
            for i, term in enumerate(terms):
                t = np.where(se[:, i] > 0, b[:, i] / np.where(se[:, i] > 0, se[:, i], 1), np.nan)
                out = pdf[by].assign(term=term, estimate=b[:, i], std_error=se[:, i], t_stat=t, nobs=n, ssr=ssr, r2=r2, r2_adjusted=adjusted)
                yield out.astype({c: "Float64" for c in ("t_stat", "r2", "r2_adjusted")})

    out = rows.mapInPandas(solve, schema)
    out = out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("t_stat", "r2", "r2_adjusted")})
    return out.select(*by, "term", "estimate", "std_error", "t_stat", t_p(F.col("t_stat"), F.col("nobs") - len(terms)).alias("p_value"), "nobs", "ssr", "r2", "r2_adjusted")


def inflation(df: DataFrame, xs: list[str], by: list[str]) -> DataFrame:
    """by, regressor, vif: the diagonal of the inverse of each group's correlation matrix, from one pass."""
    rows = df.na.drop(subset=xs).groupBy(*by).agg(*_moments(xs, True), F.count("*").alias("nobs"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in by]

    def solve(batches):
        for pdf in batches:
            g = _stacked(pdf, len(xs))
            scale = np.sqrt(np.maximum(np.einsum("gii->gi", g), 0))
            good = _solvable(g, scale)
            g, scale = g[good], scale[good]
            found = np.einsum("gii->gi", np.linalg.inv(g / (scale[:, :, None] * scale[:, None, :])))
            for i, x in enumerate(xs):
                yield pdf[good][by].assign(regressor=x, vif=found[:, i])

    return rows.mapInPandas(solve, ", ".join([*kinds, "regressor string", "vif double"]))


def fitted(df: DataFrame, fit: DataFrame, y: str, xs: list[str], by: list[str] | None = None) -> DataFrame:
    """df with residual: y less the fit of ols(), which has a row for each group and term."""
    by = by or []
    # one row a group, with the estimates as columns
    wide = fit.groupBy(*by).agg(*[F.max(F.when(F.col("term") == t, F.col("estimate"))).alias(f"_b{i}") for i, t in enumerate([CONST, *xs])])
    joined = df.join(wide, by) if by else df.crossJoin(F.broadcast(wide))
    predicted = F.coalesce("_b0", F.lit(0.0)) + sum((F.col(f"_b{i + 1}") * F.col(x) for i, x in enumerate(xs)), F.lit(0.0))
    return joined.withColumn("residual", F.col(y) - predicted).drop(*[f"_b{i}" for i in range(len(xs) + 1)])
