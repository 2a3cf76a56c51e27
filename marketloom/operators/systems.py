"""Systems of series: order selection, impulse responses, variance shares, Johansen and error correction.

One pass sums the cross products of the lagged columns; what follows is algebra on that small matrix, whose size
is the number of columns and lags and not of rows. Inputs are wide: ts and a column for each series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import chi2_sf, normal_p
from .gram import CONST, cross_products, matrix
from .multivariate import lagged, var_model

#: 90, 95 and 99 % critical values with a constant, by number of series less the rank tested.
TRACE = [(2.7055, 3.8415, 6.6349), (13.4294, 15.4943, 19.9349), (27.0669, 29.7961, 35.4628), (44.4929, 47.8545, 54.6815), (65.8202, 69.8189, 77.8202)]
MAX_EIGEN = [(2.7055, 3.8415, 6.6349), (12.2971, 14.2639, 18.5200), (18.8928, 21.1314, 25.8650), (25.1236, 27.5858, 32.7172), (31.2379, 33.8777, 39.3693)]


def gram(df: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """Cross products of columns, CONST included, over the rows without nulls, and the number of rows."""
    row = df.na.drop().agg(*cross_products(names), F.count("*").alias("n")).first()
    if not row["n"]:
        raise ValueError("no row has a value in every column")
    return matrix(row, len(names)), int(row["n"])


def _regressors(columns: list[str], lags: int) -> list[str]:
    return [CONST, *[f"{c}_L{k}" for k in range(1, lags + 1) for c in columns]]


def _fit(g: np.ndarray, n: int, k: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (regressors x equations) and residual cross products of the first `lags` lags."""
    use, y = np.arange(1 + k * lags), np.arange(len(g) - k, len(g))
    b = np.linalg.solve(g[np.ix_(use, use)], g[np.ix_(use, y)])
    return b, g[np.ix_(y, y)] - g[np.ix_(y, use)] @ b


def order_selection(df: DataFrame, columns: list[str], maxlags: int = 10) -> DataFrame:
    """lags, nobs, aic, bic, hqic, fpe of a vector autoregression, all orders on the rows of the longest."""
    k = len(columns)
    g, n = gram(lagged(df.select("ts", *columns), columns, maxlags), [*_regressors(columns, maxlags), *columns])
    out = []
    for p in range(maxlags + 1):
        _, s = _fit(g, n, k, p)
        m, each = k * (1 + k * p), 1 + k * p
        level = float(np.linalg.slogdet(s / n)[1])
        out.append((p, n, level + 2 * m / n, level + np.log(n) * m / n, level + 2 * np.log(np.log(n)) * m / n, float(np.exp(level)) * ((n + each) / (n - each)) ** k))
    return df.sparkSession.createDataFrame([tuple(map(lambda x: float(x) if isinstance(x, np.floating) else x, r)) for r in out], "lags int, nobs long, aic double, bic double, hqic double, fpe double")


def selected_order(df: DataFrame, columns: list[str], maxlags: int = 10, criterion: str = "aic") -> int:
    """The lags with the least of a criterion (aic, bic, hqic, fpe); of equal ones the fewest."""
    if criterion not in ("aic", "bic", "hqic", "fpe"):
        raise ValueError(f"unknown criterion {criterion!r}")
    return order_selection(df, columns, maxlags).orderBy(criterion, "lags").first()["lags"]  # one row for each number of lags


def selected_var(df: DataFrame, columns: list[str], maxlags: int = 10, criterion: str = "aic") -> DataFrame:
    """lags and the columns of `var_model`: the autoregression with as many lags as the criterion selects, on all the rows it can use."""
    p = selected_order(df, columns, maxlags, criterion)
    return var_model(df, columns, p).select(F.lit(p).alias("lags"), "*")


def var_checks(df: DataFrame, columns: list[str], lags: int, test_lags: int = 10) -> DataFrame:
    """test, lags, statistic, df, p_value, passed of a vector autoregression.

    stability: the largest modulus among the companion's eigenvalues, passed below 1. whiteness: the portmanteau of the residuals
    up to test_lags (one more than the model's at least), passed if not rejected at 5 %.
    """
    k, m = len(columns), max(test_lags, lags + 1)
    rows = lagged(df.select("ts", *columns), columns, lags).na.drop()
    before = _regressors(columns, lags)
    g, n = gram(rows, [*before, *columns])
    b, _ = _fit(g, n, k, lags)
    left = [(F.col(c) - b[0, j] - sum((b[i, j] * F.col(x) for i, x in enumerate(before[1:], 1)), F.lit(0.0))).alias(f"e{j}") for j, c in enumerate(columns)]
    names = [f"e{j}" for j in range(k)]
    pairs = {(h, i, j): F.sum(F.col(names[i]) * F.col(f"{names[j]}_L{h}" if h else names[j])) for h in range(m + 1) for i in range(k) for j in range(k)}
    row = lagged(rows.select("ts", *left), names, m).agg(*[F.coalesce(v, F.lit(0.0)).alias("_".join(map(str, key))) for key, v in pairs.items()]).first()
    c = np.array([[[row[f"{h}_{i}_{j}"] for j in range(k)] for i in range(k)] for h in range(m + 1)]) / n
    inverse = np.linalg.inv(c[0])
    q, free = n * float(sum(np.trace(x.T @ inverse @ x @ inverse) for x in c[1:])), k * k * (m - lags)
    companion = np.zeros((k * max(lags, 1),) * 2)
    companion[:k, : k * lags] = b[1:].T
    companion[k:, :-k] += np.eye(k * max(lags - 1, 0))
    modulus, p = float(np.abs(np.linalg.eigvals(companion)).max()), chi2_sf(q, free)
    out = [("stability", lags, modulus, None, None, modulus < 1), ("whiteness", m, q, free, float(p), p >= 0.05)]
    return df.sparkSession.createDataFrame(out, "test string, lags int, statistic double, df int, p_value double, passed boolean")


def _responses(df: DataFrame, columns: list[str], lags: int, horizons: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Moving-average matrices (response x impulse) up to the horizon, and the residual covariance."""
    k = len(columns)
    g, n = gram(lagged(df.select("ts", *columns), columns, lags), [*_regressors(columns, lags), *columns])
    b, s = _fit(g, n, k, lags)
    a = [b[1 + k * i : 1 + k * (i + 1)].T for i in range(lags)]
    psi = [np.eye(k)]
    for h in range(1, horizons + 1):
        psi.append(sum((psi[h - i - 1] @ a[i] for i in range(min(h, lags))), np.zeros((k, k))))
    return psi, s / (n - 1 - k * lags)


def impulse_responses(df: DataFrame, columns: list[str], lags: int, horizons: int = 10, orthogonalized: bool = True) -> DataFrame:
    """horizon, impulse, response, value; orthogonalised by a Cholesky factor in the order of the columns."""
    psi, sigma = _responses(df, columns, lags, horizons)
    shock = np.linalg.cholesky(sigma) if orthogonalized else np.eye(len(columns))
    rows = [(h, columns[j], columns[i], float(v)) for h, m in enumerate(psi) for (i, j), v in np.ndenumerate(m @ shock)]
    return df.sparkSession.createDataFrame(rows, "horizon int, impulse string, response string, value double")


def variance_shares(df: DataFrame, columns: list[str], lags: int, horizons: int = 10) -> DataFrame:
    """horizon (from 1), variable, shock, share: forecast error variance by shock; shares of a variable add up to 1."""
    psi, sigma = _responses(df, columns, lags, horizons - 1)
    factor, total, rows = np.linalg.cholesky(sigma), np.zeros((len(columns),) * 2), []
    for h, m in enumerate(psi):
        total = total + (m @ factor) ** 2
        share = total / total.sum(axis=1, keepdims=True)
        rows += [(h + 1, columns[i], columns[j], float(v)) for (i, j), v in np.ndenumerate(share)]
    return df.sparkSession.createDataFrame(rows, "horizon int, variable string, shock string, share double")


def _moments(df: DataFrame, columns: list[str], diffs: int) -> tuple[np.ndarray, int, int]:
    """Cross products of the constant, lagged changes, changes and levels one before; rows; number of the first two."""
    order = Window.partitionBy(F.lit(0)).orderBy("ts")  # a single calendar: its rows are the dates
    rows = df.select("ts", *columns).na.drop().select("ts", *[F.lag(c).over(order).alias(f"{c}_B") for c in columns], *[(F.col(c) - F.lag(c).over(order)).alias(f"{c}_D") for c in columns])
    changes = [f"{c}_D" for c in columns]
    rows = lagged(rows, changes, diffs)
    before = _regressors(changes, diffs)
    g, n = gram(rows, [*before, *changes, *[f"{c}_B" for c in columns]])
    return g, n, len(before)


def _reduced_rank(g: np.ndarray, n: int, m: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, descending, their vectors, and the moments of changes and levels without what comes before them."""
    s = (g[m:, m:] - g[m:, :m] @ np.linalg.solve(g[:m, :m], g[:m, m:])) / n
    s00, s01, s11 = s[:k, :k], s[:k, k:], s[k:, k:]
    low = np.linalg.inv(np.linalg.cholesky(s11))
    values, vectors = np.linalg.eigh(low @ s01.T @ np.linalg.solve(s00, s01) @ low.T)
    order = np.argsort(values)[::-1]
    return values[order], (low.T @ vectors)[:, order], s


def johansen(df: DataFrame, columns: list[str], diffs: int = 1) -> DataFrame:
    """rank tested, eigenvalue, trace and largest-eigenvalue statistics with their critical values, and nobs.

    The model has a constant. The rank is the first row whose trace is below its 95 % value. Up to five series.
    """
    k = len(columns)
    if not 2 <= k <= len(TRACE):
        raise ValueError(f"two to {len(TRACE)} series, not {k}")
    g, n, m = _moments(df, columns, diffs)
    values, _, _ = _reduced_rank(g, n, m, k)
    logs = -n * np.log(1 - np.clip(values, 0, 1 - 1e-15))
    rows = [(r, float(values[r]), float(logs[r:].sum()), *TRACE[k - r - 1], float(logs[r]), *MAX_EIGEN[k - r - 1], n) for r in range(k)]
    kinds = "trace double, trace_90 double, trace_95 double, trace_99 double, max_eigen double, max_eigen_90 double, max_eigen_95 double, max_eigen_99 double"
    return df.sparkSession.createDataFrame(rows, f"rank int, eigenvalue double, {kinds}, nobs long")


def vecm(df: DataFrame, columns: list[str], rank: int | None = None, diffs: int = 1) -> DataFrame:
    """kind, equation, term, value, std_error, z_stat, p_value of an error correction model: alpha, beta (its leading block the identity), gamma.

    beta has a row for each relation and series; alpha for each equation and relation; gamma for each equation and
    lagged change or constant. Errors take beta as known, with residual variances over the number of rows; beta has none.
    Without a rank it is the first one whose trace is below its 95 % value; ValueError where that is 0 or the number of series.
    """
    k = len(columns)
    if rank is None:
        rank = next((r["rank"] for r in sorted(johansen(df, columns, diffs).collect(), key=lambda r: r["rank"]) if r["trace"] < r["trace_95"]), k)
    if not 0 < rank < k:
        raise ValueError(f"the rank must lie between 1 and {k - 1}")
    g, n, m = _moments(df, columns, diffs)
    _, vectors, s = _reduced_rank(g, n, m, k)
    beta = vectors[:, :rank] @ np.linalg.inv(vectors[:rank, :rank])
    s01, s11 = s[:k, k:], s[k:, k:]
    alpha = s01 @ beta @ np.linalg.inv(beta.T @ s11 @ beta)
    gamma = np.linalg.solve(g[:m, :m], g[:m, m : m + k] - g[:m, m + k :] @ beta @ alpha.T).T
    # the regressors of an equation: what comes before, then the relations' values one date before
    take = np.zeros((len(g), m + rank))
    take[:m, :m], take[m + k :, m:] = np.eye(m), beta
    zz, b = take.T @ g @ take, np.hstack([gamma, alpha])
    zy = take.T @ g[:, m : m + k]
    sigma = (np.diag(g[m : m + k, m : m + k]) - np.einsum("ij,ji->i", b, zy)) / n
    error = np.sqrt(np.outer(np.maximum(sigma, 0), np.diag(np.linalg.inv(zz))))
    before = _regressors([f"{c}_D" for c in columns], diffs)
    rows = [("beta", f"relation_{r + 1}", columns[i], float(beta[i, r]), None) for r in range(rank) for i in range(k)]
    rows += [("alpha", columns[i], f"relation_{r + 1}", float(alpha[i, r]), float(error[i, m + r])) for i in range(k) for r in range(rank)]
    rows += [("gamma", columns[i], before[j], float(gamma[i, j]), float(error[i, j])) for i in range(k) for j in range(m)]
    out = df.sparkSession.createDataFrame(rows, "kind string, equation string, term string, value double, std_error double")
    z = F.try_divide("value", "std_error")
    return out.withColumns({"z_stat": z, "p_value": normal_p(z)})
