"""Conditional volatility: GARCH, GJR and exponential GARCH of any orders, on returns in percent.

Shocks are normal, Student t (nu) or skewed t (eta, lambda), all of unit variance. The likelihood is a recursion along a
series, so each symbol is one Arrow group whose rows are its dates; symbols run in parallel. What is made of a fit is Spark's:
`fitted` returns a row for each symbol, `estimates` its parameters, `path` its volatility, `whiteness` tests of what it leaves.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import normal_p
from .efficiency import ljung_box
from .pricing import PERIODS

MEAN_ABS = math.sqrt(2 / math.pi)
MODELS = ("garch", "gjr_garch", "egarch")
SHAPES = {"normal": (), "t": ("nu",), "skewt": ("eta", "lambda")}
Z95 = 1.959963984540054


def climb(f: Callable[[np.ndarray], float], start: np.ndarray, iterations: int, tolerance: float = 1e-8) -> tuple[np.ndarray, float, bool]:
    """A local maximum of f by a simplex that reflects, expands and shrinks; whether it got there in the iterations."""
    points = [start, *[start + step for step in np.eye(len(start)) * 0.5]]
    values, done = [f(p) for p in points], False
    for _ in range(iterations):
        order = np.argsort(values)[::-1]
        points, values = [points[i] for i in order], [values[i] for i in order]
        if values[0] - values[-1] < tolerance:
            done = True
            break
        centre = np.mean(points[:-1], axis=0)
        for factor in (2.0, 1.0, 0.5, -0.5):
            trial = centre + factor * (centre - points[-1])
            value = f(trial)
            if value > (values[0] if factor == 2.0 else values[-1]):
                points[-1], values[-1] = trial, value
                break
        else:
            points = [points[0], *[(p + points[0]) / 2 for p in points[1:]]]
            values = [values[0], *[f(p) for p in points[1:]]]
    best = int(np.argmax(values))
    return points[best], values[best], done


def _log_gamma_ratio(nu: float) -> float:
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(math.pi * (nu - 2))


def log_density(z: np.ndarray, dist: str, shape: np.ndarray) -> np.ndarray:
    """Of shocks of unit variance; the skewed t has its mean at 0 too."""
    if dist == "normal":
        return -0.5 * (math.log(2 * math.pi) + z * z)
    nu, skew = shape[0], shape[1] if dist == "skewt" else 0.0
    a = 4 * skew * math.exp(_log_gamma_ratio(nu)) * (nu - 2) / (nu - 1)
    b = math.sqrt(1 + 3 * skew * skew - a * a)
    side = np.where(z < -a / b, 1 - skew, 1 + skew)
    return math.log(b) + _log_gamma_ratio(nu) - (nu + 1) / 2 * np.log1p(((b * z + a) / side) ** 2 / (nu - 2))


class Model:
    """Names of the parameters of a specification, their free form for the search, and the variances that they give."""

    def __init__(self, kind: str, p: int, o: int, q: int, dist: str, mean: str):
        if kind not in MODELS or dist not in SHAPES or mean not in ("constant", "zero"):
            raise ValueError(f"no model {kind} with {dist} shocks and a {mean} mean")
        if p < 1 or o < 0 or q < 0:
            raise ValueError("orders: p is 1 at least, o and q 0 at least")
        self.kind, self.p, self.o, self.q, self.dist = kind, p, o, q, dist
        self.means = ["mu"] if mean == "constant" else []
        news = [f"alpha[{i + 1}]" for i in range(p)] + [f"gamma[{i + 1}]" for i in range(o)] + [f"beta[{i + 1}]" for i in range(q)]
        self.names = [*self.means, "omega", *news, *SHAPES[dist]]

    def start(self, r: np.ndarray) -> np.ndarray:
        mu = [float(r.mean())] if self.means else []
        level = math.log(np.var(r))
        shape = {"normal": [], "t": [math.log(6.0)], "skewt": [math.log(6.0), 0.0]}[self.dist]
        if self.kind == "egarch":
            beta = [1.5] + [0.0] * (self.q - 1) if self.q else []
            return np.array([*mu, 0.1 * level, *[0.2 / self.p] * self.p, *[0.0] * self.o, *beta, *shape])
        shares = [-2.0] * (self.p + self.o) + ([1.0] + [-1.0] * (self.q - 1) if self.q else [])
        return np.array([*mu, level + math.log(0.1), 2.0, *shares, *shape])

    def natural(self, theta: np.ndarray) -> np.ndarray:
        """Variances stay positive and persistence below 1 whatever the free parameters.

        A rise weighs alpha, a fall alpha + gamma, an older variance beta; these are shares of a total below 1.
        """
        m, s = len(self.means), len(SHAPES[self.dist])
        body, tail = theta[m : len(theta) - s], theta[len(theta) - s :]
        if self.kind == "egarch":
            core = [*body[: 1 + self.p + self.o], *_stationary(np.tanh(body[1 + self.p + self.o :]))]
        else:
            total = 1 / (1 + math.exp(-min(max(body[1], -500.0), 500.0)))
            share = np.exp(body[2:] - body[2:].max())
            share = total * share / share.sum()
            rises, falls, beta = share[: self.p], share[self.p : self.p + self.o], share[self.p + self.o :]
            both = min(self.p, self.o)
            alpha, gamma = rises.copy(), 2 * falls
            alpha[:both] *= 2
            gamma[:both] -= alpha[:both]
            core = [math.exp(min(body[0], 50.0)), *alpha, *gamma, *beta]
        shape = [2.05 + math.exp(min(tail[0], 10.0))] if s else []
        return np.array([*theta[:m], *core, *shape, *([math.tanh(tail[1])] if s == 2 else [])])

    def variances(self, values: np.ndarray, r: np.ndarray, before: float) -> tuple[np.ndarray, np.ndarray]:
        """Residuals and their variances; `before` stands for squares and variances ahead of the series."""
        m = len(self.means)
        e = r - values[0] if m else r
        omega, rest = values[m], values[m + 1 :]
        alpha, gamma, beta = rest[: self.p], rest[self.p : self.p + self.o], rest[self.p + self.o : self.p + self.o + self.q].tolist()
        n, out = len(e), np.empty(len(e))
        if self.kind == "egarch":
            logs, zs, first = [], [], math.log(before)
            up, sign = alpha.tolist(), gamma.tolist()
            if len(up) == len(sign) == len(beta) == 1:
                (a,), (g,), (b,), h, news = up, sign, beta, first, 0.0
                for x in e.tolist():
                    h = min(50.0, max(-50.0, omega + news + b * h))
                    logs.append(h)
                    z = x * math.exp(-h / 2)
                    news = a * (abs(z) - MEAN_ABS) + g * z
                return e, np.exp(np.array(logs))
            for t, x in enumerate(e.tolist()):
                h = omega
                for i, a in enumerate(up):
                    h += a * (abs(zs[t - 1 - i]) - MEAN_ABS) if t > i else 0.0
                for i, a in enumerate(sign):
                    h += a * zs[t - 1 - i] if t > i else 0.0
                for i, b in enumerate(beta):
                    h += b * (logs[t - 1 - i] if t > i else first)
                h = min(50.0, max(-50.0, h))
                logs.append(h)
                zs.append(x * math.exp(-h / 2))
            return e, np.exp(np.array(logs))
        square, news = e * e, np.full(n, omega)
        for weights, known, unknown in ((alpha, square, before), (gamma, square * (e < 0), before / 2)):
            for i, a in enumerate(weights):
                news += a * np.concatenate([np.full(min(i + 1, n), unknown), known[: max(n - i - 1, 0)]])
        if not beta:
            return e, news
        if len(beta) == 1:
            b = beta[0]
            return e, np.fromiter(islice(accumulate(news.tolist(), lambda v, x: x + b * v, initial=before), 1, None), float, n)
        past = [before] * len(beta)
        for t, v in enumerate(news.tolist()):
            for b, x in zip(beta, past, strict=True):
                v += b * x
            out[t] = v
            past = [v, *past[:-1]]
        return e, out

    def terms(self, values: np.ndarray, r: np.ndarray, before: float) -> np.ndarray:
        """Log likelihood of each date."""
        e, v = self.variances(values, r, before)
        v = np.maximum(v, 1e-300)
        return log_density(e / np.sqrt(v), self.dist, values[len(values) - len(SHAPES[self.dist]) :]) - 0.5 * np.log(v)


def _stationary(partial: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression with these partial autocorrelations."""
    a = np.empty(0)
    for k in partial:
        a = np.append(a - k * a[::-1], k)
    return a


def _robust_errors(terms: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    """Of the quasi-likelihood: second derivatives around the products of the scores; not a number where they fail."""
    k, h = len(x), 1e-4 * np.maximum(np.abs(x), 1e-2)
    step, f0 = np.diag(h), float(terms(x).sum())
    ups, downs = [terms(x + s) for s in step], [terms(x - s) for s in step]
    score = np.array([(u - d) / (2 * w) for u, d, w in zip(ups, downs, h, strict=True)])
    hess = np.empty((k, k))
    for i in range(k):
        hess[i, i] = (ups[i].sum() - 2 * f0 + downs[i].sum()) / h[i] ** 2
        for j in range(i):
            corners = sum(a * b * terms(x + a * step[i] + b * step[j]).sum() for a in (1, -1) for b in (1, -1))
            hess[i, j] = hess[j, i] = corners / (4 * h[i] * h[j])
    try:
        inverse = np.linalg.inv(hess)
    except np.linalg.LinAlgError:
        return np.full(k, np.nan)
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.diag(inverse @ (score @ score.T) @ inverse))


def _before(r: np.ndarray) -> float:
    """Squares ahead of the series: those of its first 75 dates, each weighing 0.94 of the one before."""
    weights = 0.94 ** np.arange(min(75, len(r)))
    return float(weights @ (r[: len(weights)] - r.mean()) ** 2 / weights.sum())


def spread(df: DataFrame) -> DataFrame:
    """By symbol over as many tasks as the session shuffles to: a fit is long work on few bytes, which would be put together otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol")


def fitted(df: DataFrame, model: str = "garch", p: int = 1, o: int = 0, q: int = 1, dist: str = "normal", mean: str = "constant", min_obs: int = 2, iterations: int = 4000) -> DataFrame:
    """symbol, n, names, values, errors (arrays), loglik, converged, current_vol: one row for each symbol.

    Constant series and those with fewer than min_obs returns are left out; an error that can't be had is null.
    """
    spec = Model(model, p, o, q, dist, mean)
    columns = ["symbol", "n", "names", "values", "errors", "loglik", "converged", "current_vol"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values("ts").r.dropna().to_numpy() * 100
        if len(r) < max(min_obs, 2) or not np.ptp(r):
            return pd.DataFrame([], columns=columns)
        before = _before(r) or float(np.mean((r - r.mean()) ** 2))

        def value(theta: np.ndarray) -> float:
            total = float(spec.terms(spec.natural(theta), r, before).sum())
            return total if math.isfinite(total) else -1e300

        theta, left = spec.start(r), iterations
        best, done = value(theta), False
        with np.errstate(all="ignore"):
            for _ in range(4):  # a simplex that stopped early moves on when it is made anew
                theta, found, done = climb(value, theta, left // 4)
                if found - best < 1e-6:
                    break
                best = found
            x = spec.natural(theta)
            errors = [float(v) if math.isfinite(v) else None for v in _robust_errors(lambda v: spec.terms(v, r, before), x)]
        last = math.sqrt(spec.variances(x, r, before)[1][-1]) / 100
        return pd.DataFrame([(pdf.symbol.iloc[0], len(r), spec.names, x.tolist(), errors, found, done, last)], columns=columns)

    schema = "symbol string, n long, names array<string>, values array<double>, errors array<double>, loglik double, converged boolean, current_vol double"
    return spread(df.select("symbol", "ts", "r")).groupBy("symbol").applyInPandas(fit, schema)


def estimates(fits: DataFrame) -> DataFrame:
    """symbol, term, estimate, std_error, t_stat, p_value, ci_low, ci_high: parameters for returns in percent, errors robust."""
    rows = fits.select("symbol", F.inline(F.arrays_zip("names", "values", "errors")))
    b, s = F.col("estimate"), F.col("std_error")
    rows = rows.toDF("symbol", "term", "estimate", "std_error").withColumn("t_stat", F.try_divide(b, s))
    return rows.select("*", normal_p(F.col("t_stat")).alias("p_value"), (b - Z95 * s).alias("ci_low"), (b + Z95 * s).alias("ci_high"))


def path(df: DataFrame, fits: DataFrame, model: str = "garch", p: int = 1, o: int = 0, q: int = 1, dist: str = "normal", mean: str = "constant") -> DataFrame:
    """symbol, ts, conditional_vol (a fraction, not percent), std_residual of each return under its symbol's fit of that specification."""
    spec = Model(model, p, o, q, dist, mean)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.dropna(subset=["r"]).sort_values("ts")
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["symbol", "ts", "conditional_vol", "std_residual"])
        r = left.r.to_numpy() * 100
        e, v = spec.variances(np.array(right["values"].iloc[0]), r, _before(r) or float(np.mean((r - r.mean()) ** 2)))
        return pd.DataFrame({"symbol": left.symbol, "ts": left.ts, "conditional_vol": np.sqrt(v) / 100, "std_residual": e / np.sqrt(v)})

    kind = dict(df.dtypes)["ts"]
    both = df.select("symbol", "ts", "r").groupBy("symbol").cogroup(fits.select("symbol", "values").groupBy("symbol"))
    return both.applyInPandas(run, f"symbol string, ts {kind}, conditional_vol double, std_residual double")


def whiteness(paths: DataFrame, lags: int = 10) -> DataFrame:
    """symbol, subject (residuals and their squares, standardised) and the columns of Ljung-Box: what the model leaves."""
    z = F.col("std_residual")
    tests = [ljung_box(paths.select("symbol", "ts", of.alias("r")), lags).select(F.lit(name).alias("subject"), "*") for name, of in (("residuals", z), ("squares", z * z))]
    return tests[0].unionByName(tests[1])


def _sum(prefix: str) -> Column:
    pairs = F.filter(F.arrays_zip("names", "values"), lambda x: F.startswith(x["names"], F.lit(prefix)))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x["values"])


def _summary(df: DataFrame, model: str, p: int, o: int, q: int, dist: str, mean: str, frequency: str) -> DataFrame:
    fits = fitted(df, model, p, o, q, dist, mean)
    k = len(Model(model, p, o, q, dist, mean).names)
    alpha, gamma, beta = _sum("alpha"), _sum("gamma"), _sum("beta")
    held = beta if model == "egarch" else alpha + gamma / 2 + beta
    rows = fits.select("symbol", "n", _sum("omega").alias("omega"), alpha.alias("alpha"), gamma.alias("gamma"), beta.alias("beta"), held.alias("persistence"), "loglik", "converged", "current_vol")
    w, h = F.col("omega"), F.col("persistence")
    level = F.exp(w / (2 * (1 - h))) if model == "egarch" else F.sqrt(w / (1 - h))
    inside = (h > 0) & (h < 1)
    rows = rows.withColumns({"half_life": F.when(inside, F.log(F.lit(0.5)) / F.log(h)), "unconditional_vol": F.when(inside, level / 100)})
    return rows.withColumns({"unconditional_vol_annualised": F.col("unconditional_vol") * math.sqrt(PERIODS[frequency]), "aic": 2 * k - 2 * F.col("loglik"), "bic": k * F.log("n") - 2 * F.col("loglik")})


def garch(df: DataFrame, p: int = 1, q: int = 1, dist: str = "normal", mean: str = "constant", frequency: str = "D") -> DataFrame:
    """A row for each symbol: omega and the sums of alpha and beta, persistence (alpha + beta), likelihood, aic, bic, volatilities. gamma is 0."""
    return _summary(df, "garch", p, 0, q, dist, mean, frequency)


def gjr_garch(df: DataFrame, p: int = 1, o: int = 1, q: int = 1, dist: str = "normal", mean: str = "constant", frequency: str = "D") -> DataFrame:
    """The same with gamma, what falls add; persistence is alpha + gamma / 2 + beta."""
    return _summary(df, "gjr_garch", p, o, q, dist, mean, frequency)


def egarch(df: DataFrame, p: int = 1, o: int = 1, q: int = 1, dist: str = "normal", mean: str = "constant", frequency: str = "D") -> DataFrame:
    """The same of the log variance; persistence is beta, and the unconditional level is that of the mean log variance."""
    return _summary(df, "egarch", p, o, q, dist, mean, frequency)
