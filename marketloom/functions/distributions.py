"""Distribution functions, for the few numbers that a test ends in."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_sf(x: float) -> float:
    return math.erfc(x / math.sqrt(2)) / 2


def normal_ppf(p: float) -> float:
    """By bisection on the tail, to the last bit that matters."""
    low, high = -40.0, 40.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - normal_sf(mid) < p else (low, mid)
    return (low + high) / 2


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi2_sf(x: float, df: float) -> float:
    return _gamma_q(df / 2, x / 2)


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf(t: float, df: float) -> float:
    tail = _beta_i(df / 2, 0.5, df / (df + t * t)) / 2
    return tail if t >= 0 else 1 - tail


def t_ppf(p: float, df: float) -> float:
    """By bisection on the tail."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, df) < p else (low, mid)
    return (low + high) / 2


def f_sf(x: float, d1: float, d2: float) -> float:
    return _beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def kolmogorov_sf(x: float) -> float:
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0


def _column(f, *args: Column) -> Column:
    def each(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*series, strict=True)], dtype="float64")

    kinds = {
        1: lambda a: each(a), 2: lambda a, b: each(a, b), 3: lambda a, b, c: each(a, b, c),
    }
    apply = kinds[len(args)]
    hints = {"a": pd.Series, "b": pd.Series, "c": pd.Series, "return": pd.Series}
    apply.__annotations__ = {k: hints[k] for k in [*"abc"[: len(args)], "return"]}
    return F.pandas_udf(apply, "double")(*args)


def _let(value: Column, then) -> Column:
    """then(value), with the value made once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _upper(z: Column) -> Column:
    """Upper normal tail for z >= 0: a power series below 3, a continued fraction above."""
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    start = F.struct(z.alias("term"), z.alias("total"))

    def add(a: Column, n: Column) -> Column:
        term = a["term"] * z * z / (2 * n + 1)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    series = 0.5 - density * F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, add, lambda a: a["total"])
    fraction = density / F.aggregate(F.sequence(F.lit(80), F.lit(1)), z, lambda f, k: z + k / f)
    return F.when(z < 3, series).otherwise(fraction)


def normal_p(z: Column) -> Column:
    """Two-sided p-value of a standard normal statistic."""
    return _let(F.abs(z).cast("double"), lambda x: 2 * _upper(x))


def normal_cdf(z: Column) -> Column:
    return _let(z.cast("double"), lambda x: F.when(x > 0, 1 - _upper(x)).otherwise(_upper(-x)))


def chi2_p_by(x: Column, df: Column) -> Column:
    """chi2_p() with degrees of freedom from a column, from 1."""
    half, odd = F.greatest(x, F.lit(0.0)) / 2, df % 2 == 1
    first = F.exp(-half) * F.when(odd, F.sqrt(half) / math.gamma(1.5)).otherwise(1.0)
    terms, shift = F.floor(df / 2).cast("int"), F.when(odd, 0.5).otherwise(0.0)
    start = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))
    more = lambda held, j: F.struct((held["sum"] + held["term"]).alias("sum"), (held["term"] * half / (j + shift)).alias("term"))
    sums = F.when(terms >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, more, lambda held: held["sum"])).otherwise(0.0)
    return sums + F.when(odd, normal_p(F.sqrt(2 * half))).otherwise(0.0)


def chi2_p(x: Column, df: int) -> Column:
    """Upper tail of chi-squared with a whole number of degrees of freedom."""
    half = lambda v: F.greatest(v, F.lit(0.0)) / 2
    if df % 2 == 0:
        return _let(half(x), lambda h: F.exp(-h) * sum((F.pow(h, F.lit(float(j))) / float(math.factorial(j)) for j in range(df // 2)), F.lit(0.0)))
    rest = lambda h: sum((F.exp(-h) * F.pow(h, F.lit(j - 0.5)) / math.gamma(j + 0.5) for j in range(1, (df + 1) // 2)), F.lit(0.0))
    return _let(half(x), lambda h: normal_p(F.sqrt(2 * h)) + rest(h))


def t_p(t: Column, df: Column) -> Column:
    return _column(lambda x, n: 2 * t_sf(abs(x), n), t, df.cast("double"))


def t_ppf(p: float, df: float) -> float:
    """By bisection."""
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, df) < p else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: Column) -> Column:
    return _column(lambda n: t_ppf(p, n), df.cast("double"))


def f_p(x: Column, d1: Column, d2: Column) -> Column:
    return _column(f_sf, x, d1.cast("double"), d2.cast("double"))


#: Rational approximation of the normal inverse after Acklam: numerator and denominator in the middle and in the tails.
ACKLAM_MIDDLE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_MIDDLE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
ACKLAM_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
ACKLAM_EDGE = 0.02425


def normal_quantile(p: Column) -> Column:
    """The normal inverse of p in (0, 1), to about nine digits."""
    poly = lambda c, x: functools.reduce(lambda v, k: v * x + k, c[1:], F.lit(c[0]))
    tail = lambda q: _let(F.sqrt(-2 * F.log(q)), lambda r: poly(ACKLAM_TAIL, r) / poly(ACKLAM_TAIL_BELOW, r))
    middle = _let(p - 0.5, lambda q: q * poly(ACKLAM_MIDDLE, q * q) / poly(ACKLAM_MIDDLE_BELOW, q * q))
    return F.when(p < ACKLAM_EDGE, tail(p)).when(p > 1 - ACKLAM_EDGE, -tail(1 - p)).otherwise(middle)


#: MacKinnon's response surfaces, by trend (n none, c constant, ct with a trend) and number of series: where the
#: small-p polynomial ends, the least and largest statistic, and the polynomials; normal quantiles by powers of the statistic.
INF = math.inf
SURFACES = {
    ("n", 1): (-1.04, -19.04, INF, (0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066)),
    ("c", 1): (-1.61, -18.83, 2.74, (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)),
    ("c", 2): (-2.62, -18.86, 0.92, (2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377)),
    ("c", 3): (-3.13, -23.48, 0.55, (3.4699, 1.4856, 0.03164), (2.5893, 0.45168, -0.36529, -0.050074)),
    ("c", 4): (-3.47, -28.07, 0.61, (3.9673, 1.4777, 0.026315), (3.0387, 0.45452, -0.33666, -0.041921)),
    ("c", 5): (-3.78, -25.96, 0.79, (4.5509, 1.5338, 0.029545), (3.5049, 0.52098, -0.29158, -0.033468)),
    ("c", 6): (-3.93, -23.27, 1.0, (5.1399, 1.6036, 0.034445), (3.9489, 0.58933, -0.25359, -0.02721)),
    ("ct", 1): (-2.89, -16.18, 0.7, (3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285)),
}

#: MacKinnon's critical values at 1, 5 and 10 %, by powers of 1 / nobs.
CRITICAL = {
    ("n", 1): ((-2.56574, -2.2358, -3.627, 0.0), (-1.941, -0.2686, -3.365, 31.223), (-1.61682, 0.2656, -2.714, 25.364)),
    ("c", 1): ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.04), (-2.56677, -1.5384, -2.809, 0.0)),
    ("c", 2): ((-3.89644, -10.9519, -22.527, 0.0), (-3.33613, -6.1101, -6.823, 0.0), (-3.04445, -4.2412, -2.72, 0.0)),
    ("c", 3): ((-4.29374, -14.4354, -33.195, 47.433), (-3.74066, -8.5631, -10.852, 27.982), (-3.45218, -6.2143, -3.718, 0.0)),
    ("ct", 1): ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.38)),
}

#: Critical values of the KPSS statistic around a level and around a trend, and their p-values.
KPSS_CRITICAL = {
    "c": ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)),
    "ct": ((0.119, 0.10), (0.146, 0.05), (0.176, 0.025), (0.216, 0.01)),
}


def unit_root_sf(tau: float, trend: str = "c", series: int = 1) -> float:
    switch, _, most, small, large = SURFACES[trend, series]
    if tau > most:
        return 1.0
    return normal_sf(-sum(c * tau**i for i, c in enumerate(small if tau <= switch else large)))


def unit_root_p(tau: Column, trend: str = "c", series: int = 1) -> Column:
    """p-value of a Dickey-Fuller or Phillips-Perron t, or of one of the residuals of so many series."""
    switch, _, most, small, large = SURFACES[trend, series]

    def tail(t: Column) -> Column:
        poly = lambda c: sum((F.lit(x) * F.pow(t, F.lit(float(i))) for i, x in enumerate(c)), F.lit(0.0))
        return F.when(t > most, 1.0).otherwise(normal_cdf(F.when(t <= switch, poly(small)).otherwise(poly(large))))

    return _let(tau, tail)


def critical_values(nobs: Column, trend: str = "c", series: int = 1) -> list[Column]:
    """critical_1, critical_5 and critical_10, per cent; null where no table is at hand."""
    rows = CRITICAL.get((trend, series), ((None,),) * 3)
    each = [F.lit(None).cast("double") if c[0] is None else sum((F.lit(x) / F.pow(nobs.cast("double"), F.lit(float(i))) for i, x in enumerate(c)), F.lit(0.0)) for c in rows]
    return [v.alias(f"critical_{p}") for v, p in zip(each, (1, 5, 10), strict=True)]


def kolmogorov_p(x: Column) -> Column:
    """Tail of the Kolmogorov distribution."""
    terms = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * x * x) for k in range(1, 41)), F.lit(0.0))
    return F.when(x > 0.2, F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms))).otherwise(1.0)


def kpss_p(x: Column, trend: str = "c") -> Column:
    """p-value by lines between the published critical values, within 0.01 and 0.1."""
    table = KPSS_CRITICAL[trend]
    out = F.lit(table[-1][1])
    for (a, p), (b, q) in reversed(list(zip(table, table[1:], strict=False))):
        out = F.when(x < b, p + (x - a) * (q - p) / (b - a)).otherwise(out)
    return F.when(x <= table[0][0], table[0][1]).otherwise(out)
