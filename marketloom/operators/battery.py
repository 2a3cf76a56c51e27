"""The battery of residual checks in one pass: one window over each series, one aggregation, and small systems solved from its row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import chi2_p, chi2_p_by, kolmogorov_p
from .gram import _solvable

#: The fewest residuals, most lags, Durbin-Watson's band, thresholds of inflation and of a shift in standard deviations.
LEAST, MOST_LAGS, BAND, INFLATED, MATERIAL = 20, 10, (1.5, 2.5), 10.0, 0.5
NEED_REGRESSORS = ("breusch_pagan", "white", "vif")
CHECKS = ("jarque_bera", "breusch_pagan", "white", "durbin_watson", "ljung_box", "arch_lm", "vif", "cusum", "structural_break")


def default_lags(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MOST_LAGS), F.floor(n / 5))).cast("int")


def _products(xs: list[str]) -> list[Column]:
    return [F.col(a) * F.col(b) for i, a in enumerate(xs) for b in xs[i:]]


def _products_of(prefix: str, columns: list[Column]) -> list[Column]:
    """Sums, products and number of columns that are near zero on average already, and null together."""
    pairs = [F.sum(columns[i] * columns[j]).alias(f"{prefix}_{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))]
    return [*pairs, *[F.sum(c).alias(f"{prefix}_s{i}") for i, c in enumerate(columns)], F.count(columns[-1]).alias(f"{prefix}_n")]


def _matrices(pdf: pd.DataFrame, prefix: str, k: int) -> np.ndarray:
    """Products about the means, stacked."""
    out = np.empty((len(pdf), k, k))
    for i in range(k):
        for j in range(i, k):
            out[:, i, j] = out[:, j, i] = pdf[f"{prefix}_{i}_{j}"].to_numpy(dtype=float)
    sums = np.column_stack([pdf[f"{prefix}_s{i}"].to_numpy(dtype=float) for i in range(k)])
    return out - sums[:, :, None] * sums[:, None, :] / np.maximum(pdf[f"{prefix}_n"].to_numpy(), 1)[:, None, None]


def _explained(g: np.ndarray) -> np.ndarray:
    """R2 of the last column on the others, of stacked matrices; not a number where it can't be had."""
    x, scale = g[:, :-1, :-1], np.sqrt(np.maximum(np.einsum("gii->gi", g), 0))
    out = np.full(len(g), np.nan)
    good = _solvable(x, scale[:, :-1]) & (scale[:, -1] > 0)
    if good.any():
        unit = g[good] / (scale[good][:, :, None] * scale[good][:, None, :])
        b = np.linalg.solve(unit[:, :-1, :-1], unit[:, :-1, -1:])[:, :, 0]
        out[good] = np.einsum("gi,gi->g", b, unit[:, :-1, -1])
    return out


def report(df: DataFrame, xs: list[str] | None = None, column: str = "residual", checks: list[str] | None = None, lags: int | None = None, alpha: float = 0.05) -> DataFrame:
    """symbol, check, lags, statistic, p_value, passed, detail: every check that applies to each series of residuals.

    Without regressors the three checks that need them are passed over; asked for by name, that is an error. vif has a row
    for each regressor that varies (vif_name), if two do. lags (of ljung_box and arch_lm) follow from the length where none are
    given. passed is null where residuals are degenerate, which means not judged; statistic is 0 then. detail is the effect of
    structural_break, whose statistic is the break's place as a share of the series. Series with fewer than LEAST residuals are left
    out. A series is one window; everything else is sums.
    """
    xs = list(xs or [])
    wanted = list(checks) if checks is not None else [c for c in CHECKS if xs or c not in NEED_REGRESSORS]
    if unknown := [c for c in wanted if c not in CHECKS]:
        raise ValueError(f"unknown checks {unknown}; there are {', '.join(CHECKS)}")
    if lacking := [c for c in wanted if c in NEED_REGRESSORS and not xs]:
        raise ValueError(f"{', '.join(lacking)} need regressors")
    deepest = lags or MOST_LAGS
    whole, order = Window.partitionBy("symbol"), Window.partitionBy("symbol").orderBy("ts")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    e = F.col("e")
    held = [f"x{i}" for i in range(len(xs))]  # whatever the regressors are called
    rows = df.where(F.col(column).isNotNull() & ~F.isnan(column)).select("symbol", "ts", F.col(column).cast("double").alias("e"), *[F.col(x).cast("double").alias(h) for x, h in zip(xs, held, strict=True)])
    complete = F.lit(True)
    for x in held:
        complete = complete & F.col(x).isNotNull()
    wide = {f"w{i}": F.when(complete, c) for i, c in enumerate([*map(F.col, held), *_products(held), e * e])} if xs else {}
    rows = rows.withColumns(wide).withColumn("q", e * e)
    rows = rows.withColumns({c: F.col(c) - F.avg(c).over(whole) for c in [*wide, "q"]})
    rows = rows.select("*", F.count("*").over(whole).alias("n"), (e - F.avg("e").over(whole)).alias("d"), F.stddev_pop("e").over(whole).alias("sd"), F.row_number().over(order).alias("k"))
    rows = rows.where(F.col("n") >= LEAST).withColumn("L", F.lit(lags) if lags else default_lags(F.col("n")))
    rows = rows.select(
        "*", F.sum("d").over(upto).alias("s"), F.lag("e").over(order).alias("e1"), *[F.lag("d", i).over(order).alias(f"d{i}") for i in range(1, deepest + 1)],
        *[F.lag("q", i).over(order).alias(f"q{i}") for i in range(1, deepest + 1)],
    )
    squared, left, right = e * e, F.col("s") / F.col("k"), -F.col("s") / (F.col("n") - F.col("k"))
    gain = F.when((F.col("k") >= 2) & (F.col("n") - F.col("k") >= 2) & (F.col("k") % 5 == 0), F.col("k") * left * left + (F.col("n") - F.col("k")) * right * right)
    late = F.col("k") > F.col("L")
    # rows without enough before them are null in all columns, lags beyond a series' own are null in theirs and not used
    lagged = [*[F.when(late & (F.lit(i) <= F.col("L")), F.col(f"q{i}")) for i in range(1, deepest + 1)], F.when(late, F.col("q"))]
    sums = [
        F.first("L").alias("lags"), F.count("*").alias("n"), F.skewness("e").alias("skew"), F.kurtosis("e").alias("kurt"), F.sum(squared).alias("ee"), F.sum(F.pow(e - F.col("e1"), F.lit(2))).alias("steps"),
        F.sum(F.col("d") * F.col("d")).alias("c0"), *[F.sum(F.when(F.lit(i) <= F.col("L"), F.col("d") * F.col(f"d{i}"))).alias(f"c{i}") for i in range(1, deepest + 1)],
        F.max(F.abs("s")).alias("far"), F.max_by(F.struct("k", F.try_divide(F.abs(right - left), F.col("sd")).alias("effect")), F.struct(gain.alias("gain"), (-F.col("k")).alias("first"))).alias("shift"),
        *_products_of("arch", lagged),
    ]
    if xs:
        sums += _products_of("white", [F.col(c) for c in wide])
    s = rows.groupBy("symbol").agg(*sums)
    kind, k = dict(df.dtypes)["symbol"], len(xs)
    columns = len(wide)

    def solve(batches):
        for pdf in batches:
            g, deep = _matrices(pdf, "arch", deepest + 1), pdf["lags"].to_numpy()
            found = np.full(len(pdf), np.nan)
            for L in np.unique(deep):
                at, use = np.flatnonzero(deep == L), [*range(L), deepest]
                found[at] = _explained(g[at][:, use][:, :, use]) * pdf["arch_n"].to_numpy()[at]
            out = {"arch": found}
            if xs:
                w, n = _matrices(pdf, "white", columns), pdf["white_n"].to_numpy()
                use = [*range(k), columns - 1]
                out |= {"breusch": _explained(w[:, use][:, :, use]) * n, "white": _explained(w) * n}
                varies = np.einsum("gii->gi", w)[:, :k] > 0
                for i in range(k):
                    others = np.full(len(pdf), np.nan)
                    for row in np.flatnonzero(varies[:, i] & (varies.sum(1) >= 2)):
                        use = [j for j in range(k) if varies[row, j] and j != i] + [i]
                        others[row] = 1 / (1 - _explained(w[row : row + 1][:, use][:, :, use])[0])
                    out[f"vif{i}"] = np.where(varies[:, i] & (varies.sum(1) >= 2), np.where(np.isfinite(others), others, -1.0), np.nan)
            yield pdf[["symbol"]].assign(**{c: pd.array(np.where(np.isfinite(v), v, np.nan), "Float64") for c, v in out.items()})

    solved = ["arch", *(["breusch", "white", *[f"vif{i}" for i in range(k)]] if xs else [])]
    systems = s.mapInPandas(solve, f"symbol {kind}, " + ", ".join(f"{c} double" for c in solved))
    systems = systems.select("symbol", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in solved])
    return _judged(s.join(systems, "symbol"), xs, wanted, deepest, alpha)


def _judged(s: DataFrame, xs: list[str], wanted: list[str], deepest: int, alpha: float) -> DataFrame:
    n, lags = F.col("n"), F.col("lags")
    box = n * (n + 2) * sum((F.coalesce(F.pow(F.col(f"c{i}") / F.col("c0"), F.lit(2)), F.lit(0.0)) / (n - i) for i in range(1, deepest + 1)), F.lit(0.0))
    spread = F.col("c0") > 0
    normal = F.when(spread, n / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4))
    watson, cusum = F.try_divide(F.col("steps"), F.col("ee")), F.when(spread, F.col("far") / F.sqrt("c0"))
    tests = {
        "jarque_bera": (normal, F.exp(-normal / 2)), "ljung_box": (F.when(spread, box), chi2_p_by(box, lags)), "arch_lm": (F.col("arch"), chi2_p_by(F.col("arch"), lags)), "cusum": (cusum, kolmogorov_p(cusum)),
    }
    nothing = F.lit(None).cast("double")
    if xs:
        tests |= {"breusch_pagan": (F.col("breusch"), chi2_p(F.col("breusch"), len(xs))), "white": (F.col("white"), chi2_p(F.col("white"), len(xs) + len(_products(xs))))}
    rows = {c: (stat, p, p >= alpha, nothing) for c, (stat, p) in tests.items()}
    rows["durbin_watson"] = (watson, nothing, watson.between(*BAND), nothing)
    effect = F.col("shift.effect")
    rows["structural_break"] = (F.when(effect.isNotNull(), F.col("shift.k") / n), nothing, effect < MATERIAL, effect)
    lagged = {"ljung_box", "arch_lm"}
    each = []
    for check in wanted:
        if check == "vif":
            for i, x in enumerate(xs):
                v = F.col(f"vif{i}")
                each.append(F.when(v.isNotNull(), _row(f"vif_{x}", None, F.when(v > 0, v), nothing, F.when(v > 0, v < INFLATED), nothing)))
        else:
            each.append(_row(check, lags if check in lagged else None, *rows[check]))
    return s.select("symbol", F.explode(F.array_compact(F.array(*each))).alias("x")).select("symbol", "x.*")


def _row(check: str, lags: Column | None, stat: Column, p: Column, passed: Column, detail: Column) -> Column:
    judged = stat.isNotNull()
    return F.struct(
        F.lit(check).alias("check"), (F.lit(None) if lags is None else lags).cast("int").alias("lags"), F.coalesce(stat, F.lit(0.0)).alias("statistic"),
        F.when(judged, p).alias("p_value"), F.when(judged, passed).alias("passed"), F.when(judged, detail).alias("detail"),
    )
