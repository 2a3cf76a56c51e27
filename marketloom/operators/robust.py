"""Least squares with robust covariances: HC3 and Newey-West, from a second pass over the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import normal_p
from .gram import CONST, cross_products, matrix


def _solved(rows: DataFrame, terms: list[str], y: str, by: list[str]) -> DataFrame:
    """One row a group: nobs, b (estimates) and inverse (of the cross products, row by row)."""
    sums = rows.groupBy(*by).agg(*cross_products([*terms, y]), F.count("*").alias("nobs"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.schema if f.name in by)
    k = len(terms)

    def solve(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                g = matrix(row, k + 1)
                if row["nobs"] > k and np.linalg.matrix_rank(g[:k, :k]) == k:
                    inverse = np.linalg.inv(g[:k, :k])
                    out.append((*[row[c] for c in by], int(row["nobs"]), (inverse @ g[:k, k]).tolist(), inverse.reshape(-1).tolist()))
            yield pd.DataFrame(out, columns=[*by, "nobs", "b", "inverse"])

    return sums.mapInPandas(solve, f"{kinds}, nobs long, b array<double>, inverse array<double>")


def robust_ols(df: DataFrame, y: str, xs: list[str], by: list[str], cov: str = "white", lags: int | None = None, order: str = "ts") -> DataFrame:
    """Per group and term: estimate, std_error, z_stat, p_value (normal) and nobs.

    cov: `white` is HC3, each residual divided by one less its leverage; `newey_west` has Bartlett weights over
    `lags` rows in `order`, floor(4 (n / 100)^(2/9)) if not given. Estimates are those of plain least squares. Rows
    with nulls, and groups that can't be solved, are left out.
    """
    if cov not in ("white", "newey_west"):
        raise ValueError(f"unknown covariance {cov!r}: white or newey_west")
    terms = [CONST, *xs]
    k = len(terms)
    rows = df.na.drop(subset=[*xs, y])
    fit = _solved(rows, terms, y, by)
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in xs]]
    e = F.col(y) - sum((F.col("b")[i] * v for i, v in enumerate(x)), F.lit(0.0))
    if cov == "white":
        e = e / (1 - sum((F.col("inverse")[i * k + j] * x[i] * x[j] for i in range(k) for j in range(k)), F.lit(0.0)))
    u = rows.join(fit, by).select(*by, order, "nobs", *[(e * v).alias(f"u{i}") for i, v in enumerate(x)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    meat = {(i, j): F.col(f"u{i}") * F.col(f"u{j}") for i, j in pairs}
    if cov == "newey_west":
        own = F.lit(lags) if lags is not None else F.floor(4 * F.pow(F.col("nobs") / 100, F.lit(2 / 9)))
        most = lags if lags is not None else fit.agg(F.max(F.floor(4 * F.pow(F.col("nobs") / 100, F.lit(2 / 9))))).first()[0] or 0
        along = Window.partitionBy(*by).orderBy(order)
        u = u.select("*", *[F.lag(f"u{i}", n).over(along).alias(f"u{i}_{n}") for n in range(1, most + 1) for i in range(k)])
        for i, j in pairs:
            for n in range(1, most + 1):
                both = F.col(f"u{i}") * F.col(f"u{j}_{n}") + F.col(f"u{i}_{n}") * F.col(f"u{j}")
                meat[i, j] = meat[i, j] + F.greatest(F.lit(0.0), 1 - n / (own + 1)) * F.coalesce(both, F.lit(0.0))
    sums = u.groupBy(*by).agg(*[F.sum(v).alias(f"{i}_{j}") for (i, j), v in meat.items()])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fit.schema if f.name in by)

    def sandwich(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                inverse = np.array(row["inverse"]).reshape(k, k)
                se = np.sqrt(np.maximum(np.diag(inverse @ matrix(row, k) @ inverse), 0))
                b = row["b"]
                out += [(*[row[c] for c in by], t, b[i], se[i], b[i] / se[i] if se[i] > 0 else None, row["nobs"]) for i, t in enumerate(terms)]
            yield pd.DataFrame(out, columns=[*by, "term", "estimate", "std_error", "z_stat", "nobs"])

    found = sums.join(fit, by).mapInPandas(sandwich, f"{kinds}, term string, estimate double, std_error double, z_stat double, nobs long")
    return found.withColumn("p_value", normal_p(F.col("z_stat")))
