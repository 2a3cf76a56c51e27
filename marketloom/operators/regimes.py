"""Markov switching of mean and variance: the filter runs along a series, so each symbol is one group; symbols run in parallel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _smoothed(y: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Probabilities of the regimes given all values, expected moves between them, and the log likelihood."""
    density = np.exp(-0.5 * (y[:, None] - mean) ** 2 / var) / np.sqrt(2 * math.pi * var)
    k, rows, chance = density.shape[1], density.tolist(), move.tolist()
    each, ahead, scale, now = range(k), [], [], start.tolist()
    for d in rows:  # along the series, forwards and back; plain numbers, as the regimes are few
        a = [now[i] * d[i] for i in each]
        total = sum(a) or 1e-300
        a = [x / total for x in a]
        ahead.append(a)
        scale.append(total)
        now = [sum(a[i] * chance[i][j] for i in each) for j in each]
    back, later, moves = [[1.0] * k], [1.0] * k, [[0.0] * k for _ in each]
    for t in range(len(rows) - 2, -1, -1):
        w = [rows[t + 1][j] * later[j] / scale[t + 1] for j in each]
        for i in each:
            for j in each:
                moves[i][j] += ahead[t][i] * chance[i][j] * w[j]
        later = [sum(chance[i][j] * w[j] for j in each) for i in each]
        back.append(later)
    return np.array(ahead) * np.array(back[::-1]), np.array(moves), float(np.log(scale).sum())


def _fitted(y: np.ndarray, k: int, switching_variance: bool, rounds: int) -> tuple:
    """The best of two starts: regimes apart in level and apart in spread. Regimes come by variance, or by mean where that is shared."""
    best = None
    for level, spread in ((1.0, 0.5), (0.2, 1.5)):
        at = np.linspace(-1, 1, k)
        mean, var = y.mean() + level * y.std() * at, y.var() * np.exp(spread * at)
        move, start = np.full((k, k), 0.1 / max(1, k - 1)), np.full(k, 1 / k)
        np.fill_diagonal(move, 0.9)
        last = -math.inf
        for _ in range(rounds):
            p, moves, value = _smoothed(y, start, move, mean, var)
            weight = np.maximum(p.sum(0), 1e-12)
            mean = p.T @ y / weight
            apart = (p * (y[:, None] - mean) ** 2).sum(0)
            var = np.maximum(apart / weight if switching_variance else np.full(k, apart.sum() / len(y)), 1e-8 * y.var())
            move, start = moves / np.maximum(moves.sum(1, keepdims=True), 1e-300), p[0]
            if value - last < 1e-7 * abs(value):
                break
            last = value
        if best is None or value > best[0]:
            best = (value, mean, var, move, p)
    value, mean, var, move, p = best
    order = np.argsort(var if switching_variance else mean, kind="stable")
    return value, mean[order], var[order], move[np.ix_(order, order)], p[:, order]


def _groups(df: DataFrame, make, schema: str, column: str, k: int, switching_variance: bool, rounds: int) -> DataFrame:
    if not 2 <= k <= 4:
        raise ValueError("two to four regimes")
    names = [c.split()[0] for c in schema.split(", ")]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values("ts")
        y = pdf["y"].to_numpy(dtype=float)
        if len(y) < 10 * k or not np.ptp(y):
            return pd.DataFrame([], columns=names)
        return pd.DataFrame(make(pdf, *_fitted(y, k, switching_variance, rounds)), columns=names)

    return df.selectExpr("symbol", "ts", f"{column} AS y").groupBy("symbol").applyInPandas(fit, schema)


def markov_switching(df: DataFrame, k: int = 2, switching_variance: bool = True, column: str = "r", rounds: int = 200) -> DataFrame:
    """symbol, regime, mean, variance, share, duration (expected), to_0 .. (chances of the next regime), loglik, by expectation maximisation."""
    moves = [f"to_{j}" for j in range(k)]

    def rows(pdf, value, mean, var, move, p):
        return [(pdf.symbol.iloc[0], i, mean[i], var[i], p[:, i].mean(), 1 / max(1e-12, 1 - move[i, i]), *move[i], value) for i in range(k)]

    kinds = ", ".join(f"{c} double" for c in ["mean", "variance", "share", "duration", *moves, "loglik"])
    return _groups(df, rows, f"symbol string, regime int, {kinds}", column, k, switching_variance, rounds)


def regime_path(df: DataFrame, k: int = 2, switching_variance: bool = True, column: str = "r", rounds: int = 200) -> DataFrame:
    """symbol, ts, regime, probability: the likeliest regime of each date given the whole series."""

    def rows(pdf, value, mean, var, move, p):
        return zip(pdf.symbol, pdf.ts, p.argmax(1).astype(int), p.max(1), strict=True)

    return _groups(df, rows, f"symbol string, ts {dict(df.dtypes)['ts']}, regime int, probability double", column, k, switching_variance, rounds)
