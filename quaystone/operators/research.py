"""Positions, profit and loss, statistics and risk over panels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 244


def response(kind: str, y: Column, p: float = 1.0) -> Column:
    """Response curves; the scale that keeps a normal signal's variance at one is worked out beforehand."""
    phi = math.exp(-p * p / 2) / math.sqrt(2 * math.pi)
    tail = 0.5 * math.erfc(p / math.sqrt(2))
    clipped = F.least(F.lit(p), F.greatest(F.lit(-p), y))
    if kind == "reverting":
        return (1 + 2 / p**2) ** 0.75 * y * F.exp(-0.5 * (y / p) ** 2)
    if kind == "absorbing":
        return (1 + 6 / p**2) ** 1.75 / math.sqrt(15) * y**3 * F.exp(-1.5 * (y / p) ** 2)
    if kind == "sigmoid":
        return y / F.sqrt(p * p + y * y) / math.sqrt(1 - math.sqrt(math.pi / 2) * p * math.exp(p * p / 2) * math.erfc(p / math.sqrt(2)))
    if kind == "semilinear":
        return clipped / math.sqrt(p * p + (1 - p * p) * (1 - 2 * tail) - 2 * p * phi)
    if kind == "buffer":
        return (y - clipped) / math.sqrt(2 * ((1 + p * p) * tail - p * phi))
    if kind == "band":
        return F.when(F.abs(y) > p, y).otherwise(0.0) / math.sqrt(2 * tail + 2 * p * phi)
    return F.when(y >= 0, 1.0).otherwise(-1.0) if kind == "sign" else y


def pnl(panel: DataFrame, cost: float = 0.0005) -> DataFrame:
    """panel: asset, date, holding (known at the day's end), ret. P&L of yesterday's holding less the cost of changing it."""
    w = Window.partitionBy("asset").orderBy("date")
    held = panel.withColumn("held", F.lag("holding").over(w))
    return held.withColumn("pnl", F.coalesce(F.col("held") * F.col("ret"), F.lit(0.0)) - F.coalesce(F.abs(F.col("held") - F.lag("held").over(w)), F.lit(0.0)) * cost)


def stats(series: DataFrame, *keys: str) -> DataFrame:
    """Sharpe (of the sample's and of the population's deviation), Sortino, total, success rate, worst drawdown and Calmar of daily pnl by keys (date ordered)."""
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    s = series.withColumn("cum", F.sum("pnl").over(w))
    s = s.withColumn("dd", F.col("cum") - F.greatest(F.max("cum").over(w), F.lit(0.0)))
    out = s.groupBy(*keys).agg(F.count("*").alias("days"), F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("sd"), F.stddev_pop("pnl").alias("sdp"), F.sqrt(F.avg(F.pow(F.least("pnl", F.lit(0.0)), F.lit(2)))).alias("down"), F.sum("pnl").alias("total"), F.avg(F.when(F.col("pnl") != 0, (F.col("pnl") > 0).cast("double"))).alias("success"), F.min("dd").alias("max_dd"))
    zero = F.lit(0)
    return out.withColumns({"sharpe": F.col("m") / F.nullif("sd", zero) * math.sqrt(YEAR), "sharpe_pop": F.col("m") / F.nullif("sdp", zero) * math.sqrt(YEAR), "sortino": F.col("m") / F.nullif("down", zero) * math.sqrt(YEAR), "calmar": F.col("m") * YEAR / F.nullif(-F.col("max_dd"), zero)}).drop("m", "sd", "sdp", "down")


def tenors(series: DataFrame, years: list[int]) -> DataFrame:
    """The series once per tenor: its last n years (0: all)."""
    last = series.agg(F.max("date").alias("last"))
    each = series.crossJoin(F.broadcast(last)).withColumn("tenor", F.explode(F.lit(years)))
    return each.where((F.col("tenor") == 0) | (F.col("date") > F.add_months("last", -12 * F.col("tenor")))).drop("last")


def correlations(rets: DataFrame) -> DataFrame:
    """Correlation and covariance of every two assets' returns on common dates: long, joined on the date."""
    a, b = rets.select("date", F.col("asset").alias("a"), F.col("ret").alias("x")), rets.select("date", F.col("asset").alias("b"), F.col("ret").alias("y"))
    return a.join(b, "date").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.covar_samp("x", "y").alias("cov"), F.count("*").alias("n"))


def risk(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """Each asset's marginal part of the portfolio's deviation, and its 95 % value at risk."""
    a, b = rets.select("date", F.col("asset").alias("a"), F.col("ret").alias("x")), rets.select("date", F.col("asset").alias("b"), F.col("ret").alias("y"))
    cov = a.join(b, "date").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("cov"))
    j = cov.join(weights.select(F.col("asset").alias("b"), F.col("w").alias("wb")), "b").groupBy("a").agg(F.sum(F.col("cov") * F.col("wb")).alias("cw"))
    j = j.join(weights.select(F.col("asset").alias("a"), F.col("w").alias("wa")), "a")
    var = j.withColumn("var", F.sum(F.col("cw") * F.col("wa")).over(Window.partitionBy(F.lit(0))))
    return var.select(F.col("a").alias("asset"), (F.col("wa") * F.col("cw") / F.sqrt("var")).alias("part"), (1.6448536269514722 * F.sqrt("var")).alias("var95"))


def adf(df: DataFrame, lags: int = 1) -> DataFrame:
    """Augmented Dickey-Fuller statistic of x with a constant, per asset, by least squares on the lag matrix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")["x"].to_numpy(float)
        d = np.diff(x)
        y = d[lags:]
        m = np.column_stack([x[lags:-1], np.ones(len(y)), *[d[lags - k : -k] for k in range(1, lags + 1)]])
        if len(y) <= m.shape[1] + 1:
            return pd.DataFrame({"asset": pdf["asset"][:1], "adf": [np.nan], "n": [len(y)]})
        beta, *_ = np.linalg.lstsq(m, y, rcond=None)
        e = y - m @ beta
        se = math.sqrt((e @ e) / (len(y) - m.shape[1]) * np.linalg.inv(m.T @ m)[0, 0])
        return pd.DataFrame({"asset": pdf["asset"][:1], "adf": [beta[0] / se], "n": [len(y)]})

    return df.groupBy("asset").applyInPandas(run, "asset string, adf double, n long")


def kalman(df: DataFrame, delta: float = 1e-4, noise: float = 1e-3) -> DataFrame:
    """Time-varying slope and intercept of y on x, per asset."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        theta, p, out = np.zeros(2), np.zeros((2, 2)), np.empty((len(pdf), 2))
        for i, (x, y) in enumerate(pdf[["x", "y"]].to_numpy(float)):
            h = np.array([x, 1.0])
            r = p + delta / (1 - delta) * np.eye(2)
            k = r @ h / (h @ r @ h + noise)
            theta = theta + k * (y - h @ theta)
            p = r - np.outer(k, h) @ r
            out[i] = theta
        return pdf[["asset", "date"]].assign(slope=out[:, 0], intercept=out[:, 1])

    return df.groupBy("asset").applyInPandas(run, "asset string, date date, slope double, intercept double")


def johansen(df: DataFrame, lags: int = 1) -> DataFrame:
    """Trace and largest-eigenvalue statistics per rank for groups of series (g, date, name, x) on their common dates.

    A group is a handful of series: differences and lagged levels are freed of lagged differences and a constant, and
    the eigenvalues of their squared canonical correlations give the statistics.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="name", values="x").dropna().sort_index().to_numpy(float)
        d = np.diff(wide, axis=0)
        rows = len(d) - lags
        if rows <= wide.shape[1] * (lags + 2):
            return pd.DataFrame(columns=["g", "rank", "trace", "largest", "n"])
        known = np.column_stack([np.ones(rows), *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]])
        free = lambda y: y - known @ np.linalg.lstsq(known, y, rcond=None)[0]
        r0, r1 = free(d[lags:]), free(wide[lags:-1])
        s00, s01, s11 = r0.T @ r0, r0.T @ r1, r1.T @ r1
        roots = np.sort(np.linalg.eigvals(np.linalg.solve(s11, s01.T) @ np.linalg.solve(s00, s01)).real)[::-1].clip(0, 1 - 1e-12)
        gains = -rows * np.log1p(-roots)
        return pd.DataFrame({"g": pdf["g"].iloc[0], "rank": range(len(roots)), "trace": gains[::-1].cumsum()[::-1], "largest": gains, "n": rows})

    return df.groupBy("g").applyInPandas(run, "g string, rank int, trace double, largest double, n long")


def traded_pnl(panel: DataFrame) -> DataFrame:
    """panel: asset, date, pos, trade_px, close. The old position from close to close, its change from the trade price to the close."""
    w = Window.partitionBy("asset").orderBy("date")
    p = panel.withColumns({"held": F.coalesce(F.lag("pos").over(w), F.lit(0.0)), "last_close": F.lag("close").over(w)})
    return p.withColumn("pnl", F.coalesce(F.col("held") * (F.col("close") - F.col("last_close")), F.lit(0.0)) + (F.col("pos") - F.col("held")) * (F.col("close") - F.col("trade_px")))
