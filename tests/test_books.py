"""Books of holdings against pandas."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaystone.operators import books as bk


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2023-01-02", periods=120).date
    out = []
    for k, a in enumerate("ab"):
        close = 100 * np.exp(rng.normal(0, 0.01, 120).cumsum())
        holding = np.where(rng.random(120) < 0.1, np.nan, rng.normal(0.5, 1, 120))
        out.append(pd.DataFrame({"asset": a, "date": days, "close": close, "trade_px": close * (1 + rng.normal(0, 0.001, 120)), "holding": holding, "index_holding": 1.0 + k, "pos": np.sign(rng.normal(size=120)), "cost": 0.001}))
    pdf = pd.concat(out, ignore_index=True)
    pdf["ret"] = pdf.groupby("asset")["close"].pct_change()
    return pdf


def frame(spark, pdf):
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "asset string, date date, close double, trade_px double, holding double, index_holding double, pos double, cost double, ret double")


def wide(pdf, c):
    return pdf.pivot(index="date", columns="asset", values=c).astype(float)


def same(got, want, c):
    assert np.allclose(wide(got, c), want.reindex(sorted(set(got["date"]))).to_numpy(), equal_nan=True)


def test_tilt_and_scaling(spark, made):
    h, r = wide(made, "holding"), wide(made, "ret")
    got = bk.tilt_timing(frame(spark, made), 30).toPandas()
    same(got, h.rolling(30, min_periods=1).mean(), "tilt")
    same(got, h - h.mean(), "whole_timing")
    same(bk.vol_scaled(frame(spark, made), 40).toPandas(), h / r.rolling(40, min_periods=1).std(), "scaled")


@pytest.mark.parametrize("portfolio", [False, True])
def test_beta_hedges(spark, made, portfolio):
    got = bk.beta_hedged(frame(spark, made), portfolio, win=30).toPandas()
    h, i, r = wide(made, "holding").ffill(), wide(made, "index_holding").ffill(), wide(made, "ret")
    pnl, index = (h.shift(1).fillna(0) * r).iloc[1:], (i.shift(1).fillna(0) * r).iloc[1:]
    a, b = (pd.DataFrame({k: x.sum(axis=1) for k in "ab"}) for x in (pnl, index)) if portfolio else (pnl, index)
    a, b = a.rolling(5).mean(), b.rolling(5).mean()
    beta = pd.DataFrame({k: b[k].rolling(30).cov(a[k]) / b[k].rolling(30).var() for k in "ab"}).clip(0, 1e5).ffill()
    assert beta.notna().any().all()
    same(got, beta, "beta")
    same(got, (h - i * beta).loc[beta.index], "neutral")
    same(got, pnl - index * beta, "hedged")


def test_trades_and_their_bundle(spark, made):
    pos, close, px = (wide(made, c) for c in ("pos", "close", "trade_px"))
    held = pos.shift(1).fillna(0)
    same(bk.traded_returns(frame(spark, made)).toPandas(), held * close.pct_change().fillna(0) + (pos - held) * (close / px - 1) - (pos - held).abs() * 0.001, "pnl")
    days = bk.simulated(frame(spark, made), (0.1, 0.2))
    got = days.toPandas().set_index("date").sort_index()
    want = (pos * (close - px) + (pos.shift(1) * (px - close.shift(1))).fillna(0) - 0.001).sum(axis=1)
    assert np.allclose(got["pnl"], want) and np.allclose(got["margin"], np.maximum(pos * close * 0.1, -pos * close * 0.2).sum(axis=1))
    r = {x["tenor"]: x for x in bk.tenor_bundle(days, [2, 24]).collect()}
    cut = (pd.Timestamp(want.index[-1]) - pd.DateOffset(months=2)).date()
    assert np.isclose(r[2]["total"], want[[d >= cut for d in want.index]].sum()) and np.isclose(r[24]["sd"], want.std()) and r[24]["days"] == 120
    assert bk.tenor_bundle(days.where("false"), [3]).count() == 0


def test_residuals_are_those_of_least_squares(spark, made):
    p = made.assign(x=made["trade_px"] / 100)
    df = frame(spark, made).select("asset", "date", "ret", "holding", (F.col("trade_px") / 100).alias("x"))
    got = bk.residuals(df, "ret", "holding", "x").toPandas().set_index("asset")
    for a in "ab":
        q = p[(p["asset"] == a)].dropna(subset=["ret", "holding"])
        m, y = np.column_stack([np.ones(len(q)), q["holding"], q["x"]]), q["ret"].to_numpy()
        b, *_ = np.linalg.lstsq(m, y, rcond=None)
        e = y - m @ b
        sd = np.sqrt(e @ e / (len(q) - 3))
        se = sd * np.sqrt(np.diag(np.linalg.inv(m.T @ m)))
        r = got.loc[a]
        assert np.allclose([r["b0"], r["b1"], r["b2"]], b) and np.allclose([r["t1"], r["t2"]], (b / se)[1:]) and np.isclose(r["resid_sd"], sd)
        assert np.isclose(r["z_last"], e[-1] / sd) and np.isclose(r["r2"], 1 - e @ e / ((y - y.mean()) ** 2).sum())
    flat = df.withColumn("x", F.lit(1.0))
    assert bk.residuals(flat, "ret", "holding", "x").where("b1 IS NOT NULL").count() == 0


def test_sheets_and_contract_changes(spark):
    day = lambda d: datetime.date(2024, 1, d)
    wide_ = spark.createDataFrame([(day(1), 5.0, 1.0, 1.0), (day(9), 0.0, None, 2.0), (day(10), 3.0, 4.0, 2.0)], "date date, `a:x` double, b double, c double")
    header = spark.createDataFrame([("a:x", "i1"), ("b", "i2")], "name string, index_code string")
    got = {(r["index_code"], r["date"].day, r["value"]) for r in bk.sheet_rows(wide_, header, look_back=5).collect()}
    assert got == {("i1", 10, 3.0), ("i2", 10, 4.0)}
    assert bk.sheet_rows(wide_, header, zero_is_null=False).count() == 5
    rows = spark.createDataFrame([("a", day(1), "x", 10.0), ("a", day(2), "x", 11.0), ("a", day(3), "y", 50.0), ("a", day(4), "y", 55.0)], "asset string, date date, contract string, close double")
    assert [r["diff"] for r in bk.contract_changes(rows).orderBy("date").collect()] == [None, 1.0, 0.0, 5.0]
