"""Signals across assets against pandas."""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quaystone.operators import crowd as cr


def made(spark, n=80):
    rng = np.random.default_rng(9)
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(i) for i in range(n)]
    x = pd.DataFrame(rng.normal(size=(n, 4)), index=days, columns=list("abcd"))
    x.iloc[:3, 1:] = np.nan  # one asset only: no deviation
    x.iloc[10, 2] = np.nan
    long = x.rename_axis("date").reset_index().melt("date", var_name="asset", value_name="x")
    return x, spark.createDataFrame(long.astype(object).where(long.notna(), None), "date date, asset string, x double")


def test_scores_by_a_smoothed_deviation(spark):
    x, df = made(spark)
    d = x.sub(x.mean(axis=1), axis=0)
    want = d.div(d.std(axis=1).ewm(halflife=5).mean().bfill(), axis=0)
    got = cr.smoothed_scores(df, "x", 5).toPandas().pivot(index="date", columns="asset", values="score").astype(float)
    assert np.allclose(got, want, equal_nan=True)
    assert cr.smoothed_scores(df.where("false"), "x", 5).count() == 0


def test_followers_get_the_mean_of_their_leaders(spark):
    x, df = made(spark)
    table = [("a", "d", "x", 0), ("b", "d", "sign", 2), ("b", "c", "x", 3), ("nobody", "c", "x", 0)]
    got = cr.leader_signals(df, {"x": F.col("x"), "sign": F.signum("x")}, table).toPandas().pivot(index="date", columns="asset", values="signal")
    want = pd.DataFrame({"c": x["b"].shift(3), "d": pd.concat([x["a"], np.sign(x["b"]).shift(2)], axis=1).mean(axis=1)})
    assert np.allclose(got.reindex(x.index).astype(float), want, equal_nan=True)


def test_flows_of_a_day(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("a", day, i, p, 2.0, o) for i, (p, o) in enumerate([(10.0, 5.0), (11.0, 7.0), (11.0, 9.0), (9.0, 4.0)])] + [("b", day, 0, 3.0, 1.0, 1.0)]
    got = {r["asset"]: r for r in cr.day_flows(spark.createDataFrame(rows, "asset string, date date, i int, price double, volume double, oi double"), ["i"], "i < 2").collect()}
    a, b = got["a"], got["b"]
    assert (a["n"], a["money_flow"], a["oi_flow"], a["twap_1"], a["twap_2"]) == (3, 11.0 * 2 - 9.0 * 2, 2.0 + 5.0, 10.5, 10.0) and np.isclose(a["mean"], -1 / 3)
    assert b["n"] == 0 and b["mean"] is None and b["money_flow"] is None and b["twap_2"] is None
