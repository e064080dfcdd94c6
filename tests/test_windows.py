"""Recipes against pandas, and their edge cases."""

import math

import numpy as np
import pandas as pd
import pytest

from quaystone.functions.recipe import Ewm, Recipe, halflife, quantile, rank_avg, roll, s, span
from quaystone.sources.panels import numbered

SCHEMA = "asset string, date date, close double"


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    out = []
    for k, n in (("a", 300), ("b", 40), ("one", 1), ("flat", 30), ("none", 10)):
        x = np.full(n, 5.0) if k == "flat" else 100 + rng.normal(0, 1, n).cumsum()
        for i, d in enumerate(pd.date_range("2024-01-01", periods=n)):
            out.append((k, d.date(), None if k == "none" or (k == "a" and i % 11 == 4) else float(x[i])))
    return numbered(spark.createDataFrame(out, SCHEMA)).cache()


def both(panel, recipe, make):
    got = recipe.apply(panel).orderBy("asset", "date").toPandas()
    frame = panel.orderBy("asset", "date").toPandas()
    want = frame.groupby("asset", group_keys=False)["close"].apply(make).reindex(frame.index)
    a, b = got["out"].astype(float).to_numpy(), want.astype(float).to_numpy()
    assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("alpha", [span(5), span(20), halflife(40), 0.9])
def test_ewm_mean_with_gaps(panel, alpha):
    """Null rows let weights decay; where the value itself is null pandas still gives the mean, and so do we."""
    both(panel, Recipe([Ewm("out", "close", alpha)]), lambda x: x.ewm(alpha=alpha).mean())


def test_ewm_std_is_bias_corrected(panel):
    got = Recipe([Ewm("out", "close", span(10), stat="std", least=2)]).apply(panel).where("asset = 'b'").orderBy("date").toPandas()["out"]
    want = panel.where("asset = 'b'").orderBy("date").toPandas()["close"].ewm(span=10).std()
    assert np.allclose(got[1:], want[1:], rtol=1e-7)


def test_ewm_not_adjusted(panel):
    got = Recipe([Ewm("out", "close", span(10), adjust=False, least=3)]).apply(panel).where("asset = 'b'").orderBy("date").toPandas()["out"]
    want = panel.where("asset = 'b'").orderBy("date").toPandas()["close"].ewm(span=10, adjust=False, min_periods=3).mean()
    assert np.allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("n", [3, 20])
def test_rolling_needs_full_windows(panel, n):
    both(panel, Recipe([{"out": roll("stddev_samp", "close", n)}]), lambda x: x.rolling(n).std())
    both(panel, Recipe([{"out": quantile("close", 0.3, n)}]), lambda x: x.rolling(n).quantile(0.3))


def test_rank_averages_ties(spark):
    df = numbered(spark.createDataFrame([(k, pd.Timestamp("2024-01-01").date(), v) for k, v in (("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", None), ("e", 5.0))], SCHEMA))
    got = {r["asset"]: r["r"] for r in Recipe([{"r": rank_avg("close")}]).apply(df).collect()}
    assert got == {"a": 1.0, "b": 2.5, "c": 2.5, "d": None, "e": 4.0}


def test_no_division_by_zero(panel):
    out = Recipe([{"m": roll("avg", "close", 5), "sd": roll("stddev_samp", "close", 5)}, {"z": s("(close - m) / nullif(sd, 0)")}]).apply(panel).where("asset = 'flat'").toPandas()
    assert out["z"].isna().all()


def test_empty_panel(panel):
    assert Recipe([Ewm("out", "close", 0.2), {"m": roll("avg", "close", 5)}]).apply(panel.limit(0)).count() == 0
    assert math.isclose(span(3), 0.5)
