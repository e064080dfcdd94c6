"""Session masks, Poisson resampling and tables with totals against plain forms."""

import datetime

import numpy as np
import pandas as pd
import pytest

from quaystone.operators import resample as rp
from quaystone.operators.sessions import with_session


def test_masks_equal_minute_by_minute_tests(spark):
    rng = np.random.default_rng(2)
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(int(k))
    sessions = []
    for kind in ("a", "b", "c"):
        for _ in range(7):
            first = rng.integers(0, 20)
            s, e = rng.integers(0, 1440, 2)
            sessions.append((kind, day(first), day(first + rng.integers(0, 9)), int(s), int(e), bool(rng.random() < 0.7)))
    ticks = [(i, str(rng.choice(["a", "b", "c", "none"])), day(rng.integers(-3, 32)), int(rng.integers(0, 1440))) for i in range(3000)] + [(9999, None, day(3), 600)]
    table = spark.createDataFrame(sessions, "kind string, from_date date, to_date date, start_minute int, end_minute int, open boolean")

    def inside(kind, date, minute):
        on = [o for k, a, b, s, e, o in sessions if k == kind and a <= date <= b and (s <= minute < e if e > s else minute >= s or minute < e)]
        return bool(on) and all(on)

    for buffer in (0, 2):
        got = with_session(spark.createDataFrame(ticks, "id int, product string, date date, minute int"), table, "product", buffer=buffer).collect()
        want = {i: any(inside(k, d, (m + j) % 1440) for j in range(-buffer, buffer + 1)) for i, k, d, m in ticks}
        assert len(got) == len(ticks) and all(r["in_session"] == want[r["id"]] for r in got) and 0 < sum(want.values()) < len(ticks)


def test_no_range_join_with_sessions(spark):
    table = spark.createDataFrame([("a", datetime.date(2024, 1, 1), datetime.date(2024, 1, 2), 0, 60, True)], "kind string, from_date date, to_date date, start_minute int, end_minute int, open boolean")
    ticks = spark.createDataFrame([(1, "a", datetime.date(2024, 1, 1), 5)], "id int, product string, date date, minute int")
    plan = with_session(ticks, table, "product")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.fixture(scope="module")
def rets(spark):
    rng = np.random.default_rng(8)
    rows = [(a, datetime.date(2020, 1, 1) + datetime.timedelta(i), float(x)) for a in "abcd" for i, x in enumerate(rng.gamma(2, 0.01, 400) - 0.019)]
    return spark.createDataFrame(rows, "asset string, date date, ret double").repartition(3).cache(), pd.DataFrame(rows, columns=["asset", "date", "ret"])


def test_weights_are_poisson(spark):
    w = pd.Series([r[0] for r in spark.range(60_000).select(rp.poisson_weight("id")).collect()])
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs((w == 0).mean() - np.exp(-1)) < 0.01 and w.max() < 10


def test_bootstrap_moments(rets):
    frame, plain = rets
    got = rp.bootstrap(frame, 200).toPandas()
    again = rp.bootstrap(frame.repartition(1), 200).toPandas()
    assert len(got) == 800 and got.set_index(["asset", "draw"]).sort_index()["n"].equals(again.set_index(["asset", "draw"]).sort_index()["n"])
    for asset, p in plain.groupby("asset"):
        mine = got[got["asset"] == asset]
        assert abs(mine["mean"].std() / (p["ret"].std() / 20) - 1) < 0.2 and abs(mine["mean"].mean() - p["ret"].mean()) < p["ret"].std() / 20
        assert abs(mine["sd"].mean() / p["ret"].std() - 1) < 0.05 and abs(mine["skew"].mean() - p["ret"].skew()) < 0.35
        assert np.allclose(mine["sharpe"], mine["mean"] / mine["sd"] * 244**0.5)


def test_drawn_assets_pool_their_returns(rets, spark):
    frame, plain = rets
    got = rp.bootstrap_assets(frame, 20).toPandas().set_index("draw")
    weights = {(r[0], r[1]): r[2] for r in spark.createDataFrame([(a, d) for a in "abcd" for d in range(1, 21)], "asset string, draw int").select("asset", "draw", rp.poisson_weight("asset", "draw")).collect()}
    for draw in got.index:
        pooled = np.concatenate([plain[plain["asset"] == a]["ret"].to_numpy() for a in "abcd" for _ in range(weights[a, draw])] or [np.empty(0)])
        assert got.loc[draw, "n"] == len(pooled)
        if len(pooled):
            assert np.isclose(got.loc[draw, "mean"], pooled.mean()) and np.isclose(got.loc[draw, "sd"], pooled.std(ddof=1))


def test_totals_on_both_axes(spark):
    rows = [("x", "p", "c", "k1", 1.0), ("x", "p", "c", "k2", 2.0), ("x", "q", "d", "k1", 4.0), ("y", None, "c", "k1", 8.0), ("y", "q", None, "k2", 16.0)]
    df = spark.createDataFrame(rows, "a string, b string, otype string, strike string, v double")
    got = rp.pivot_with_totals(df, ["a", "b"], ["otype", "strike"], "v")
    assert got.columns == ["a", "b", "c|k1", "c|k2", "d|k1", "null|k2", "Total"]
    assert {tuple(r)[:2]: tuple(r)[2:] for r in got.collect()} == {("x", "p"): (1, 2, 0, 0, 3), ("x", "q"): (0, 0, 4, 0, 4), ("y", "null"): (8, 0, 0, 0, 8), ("y", "q"): (0, 0, 0, 16, 16), ("Total", "Total"): (9, 2, 4, 16, 31)}
    with pytest.raises(ValueError):
        rp.pivot_with_totals(df, ["a"], ["otype", "strike"], "v", most=3)
