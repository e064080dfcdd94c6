"""Stored definitions in one pass: against the SQL of each one's recipe, and plain forms for what has no recipe."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from quaystone.operators import definitions as de
from quaystone.operators.signals import Definition, definition
from quaystone.plans.definition_queries import library


@pytest.fixture(scope="module")
def frame():
    rng, out = np.random.default_rng(5), []
    for asset, n in (("Brand#1", 800), ("Brand#2", 800), ("Brand#3", 300), ("Brand#9", 1)):
        days = np.sort(rng.choice(pd.bdate_range("2020-12-01", periods=int(n * 1.4) + 1), n, replace=False))
        close = 100 + rng.normal(0, 1, n).cumsum()
        for i, d in enumerate(days):
            out.append((asset, pd.Timestamp(d).date(), i, float(close[i] - 0.2), float(close[i] + rng.uniform(0.1, 1)), float(close[i] - rng.uniform(0.3, 1)), float(close[i]), float(rng.integers(10, 500))))
    f = pd.DataFrame(out, columns=["asset", "date", "rn", "open", "high", "low", "close", "volume"])
    return f.assign(idx=f.groupby("date")["close"].transform("mean"))


@pytest.fixture(scope="module")
def panel(spark, frame):
    return spark.createDataFrame(frame, "asset string, date date, rn int, open double, high double, low double, close double, volume double, idx double").repartition(5).cache()


@pytest.fixture(scope="module")
def duck(frame):
    con = duckdb.connect()
    con.register("f", frame)
    con.execute("CREATE TABLE panel AS SELECT * REPLACE (date::DATE AS date) FROM f")
    return con


def history(frame, asset):
    p = frame[frame["asset"] == asset]
    columns = {"ln(close)": np.log(p["close"]), "high - low": p["high"] - p["low"], "ln(close / open)": np.log(p["close"] / p["open"]), "close / 1000": p["close"] / 1000} | {c: p[c] for c in ("close", "volume", "idx")}
    return de.History({k: pd.Series(v.to_numpy(float), pd.DatetimeIndex(p["date"])) for k, v in columns.items()})


def by_recipe(s):
    return s.kind == "own" and not s.across and "bfc" not in s.definition.after and not s.definition.method.startswith("seasonal")


def test_the_library_is_large_and_merged(frame):
    stored = library()
    assert len(stored) >= 100 and len({s.signal for s in stored}) == len(stored)
    h, alone = history(frame, "Brand#1"), 0
    for s in stored:
        one = history(frame, "Brand#1")
        one.value(de.graph(s)[0])
        h.value(de.graph(s)[0])
        alone += len(one.known)
    assert len(h.known) < 0.75 * alone


def test_signals_equal_the_sql_of_their_recipes(frame, duck):
    stored = {s.definition: s for s in library() if by_recipe(s)}
    assert len(stored) > 80
    known = {a: history(frame, a) for a in frame["asset"].unique()}
    for d, s in stored.items():
        want = duck.execute(definition(d).oracle("s0 AS MATERIALIZED (SELECT * FROM panel)")).df()
        for asset, h in known.items():
            got, w = h.value(de.graph(s)[0]), want[want["asset"] == asset].sort_values("date")
            assert list(got.index) == list(pd.to_datetime(w["date"])) and np.allclose(got.to_numpy(float), w["final_"].astype(float), atol=2e-6, equal_nan=True), (s.signal, asset)


@pytest.mark.parametrize("back, ahead, years, least", [(14, 14, 3, 10), (200, 180, 2, 40), (5, 0, 0, 2)])
def test_seasonal_scores(frame, back, ahead, years, least):
    x = history(frame, "Brand#1").columns["close"]
    got = de._season(x, back, ahead, years, least)
    for i, t in enumerate(x.index):
        seen = pd.Series(False, x.index)
        for k in range(years + 1):
            y = t.year - k
            middle = t.replace(year=y, day=28) if (t.month, t.day) == (2, 29) else t.replace(year=y)
            end = t if k == 0 else middle + pd.Timedelta(days=ahead)
            seen |= (x.index >= middle - pd.Timedelta(days=back)) & (x.index <= end)
        sample = x[seen & (x.index <= t)]
        want = (sample.iloc[-1] - sample.mean()) / sample.std() if len(sample) >= least else np.nan
        assert np.isclose(got.iloc[i], want, equal_nan=True), t


def test_cost_buffer_follows_volatility(frame):
    h = history(frame, "Brand#1")
    s = next(s for s in library() if s.definition.after == "bfc0.3" and not s.across)
    got = h.value(de.graph(s)[0])
    plain = h.value(de.graph(de.Stored("", Definition("close", "ewmac", (3, 9, 3), after="", vol=40)))[0]).dropna()
    plain = plain.reindex(pd.date_range(plain.index[0], plain.index[-1])).ffill().reindex(pd.bdate_range(plain.index[0], plain.index[-1]))
    vol = h.columns["close"].pct_change().rolling(20).std()
    vol = vol.reindex(pd.date_range(vol.index[0], vol.index[-1])).ffill().reindex(plain.index)
    gap, held, out = 0.3 * (3 * 2e-4 / vol) ** (1 / 3), 0.0, []
    for i, (v, g) in enumerate(zip(plain, gap)):
        held = (v if abs(v) >= g else 0.0) if i == 0 else v - g if v - g >= held else v + g if v + g < held else held
        out.append(held)
    assert np.allclose(got, out) and got.nunique() > 20


def run(spark, panel, stored):
    return de.run_stored(panel, spark.createDataFrame([s.row() for s in stored], de.TABLE)).toPandas().sort_values(["signal", "asset", "date"], ignore_index=True)


def own(frame, d):
    out = {}
    for asset in frame["asset"].unique():
        x = history(frame, asset).value(de.graph(de.Stored("", d))[0])
        out[asset] = x
    return pd.DataFrame(out)


def test_signals_across_assets_are_buffered_last(spark, panel, frame):
    plain, d = Definition("close", "zscore", (10, 30, 10), after="sma1"), Definition("close", "zscore", (10, 30, 10), after="sma1|buf0.4")
    got = run(spark, panel, [de.Stored(h, d, across=h) for h in ("demean", "score", "rank")])
    x = own(frame, plain)
    n = x.notna().sum(axis=1)
    want = {"demean": x.sub(x.mean(axis=1), axis=0), "score": x.sub(x.mean(axis=1), axis=0).div(x.std(axis=1), axis=0), "rank": x.rank(axis=1).sub((n + 1) / 2, axis=0).mul(2).div((n - 1).where(n > 1), axis=0)}
    for how, w in want.items():
        for asset in ("Brand#1", "Brand#3"):
            rows = w[asset][x[asset].notna()]
            w_held = de._buffer(rows, pd.Series(0.4, rows.index))
            mine = got[(got["signal"] == how) & (got["asset"] == asset)]
            assert list(pd.to_datetime(mine["date"])) == list(rows.index) and np.allclose(mine["value"].astype(float), w_held, equal_nan=True, atol=1e-8), (how, asset)


def test_joint_signals(spark, panel, frame):
    d = Definition("close", "zscore", (10, 30, 10), after="ema1")
    stored = [de.Stored("all", d, "shared", ("Brand#1", "Brand#2", "Brand#3")), de.Stored("two", d, "pair", ("Brand#1", "Brand#2")), de.Stored("flat", d, "neutral", ("Brand#1", "Brand#3", "Brand#2")), de.Stored("some", d, "own", ("Brand#3",))]
    got = run(spark, panel, stored)
    x = own(frame, d)["Brand#1"].dropna()
    x = x.reindex(pd.date_range(x.index[0], x.index[-1])).ffill()
    close = frame.pivot(index="date", columns="asset", values="close")
    close.index = pd.DatetimeIndex(close.index)
    for signal, asset, side in (("all", "Brand#3", 1), ("all", "Brand#1", 1), ("two", "Brand#1", 1), ("two", "Brand#2", -1)):
        mine = got[(got["signal"] == signal) & (got["asset"] == asset)]
        want = x.reindex(close[asset].dropna().index).dropna() * side
        assert list(pd.to_datetime(mine["date"])) == list(want.index) and np.allclose(mine["value"], want)
    assert set(got[got["signal"] == "some"]["asset"]) == {"Brand#3"} and set(got[got["signal"] == "two"]["asset"]) == {"Brand#1", "Brand#2"}
    legs = {}
    for asset in ("Brand#1", "Brand#3"):
        c = close[[asset, "Brand#2"]].dropna()
        r = c.pct_change().fillna(0)
        m = r.rolling(5).mean()
        beta = m["Brand#2"].rolling(122).cov(m[asset]) / m["Brand#2"].rolling(122).var()
        vol = (r[asset] - beta * r["Brand#2"]).rolling(20).std()
        held = x.reindex(c.index.union(x.index)).ffill().reindex(c.index)
        held = x.reindex(c.index).ffill()
        legs[asset] = held * r[asset].rolling(20).std() / vol
        legs[f"{asset}<"] = -held * beta * r["Brand#2"].rolling(20).std() / vol
    for asset, want in (("Brand#1", legs["Brand#1"]), ("Brand#3", legs["Brand#3"]), ("Brand#2", pd.concat([legs["Brand#1<"], legs["Brand#3<"]], axis=1).sum(axis=1, min_count=1))):
        mine = got[(got["signal"] == "flat") & (got["asset"] == asset)]
        assert len(mine) == len(want) and np.allclose(mine["value"].astype(float), want.sort_index(), equal_nan=True, rtol=1e-6, atol=1e-8), asset


def test_one_exchange_for_all_definitions(panel):
    plan = de.own_signals(panel.sparkSession.createDataFrame(panel.toPandas()), [s for s in library() if s.kind == "own"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Exchange hashpartitioning(asset" in plan and plan.count("FlatMapGroupsInPandas") == 1


def test_unknown_steps_and_too_many_rows_are_refused(spark, monkeypatch):
    for bad in (Definition("close", "nothing", (1, 2, 1)), Definition("close", "ma", (1, 2, 1), "what3"), Definition("close", "ma", (1, 2, 1), after="zzz"), Definition("close", "ma", (1, 2, 1), "df1", "ratio")):
        with pytest.raises(ValueError):
            de.graph(de.Stored("bad", bad))
    monkeypatch.setattr(de, "MOST_DEFINITIONS", 2)
    with pytest.raises(ValueError):
        de.stored_definitions(spark.createDataFrame([s.row() for s in library()[:3]], de.TABLE))
