"""Windows and indicators against plain pandas forms written from their definitions, asset by asset."""

import numpy as np
import pandas as pd
import pytest

from quaystone.functions.recipe import Ewm, Recipe
from quaystone.operators import indicators as ind
from quaystone.operators import timeseries as ts
from quaystone.operators.signals import Definition, definition
from quaystone.sources.panels import numbered

N = 320


@pytest.fixture(scope="module")
def frame():
    rng, out = np.random.default_rng(17), []
    for k, n in (("a", N), ("b", 90), ("one", 1)):
        close = 100 + rng.normal(0, 1, n).cumsum()
        high, low = close + rng.uniform(0.1, 1, n), close - rng.uniform(0.1, 1, n)
        for i, d in enumerate(pd.bdate_range("2024-01-01", periods=n)):
            out.append((k, d.date(), float(low[i] + 0.3 * (high[i] - low[i])), float(high[i]), float(low[i]), float(close[i]), float(rng.integers(10, 500))))
    return pd.DataFrame(out, columns=["asset", "date", "open", "high", "low", "close", "volume"])


@pytest.fixture(scope="module")
def panel(spark, frame):
    return numbered(spark.createDataFrame(frame, "asset string, date date, open double, high double, low double, close double, volume double")).cache()


def check(panel, frame, recipe, make, columns=None, tol=1e-7):
    """make: from an asset's frame to the columns that the recipe keeps, in their order."""
    got = recipe.apply(panel).select("asset", "date", *recipe.keep).toPandas().sort_values(["asset", "date"])
    for asset, part in frame.groupby("asset"):
        want = make(part.reset_index(drop=True))
        want = list(want) if isinstance(want, (tuple, list)) else [want]
        mine = got[got["asset"] == asset]
        for name, w in zip(columns or recipe.keep, want, strict=True):
            assert np.allclose(mine[name].astype(float), np.asarray(w, float), rtol=tol, atol=tol, equal_nan=True), (asset, name)


def rank_of_last(x, n):
    return x.rolling(n).apply(lambda w: (w <= w[-1]).sum(), raw=True)


def robust(x):
    v = x.ewm(span=35, min_periods=10).std()
    v = v.where(~(v < 1e-8), 1e-8)
    floor = v.rolling(500, min_periods=100).quantile(0.05)
    floor.iloc[0] = 0.0
    return np.maximum(v, floor.ffill())


def risk(x, n):
    return x / x.ewm(span=n, min_periods=10, ignore_na=True).std()


def kdj(x, n):
    k = (x - x.rolling(n).min()) / (x.rolling(n).max() - x.rolling(n).min()) - 0.5
    return 3 * k - 2 * k.rolling(3).mean()


CONV = {
    "ma": lambda x, n: x.rolling(n, min_periods=n // 2).mean() / x.abs().rolling(120, min_periods=60).mean(),
    "mad": lambda x, n: x.rolling(n, min_periods=n // 2).mean() / x.rolling(120, min_periods=60).std(),
    "ma_sgn": lambda x, n: np.sign(x.rolling(n).mean()),
    "ema": lambda x, n: x.ewm(n).mean() / x.abs().ewm(120).mean(),
    "emad": lambda x, n: x.ewm(n).mean() / x.ewm(120).std(),
    "ema_sgn": lambda x, n: np.sign(x.ewm(n).mean()),
    "ema_dff": lambda x, n: risk(x - x.ewm(n).mean(), 120),
    "ema_dff_sgn": lambda x, n: np.sign(x - x.ewm(n).mean()),
    "ma_dff": lambda x, n: risk(x - x.rolling(n).mean(), 120),
    "ma_dff_sgn": lambda x, n: np.sign(x - x.rolling(n).mean()),
    "ewmac": lambda x, n: (x.ewm(span=n).mean() - x.ewm(span=4 * n).mean()) / robust(x.diff()),
    "kdj": kdj,
    "zscore_biased": lambda x, n: x / x.rolling(n).std(),
    "zscore": lambda x, n: (x - x.rolling(n).mean()) / x.rolling(n).std(),
    "zscore_adj": lambda x, n: (x - x.rolling(n).mean()) / x.diff().rolling(n).std() / np.sqrt(n),
    "qtl": lambda x, n: 2 * (rank_of_last(x, n) / n - 1 / n) / (1 - 1 / n) - 1,
    "hlratio": lambda x, n: 2 * (x - x.rolling(n).min()) / (x.rolling(n).max() - x.rolling(n).min()) - 1,
}


@pytest.mark.parametrize("kind", ts.CONV)
def test_signal_methods(panel, frame, kind):
    expression = "close - open" if kind in ts.OF_CHANGES else "close"
    plain = lambda p: p["close"] - p["open"] if kind in ts.OF_CHANGES else p["close"]

    def make(p):
        parts = [CONV[kind](plain(p), n).clip(-2.5, 2.5) for n in (10, 15, 20) if len(p) > n]
        return pd.concat(parts, axis=1).mean(axis=1) if parts else np.full(len(p), np.nan)

    check(panel, frame, ts.conv_signal(kind, x=expression), make, tol=1e-6)


def wma(x, a, adjust=False, least=0):
    return x.ewm(alpha=a, adjust=adjust, min_periods=least).mean()


def true_range(p):
    return pd.concat([p.high - p.low, (p.high - p.close.shift()).abs(), (p.low - p.close.shift()).abs()], axis=1).max(axis=1)


def atr(p, n):
    return true_range(p).ewm(span=n, adjust=False, min_periods=n - 1).mean()


def adx(p, n=14):
    up, down = p.high.diff(), -p.low.diff()
    pos, neg = up.where((up > down) & (up > 0), 0.0).where(up.notna()), down.where((down > up) & (down > 0), 0.0).where(up.notna())
    a = atr(p, n)
    pdi, ndi = pos.ewm(span=n, min_periods=n - 1).mean() / a, neg.ewm(span=n, min_periods=n - 1).mean() / a
    return ((pdi - ndi).abs() / (pdi + ndi)).ewm(span=n, min_periods=n - 1).mean(), pdi, ndi


def rsi(p, n=14):
    d = p.close.diff()
    up, down = d.clip(lower=0).ewm(com=n - 1).mean(), (-d).clip(lower=0).ewm(com=n - 1).mean()
    return 100 * up / (up + down), up, down


def fisher(p):
    top, bottom = p.high.rolling(20).max(), p.low.rolling(20).min()
    f = ((p.close - bottom) / (top - bottom) * 2 - 1).ewm(alpha=0.7, adjust=False).mean()
    return f, (0.5 * np.log((1 + f) / (1 - f))).ewm(alpha=0.7, adjust=True).mean()


def tail_mean(p, n=20, pct=50, direction=1):
    out = np.full(len(p), np.nan)
    for i in range(n, len(p)):
        x = p.close.iloc[i - n : i]
        keep = x[x * direction >= np.percentile(x, pct) * direction]
        w = keep.rank(ascending=False) * np.arange(1, len(keep) + 1)
        out[i] = (keep * w).sum() / w.sum()
    return out


def value_chart(p, n, rng=8):
    if n > 7:
        v = p.high.rolling(rng).max() - p.low.rolling(rng).min()
        unit = sum(v.shift(rng * k) for k in range(5)) / 25
    else:
        unit = pd.concat([p.high - p.low, (p.close - p.close.shift()).abs()], axis=1).max(axis=1).rolling(n).mean() * 0.16
    mid = (p.high.rolling(n).mean() + p.low.rolling(n).mean()) / 2
    return [(p[c] - mid) / unit for c in ("open", "high", "low", "close")]


def heiken(p):
    c, o = (p.open + p.high + p.low + p.close) / 4, []
    for i in range(len(p)):
        o.append(p.open[i] if i == 0 else (o[-1] + c[i - 1]) / 2)
    o = pd.Series(o)
    return o, np.maximum(p.high, np.maximum(o, c)), np.minimum(p.low, np.minimum(o, c)), c


def dvo(p):
    mix = 0.4 * p.high + 0.3 * p.low + 0.2 * p.open + 0.1 * p.close
    r = p.close / mix
    theta = 0.5 * r + 0.3 * r.shift() + 0.2 * r.shift(2)
    return theta.rolling(40).apply(lambda w: 100 * ((w < w[-1]).sum() + 0.5 * (w == w[-1]).sum() + 0.5) / len(w), raw=True)


def spearman(p):
    from itertools import permutations  # exact ranks of four values; the p-value of four is 1 - |r|

    spans, out = (5, 10, 20, 40), []
    e = pd.concat([p.close.ewm(span=n).mean() for n in spans], axis=1)
    for i in range(len(p)):
        if i < 39:
            out.append((np.nan,) * 3)
            continue
        r = np.corrcoef(e.iloc[i].rank(), [4, 3, 2, 1])[0, 1]
        out.append((100 * r, 100 * (1 - abs(r)), e.iloc[i].max() - e.iloc[i].min()))
    assert len(list(permutations(spans))) == 24
    return [np.array(out)[:, k] for k in range(3)]


LOGS = lambda p: np.log(p.close / p.close.shift())
PLAIN = {
    "atr": (Recipe(ind.atr(20), ("atr",)), lambda p: atr(p, 20)),
    "adx": (ind.adx(), adx),
    "rsi": (ind.rsi(), rsi),
    "macd": (ind.macd(), lambda p: (m := p.close.ewm(span=12, min_periods=25).mean() - p.close.ewm(span=26, min_periods=25).mean(), g := m.ewm(span=9, min_periods=8).mean(), m - g)),
    "trix": (ind.trix(), lambda p: p.close.ewm(span=10, adjust=False, min_periods=9).mean().ewm(span=10, adjust=False, min_periods=9).mean().ewm(span=10, adjust=False, min_periods=9).mean().pct_change(fill_method=None)),
    "bbands": (ind.bbands(), lambda p: (m := p.close.rolling(20).mean(), 4 * (d := p.close.rolling(20).std()) / m, (p.close - m + 2 * d) / (4 * d), m + 2 * d, m - 2 * d)),
    "stochastic": (ind.stochastic(), lambda p: (k := 100 * (p.close - p.low.rolling(14).min()) / (p.high.rolling(14).max() - p.low.rolling(14).min()), s := k.rolling(3).mean(), s.rolling(3).mean())),
    "cmi": (ind.cmi(), lambda p: 100 * (p.close - p.close.shift(14)).abs() / (p.high.rolling(14).max() - p.low.rolling(14).min())),
    "efficiency": (ind.efficiency(), lambda p: 100 * (p.close - p.close.shift(10)).abs() / p.close.diff().abs().rolling(10).sum()),
    "vortex": (ind.vortex(), lambda p: ((p.high - p.low.shift()).abs() - (p.low - p.high.shift()).abs()).rolling(14).sum() / true_range(p).rolling(14).sum()),
    "kst": (ind.kst(), lambda p: sum(w * ((p.close - p.close.shift(r - 1)) / p.close.shift(r - 1)).rolling(n).sum() for w, r, n in ((1, 10, 10), (2, 15, 10), (3, 20, 10), (4, 30, 15)))),
    "mass": (ind.mass_index(), lambda p: ((e := (p.high - p.low).ewm(span=9, min_periods=8).mean()) / e.ewm(span=9, min_periods=8).mean()).rolling(25).sum()),
    "donchian": (ind.donchian(), lambda p: (p.high.rolling(20).max(), p.low.rolling(20).min(), p.high.rolling(20).apply(lambda w: len(w) - 1 - np.flatnonzero(w == w.max())[-1], raw=True), p.low.rolling(20).apply(lambda w: len(w) - 1 - np.flatnonzero(w == w.min())[-1], raw=True))),
    "fisher": (ind.fisher(), fisher),
    "pct_channel": (ind.pct_channel(20, 30), lambda p: p.close.rolling(20).quantile(0.3).shift()),
    "tail_high": (ind.tail_mean(), tail_mean),
    "tail_low": (ind.tail_mean(pct=0.3, direction=-1), lambda p: tail_mean(p, pct=30, direction=-1)),
    "value_chart": (ind.value_chart(), lambda p: value_chart(p, 10)),
    "value_chart_short": (ind.value_chart(5), lambda p: value_chart(p, 5)),
    "tema": (ind.tema(), lambda p: 3 * (a := wma(p.close, 2 / 11)) - 3 * (b := wma(a, 2 / 11)) + wma(b, 2 / 11)),
    "slope": (ind.slope(), lambda p: p.close.rolling(10).apply(lambda w: np.polyfit(range(10), w, 1)[0], raw=True)),
    "heiken": (ind.heiken_ashi(), heiken),
    "dvo": (ind.dvo((0.4, 0.3, 0.2, 0.1), (0.5, 0.3, 0.2), 40), dvo),
    "ribbon": (ind.ribbon(), spearman),
    "plunger": (ind.plunger(), lambda p: ((p.high.rolling(20).max() - p.close) / atr(p, 40), (p.close - p.low.rolling(20).min()) / atr(p, 40))),
    "kumo": (ind.kumo(), lambda p: (tk := (p.high.rolling(9).max() + p.low.rolling(9).min()) / 2, kj := (p.high.rolling(26).max() + p.low.rolling(26).min()) / 2, (tk + kj) / 2, (p.high.rolling(52).max() + p.low.rolling(52).min()) / 2)),
    "robust": (ts.robust_vol(), lambda p: robust(LOGS(p))),
    "robust_filled": (ts.robust_vol(backfill=True), lambda p: robust(LOGS(p)).ffill().bfill()),
    "ewmac": (ts.ewmac(), lambda p: (p.close.ewm(span=8).mean() - p.close.ewm(span=32).mean()) / robust(p.close.diff())),
    "grid": (ts.ewmac_grid(), lambda p: pd.concat([(p.close.ewm(span=a).mean() - p.close.ewm(span=b).mean()) / robust(p.close.diff()) for a in (4, 8, 16) for b in (16, 32, 64) if a < b], axis=1).mean(axis=1)),
    "grid_own_vol": (ts.ewmac_grid((4, 8), (16,), vol=20), lambda p: pd.concat([risk(p.close.ewm(span=a).mean() - p.close.ewm(span=16).mean(), 20) for a in (4, 8)], axis=1).mean(axis=1)),
    "pct_scores": (ts.pct_scores(60), lambda p: (u := (rank_of_last(p.close, 60) - 1) / 59, 2 * u - 1)),
    "pct_lowest": (ts.pct_scores(60, lowest=True), lambda p: (u := 1 - (rank_of_last(p.close, 60) - 1) / 59, 2 * u - 1)),
    "hl_kdj": (ts.hl_kdj(), lambda p: (2 * (k := (p.close - p.close.rolling(14).min()) / (p.close.rolling(14).max() - p.close.rolling(14).min()) - 0.5), k, d := k.rolling(3).mean(), 3 * k - 2 * d)),
    "rolling_fit": (ts.rolling_fit(), None),
    "skew_kurt": (ts.skew_kurt(), lambda p: (LOGS(p).rolling(30).skew(), LOGS(p).rolling(30).kurt())),
    "drawdown": (ts.drawdown(), None),
}


@pytest.mark.parametrize("name", sorted(k for k, v in PLAIN.items() if v[1]))
def test_recipes(panel, frame, name):
    recipe, make = PLAIN[name]
    check(panel, frame, recipe, make, tol=2e-6 if name in ("skew_kurt", "slope") else 1e-7)


def test_means_that_skip_gaps(panel, frame):
    """ignore_na: weights decay over rows with a value only."""
    gaps = lambda p: p["close"].where(pd.Series(range(len(p))) % 4 != 2)
    recipe = Recipe([Ewm("out", "CASE WHEN rn % 4 <> 2 THEN close END", 0.3, skip=True), Ewm("sd", "CASE WHEN rn % 4 <> 2 THEN close END", 0.3, stat="std", least=2, skip=True)], ("out", "sd"))
    check(panel, frame, recipe, lambda p: (gaps(p).ewm(alpha=0.3, ignore_na=True).mean(), gaps(p).ewm(alpha=0.3, ignore_na=True).std()), tol=1e-6)


def grid(x, p):
    """The last value on or before each business day."""
    s = pd.Series(x.to_numpy(), pd.to_datetime(p["date"])).dropna()
    return s.reindex(pd.date_range(s.index[0], s.index[-1])).ffill().reindex(pd.bdate_range(s.index[0], s.index[-1]))


def test_definitions_follow_their_chains(spark, frame):
    """Rows with gaps in the dates; chains before and behind a method."""
    sparse = frame[(frame["asset"] != "one")].groupby("asset", group_keys=False).apply(lambda p: p[p.index % 3 != 1]).reset_index(drop=True)
    panel = numbered(spark.createDataFrame(sparse, "asset string, date date, open double, high double, low double, close double, volume double"))
    d = Definition("close", "zscore", (10, 20, 5), "df2|ema3", "pct_change", False, "price", "ema2|hmp0.3|sma2")
    got = definition(d).apply(panel).toPandas()
    for asset, p in sparse.groupby("asset"):
        x = grid(p["close"], p).pct_change(2, fill_method=None).ewm(3).mean()
        z = -pd.concat([((x - x.rolling(n).mean()) / x.rolling(n).std()).clip(-2, 2) for n in (10, 15)], axis=1).mean(axis=1).dropna()
        z = z.ewm(2, ignore_na=True).mean()
        held, out = None, []
        for v in z:
            held = v if held is None or abs(held - v) >= 0.3 else held
            out.append(held)
        want = pd.Series(out, z.index).rolling(2).mean()
        mine = got[got["asset"] == asset].sort_values("date")
        assert list(pd.to_datetime(mine["date"])) == list(want.index) and np.allclose(mine["final_"].astype(float), want, equal_nan=True, atol=1e-8)


def test_unknown_steps_are_refused():
    for bad in (Definition("close", "nothing", (1, 2, 1)), Definition("close", "ma", (1, 2, 1), "what3"), Definition("close", "ma", (1, 2, 1), after="zzz"), Definition("close", "ma", (1, 2, 1), "df1", "ratio")):
        with pytest.raises(ValueError):
            definition(bad)
