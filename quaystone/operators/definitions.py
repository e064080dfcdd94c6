"""Many stored signal definitions in one pass: rows of a table become one graph of steps over an asset's history.

A definition's chain (signals.py states its parts) is a node: a step, its parameters and the nodes it reads. Equal nodes of
all definitions are one, so a mean or a grid that many definitions share is worked out once for each asset. The panel is
exchanged once, by asset, and an asset's daily history is a group. What needs other assets comes behind that, by
equality joins and windows: signals given to several assets, long-short pairs, positions that are neutral to an index
asset, and demeaning, scoring or ranking across assets, with the last buffer behind it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.functions import kernels as kn
from quaystone.functions.recipe import com, span
from quaystone.operators.seasonal import NEW_YEARS
from quaystone.operators.signals import DAYS, SCORES, Definition
from quaystone.operators.timeseries import CONV

#: A table of definitions is sent to all tasks; more rows than these are refused.
MOST_DEFINITIONS = 10_000
TABLE = "signal string, kind string, assets array<string>, across string, feature string, method string, params array<double>, before string, change string, bullish boolean, freq string, after string, vol int, cap array<double>, index string"
BUSINESS, EVERY = (0, 1, 2, 3, 4), (0, 1, 2, 3, 4, 5, 6)
#: Scores of seasonal_score_*: the least number of rows in the sample.
SEASONAL = {"seasonal_score_w": 10, "seasonal_score_d": 40}
TRADE_COST, COST_VOL = 2e-4, 20
BETA_DAYS, NEUTRAL_VOL = 122, 20


@dataclass(frozen=True)
class Stored:
    """kind: own (each asset's own feature), or the first asset's signal for all assets (shared), for the first and against the second (pair), or neutral to the last one (neutral)."""

    signal: str
    definition: Definition
    kind: str = "own"
    assets: tuple[str, ...] | None = None  # all, if none are named
    across: str = ""  # demean, score or rank

    def row(self) -> tuple:
        d = self.definition
        return (self.signal, self.kind, self.assets and list(self.assets), self.across, d.feature, d.method, list(map(float, d.params)), d.before, d.change, d.bullish, d.freq, d.after, d.vol, d.cap and list(map(float, d.cap)), d.index)

    @staticmethod
    def of(r) -> Stored:
        d = Definition(r["feature"], r["method"], tuple(r["params"]), r["before"], r["change"], r["bullish"], r["freq"], r["after"], r["vol"], r["cap"] and tuple(r["cap"]), r["index"])
        return Stored(r["signal"], d, r["kind"], r["assets"] and tuple(r["assets"]), r["across"])


def node(step: str, *inputs, **params) -> tuple:
    return step, tuple(params.items()), inputs


def changed(x: tuple, change: str, n: int) -> tuple:
    if change not in ("diff", "pct_change"):
        raise ValueError(f"no change {change}")
    return node(change, x, n=n)


def _before(d: Definition, x: tuple) -> tuple:
    gridded = False

    def on_grid(x):
        nonlocal gridded
        if d.freq != "price" or gridded:
            return x
        gridded = True
        return node("grid", node("present", x), days=BUSINESS)

    for step in d.before.split("|"):
        if step == "beta_resid":
            x = node("residual", x, node("feature", name=d.index), change=d.change or "pct_change", n=int(d.params[3]) if len(d.params) > 3 else 250)
            continue
        if "yoy" in step:
            kind = "lunar" if "lunar" in step else "cal" if "cal" in step else "stitched"
            x = on_grid(node("yoy", node("present", x), kind=kind, group="week" if "_wk" in step else "day", change=d.change or "diff"))
            continue
        x = on_grid(x)
        head, n = re.fullmatch(r"([a-z]*)(\d*)", step).groups() if re.fullmatch(r"[a-z]*\d*", step) else (step, "")
        if head == "df" and n:
            x = changed(x, d.change or "diff", int(n))
        elif head in ("sma", "sum") and n:
            x = node("mean" if head == "sma" else "total", x, n=int(n))
        elif head == "ema" and n:
            x = node("smooth", x, alpha=com(int(n)))
        elif head in ("lr", "flr") and not n:
            x = node("log1p", x)
        elif head == "csum" and not n:
            x = node("running", x)
        elif step:
            raise ValueError(f"no step {step}")
    return x


def _windowed(kind: str, n: int, x: tuple, vol: int) -> tuple:
    """A signal method with a window of n rows."""
    mean, half = node("mean", x, n=n), vol // 2
    if kind in ("ma", "mad"):
        m = node("mean", x, n=n, least=n // 2)
        return node("over", m, node("mean", node("abs", x), n=vol, least=half) if kind == "ma" else node("std", x, n=vol, least=half), m)
    if kind in ("ema", "emad"):
        m = node("smooth", x, alpha=com(n))
        return node("over", m, node("smooth", node("abs", x), alpha=com(vol)) if kind == "ema" else node("smooth_std", x, alpha=com(vol), least=2), m)
    if kind in ("ma_sgn", "ema_sgn"):
        return node("sign", mean if kind == "ma_sgn" else node("smooth", x, alpha=com(n)))
    if kind in ("ma_dff", "ma_dff_sgn", "ema_dff", "ema_dff_sgn"):
        away = node("minus", x, mean if kind.startswith("ma") else node("smooth", x, alpha=com(n)))
        return node("clear_sign", away, x) if kind.endswith("sgn") else node("over", away, node("smooth_std", away, alpha=span(vol), least=10), x)
    if kind == "ewmac":
        return node("ratio", node("minus", node("smooth", x, alpha=span(n)), node("smooth", x, alpha=span(4 * n))), node("robust", node("diff", x, n=1)))
    if kind in ("kdj", "hlratio"):
        return node(kind, x, n=n)
    if kind == "qtl":
        return node("place", x, n=n)
    if kind == "zscore_biased":
        return node("over", x, node("std", x, n=n), mean)
    if kind == "zscore_adj":
        return node("over", node("minus", x, mean), node("std", node("diff", x, n=1), n=n), mean, times=float(np.sqrt(n)))
    return node("over", node("minus", x, mean), node("std", x, n=n), mean)


def _method(d: Definition, x: tuple) -> tuple:
    p = d.params
    if d.method == "rng":
        return node("range", x, middle=p[0], most=p[1], unit=p[2])
    if d.method in SEASONAL:
        return node("season", node("present", x), back=int(p[0]), ahead=int(p[1]), years=int(p[2]), least=SEASONAL[d.method])
    if d.method in ("dbl_th", "hysteresis"):
        y = _windowed(SCORES[d.change], int(p[1]), x, d.vol) if d.change else x
        return node("beyond", y, level=p[0]) if d.method == "dbl_th" else node("hysteresis", y, enter=p[0], gap=p[2], side=len(p) <= 3 or p[3] > 0)
    if d.method == "":
        return x
    if d.method not in CONV:
        raise ValueError(f"no method {d.method}")
    x = node("present", x)
    low, high = d.cap or (None, None)
    return node("average", *[node("capped", _windowed(d.method, n, x, d.vol), x, n=n, low=low, high=high) for n in range(*map(int, p[:3]))])


def _after(d: Definition, x: tuple, hold_last: bool) -> tuple[tuple, tuple | None]:
    """The signal behind its chain; with hold_last a buffer at the end isn't applied, and its gap comes beside the signal."""
    steps, gap = (d.after.split("|") if d.after else []), None
    if steps:
        x = node("grid", node("present", x), days=BUSINESS)
    for i, step in enumerate(steps):
        head, rest = step[:3], step[3:]
        if head in ("buf", "bfc"):
            gap = node("level", x, value=float(rest)) if head == "buf" else node("cost_gap", x, node("feature", name="close"), size=float(rest))
            x, gap = (x, gap) if hold_last and i == len(steps) - 1 else (node("buffer", x, gap), None)
        elif head == "ema":
            x = node("smooth", x, alpha=com(int(rest)), skip=True)
        elif head == "sma":
            x = node("mean", x, n=int(rest))
        elif head == "hmp":
            x = node("hump", x, gap=float(rest))
        elif head == "hys":
            _, enter, leave = step.split("_")
            x = node("hysteresis", x, enter=float(enter), gap=float(leave), side=True)
        elif head in ("pos", "neg"):
            x = node("one_side", x, sign=1 if head == "pos" else -1)
        elif head == "arr":
            x = node("arrears", x, k=float(rest))
        elif head == "acl":
            x = node("diff", x, n=int(rest))
        elif head == "sgn":
            x = node("sign", x)
        else:
            raise ValueError(f"no step {step}")
    return x, gap


def graph(s: Stored) -> tuple[tuple, tuple | None]:
    """The node of a definition's signal, and that of the gap of a buffer which comes later."""
    d = s.definition
    x = node("feature", name=d.feature)
    if d.freq.startswith("W-"):
        x = node("grid", x, days=(DAYS[d.freq[2:]],))
    x = _method(d, _before(d, x))
    x, gap = _after(d, x if d.bullish else node("minus_x", x), bool(s.across))
    return (x, gap) if s.kind == "own" else (node("grid", node("present", x), days=EVERY), None)


def _steps(x: pd.Series, step, state: tuple) -> pd.Series:
    out = np.empty(len(x))
    for i, v in enumerate(x.to_numpy(float)):
        state = step(state, v)
        out[i] = state[0]
    return pd.Series(out, x.index)


def _grid(x: pd.Series, days) -> pd.Series:
    if not len(x):
        return x
    x = x.reindex(pd.date_range(x.index[0], x.index[-1])).ffill()
    return x[x.index.weekday.isin(days)]


def _change(x, n, change):
    return x - x.shift(n) if change == "diff" else x / x.shift(n).replace(0, np.nan) - 1


def _rolling(fn, n: int, *columns: pd.Series) -> pd.Series:
    """fn of every window of n rows, each about its own values (running sums would carry rounding along), in blocks of rows."""
    out = np.full(len(columns[0]), np.nan)
    if len(out) >= n:
        views = [np.lib.stride_tricks.sliding_window_view(c.to_numpy(float), n) for c in columns]
        with np.errstate(divide="ignore", invalid="ignore"):
            for i in range(0, len(views[0]), 4096):
                out[i + n - 1 : i + n - 1 + len(views[0][i : i + 4096])] = fn(*(v[i : i + 4096] for v in views))
    return pd.Series(out, columns[0].index)


def _mean(x, n, least=None):
    return _rolling(lambda w: w.mean(axis=1), n, x) if least is None else x.rolling(n, min_periods=max(1, least)).mean()


def _std(x, n, least=None):
    return _rolling(lambda w: w.std(axis=1, ddof=1), n, x) if least is None else x.rolling(n, min_periods=max(1, least)).std()


def _slope(y, x):
    away = x - x.mean(axis=1, keepdims=True)
    return (y * away).sum(axis=1) / (away * away).sum(axis=1)


def _residual(x, index, change, n):
    """Summed changes less beta times those of the index; beta from five-day means of five-day changes, not below 0."""
    index = index.reindex(x.index)
    own, other = (_mean(_change(v, 5, change), 5) for v in (x, index))
    beta = _rolling(_slope, n, own, other).clip(lower=0).ffill()
    return (_change(x, 1, change) - beta * _change(index, 1, change)).cumsum().ffill()


_NEW_YEARS = np.array(NEW_YEARS, "datetime64[D]")


def _yoy_one(x: pd.Series, kind: str, group: str, change: str) -> pd.Series:
    """x against the same label of the year before; labels without a value take the one before in their year, else the one behind."""
    if not len(x):
        return x
    if kind == "cal":
        year, label = x.index.year.to_numpy(), (x.index.dayofyear.to_numpy() if group == "day" else x.index.isocalendar().week.to_numpy().astype(int))
    else:
        days = x.index.to_numpy().astype("datetime64[D]")
        far = np.abs((days[:, None] - _NEW_YEARS).astype(int))
        near = _NEW_YEARS[far.argmin(axis=1)]
        year, label = near.astype("datetime64[Y]").astype(int) + 1970, (days - near).astype(int)
        label = label if group == "day" else label // 7
    cells = pd.DataFrame({"year": year, "label": label, "x": x.to_numpy()}).groupby(["year", "label"])["x"].last().unstack().ffill(axis=1).bfill(axis=1)
    value = cells.diff() if change == "diff" else cells / cells.shift().replace(0, np.nan) - 1
    late = (year > year[0] + 1) | ((year == year[0] + 1) & (label > label[0]))
    row, column = cells.index.get_indexer(year), cells.columns.get_indexer(label)
    return pd.Series(value.to_numpy()[row, column], x.index)[late]


def _yoy(x, kind, group, change):
    if kind != "stitched":
        return _yoy_one(x, kind, group, change)
    both = pd.concat([_yoy_one(x, k, group, change) for k in ("cal", "lunar")], axis=1, keys=("cal", "lunar")).sort_index().ffill()
    day = both.index
    from_march = pd.Series((day - pd.to_datetime(dict(year=day.year, month=3, day=15)).to_numpy()).days / 30, day).clip(0, 1)
    from_december = pd.Series(1 - (day - pd.to_datetime(dict(year=day.year, month=12, day=1)).to_numpy()).days / 30, day).clip(lower=0)
    part = from_december.where(day.month == 12, from_march)
    return both["cal"] * part + both["lunar"] * (1 - part)


def _season(x, back, ahead, years, least):
    """Score of x among the rows from back days before to ahead days behind this day of the former years, and those of this year up to now."""
    day = x.index.to_numpy().astype("datetime64[D]")
    centred = (x - x.mean()).to_numpy().astype(np.longdouble)  # sums of all rows are taken from each other
    sums = [np.concatenate([[0], np.cumsum(centred**k)]) for k in (0, 1, 2)]
    end = np.arange(1, len(x) + 1)
    n, s1, s2 = (np.zeros(len(x), np.longdouble) for _ in range(3))
    leap = (x.index.month == 2) & (x.index.day == 29)
    for k in range(min(years, x.index[-1].year - x.index[0].year) + 1 if len(x) else 0):
        middle = (x.index - pd.DateOffset(years=k)).to_numpy().astype("datetime64[D]") - (leap.astype(int) if k == 0 else 0)
        first = np.searchsorted(day, middle - back)
        last = end if k == 0 else np.minimum(np.searchsorted(day, middle + ahead, "right"), last_first)
        first = np.minimum(first, last)
        n, s1, s2 = n + sums[0][last] - sums[0][first], s1 + sums[1][last] - sums[1][first], s2 + sums[2][last] - sums[2][first]
        last_first = first
    with np.errstate(divide="ignore", invalid="ignore"):
        mean, spread = s1 / n, np.sqrt(np.maximum(s2 - s1 * s1 / n, 0) / (n - 1))
        out = (centred - mean) / np.where(spread > 0, spread, np.nan)
    return pd.Series(np.where(n >= least, out, np.nan).astype(float), x.index)


def _robust(x):
    v = x.ewm(span=35, min_periods=10).std()
    v = v.where(~(v < 1e-8), 1e-8)
    return np.maximum(v, v.rolling(500, min_periods=100).quantile(0.05).ffill().fillna(0))


def _k(x, n):
    low, high = x.rolling(n).min(), x.rolling(n).max()
    return (x - low) / (high - low).replace(0, np.nan) - 0.5


def _over(x, scale, size, times=1.0):
    scale = scale * times
    return x / scale.where(scale > 1e-7 * size.abs())


def _cost_gap(x, close, size):
    """A gap that grows with the cost of a trade and falls with the price's volatility."""
    vol = close.pct_change(fill_method=None).rolling(COST_VOL).std()
    vol = vol.reindex(vol.index.union(x.index)).ffill().reindex(x.index)
    return size * (3 * TRADE_COST / vol) ** (1 / 3)


def _buffer(x, gap):
    """The first row takes the signal if it is at least gap; then trades go to the near edge of the band."""
    held, out = None, np.empty(len(x))
    for i, (v, g) in enumerate(zip(x.to_numpy(float), gap.to_numpy(float), strict=True)):
        if held is None:
            held = v if abs(v) >= g else 0.0
        elif v - g >= held:
            held = v - g
        elif v + g < held:
            held = v + g
        out[i] = held
    return pd.Series(out, x.index)


STEPS = {
    "grid": _grid, "present": lambda x: x.dropna(), "diff": lambda x, n: x - x.shift(n), "pct_change": lambda x, n: _change(x, n, "pct_change"), "mean": _mean, "std": _std, "total": lambda x, n: x.rolling(n).sum(), "smooth": lambda x, alpha, skip=False: x.ewm(alpha=alpha, ignore_na=skip).mean(),
    "smooth_std": lambda x, alpha, least: x.ewm(alpha=alpha, min_periods=least).std(), "log1p": lambda x: np.log1p(x.where(x > -1)), "running": lambda x: x.cumsum().ffill(), "abs": lambda x: x.abs(), "minus": lambda x, y: x - y, "minus_x": lambda x: -x,
    "sign": np.sign, "clear_sign": lambda d, x: np.sign(d).where((d.abs() > 1e-9 * x.abs()) | d.isna(), 0.0), "over": _over, "ratio": lambda x, y: x / y.replace(0, np.nan), "robust": _robust, "hlratio": lambda x, n: 2 * _k(x, n),
    "kdj": lambda x, n: (lambda k: 3 * k - 2 * k.rolling(3).mean())(_k(x, n)), "place": lambda x, n: 2 * (x.rolling(n).rank(method="max") - 1) / (n - 1) - 1, "capped": lambda v, x, n, low, high: (v if low is None else v.clip(low, high)) * (1 if len(x) > n else np.nan),
    "average": lambda *x: pd.concat(x, axis=1).mean(axis=1), "range": lambda x, middle, most, unit: (x - middle).clip(-most, most) / unit, "season": _season, "beyond": lambda x, level: np.sign(x).where((x.abs() >= level) | x.isna(), 0.0), "residual": _residual, "yoy": _yoy,
    "hysteresis": lambda x, enter, gap, side: _steps(x, kn.hysteresis(enter, gap, side), (0.0, 0.0)), "hump": lambda x, gap: _steps(x, kn.hump_from_first(gap), (0.0, 0.0)), "one_side": lambda x, sign: x.where(x * sign > 0, 0.0),
    # k times a value taken from k + 1 times it: the value itself. Stored definitions carry this step; it changes nothing.
    "arrears": lambda x, k: (k + 1) * x - k * x, "level": lambda x, value: pd.Series(value, x.index), "cost_gap": _cost_gap, "buffer": _buffer,
}


class History:
    """An asset's columns by date, and every node worked out so far."""

    def __init__(self, columns: dict[str, pd.Series]):
        self.columns, self.known = columns, {}

    def value(self, n: tuple) -> pd.Series:
        if n not in self.known:
            step, params, inputs = n
            self.known[n] = self.columns[dict(params)["name"]].dropna() if step == "feature" else STEPS[step](*map(self.value, inputs), **dict(params))
        return self.known[n]


def stored_definitions(table: DataFrame) -> list[Stored]:
    """The rows of a table of definitions, MOST_DEFINITIONS at most."""
    rows = table.limit(MOST_DEFINITIONS + 1).collect()
    if len(rows) > MOST_DEFINITIONS:
        raise ValueError(f"more than {MOST_DEFINITIONS} definitions")
    return [Stored.of(r) for r in rows]


def own_signals(panel: DataFrame, stored: list[Stored]) -> DataFrame:
    """signal, asset, date, value and gap (of a buffer to come) of all definitions, for those of an asset that read its own features."""
    graphs = [(s, *graph(s)) for s in stored]

    def features(n: tuple) -> set[str]:
        return {dict(n[1])["name"]} if n[0] == "feature" else set().union(*map(features, n[2]))

    names = sorted(set().union(*(features(g) for _, x, gap in graphs for g in (x, gap) if g)))

    def signals(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        asset, index, out = pdf["asset"].iloc[0], pd.DatetimeIndex(pdf["date"]), []
        history = History({c: pd.Series(pdf[f"f{i}"].to_numpy(float), index) for i, c in enumerate(names)})
        for s, x, gap in graphs:
            if not s.assets or (asset in s.assets if s.kind == "own" else asset == s.assets[0]):
                value = history.value(x)
                out.append(pd.DataFrame({"signal": s.signal, "asset": asset, "date": value.index.date, "value": value.to_numpy(float), "gap": history.value(gap).to_numpy(float) if gap else np.nan}))
        return pd.concat(out) if out else pd.DataFrame(columns=["signal", "asset", "date", "value", "gap"], dtype=object)

    columns = [F.expr(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)]
    made = panel.select("asset", "date", *columns).groupBy("asset").applyInPandas(signals, "signal string, asset string, date date, value double, gap double")
    return made.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("value", "gap")})


def across_assets(signals: DataFrame, how: str) -> DataFrame:
    """value demeaned, scored or ranked (-1 to 1, ties averaged) among the assets of a signal's day; rows without a value drop out."""
    day = Window.partitionBy("signal", "date")
    s = signals.where("value IS NOT NULL")
    away = F.col("value") - F.avg("value").over(day)
    if how == "demean":
        return s.withColumn("value", away)
    if how == "score":
        return s.withColumn("value", away / F.nullif(F.stddev_samp("value").over(day), F.lit(0)))
    s = s.withColumn("rounded", F.round("value", 9))
    place = F.rank().over(day.orderBy("rounded")) + (F.count("*").over(Window.partitionBy("signal", "date", "rounded")) - 1) / 2
    n = F.count("*").over(day)
    return s.withColumn("value", 2 * (place - (n + 1) / 2) / F.nullif(n - F.lit(1.0), F.lit(0))).drop("rounded")


def buffered(signals: DataFrame) -> DataFrame:
    """value behind its buffer, where a row has a gap."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        return pdf.assign(value=_buffer(pdf["value"], pdf["gap"]))

    return signals.where("gap IS NULL").union(signals.where("gap IS NOT NULL").groupBy("signal", "asset").applyInPandas(run, signals.schema))


def _targets(spark: SparkSession, stored: list[Stored], sides) -> DataFrame:
    rows = [(s.signal, a, float(w), s.assets[-1]) for s in stored for a, w in sides(s)]
    return spark.createDataFrame(rows, "signal string, asset string, side double, index string")


def given_to_assets(signals: DataFrame, panel: DataFrame, stored: list[Stored]) -> DataFrame:
    """The first asset's signal for every asset of its definition (of a pair: against the second), on that asset's days."""
    targets = _targets(panel.sparkSession, stored, lambda s: [(a, -1 if s.kind == "pair" and i else 1) for i, a in enumerate(s.assets)])
    days = panel.select("asset", "date").join(targets, "asset")
    held = signals.select("signal", "date", "value")
    return days.join(held, ["signal", "date"]).select("signal", "asset", "date", (F.col("value") * F.col("side")).alias("value"), F.lit(None).cast("double").alias("gap"))


def neutral_to_index(signals: DataFrame, panel: DataFrame, stored: list[Stored]) -> DataFrame:
    """Positions in assets and against their index asset: the beta of five-day mean returns over BETA_DAYS, sized by the volatility of what is left."""
    targets = _targets(panel.sparkSession, stored, lambda s: [(a, 1) for a in s.assets[:-1]])
    index = panel.select(F.col("asset").alias("index"), "date", F.col("close").alias("index_close"))
    both = panel.select("asset", "date", "close").join(targets, "asset").join(index, ["index", "date"]).join(signals.select("signal", "date", "value"), ["signal", "date"], "left")
    w = Window.partitionBy("signal", "asset").orderBy("date")
    last = lambda n: w.rowsBetween(1 - n, 0)
    full = lambda column, n, over: F.when(F.count("*").over(last(n)) >= n, over)
    ret = lambda c: F.coalesce(F.col(c) / F.lag(c).over(w) - 1, F.lit(0.0))
    both = both.withColumns({"r": ret("close"), "ri": ret("index_close"), "held": F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    both = both.withColumns({"m": full("r", 5, F.avg("r").over(last(5))), "mi": full("ri", 5, F.avg("ri").over(last(5))), "v": full("r", NEUTRAL_VOL, F.stddev_samp("r").over(last(NEUTRAL_VOL))), "vi": full("ri", NEUTRAL_VOL, F.stddev_samp("ri").over(last(NEUTRAL_VOL)))})
    beta = F.when(F.count("m").over(last(BETA_DAYS)) >= BETA_DAYS, F.covar_samp("mi", "m").over(last(BETA_DAYS)) / F.nullif(F.var_samp("mi").over(last(BETA_DAYS)), F.lit(0)))
    both = both.withColumn("beta", beta).withColumn("left", F.col("r") - F.col("beta") * F.col("ri"))
    both = both.withColumn("vl", F.when(F.count("left").over(last(NEUTRAL_VOL)) >= NEUTRAL_VOL, F.nullif(F.stddev_samp("left").over(last(NEUTRAL_VOL)), F.lit(0))))
    legs = F.array(F.struct(F.col("asset"), (F.col("held") * F.col("v") / F.col("vl")).alias("value")), F.struct(F.col("index").alias("asset"), (-F.col("held") * F.col("beta") * F.col("vi") / F.col("vl")).alias("value")))
    return both.select("signal", "date", F.explode(legs).alias("leg")).groupBy("signal", F.col("leg.asset").alias("asset"), "date").agg(F.sum("leg.value").alias("value")).select("signal", "asset", "date", "value", F.lit(None).cast("double").alias("gap"))


def run_stored(panel: DataFrame, table: DataFrame) -> DataFrame:
    """signal, asset, date and value of every definition of a table (TABLE); panel: asset, date and the columns that features read."""
    stored = stored_definitions(table)
    names = lambda test: [s.signal for s in stored if test(s)]
    made = own_signals(panel, stored)
    of = lambda test: made.where(F.col("signal").isin(names(test)))
    parts = [of(lambda s: s.kind == "own" and not s.across)]
    parts += [buffered(across_assets(of(lambda s, h=how: s.kind == "own" and s.across == h), how)) for how in sorted({s.across for s in stored if s.kind == "own"} - {""})]
    joint = {"given": [s for s in stored if s.kind in ("shared", "pair")], "neutral": [s for s in stored if s.kind == "neutral"]}
    if joint["given"]:
        parts.append(given_to_assets(of(lambda s: s.kind in ("shared", "pair")), panel, joint["given"]))
    if joint["neutral"]:
        parts.append(neutral_to_index(of(lambda s: s.kind == "neutral"), panel, joint["neutral"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("signal", "asset", "date", "value")
