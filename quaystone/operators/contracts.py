"""Contract codes, grades and options on contracts."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE = r"^([A-Za-z]+)([0-9]{3,4})(?:-?([CP])-?([0-9]+))?$"


def code_parts(code: Column, ref_year: Column) -> dict[str, Column]:
    """product, contract month (yyyymm), option side and strike of a code like rb2405, TA405 or m2405-C-3000.

    A year of one digit is of the reference year's decade from 5 on, else of the decade of the year five years later.
    """
    part = lambda k: F.nullif(F.regexp_extract(code, CODE, k), F.lit(""))
    digits = part(2).cast("int")
    decade = F.when(F.floor(digits / 100) >= 5, F.floor(ref_year / 10) * 10).otherwise(F.floor((ref_year + 5) / 10) * 10)
    month = F.when(F.length(part(2)) == 4, 200000 + digits).otherwise(decade * 100 + digits)
    return {"product": part(1), "month": month.cast("int"), "side": part(3), "strike": part(4).cast("int")}


# Grades (iron, silica, alumina, phosphorus, sulphur in per cent) and the exchange's premiums by regime.
GRADES = {
    "iocj": (65.0, 2.0, 1.37, 0.06, 0.01), "brbf": (62.5, 5.2, 1.8, 0.07, 0.0), "ssf": (56.5, 6.2, 3.0, 0.05, 0.045), "pbf": (61.5, 3.57, 2.31, 0.09, 0.02),
    "macf": (60.8, 4.4, 2.3, 0.08, 0.02), "jmb": (60.5, 4.5, 2.9, 0.12, 0.02), "nmf": (62.7, 4.11, 2.2, 0.1, 0.06),
}
#: Of a regime: first and last day, what a grade must meet, terms (element, side, threshold, width, a point's worth), premiums of brands.
REGIMES = (
    ("2013-10-14", "2018-08-15", "fe BETWEEN 60 AND 65 AND al + si <= 10 AND p <= 0.15 AND s <= 0.2",
     (("fe", "above", 62, 3, 10), ("fe", "below", 62, None, -15), ("si", "above", 4, None, -10), ("al", "above", 2.5, None, -10), ("p", "above", 0.07, None, -100), ("p", "above", 0.1, None, -200), ("s", "above", 0.05, None, -100)), {}),
    ("2018-08-15", "2020-08-15", "fe >= 60 AND al + si <= 8.5 AND si <= 6.5 AND al <= 3.5 AND p <= 0.15 AND s <= 0.2",
     (("fe", "above", 62, 3, 10), ("fe", "below", 62, None, -15), ("si", "above", 4, None, -10), ("si", "above", 4.5, 2, -10), ("al", "above", 2.5, None, -15), ("al", "above", 3, 0.5, -15), ("p", "above", 0.07, None, -100), ("p", "above", 0.1, None, -200), ("s", "above", 0.03, None, -100)), {}),
    ("2020-08-15", "2022-01-18", "true", (("fe", "above", 62, None, 10), ("fe", "below", 62, None, -10), ("si", "above", 5, None, -10), ("al", "above", 2.5, None, -10), ("p", "above", 1, None, -500), ("s", "above", 0.03, None, -100)),
     {"macf": -20, "jmb": -25, "brbf": 20, "ssf": -90, "iocj": 35}),
    ("2022-01-18", "2022-04-19", "true", (("fe", "above", 62, None, 10), ("fe", "below", 62, None, -10), ("si", "above", 5, None, -10), ("al", "above", 2.5, None, -10), ("p", "above", 1, None, -500), ("s", "above", 0.03, None, -100)),
     {"macf": -30, "jmb": -35, "brbf": 20, "ssf": -80, "iocj": 90}),
    ("2022-04-19", "9999-12-31", "fe >= 56 AND si <= 8.5 AND al <= 3.5 AND p <= 0.15 AND s <= 0.2",
     (("fe", "above", 61, None, 15), ("fe", "below", 61, None, -15), ("fe", "below", 60, None, -15), ("fe", "above", 63.5, None, 10), ("si", "above", 4.5, None, -10), ("si", "above", 6.5, None, -5), ("si", "below", 4.5, None, 5),
      ("al", "above", 2.5, None, -30), ("al", "below", 2.5, 1.5, 20), ("p", "above", 0.1, None, -1000), ("p", "above", 0.12, None, -500), ("s", "above", 0.03, None, -100), ("s", "above", 0.1, None, -400)), {"pbf": 15, "iocj": 15, "brbf": 15}),
)


def _term(element: str, side: str, threshold: float, width: float | None, worth: float) -> str:
    far = f"{element} - {threshold}" if side == "above" else f"{threshold} - {element}"
    inside = f"greatest({far}, 0)" if width is None else f"least(greatest({far}, 0), {width})"
    return f"{worth} * {inside}"


def premium() -> str:
    """A grade's premium on a day (columns brand, fe, si, al, p, s, day), of the latest regime that it meets; reads the same in both dialects."""
    cases = []
    for first, last, meets, terms, brands in reversed(REGIMES):
        extra = "CASE brand " + " ".join(f"WHEN '{b}' THEN {v}" for b, v in brands.items()) + " ELSE 0 END" if brands else "0"
        cases.append(f"WHEN day BETWEEN DATE '{first}' AND DATE '{last}' AND ({meets}) THEN {' + '.join(_term(*t) for t in terms)} + {extra}")
    return f"CASE {' '.join(cases)} END"


#: Knots of the normal distribution function, a thousandth of sqrt(2) apart, and its slopes there times that step.
_STEP = 1e-3
_KNOTS = np.arange(0, 6 + 2 * _STEP, _STEP)
_HEIGHTS = np.array([0.5 * (1 + math.erf(k)) for k in _KNOTS])
_SLOPES = np.exp(-(_KNOTS**2)) / math.sqrt(math.pi) * _STEP


def _normal(x):
    """Normal distribution function of an array by cubics between knots, to within 1e-13."""
    z = np.asarray(x, float) / math.sqrt(2)
    far = np.minimum(np.nan_to_num(np.abs(z)), 6.0) / _STEP
    at = far.astype(np.int64)
    u = far - at
    v = 1 - u
    y = _HEIGHTS[at] * v * v * (1 + 2 * u) + _HEIGHTS[at + 1] * u * u * (1 + 2 * v) + u * v * (_SLOPES[at] * v - _SLOPES[at + 1] * u)
    return np.where(np.isnan(z), np.nan, np.where(z < 0, 1 - y, y))


def hedged_value(prices: np.ndarray, days: np.ndarray, vol: float, year: float = 365.25) -> float:
    """Price of an at-the-money call on a forward plus what hedging it at its delta brings, less its pay-off; zero at the break-even volatility."""
    strike, tau = prices[0], np.maximum(days[-1] - days, 1) / year
    sd = vol * np.sqrt(tau)
    d1 = np.log(prices / strike) / sd + sd / 2
    value = prices[0] * _normal(d1[0]) - strike * _normal(d1[0] - sd[0])
    return float(value + (_normal(d1[:-1]) * np.diff(prices)).sum() - max(prices[-1] - strike, 0.0))


def breakeven(df: DataFrame, least: int = 10) -> DataFrame:
    """The volatility at which a delta-hedged call on a contract breaks even, by halving; df: asset, contract, date, close. A group is one contract's history; null without a root."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        prices, days = pdf["close"].to_numpy(float), np.array([d.toordinal() for d in pdf["date"]], float)
        out = pdf[["asset", "contract"]].head(1).assign(n=len(pdf), vol=np.nan)
        if len(pdf) >= least and (prices > 0).all():
            low, high = 1e-3, 20.0
            if hedged_value(prices, days, low) * hedged_value(prices, days, high) < 0:
                sign = math.copysign(1, hedged_value(prices, days, high))
                for _ in range(60):
                    mid = (low + high) / 2
                    low, high = (low, mid) if sign * hedged_value(prices, days, mid) > 0 else (mid, high)
                out["vol"] = (low + high) / 2
        return out

    return df.groupBy("asset", "contract").applyInPandas(run, "asset string, contract string, n long, vol double")


#: Names of the surface's strikes and the call deltas that set them; the first is at the money.
DELTAS = {"atm": 0.5, "d25": 0.25, "d75": 0.75}


def _roots(value, rows: int, low: float = 1e-3, high: float = 20.0, steps: int = 60) -> np.ndarray:
    """Where value (a vector of vols in, one of values out) changes sign, for all rows at once by halving; nan where its ends have the same sign."""
    lows, highs = np.full(rows, low), np.full(rows, high)
    down, up = value(lows), value(highs)
    for _ in range(steps):
        mid = (lows + highs) / 2
        above = np.sign(value(mid)) == np.sign(up)
        lows, highs = np.where(above, lows, mid), np.where(above, mid, highs)
    return np.where(down * up < 0, (lows + highs) / 2, np.nan)


def surface(prices: np.ndarray, left: np.ndarray, tenors: list[int], deltas: dict[str, float] = DELTAS, year: float = 365.25):
    """Strikes, volatilities (tenors by strikes) and price counts (tenors) of one contract: prices in order of date and days left to expiry.

    A tenor's call starts with the first price so many days or fewer before expiry, is hedged from price to price at its
    delta and ends with the last price. The strike of a delta is that at the root of the money.
    """
    live = left[None, :] <= np.array(tenors)[:, None]
    first = np.where(live.any(axis=1), live.argmax(axis=1), len(prices) - 1)
    start, tau = prices[first], np.maximum(left, 1) / year
    moves = np.where(live[:, :-1], np.diff(prices)[None, :], 0.0)

    def value(strikes, vols, at):
        sd = vols[:, None] * np.sqrt(tau)[None, :]
        d1 = np.log(prices[None, :] / strikes[:, None]) / sd + sd / 2
        deltas_, rows = _normal(d1), np.arange(len(at))
        begin = start[at] * deltas_[rows, first[at]] - strikes * _normal((d1 - sd)[rows, first[at]])
        return begin + (deltas_[:, :-1] * moves[at]).sum(axis=1) - np.maximum(prices[-1] - strikes, 0.0)

    all_, shape = np.arange(len(tenors)), (len(tenors), len(deltas))
    middle = _roots(lambda v: value(start, v, all_), len(tenors))
    quantile = np.array([NormalDist().inv_cdf(d) for d in deltas.values()])
    sd = (middle * np.sqrt(tau[first]))[:, None]
    strikes = np.where(quantile[None, :] == 0, start[:, None], start[:, None] / np.exp((quantile[None, :] - sd / 2) * sd))
    at, flat = np.repeat(all_, len(deltas)), strikes.ravel()
    vols = np.where(np.isnan(flat), np.nan, _roots(lambda v: value(np.where(np.isnan(flat), 1.0, flat), v, at), len(flat)))
    return strikes, vols.reshape(shape), live.sum(axis=1)


def breakeven_surface(df: DataFrame, tenors: list[int], deltas: dict[str, float] = DELTAS, least: int = 10) -> DataFrame:
    """Break-even volatility of a delta-hedged call per contract, tenor (days before expiry) and strike; df: asset, contract, expiry, date, close.

    A group is one contract's daily history, and all its roots are halved together. vol is null without a root, with
    fewer than least prices, or where a price isn't positive; prices after the expiry or null don't count.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        prices = pdf["close"].to_numpy(float)
        left = np.array([(e - d).days for e, d in zip(pdf["expiry"], pdf["date"], strict=True)], float)
        strikes, vols, n = surface(prices, left, tenors, deltas) if (prices > 0).all() else (*[np.full((len(tenors), len(deltas)), np.nan)] * 2, (left[None, :] <= np.array(tenors)[:, None]).sum(axis=1))
        vols = np.where((n >= least)[:, None], vols, np.nan)
        out = [(t, k, int(n[i]), strikes[i, j], vols[i, j]) for i, t in enumerate(tenors) for j, k in enumerate(deltas)]
        made = pd.DataFrame(out, columns=["tenor", "strike_name", "n", "strike", "vol"])
        return made.assign(asset=pdf["asset"].iloc[0], contract=pdf["contract"].iloc[0])[["asset", "contract", *made.columns]]

    # a stated number of partitions isn't merged by size: rows are few beside the work on them
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.where("close IS NOT NULL AND date <= expiry").repartition(parts, "asset", "contract")
    return rows.groupBy("asset", "contract").applyInPandas(run, "asset string, contract string, tenor int, strike_name string, n long, strike double, vol double")
