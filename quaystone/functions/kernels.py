"""Sequential state machines, run once per key on its rows in order.

A machine is a function of the former state and the row's inputs that gives the next state; scan() runs it over arrays
inside applyInPandas. A key's rows are one asset's (or one scenario and asset's) daily history, so a group is bounded
by the length of that history. recursion() states the same machine as a recursive query for the cross-check.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def scan(df: DataFrame, step: Callable, inputs: list[str], states: dict[str, float], keys=("asset",), order="date") -> DataFrame:
    """df's keys and order column with a double column per state; step(state tuple, *inputs) -> state tuple."""
    names = list(states)
    first = tuple(states.values())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        columns, state, out = [pdf[c].to_numpy(float) for c in inputs], first, np.empty((len(pdf), len(names)))
        for i, row in enumerate(zip(*columns, strict=True)):
            state = step(state, *row)
            out[i] = state
        return pdf[[*keys, order]].assign(**{n: out[:, k] for k, n in enumerate(names)})

    kept = df.select(*keys, order, *inputs)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in (*keys, order))
    return kept.groupBy(*keys).applyInPandas(run, schema + "".join(f", `{n}` double" for n in names))


def hysteresis(enter: float, gap: float, side_only: bool = True) -> Callable:
    """Flat on the first row; take the signal's side (or the signal itself) beyond enter, and give it up when the signal falls back by gap.

    A held position is kept while the signal is null; states: position and whether a row has been seen.
    """

    def step(state, x):
        held, seen = state
        if not seen:
            return 0.0, 1.0
        take = (float(np.sign(x)) if side_only else x) if abs(x) > enter else 0.0
        if held == 0:
            return take, 1.0
        side = 1.0 if held > 0 else -1.0
        return (take if x * side <= enter - gap else held), 1.0

    return step


def hump(gap: float) -> Callable:
    """Follow the signal only when it is at least gap away."""
    return lambda state, x: (x,) if not np.isnan(x) and abs(x - state[0]) >= gap else state


def buffered(state, x, gap):
    """Trade to the near edge of the band of gap around the signal."""
    held = state[0]
    return state if np.isnan(x) else (min(max(held, x - gap), x + gap),)


def hump_from_first(gap: float) -> Callable:
    """As hump, but the first row takes its signal; states: position and whether a row has been seen."""
    return lambda state, x: ((state[0] if np.isnan(x) or (state[1] and abs(x - state[0]) < gap) else x), 1.0)


def buffer_from_first(gap: float) -> Callable:
    """Trade to the near edge of the band; the first row takes the signal itself if it is at least gap."""

    def step(state, x):
        held, seen = state
        if np.isnan(x):
            return held, 1.0
        if not seen:
            return (x if abs(x) >= gap else 0.0), 1.0
        return (x - gap if x - gap >= held else x + gap if x + gap < held else held), 1.0

    return step


def parabolic(start: float = 0.02, most: float = 0.2) -> Callable:
    """Parabolic stop: (stop, side, extreme, acceleration, last two highs and lows)."""

    def step(state, high, low):
        stop, side, extreme, speed, h1, l1, h2, l2 = state
        if side == 0:
            return low, 1.0, high, start, high, low, high, low
        stop += speed * (extreme - stop)
        if (low < stop) if side > 0 else (high > stop):
            return extreme, -side, low if side > 0 else high, start, high, low, h1, l1
        if side > 0 and high > extreme or side < 0 and low < extreme:
            extreme, speed = (high if side > 0 else low), min(speed + start, most)
        stop = min(stop, l1, l2) if side > 0 else max(stop, h1, h2)
        return stop, side, extreme, speed, high, low, h1, l1

    return step


def band_stop(state, close, upper, lower):
    """Stop-and-reverse on bands that only tighten: (upper, lower, trend)."""
    up, down, trend = state
    if np.isnan(upper) or np.isnan(up):
        return upper, lower, trend
    trend = 1.0 if close > up else -1.0 if close < down else trend
    return (min(upper, up) if trend < 0 else upper), (max(lower, down) if trend > 0 else lower), trend


def passband(a1: float, a2: float) -> Callable:
    """Two-pole filter: (output, output before, input)."""
    return lambda state, x: ((a1 - a2) * x + (a2 - a1) * state[2] + (2 - a1 - a2) * state[0] - (1 - a1) * (1 - a2) * state[1], state[0], x)


def trail(stop: float, cost: float = 0.0, close_out: float = 0.0) -> Callable:
    """Follow a side at the close; leave at the open if it gaps through the trailing stop, else at the stop: (pos, best, entry, pnl). Each side traded costs cost, leaving at a stop close_out besides."""

    def step(state, open_, high, low, close, side):
        pos, best, entry, pnl = state
        if pos:
            level = best * (1 - pos * stop)
            if pos * (open_ - level) <= 0 or pos * ((low if pos > 0 else high) - level) <= 0:
                leave = open_ if pos * (open_ - level) <= 0 else level
                return 0.0, 0.0, 0.0, pnl + pos * (leave / entry - 1) - cost - close_out
            best = max(best, high) if pos > 0 else min(best, low)
        if side and side != pos:
            return side, close, close, pnl + (pos * (close / entry - 1) - cost if pos else 0.0) - cost
        return pos, best, entry, pnl

    return step


def recursion(base: str, source: str, states: dict[str, tuple[str, str]], out: str) -> str:
    """A query over source (asset, date, rn from 0): states start as the first texts over p and go on as the second over p and r."""
    names = ", ".join(states)
    first, after = (", ".join(t[i] for t in states.values()) for i in (0, 1))
    return f"WITH RECURSIVE {base}, r(asset, date, rn, {names}) AS (SELECT asset, date, rn, {first} FROM {source} p WHERE rn = 0 UNION ALL SELECT p.asset, p.date, p.rn, {after} FROM r JOIN {source} p ON p.asset = r.asset AND p.rn = r.rn + 1) SELECT asset, date, {out} FROM r"


def lifo_trades(df: DataFrame) -> DataFrame:
    """Closed trades of a position path (asset, date, pos, price): each addition opens a lot, reductions close the latest lots first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lots, out, held, asset = [], [], 0.0, None
        for asset, date, pos, price in pdf.sort_values("date")[["asset", "date", "pos", "price"]].itertuples(index=False):
            change = pos - held
            while lots and change * lots[-1][0] < 0:
                size, day, at = lots.pop()
                part = -np.sign(change) * min(abs(size), abs(change))
                out.append((asset, part, day, at, date, price, part * (price - at)))
                if abs(size) > abs(part):
                    lots.append((size - part, day, at))
                change += part
            if change:
                lots.append((change, date, price))
            held = pos
        return pd.DataFrame(out, columns=["asset", "size", "entry_date", "entry_price", "exit_date", "exit_price", "profit"])

    return df.groupBy("asset").applyInPandas(run, "asset string, size double, entry_date date, entry_price double, exit_date date, exit_price double, profit double")
