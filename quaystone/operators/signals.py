"""Stored signal definitions: a tuple names a feature, a chain of steps before, a method, and a chain of steps after.

definition() makes a recipe of one, over a panel of asset, date, rn and the feature's columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from quaystone.functions import kernels as kn
from quaystone.functions.recipe import Ewm, Grid, Machine, Recipe, Renumber, Where, com, fill, lag, pair, roll, run, s
from quaystone.operators.seasonal import Yoy
from quaystone.operators.timeseries import CONV, conv_signal, conv_steps

DAYS = {"MON": 0, "TUE": 1, "WED": 2, "THU": 3, "FRI": 4, "SAT": 5, "SUN": 6}
#: Names of single-window scores in definitions, and the methods that they are.
SCORES = {"hlratio": "hlratio", "zscore_roll": "zscore", "zscore_adj_roll": "zscore_adj", "pct_score": "qtl", "kdj": "kdj"}


@dataclass(frozen=True)
class Definition:
    """feature: an expression of the panel; params: a range of windows (first, end, step) or what the method takes; cap: low and high."""

    feature: str
    method: str
    params: tuple[float, ...]
    before: str = ""
    change: str = "diff"
    bullish: bool = True
    freq: str = "price"
    after: str = ""
    vol: int = 120
    cap: tuple[float, float] | None = (-2.0, 2.0)
    index: str | None = None  # an expression of the panel that beta_resid goes by


def changed(x: str, change: str, n: int, out: str) -> list:
    """Difference or relative change over n rows."""
    if change not in ("diff", "pct_change"):
        raise ValueError(f"no change {change}")
    return [{f"{out}_p": lag(x, n)}, {out: s(f"({x}) - {out}_p" if change == "diff" else f"({x}) / nullif({out}_p, 0) - 1")}]


def _number(step: str, head: str) -> int:
    return int(step[len(head) :])


def before_steps(d: Definition, x: str) -> tuple[list, str, bool]:
    """Steps of the chain before the method, the column they end in, and whether it is on the grid of business days."""
    steps, gridded = [], False

    def to_grid():
        nonlocal gridded
        if d.freq == "price" and not gridded:
            steps.extend([Where(f"{x} IS NOT NULL"), Grid(x)])
            gridded = True

    for i, step in enumerate(d.before.split("|")):
        o = f"b{i}"
        if step == "beta_resid":
            win, change = int(d.params[3]) if len(d.params) > 3 else 250, d.change or "pct_change"
            steps += [*changed(x, change, 5, f"{o}x5"), *changed("idx_", change, 5, f"{o}i5"), *changed(x, change, 1, f"{o}x1"), *changed("idx_", change, 1, f"{o}i1")]
            steps += [{f"{o}xm": roll("avg", f"{o}x5", 5), f"{o}im": roll("avg", f"{o}i5", 5)}, {f"{o}raw": pair("regr_slope", f"{o}xm", f"{o}im", win)}]
            steps += [{f"{o}beta": fill(f"CASE WHEN {o}raw IS NOT NULL THEN greatest({o}raw, 0.0) END")}, {f"{o}r": s(f"{o}x1 - {o}beta * {o}i1")}, {o: run("sum", f"{o}r")}]
        elif "yoy" in step:
            kind = "lunar" if "lunar" in step else "cal" if "cal" in step else "stitched"
            steps += [Where(f"{x} IS NOT NULL"), Yoy(o, x, kind, "week" if "_wk" in step else "day", d.change or "diff")]
            x = o
            to_grid()
            continue
        else:
            to_grid()
            if step == "":
                continue
            if step.startswith("df"):
                steps += changed(x, d.change or "diff", _number(step, "df"), o)
            elif step.startswith("sma"):
                steps.append({o: roll("avg", x, _number(step, "sma"))})
            elif step.startswith("ema"):
                steps.append(Ewm(o, x, com(_number(step, "ema"))))
            elif step in ("lr", "flr"):
                steps.append({o: s(f"ln(1 + ({x}))")})
            elif step == "csum":
                steps.append({o: run("sum", x)})
            elif step.startswith("sum"):
                steps.append({o: roll("sum", x, _number(step, "sum"))})
            else:
                raise ValueError(f"no step {step}")
        x = o
    return steps, x, gridded


def _score(d: Definition, x: str) -> tuple[list, str]:
    """The single-window score that dbl_th and hysteresis go by."""
    if not d.change:
        return [], x
    steps, value = conv_steps(SCORES[d.change], (int(d.params[1]),), x, d.vol)
    return [*steps, {"scored": s(value[int(d.params[1])])}], "scored"


def hysteresis_step(out: str, x: str, enter: float, gap: float, side_only: bool = True) -> Machine:
    take = f"CASE WHEN abs(p.{x}) > {enter} THEN {f'sign(p.{x})' if side_only else f'p.{x}'} ELSE 0 END"
    after = f"CASE WHEN r.pos = 0 THEN {take} WHEN p.{x} * sign(r.pos) <= {enter - gap} THEN {take} ELSE r.pos END"
    return Machine(out, kn.hysteresis(enter, gap, side_only), (x,), {"pos": (0.0, "0.0::DOUBLE", f"coalesce({after}, r.pos)::DOUBLE"), "seen": (0.0, "1", "1")})


def hump_step(out: str, x: str, gap: float) -> Machine:
    return Machine(out, kn.hump_from_first(gap), (x,), {"pos": (0.0, f"coalesce(p.{x}, 0)::DOUBLE", f"(CASE WHEN abs(r.pos - p.{x}) >= {gap} THEN p.{x} ELSE r.pos END)::DOUBLE"), "seen": (0.0, "1", "1")})


def buffer_step(out: str, x: str, gap: float) -> Machine:
    """The first row takes the signal if it is at least gap; then trades go to the near edge of the band."""
    after = f"CASE WHEN p.{x} - {gap} >= r.pos THEN p.{x} - {gap} WHEN p.{x} + {gap} < r.pos THEN p.{x} + {gap} ELSE r.pos END"
    return Machine(out, kn.buffer_from_first(gap), (x,), {"pos": (0.0, f"(CASE WHEN abs(p.{x}) >= {gap} THEN p.{x} ELSE 0 END)::DOUBLE", f"coalesce({after}, r.pos)::DOUBLE"), "seen": (0.0, "1", "1")})


def after_steps(chain: str, x: str, gridded: bool, vol_gap: str | None = None) -> tuple[list, str]:
    """Steps of the chain behind the method, on business days."""
    steps: list = []
    if chain and not gridded:
        steps += [Where(f"{x} IS NOT NULL"), Grid(x)]
    for i, step in enumerate(chain.split("|") if chain else []):
        head, o = step[:3], f"a{i}"
        if head == "ema":
            steps.append(Ewm(o, x, com(_number(step, "ema")), skip=True))
        elif head == "sma":
            steps.append({o: roll("avg", x, _number(step, "sma"))})
        elif head == "hmp":
            steps.append(hump_step(o, x, float(step[3:])))
        elif head == "hys":
            _, enter, gap = step.split("_")
            steps.append(hysteresis_step(o, x, float(enter), float(gap)))
        elif head == "buf":
            steps.append(buffer_step(o, x, float(step[3:])))
        elif head == "pos":
            steps.append({o: s(f"CASE WHEN {x} > 0 THEN {x} ELSE 0.0 END")})
        elif head == "neg":
            steps.append({o: s(f"CASE WHEN {x} < 0 THEN {x} ELSE 0.0 END")})
        elif head == "arr":
            steps.append({o: s(f"({float(step[3:])} + 1) * {x} - {float(step[3:])} * {x}")})
        elif head == "acl":
            steps += [{f"{o}p": lag(x, _number(step, "acl"))}, {o: s(f"{x} - {o}p")}]
        elif head == "sgn":
            steps.append({o: s(f"sign({x})")})
        else:
            raise ValueError(f"no step {step}")
        x = o
    return steps, x


def definition(d: Definition) -> Recipe:
    """The signal of a definition, as column signal."""
    first = [{"x_": s(d.feature)} | ({"idx_": s(d.index)} if d.index else {}), Where("x_ IS NOT NULL"), Renumber()]
    if d.freq.startswith("W-"):
        first.append(Grid("x_", (DAYS[d.freq[2:]],)))
    before, x, gridded = before_steps(d, "x_")
    steps = [*first, *before]
    p = d.params
    if d.method == "rng":
        steps.append({"raw": s(f"greatest(least({x} - {p[0]}, {p[1]}), -{p[1]}) / {p[2]}")})
    elif d.method == "dbl_th":
        scored, y = _score(d, x)
        steps += [*scored, {"raw": s(f"CASE WHEN {y} IS NOT NULL THEN CASE WHEN abs({y}) >= {p[0]} THEN sign({y}) ELSE 0.0 END END")}]
    elif d.method == "hysteresis":
        scored, y = _score(d, x)
        steps += [*scored, hysteresis_step("raw", y, p[0], p[2], len(p) <= 3 or p[3] > 0)]
    elif d.method == "":
        steps.append({"raw": s(x)})
    elif d.method in CONV:
        steps += [Where(f"{x} IS NOT NULL"), Renumber(), *conv_signal(d.method, tuple(range(*map(int, p[:3]))), d.cap, d.vol, x).steps, {"raw": s("signal")}]
    else:
        raise ValueError(f"no method {d.method}")
    steps.append({"sided": s("raw" if d.bullish else "-raw")})
    after, y = after_steps(d.after, "sided", False)
    return Recipe([*steps, *after, {"final_": s(y)}], ("final_",))
