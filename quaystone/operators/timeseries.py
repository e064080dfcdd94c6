"""Windows by asset in date order: returns, scores, smoothing, volatility, regressions, drawdown and the like."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaystone.functions.recipe import Ewm, Ex, Recipe, RollingQuantile, Where, com, fill, fill_back, halflife, lag, pair, roll, run, s, span, whole

RET = [{"pc": lag("close")}, {"ret": s("ln(close / pc)"), "pct": s("close / pc - 1")}]


def changes(n: int = 5) -> Recipe:
    return Recipe([{"pc": lag("close"), "pn": lag("close", n), "nx": lag("close", -1)}, {"diff1": s("close - pc"), "diffn": s("close - pn"), "pct": s("close / pc - 1"), "ret": s("ln(close / pc)"), "ahead": s("ln(nx / close)")}], ("diff1", "diffn", "pct", "ret", "ahead"))


def diff_of_present(n: int = 1) -> Recipe:
    """Differences over the rows that have a value: every seventh row's value is missing here."""
    return Recipe([{"x": s("CASE WHEN rn % 7 = 3 THEN NULL ELSE close END")}, Where("x IS NOT NULL"), {"px": lag("x", n)}, {"skip_diff": s("x - px")}], ("skip_diff",))


def rolling(n: int = 20) -> Recipe:
    return Recipe([{f"{k}_{n}": roll(f, "close", n) for k, f in (("mean", "avg"), ("total", "sum"), ("sd", "stddev_samp"), ("var", "var_samp"), ("lo", "min"), ("hi", "max"))} | {"part": roll("avg", "close", n, least=5)}], (f"mean_{n}", f"total_{n}", f"sd_{n}", f"var_{n}", f"lo_{n}", f"hi_{n}", "part"))


def zscores(n: int = 20) -> Recipe:
    return Recipe(
        [{"m": roll("avg", "close", n), "sd": roll("stddev_samp", "close", n), "pc": lag("close")}, {"d": s("close - pc")}, {"dsd": roll("stddev_samp", "d", n)}, {"z": s("(close - m) / nullif(sd, 0)"), "z_adj": s(f"(close - m) / nullif(dsd * sqrt({n}), 0)")}],
        ("z", "z_adj"),
    )


def ewm_stats(n: float = 20) -> Recipe:
    return Recipe([Ewm("em", "close", span(n)), Ewm("esd", "close", span(n), stat="std", least=2), Ewm("half", "close", halflife(10), least=10), {"z_ewm": s("(close - em) / nullif(esd, 0)"), "norm": s("close / nullif(esd, 0)")}], ("em", "esd", "half", "z_ewm", "norm"))


def robust_steps(out: str, x: str, days: int = 35, least: int = 10, smallest: float = 1e-8, floor_p: float = 0.05, floor_least: int = 100, floor_days: int = 500) -> list:
    """The exponential deviation of x, at least smallest and at least a low quantile of its own past (none before floor_least values)."""
    return [
        Ewm(f"{out}_v", x, span(days), stat="std", least=least),
        {f"{out}_a": s(f"CASE WHEN {out}_v < {smallest!r} THEN {smallest!r} ELSE {out}_v END")},
        RollingQuantile(f"{out}_q", f"{out}_a", floor_p, floor_days, floor_least),
        {f"{out}_f": fill(f"{out}_q")},
        {out: s(f"CASE WHEN {out}_a IS NOT NULL THEN greatest({out}_a, coalesce({out}_f, 0)) END")},
    ]


def robust_vol(backfill: bool = False, **how) -> Recipe:
    steps = [*RET, *robust_steps("robust", "ret", **how)]
    if backfill:
        steps += [{"held": fill("robust")}, {"robust_all": fill_back("held")}]
    return Recipe(steps, ("robust_all" if backfill else "robust",))


def ewmac(fast: int = 8, slow: int = 32, x: str = "close", vol: int = 35) -> Recipe:
    return Recipe([{"px": lag(x)}, {"d": s(f"({x}) - px")}, Ewm("ef", x, span(fast)), Ewm("es", x, span(slow)), *robust_steps("rv", "d", days=vol), {"ewmac": s("(ef - es) / nullif(rv, 0)")}], ("ewmac",))


def ewmac_grid(fast: tuple[int, ...] = (4, 8, 16), slow: tuple[int, ...] = (16, 32, 64), x: str = "close", vol: int | None = None) -> Recipe:
    """The mean over all pairs of a fast and a slower span, over robust volatility of changes or (vol) over their own deviation."""
    pairs = [(a, b) for a in fast for b in slow if a < b]
    steps: list = [{"px": lag(x)}, {"d": s(f"({x}) - px")}]
    steps += [Ewm(f"e{n}", x, span(n)) for n in sorted({n for p in pairs for n in p})]
    if vol is None:
        steps += robust_steps("rv", "d")
        steps.append({f"g{a}_{b}": s(f"(e{a} - e{b}) / nullif(rv, 0)") for a, b in pairs})
    else:
        steps += [Ewm(f"v{a}_{b}", f"e{a} - e{b}", span(vol), stat="std", least=10) for a, b in pairs]
        steps.append({f"g{a}_{b}": s(f"(e{a} - e{b}) / nullif(v{a}_{b}, 0)") for a, b in pairs})
    return Recipe([*steps, {"grid": s(mean_of([f"g{a}_{b}" for a, b in pairs]))}], ("grid",))


def mean_of(names: list[str]) -> str:
    """The mean of those of some columns that aren't null."""
    total = " + ".join(f"coalesce({n}, 0)" for n in names)
    count = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE 1 END" for n in names)
    return f"({total}) / nullif(({count}) * 1.0, 0)"


def at_most(x: str, n: int) -> Ex:
    """How many of the last n rows are at most this one; null until n rows have a value."""
    frame = f"PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"

    def col():
        w = Window.partitionBy("asset").orderBy("date").rowsBetween(-(n - 1), 0)
        seen = F.collect_list(F.expr(x)).over(w)
        return F.when((F.count(F.expr(x)).over(w) >= n) & F.expr(x).isNotNull(), F.size(F.filter(seen, lambda v: v <= F.expr(x))))

    return Ex(col, f"CASE WHEN count({x}) OVER ({frame}) >= {n} AND {x} IS NOT NULL THEN len(list_filter(list({x}) OVER ({frame}), lambda v: v <= {x})) END")


def pct_scores(n: int = 60, x: str = "close", lowest: bool = False) -> Recipe:
    """The place of the last value among n, from 0 (least) to 1, or from 1 down (lowest), and from -1 to 1."""
    unit = f"(r - 1) / ({n} - 1e0)"
    return Recipe([{"r": at_most(x, n)}, {"unit": s(f"1 - {unit}" if lowest else unit)}, {"balanced": s("2 * unit - 1")}], ("unit", "balanced"))


def past_percentile(n: int = 40) -> Recipe:
    """Share of the former n rows that lie strictly below this one, plain and on absolute changes with the change's sign."""
    def below(x: str) -> Ex:
        frame = f"PARTITION BY asset ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"

        def col():
            w = Window.partitionBy("asset").orderBy("date").rowsBetween(-n, -1)
            seen = F.collect_list(F.expr(x)).over(w)
            return F.when(F.count(F.expr(x)).over(w) >= n, F.size(F.filter(seen, lambda v: v < F.expr(x))) / n)

        return Ex(col, f"CASE WHEN count({x}) OVER ({frame}) >= {n} THEN len(list_filter(list({x}) OVER ({frame}), lambda v: v < {x})) / {n}.0 END")

    return Recipe([{"pc": lag("close")}, {"d": s("close - pc")}, {"past_pct": below("close"), "abs_pct": below("abs(d)")}, {"signed_pct": s("CASE WHEN d IS NOT NULL THEN sign(d) * abs_pct END")}], ("past_pct", "signed_pct"))


def kdj_steps(out: str, x: str, n: int, smooth: int = 3, lead: int = 3) -> list:
    """The place in the range of n rows around zero, its mean over smooth rows, and the line that leads by lead."""
    return [
        {f"{out}_h": roll("max", x, n), f"{out}_l": roll("min", x, n)},
        {f"{out}_k": s(f"({x} - {out}_l) / nullif({out}_h - {out}_l, 0) - 0.5")},
        {f"{out}_d": roll("avg", f"{out}_k", smooth)},
        {out: s(f"{lead} * {out}_k - {lead - 1} * {out}_d")},
    ]


def hl_kdj(n: int = 14, x: str = "close") -> Recipe:
    return Recipe([*kdj_steps("j", x, n), {"hl_ratio": s("2 * j_k"), "k": s("j_k"), "d": s("j_d")}], ("hl_ratio", "k", "d", "j"))


def over(value: str, scale: str, size: str) -> str:
    """value over scale; null where the scale is nothing but rounding against size."""
    return f"({value}) / CASE WHEN {scale} > 1e-7 * abs({size}) THEN {scale} END"


def conv_steps(kind: str, wins: tuple[int, ...], x: str, vol: int) -> tuple[list, dict[int, str]]:
    """The steps of a signal method and its value per window."""
    half = vol // 2
    shared: dict[str, list] = {
        "ma": [{"scale": roll("avg", f"abs({x})", vol, least=half)}], "mad": [{"scale": roll("stddev_samp", x, vol, least=half)}],
        "ema": [Ewm("scale", f"abs({x})", com(vol))], "emad": [Ewm("scale", x, com(vol), stat="std", least=2)],
        "ewmac": [{"px": lag(x)}, {"dx": s(f"({x}) - px")}, *robust_steps("scale", "dx")], "zscore_adj": [{"px": lag(x)}, {"dx": s(f"({x}) - px")}],
    }
    steps, value = list(shared.get(kind, [])), {}
    for n in wins:
        m = f"m{n}"
        if kind in ("ma", "mad"):
            steps.append({m: roll("avg", x, n, least=n // 2)})
            value[n] = over(m, "scale", m)
        elif kind in ("ema", "emad"):
            steps.append(Ewm(m, x, com(n)))
            value[n] = over(m, "scale", m)
        elif kind in ("ma_sgn", "ema_sgn"):
            steps.append({m: roll("avg", x, n)} if kind == "ma_sgn" else Ewm(m, x, com(n)))
            value[n] = f"sign({m})"
        elif kind in ("ma_dff", "ma_dff_sgn", "ema_dff", "ema_dff_sgn"):
            steps += [{m: roll("avg", x, n)} if kind.startswith("ma") else Ewm(m, x, com(n)), {f"d{n}": s(f"({x}) - {m}")}]
            if kind.endswith("sgn"):
                value[n] = f"CASE WHEN abs(d{n}) > 1e-9 * abs({x}) THEN sign(d{n}) WHEN d{n} IS NOT NULL THEN 0.0 END"
            else:
                steps.append(Ewm(f"v{n}", f"d{n}", span(vol), stat="std", least=10))
                value[n] = over(f"d{n}", f"v{n}", x)
        elif kind == "ewmac":
            steps += [Ewm(f"f{n}", x, span(n)), Ewm(f"g{n}", x, span(4 * n))]
            value[n] = f"(f{n} - g{n}) / nullif(scale, 0)"
        elif kind in ("kdj", "hlratio"):
            steps += kdj_steps(f"j{n}", x, n)
            value[n] = f"j{n}" if kind == "kdj" else f"2 * j{n}_k"
        elif kind == "qtl":
            steps.append({m: at_most(x, n)})
            value[n] = f"2 * ({m} - 1) / ({n} - 1e0) - 1"
        elif kind in ("zscore", "zscore_biased", "zscore_adj"):
            steps.append({m: roll("avg", x, n), f"s{n}": roll("stddev_samp", "dx" if kind == "zscore_adj" else x, n)})
            value[n] = {"zscore": over(f"({x}) - {m}", f"s{n}", m), "zscore_biased": over(x, f"s{n}", m), "zscore_adj": over(f"({x}) - {m}", f"s{n} * sqrt({n})", m)}[kind]
        else:
            raise ValueError(f"no signal method {kind}")
    return steps, value


def conv_signal(kind: str, wins: tuple[int, ...] = (10, 15, 20), cap: float | tuple[float, float] | None = 2.5, vol: int = 120, x: str = "close") -> Recipe:
    """One of the signal methods averaged over a range of windows, each capped; windows not shorter than an asset's history are left out.

    x must not be null (filter such rows before); a scale that is zero but for rounding gives null.
    """
    steps, value = conv_steps(kind, wins, x, vol)
    low, high = cap if isinstance(cap, tuple) else (-(cap or 0), cap)
    capped = lambda v: f"CASE WHEN ({v}) IS NOT NULL AND history > {{n}} THEN {f'greatest({low}, least({high}, {v}))' if cap else v} END"
    steps = [{"history": whole("count", x)}, *steps, {f"x{n}": s(capped(v).format(n=n)) for n, v in value.items()}]
    return Recipe([*steps, {"signal": s(mean_of([f"x{n}" for n in wins]))}], ("signal",))


#: Methods that take the level of a mean, which says little of a series that doesn't change its sign.
OF_CHANGES = ("ma", "mad", "ma_sgn", "ema", "emad", "ema_sgn", "zscore_biased")
CONV = ("ma", "mad", "ma_sgn", "ema", "emad", "ema_sgn", "ema_dff", "ema_dff_sgn", "ma_dff", "ma_dff_sgn", "ewmac", "kdj", "zscore_biased", "zscore", "zscore_adj", "qtl", "hlratio")


def scored(hl: float = 20) -> Recipe:
    """Demeaned, scaled and scored by exponential means."""
    a = halflife(hl)
    return Recipe([Ewm("em", "close", a, least=5), Ewm("esd", "close", a, stat="std", least=5), {"demeaned": s("close - em"), "scaled": s("close / nullif(esd, 0)"), "score": s("(close - em) / nullif(esd, 0)")}], ("demeaned", "scaled", "score"))


def cumulative() -> Recipe:
    return Recipe([*RET, {"cum_ret": run("sum", "ret"), "cum_vol": run("sum", "volume")}, {"growth": s("exp(cum_ret)")}], ("cum_ret", "cum_vol", "growth"))


def drawdown() -> Recipe:
    return Recipe([*RET, {"cum": run("sum", "ret")}, {"peak": run("max", "cum")}, {"dd": s("cum - peak")}, {"worst": run("min", "dd"), "peak_rn": run("max", "CASE WHEN cum = peak THEN rn END")}, {"under": s("rn - peak_rn")}], ("dd", "worst", "under"))


def rolling_fit(n: int = 40) -> Recipe:
    """Regression of returns on volume changes."""
    return Recipe([*RET, {"pv": lag("volume")}, {"x": s("ln(volume / pv)")}, {"beta": pair("regr_slope", "ret", "x", n), "alpha": pair("regr_intercept", "ret", "x", n), "r2": pair("regr_r2", "ret", "x", n), "corr": pair("corr", "ret", "x", n)}, {"resid": s("ret - alpha - beta * x")}], ("beta", "alpha", "r2", "corr", "resid"))


def skew_kurt(n: int = 30) -> Recipe:
    """Bias-corrected moments from power sums of centred returns."""
    p = {f"p{k}": roll("sum", " * ".join(["ret"] * k), n) for k in (1, 2, 3, 4)}
    return Recipe(
        [*RET, p, {"mu": s(f"p1 / {n}")}, {"m2": s(f"p2 / {n} - mu * mu"), "m3": s(f"p3 / {n} - 3 * mu * p2 / {n} + 2 * mu * mu * mu"), "m4": s(f"p4 / {n} - 4 * mu * p3 / {n} + 6 * mu * mu * p2 / {n} - 3 * mu * mu * mu * mu")},
         {"skew": s(f"m3 / nullif(pow(m2, 1.5), 0) * sqrt({n} * ({n} - 1.0)) / ({n} - 2.0)"), "kurt": s(f"({n} - 1.0) / (({n} - 2.0) * ({n} - 3.0)) * (({n} + 1.0) * (m4 / nullif(m2 * m2, 0) - 3) + 6)")}],
        ("skew", "kurt"),
    )


def range_vols(n: int = 20, year: int = 244) -> Recipe:
    return Recipe(
        [*RET, {"hl": s("ln(high / low)"), "co": s("ln(close / open)"), "oc": s("ln(open / pc)"), "ho": s("ln(high / open)"), "lo": s("ln(low / open)"), "hc": s("ln(high / close)"), "lc": s("ln(low / close)")},
         {"sd": roll("stddev_samp", "ret", n), "v_hl": roll("sum", "hl * hl", n), "v_gk": roll("sum", "0.5 * hl * hl - (2 * ln(2) - 1) * co * co", n), "v_rs": roll("sum", "ho * hc + lo * lc", n), "v_oc": roll("var_samp", "oc", n), "v_co": roll("var_samp", "co", n), "seen": run("count", "ret")},
         {"vol_cc": s(f"sd * sqrt({year})"), "vol_pk": s(f"sqrt({year} * v_hl / ({n} * 4 * ln(2)))"), "vol_gk": s(f"sqrt(greatest({year} * v_gk / {n}, 0))"), "vol_rs": s(f"sqrt(greatest({year} * v_rs / {n}, 0))"),
          "vol_yz": s(f"sqrt(greatest({year} * (v_oc + 0.34 / (1.34 + ({n} + 1.0) / ({n} - 1.0)) * v_co + (1 - 0.34 / (1.34 + ({n} + 1.0) / ({n} - 1.0))) * v_rs / {n}), 0))"),
          "vol_ht": s(f"sd * sqrt({year}) * CASE WHEN seen > 4 * {n} THEN 1 / sqrt(1 - {n}.0 / (seen - {n} + 1) + ({n} * {n} - 1.0) / (3.0 * (seen - {n} + 1) * (seen - {n} + 1))) END")}],
        ("vol_cc", "vol_pk", "vol_gk", "vol_rs", "vol_yz", "vol_ht"),
    )


def asset_vols(n: int = 20) -> Recipe:
    return Recipe([*RET, {"tr": s("greatest(high - low, abs(high - pc), abs(low - pc))"), "chg": s("close - pc")}, {"vol_tr": roll("avg", "tr", n), "vol_pct": roll("stddev_samp", "pct", n), "vol_ret": roll("stddev_samp", "ret", n), "vol_px": roll("stddev_samp", "chg", n)}], ("vol_tr", "vol_pct", "vol_ret", "vol_px"))


def state_fill(n: int = 20) -> Recipe:
    """Long from a break of the old high until one of the old low, and the other way round."""
    return Recipe([{"top": roll("max", "high", n, shift=1), "bottom": roll("min", "low", n, shift=1)}, {"event": s("CASE WHEN close > top THEN 1 WHEN close < bottom THEN -1 END")}, {"held": fill("event")}, {"pos": s("coalesce(held, 0)")}], ("pos",))


def season_stats() -> Recipe:
    """Running mean and deviation per calendar month."""
    k = ("asset", "mth")
    return Recipe([*RET, {"mth": s("month(date)")}, {"n": run("count", "ret", k), "mean": run("avg", "ret", k), "sd": run("stddev_pop", "ret", k)}], ("n", "mean", "sd"))


def tilt_timing(n: int = 60) -> Recipe:
    return Recipe([{"m": roll("avg", "close", n), "all_mean": whole("avg", "close")}, {"timing": s("close - m"), "tilt": s("m - all_mean")}], ("timing", "tilt"))


def fills() -> Recipe:
    return Recipe([{"x": s("CASE WHEN rn % 5 IN (1, 2, 3) THEN NULL ELSE close END")}, {"down2": fill("x", 2), "down": fill("x"), "up1": fill_back("x", 1)}], ("down2", "down", "up1"))


def winsorised(n: int = 20, k: float = 1.5) -> Recipe:
    return Recipe([{"m": roll("avg", "close", n), "sd": roll("stddev_samp", "close", n)}, Where("sd IS NOT NULL"), {"clipped": s(f"least(greatest(close, m - {k} * sd), m + {k} * sd)")}], ("clipped",))


def roll_yield(n: int = 20) -> Recipe:
    """Near and far as close and open here: yield, momentum, basis momentum and up ratio."""
    return Recipe([*RET, {"carry": s("ln(close / open)"), "far_prev": lag("open")}, {"far_ret": s("ln(open / far_prev)")}, {"mom": roll("sum", "ret", n), "bmom": roll("sum", "ret - far_ret", n), "up": roll("avg", "CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END", n)}, {"up_ratio": s("up - 0.5")}], ("carry", "mom", "bmom", "up_ratio"))
