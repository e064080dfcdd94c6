"""Technical indicators as recipes over daily bars (asset, date, open, high, low, close, volume, rn)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaystone.functions.recipe import Ewm, Ex, Recipe, com, lag, pair, quantile, roll, run, s, span


def true_range(close: str = "close", out: str = "tr", first: str = "low") -> list:
    """Largest of the bar's range and its distances from the last close; first='close' has high - close in the range's place."""
    return [{"pc": lag(close)}, {out: s(f"greatest(high - {first}, abs(high - pc), abs(low - pc))")}]


def tr() -> Recipe:
    return Recipe(true_range() + true_range(out="tr_hc", first="close")[1:], ("tr", "tr_hc"))


def atr(n: int = 20, out: str = "atr") -> list:
    return [*true_range(), Ewm(out, "tr", span(n), adjust=False, least=n - 1)]


def cmi(n: int = 14) -> Recipe:
    return Recipe([{"earlier": lag("close", n), "top": roll("max", "high", n), "bottom": roll("min", "low", n)}, {"cmi": s("abs(close - earlier) / nullif(top - bottom, 0) * 100")}], ("cmi",))


def efficiency(n: int = 10) -> Recipe:
    return Recipe([{"earlier": lag("close", n), "pc": lag("close")}, {"path": roll("sum", "abs(close - pc)", n)}, {"eff_ratio": s("abs(close - earlier) / nullif(path, 0) * 100")}], ("eff_ratio",))


def price_density(n: int = 10) -> Recipe:
    return Recipe([{"path": roll("sum", "high - low", n), "top": roll("max", "high", n), "bottom": roll("min", "low", n)}, {"density": s("path / nullif(top - bottom, 0)")}], ("density",))


def momentum(n: int = 10) -> Recipe:
    return Recipe([{"earlier": lag("close", n)}, {"mom": s("close - earlier"), "roc": s("close / nullif(earlier, 0) - 1")}], ("mom", "roc"))


def averages(n: int = 20) -> Recipe:
    """Moving average, deviation, root mean square, variance by moments, and their exponential forms."""
    a = span(n)
    return Recipe(
        [{"ma": roll("avg", "close", n), "sd": roll("stddev_samp", "close", n), "var": roll("var_samp", "close", n), "square": roll("avg", "close * close", n)},
         Ewm("ema", "close", a), {"prior": lag("ema")}, Ewm("emavar", f"{1 - a!r} * pow(close - coalesce(prior, 0), 2)", a),
         {"bstdev": s("sqrt(var + ma * ma)"), "svar": s("square - ma * ma")}],
        ("ma", "sd", "bstdev", "svar", "ema", "emavar"),
    )


def bbands(n: int = 20, k: float = 2) -> Recipe:
    return Recipe(
        [{"ma": roll("avg", "close", n), "sd": roll("stddev_samp", "close", n)},
         {"width": s(f"2 * {k} * sd / nullif(ma, 0)"), "place": s(f"(close - ma + {k} * sd) / nullif(2 * {k} * sd, 0)"), "upper": s(f"ma + {k} * sd"), "lower": s(f"ma - {k} * sd")}],
        ("ma", "width", "place", "upper", "lower"),
    )


def pivots() -> Recipe:
    return Recipe([{"pp": s("(high + low + close) / 3")}, {"r1": s("2 * pp - low"), "s1": s("2 * pp - high"), "r2": s("pp + high - low"), "s2": s("pp - high + low"), "r3": s("high + 2 * (pp - low)"), "s3": s("low - 2 * (high - pp)")}], ("pp", "r1", "s1", "r2", "s2", "r3", "s3"))


def stochastic(n: int = 14, k: int = 3, d: int = 3) -> Recipe:
    return Recipe(
        [{"top": roll("max", "high", n), "bottom": roll("min", "low", n)}, {"fast_k": s("(close - bottom) / nullif(top - bottom, 0) * 100")}, {"slow_k": roll("avg", "fast_k", k)}, {"slow_d": roll("avg", "slow_k", d)}],
        ("fast_k", "slow_k", "slow_d"),
    )


def rsi_steps(n: int, x: str = "close") -> list:
    return [{"px": lag(x)}, {"up_move": s(f"greatest({x} - px, 0 * px)"), "down_move": s(f"greatest(px - {x}, 0 * px)")}, Ewm("up", "up_move", com(n - 1)), Ewm("down", "down_move", com(n - 1)), {"rsi": s("up / nullif(up + down, 0) * 100")}]


def rsi(n: int = 14) -> Recipe:
    return Recipe(rsi_steps(n), ("rsi", "up", "down"))


def stoch_rsi(n: int = 14, k: int = 5, d: int = 3) -> Recipe:
    return Recipe([*rsi_steps(n), {"top": roll("max", "rsi", k), "bottom": roll("min", "rsi", k)}, {"srsi_k": s("(rsi - bottom) / nullif(top - bottom, 0) * 100")}, {"srsi_d": roll("avg", "srsi_k", d)}], ("srsi_k", "srsi_d"))


def trix(n: int = 10) -> Recipe:
    a = span(n)
    return Recipe([Ewm("e1", "close", a, False, n - 1), Ewm("e2", "e1", a, False, n - 1), Ewm("e3", "e2", a, False, n - 1), {"last_e3": lag("e3")}, {"trix": s("e3 / nullif(last_e3, 0) - 1")}], ("trix",))


def adx(n: int = 14) -> Recipe:
    return Recipe(
        [*atr(n), {"ph": lag("high"), "pl": lag("low")}, {"up_move": s("high - ph"), "down_move": s("pl - low")}, {"up_only": s("CASE WHEN up_move > down_move AND up_move > 0 THEN up_move WHEN up_move IS NOT NULL THEN 0 END"), "down_only": s("CASE WHEN down_move > up_move AND down_move > 0 THEN down_move WHEN down_move IS NOT NULL THEN 0 END")},
         Ewm("up_mean", "up_only", span(n), least=n - 1), Ewm("down_mean", "down_only", span(n), least=n - 1),
         {"pdi": s("up_mean / nullif(atr, 0)"), "ndi": s("down_mean / nullif(atr, 0)")}, {"dx": s("abs(pdi - ndi) / nullif(pdi + ndi, 0)")}, Ewm("adx", "dx", span(n), least=n - 1)],
        ("adx", "pdi", "ndi"),
    )


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Recipe:
    return Recipe([Ewm("ef", "close", span(fast), least=slow - 1), Ewm("es", "close", span(slow), least=slow - 1), {"macd": s("ef - es")}, Ewm("macd_signal", "macd", span(signal), least=signal - 1), {"macd_hist": s("macd - macd_signal")}], ("macd", "macd_signal", "macd_hist"))


def mass_index() -> Recipe:
    return Recipe([Ewm("e1", "high - low", span(9), least=8), Ewm("e2", "e1", span(9), least=8), {"mass": s("e1 / nullif(e2, 0)")}, {"mass_index": roll("sum", "mass", 25)}], ("mass_index",))


def vortex(n: int = 14) -> Recipe:
    return Recipe([*true_range(), {"pl": lag("low"), "ph": lag("high")}, {"vm": s("abs(high - pl) - abs(low - ph)")}, {"vs": roll("sum", "vm", n), "ts": roll("sum", "tr", n)}, {"vortex": s("vs / nullif(ts, 0)")}], ("vortex",))


def kst(r=(10, 15, 20, 30), n=(10, 10, 10, 15)) -> Recipe:
    return Recipe([{f"c{i}": lag("close", k - 1) for i, k in enumerate(r)}, {f"m{i}": roll("sum", f"(close - c{i}) / nullif(c{i}, 0)", k) for i, k in enumerate(n)}, {"kst": s("m0 + 2 * m1 + 3 * m2 + 4 * m3")}], ("kst",))


def tsi(r: int = 25, q: int = 13) -> Recipe:
    return Recipe(
        [{"pc": lag("close")}, {"m": s("close - pc")}, Ewm("e1", "m", span(r), least=r - 1), Ewm("a1", "abs(m)", span(r), least=r - 1), Ewm("e2", "e1", span(q), least=q - 1), Ewm("a2", "a1", span(q), least=q - 1), {"tsi": s("e2 / nullif(a2, 0)")}],
        ("tsi",),
    )


_AD = "(2 * close - high - low) / nullif(high - low, 0) * volume"


def acc_dist(n: int = 10) -> Recipe:
    return Recipe([{"ad": s(_AD)}, {"earlier": lag("ad", n - 1)}, {"acc_dist": s("(ad - earlier) / nullif(earlier, 0)")}], ("acc_dist",))


def chaikin() -> Recipe:
    return Recipe([{"ad": s(_AD)}, Ewm("e3", "ad", span(3), least=2), Ewm("e10", "ad", span(10), least=9), {"chaikin": s("e3 - e10")}], ("chaikin",))


def money_flow(n: int = 14) -> Recipe:
    return Recipe([{"typical": lag("(high + low + close) / 3"), "before": lag("(high + low + close) / 3", 2)}, {"share": s("CASE WHEN typical <= before THEN 0 * volume ELSE typical * volume END / nullif(typical * volume, 0)")}, {"mfi": roll("avg", "share", n)}], ("mfi",))


def on_balance(n: int = 10) -> Recipe:
    return Recipe([{"pc": lag("close")}, {"signed": s("CASE WHEN close <= pc THEN 0 * volume ELSE volume END - CASE WHEN close >= pc THEN 0 * volume ELSE volume END")}, {"obv": roll("avg", "signed", n)}], ("obv",))


def force(n: int = 5) -> Recipe:
    return Recipe([{"pc": lag("close", n), "pv": lag("volume", n)}, {"force": s("(close - pc) * (volume - pv)")}], ("force",))


def ease(n: int = 14) -> Recipe:
    return Recipe([{"ph": lag("high"), "pl": lag("low")}, {"eom": roll("avg", "(high - ph + low - pl) * (high - low) / (2 * nullif(volume, 0))", n)}], ("eom",))


def coppock(n: int = 10) -> Recipe:
    return Recipe([{"c1": lag("close", n * 11 // 10 - 1), "c2": lag("close", n * 14 // 10 - 1)}, Ewm("coppock", "(close - c1) / nullif(c1, 0) + (close - c2) / nullif(c2, 0)", span(n), least=n)], ("coppock",))


def keltner(n: int = 20) -> Recipe:
    return Recipe([{"kel_m": roll("avg", "(high + low + close) / 3", n), "kel_u": roll("avg", "(4 * high - 2 * low + close) / 3", n), "kel_d": roll("avg", "(-2 * high + 4 * low + close) / 3", n)}], ("kel_m", "kel_u", "kel_d"))


def ultimate() -> Recipe:
    return Recipe([*true_range(), {"bp": s("close - least(low, pc)")}, {f"{x}{n}": roll("sum", x, n) for x in ("bp", "tr") for n in (7, 14, 28)}, {"ultosc": s("4 * bp7 / nullif(tr7, 0) + 2 * bp14 / nullif(tr14, 0) + bp28 / nullif(tr28, 0)")}], ("ultosc",))


def last_touch(x: str, which: str, n: int):
    """The number of the last row that holds the extreme of the last n."""
    sign = "" if which == "max" else "-"
    frame = f"PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"

    def col():
        w = Window.partitionBy("asset").orderBy("date").rowsBetween(-(n - 1), 0)
        return F.max(F.struct(F.expr(f"{sign}{x}").alias("v"), F.col("rn").alias("k"))).over(w)["k"]

    return Ex(col, f"(max({{'v': {sign}{x}, 'k': rn}}) OVER ({frame})).k")


def donchian(n: int = 20) -> Recipe:
    """Channel and bars since its ends were last touched."""
    return Recipe(
        [{"don_h": roll("max", "high", n), "don_l": roll("min", "low", n), "place_h": last_touch("high", "max", n), "place_l": last_touch("low", "min", n)}, {"idx_h": s("CASE WHEN don_h IS NOT NULL THEN rn - place_h END"), "idx_l": s("CASE WHEN don_l IS NOT NULL THEN rn - place_l END")}],
        ("don_h", "don_l", "idx_h", "idx_l"),
    )


def plunger(n: int = 20, m: int = 40) -> Recipe:
    return Recipe([*atr(m), {"top": roll("max", "high", n), "bottom": roll("min", "low", n)}, {"plunge_h": s("(top - close) / nullif(atr, 0)"), "plunge_l": s("(close - bottom) / nullif(atr, 0)")}], ("plunge_h", "plunge_l"))


def fisher(n: int = 20, p: float = 0.7, i: float = 0.7) -> Recipe:
    return Recipe(
        [{"top": roll("max", "high", n), "bottom": roll("min", "low", n)}, Ewm("fisher_p", "(close - bottom) / nullif(top - bottom, 0) * 2 - 1", p, adjust=False),
         {"raw": s("0.5 * ln((1 + fisher_p) / nullif(CASE WHEN abs(fisher_p) < 1 - 1e-9 THEN 1 - fisher_p END, 0))")}, Ewm("fisher_i", "raw", i, adjust=True)],
        ("fisher_p", "fisher_i"),
    )


def pct_channel(n: int = 20, pct: float = 50) -> Recipe:
    return Recipe([{"pct_ch": quantile("close", pct / 100, n, shift=1)}], ("pct_ch",))


def value_chart(n: int = 10, rng: int = 8) -> Recipe:
    """Prices around the mean bar in units of the range: of five spans of rng bars, or (n of 7 and less) of the last n bars' true range."""
    mean = {"h_mean": roll("avg", "high", n), "l_mean": roll("avg", "low", n)}
    if n > 7:
        steps: list = [{"va": roll("max", "high", rng), "vi": roll("min", "low", rng)}, {"v": s("va - vi")}, {f"v{k}": lag("v", k * rng) for k in range(1, 5)}, {"unit": s("(v + v1 + v2 + v3 + v4) / 25")}]
    else:
        steps = [{"pc": lag("close")}, {"tr": s("greatest(high - low, abs(close - pc))")}, {"tr_mean": roll("avg", "tr", n)}, {"unit": s("tr_mean * 0.16")}]
    return Recipe(
        [mean, {"mid": s("(h_mean + l_mean) / 2")}, *steps, {f"vci_{x[0]}": s(f"({x} - mid) / nullif(unit, 0)") for x in ("open", "high", "low", "close")}],
        ("vci_o", "vci_h", "vci_l", "vci_c"),
    )


def tema_steps(x: str, n: int, out: str) -> list:
    a = span(n)
    return [Ewm(f"{out}_1", x, a, False), Ewm(f"{out}_2", f"{out}_1", a, False), Ewm(f"{out}_3", f"{out}_2", a, False), {out: s(f"3 * {out}_1 - 3 * {out}_2 + {out}_3")}]


def tema(n: int = 10) -> Recipe:
    return Recipe(tema_steps("close", n, "tema"), ("tema",))


def slope(n: int = 10) -> Recipe:
    return Recipe([{"lr_slope": pair("regr_slope", "close", "rn", n)}], ("lr_slope",))


def dvo(weights: tuple[float, float, float, float] = (0.5, 0.5, 0.0, 0.0), smooth: tuple[float, ...] = (0.5, 0.5), m: int = 60) -> Recipe:
    """Close over a weighted price (high, low, open, close), smoothed (the newest row's weight first); its percentile (mean of strict and weak) among m."""
    mix = " + ".join(f"{w} * {x}" for w, x in zip(weights, ("high", "low", "open", "close"), strict=True))
    theta = " + ".join(f"{w} * r{k}" for k, w in enumerate(smooth))
    return Recipe([{"r0": s(f"close / nullif({mix}, 0)")}, {f"r{k}": lag("r0", k) for k in range(1, len(smooth))}, {"theta": s(theta)}, {"dvo": pct_rank("theta", m)}], ("dvo",))


def tail_mean(n: int = 20, pct: float = 0.5, direction: int = 1, x: str = "close") -> Recipe:
    """Mean of the former n values at or beyond their quantile (above it, or below it with direction -1), weighted by rank from the top and by recency."""
    beyond = ">=" if direction > 0 else "<="
    frame = f"PARTITION BY asset ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING"

    def col():
        w = Window.partitionBy("asset").orderBy("date").rowsBetween(-n, -1)
        return F.collect_list(F.expr(x)).over(w)

    kept = Ex(lambda: F.expr(f"filter(seen, v -> v {beyond} cut)"), f"list_filter(seen, lambda v: v {beyond} cut)")
    rank = "CASE WHEN y > v THEN 1.0 WHEN y = v THEN 0.5 ELSE 0.0 END"
    ranks = Ex(
        lambda: F.expr(f"transform(kept, (v, i) -> (aggregate(transform(kept, y -> double({rank})), 0D, (a, z) -> a + z) + 0.5D) * (i + 1))"),
        f"list_transform(kept, lambda v, i: (list_sum(list_transform(kept, lambda y: ({rank})::DOUBLE)) + 0.5) * i)",
    )
    total = Ex(lambda: F.expr("aggregate(w, 0D, (a, y) -> a + y)"), "list_sum(w)")
    value = Ex(lambda: F.expr("aggregate(zip_with(kept, w, (a, b) -> a * b), 0D, (a, y) -> a + y)"), "list_sum(list_transform(list_zip(kept, w), lambda z: z[1] * z[2]))")
    return Recipe(
        [{"seen": Ex(col, f"list({x}) OVER ({frame})"), "cut": quantile(x, pct, n, shift=1)}, {"kept": kept}, {"w": ranks}, {"top": value, "bottom": total}, {"tail_mean": s("CASE WHEN cut IS NOT NULL THEN top / nullif(bottom, 0) END")}],
        ("tail_mean",),
    )


def spearman_p(r: str, n: int) -> str:
    """The two-sided p-value of a rank correlation of n pairs, from the closed form of the t distribution with n - 2 degrees."""
    df, size = n - 2, f"abs({r})"
    cos2, term, total = f"(1 - {r} * {r})", 1.0, "1.0" if df > 1 else "0.0"
    odd = df % 2
    for k in range(2 + odd, df - 1, 2):
        term *= (k - 1) / k
        total += f" + {term!r} * pow({cos2}, {(k - odd) / 2})"
    inside = f"2 / pi() * (asin({size}) + {size} * sqrt({cos2}) * ({total}))" if odd else f"{size} * ({total})"
    return f"1 - ({inside})"


def ribbon(spans: tuple[int, ...] = (5, 10, 20, 40)) -> Recipe:
    """Rank correlation of exponential means with their order (per cent), its p-value (per cent), and their width."""
    n, last = len(spans), max(spans) - 1
    ranks = {f"k{m}": s("1 + " + " + ".join(f"CASE WHEN e{o} < e{m} THEN 1 ELSE 0 END" for o in spans if o != m)) for m in spans}
    apart = " + ".join(f"(k{m} - {n - i}) * (k{m} - {n - i})" for i, m in enumerate(spans))
    ends = ", ".join(f"e{m}" for m in spans)
    return Recipe(
        [Ewm(f"e{m}", "close", span(m)) for m in spans]
        + [ranks, {"rho": s(f"CASE WHEN rn >= {last} THEN 1 - 6.0 * ({apart}) / {n * (n * n - 1)}.0 END")}]
        + [{"corr": s("100 * rho"), "p_value": s(f"100 * ({spearman_p('rho', n)})"), "dist": s(f"CASE WHEN rn >= {last} THEN greatest({ends}) - least({ends}) END")}],
        ("corr", "p_value", "dist"),
    )


def pct_rank(x: str, n: int):
    """100 * (rows below + half of those equal) / n over the last n rows."""
    frame = f"PARTITION BY asset ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"

    def col():
        w = Window.partitionBy("asset").orderBy("date").rowsBetween(-(n - 1), 0)
        seen, now = F.collect_list(F.expr(x)).over(w), F.expr(x)
        below = F.aggregate(seen, F.lit(0.0), lambda a, v: a + F.when(v < now, 1.0).when(v == now, 0.5).otherwise(0.0))
        return F.when((F.count(F.expr(x)).over(w) >= n) & now.isNotNull(), 100 * (below + F.lit(0.5)) / n)

    seen = f"list({x}) OVER ({frame})"
    return Ex(col, f"CASE WHEN count({x}) OVER ({frame}) >= {n} THEN 100 * (list_sum(list_transform({seen}, lambda v: CASE WHEN v < {x} THEN 1.0 WHEN v = {x} THEN 0.5 ELSE 0 END)) + 0.5) / {n} END")


def dual_thrust(n: int = 2) -> Recipe:
    return Recipe(
        [{"hh": roll("max", "high", n), "lc": roll("min", "close", n), "hc": roll("max", "close", n), "ll": roll("min", "low", n)}, {"dt_rng": s("greatest(hh - lc, hc - ll)"), "dt_rng0": s("greatest((hh - lc) * 0.5, (hc - ll) * 0.5, high - close, close - low)")}],
        ("dt_rng", "dt_rng0"),
    )


def kumo(n: int = 26, short: float = 0.35, long: float = 2.0) -> Recipe:
    a, c = int(short * n), int(long * n)
    return Recipe([{f"{f}{k}": roll(f, x, w) for k, w in (("a", a), ("b", n), ("c", c)) for f, x in (("max", "high"), ("min", "low"))}, {"tk": s("(maxa + mina) / 2"), "kj": s("(maxb + minb) / 2"), "skb": s("(maxc + minc) / 2")}, {"ska": s("(tk + kj) / 2")}], ("tk", "kj", "ska", "skb"))


def crosses(n: int = 10, m: int = 20) -> Recipe:
    """Crosses of two averages, in each direction, on every row; the last row's are the scalar forms."""
    return Recipe([{"fast": roll("avg", "close", n), "slow": roll("avg", "close", m)}, {"gap": s("fast - slow")}, {"pg": lag("gap")}, {"cross_up": s("CASE WHEN gap > 0 AND pg < 0 THEN 1 ELSE 0 END"), "cross_down": s("CASE WHEN gap < 0 AND pg > 0 THEN 1 ELSE 0 END")}], ("gap", "cross_up", "cross_down"))


def heiken_ashi(n: int = 1) -> Recipe:
    """The open is the mean of the last open and close, so an exponential mean of lagged closes with weight one half."""
    return Recipe(
        [{f"m{x[0]}": roll("avg", x, n) for x in ("open", "high", "low", "close")}, {"ha_c": s("(mo + mh + ml + mc) / 4")}, {"lag_c": lag("ha_c"), "rows": run("count", "ha_c")},
         Ewm("ha_o", "CASE WHEN rows = 1 THEN mo ELSE lag_c END", 0.5, adjust=False), {"ha_h": s("greatest(mh, ha_o, ha_c)"), "ha_l": s("least(ml, ha_o, ha_c)")}],
        ("ha_o", "ha_h", "ha_l", "ha_c"),
    )


def svapo(period: int = 8, cutoff: float = 1, high: float = 1.5, low: float = 1.3, n: int = 100) -> Recipe:
    return Recipe(
        [*heiken_ashi(1).steps, {"ha": s("(ha_o + ha_c + ha_h + ha_l) / 4")}, *tema_steps("ha", int(0.625 * period), "hac"), {"vm": roll("avg", "volume", 5 * period), "vslope": pair("regr_slope", "volume", "rn", period)}, {"vave": lag("vm")},
         *tema_steps("vslope", period, "vt"), {"phac": lag("hac"), "pvt": lag("vt"), "vc": s("least(volume, vave * 2)")},
         {"up": s(f"CASE WHEN hac <= phac * (1 + {cutoff} / 1000.0) OR vt < pvt THEN 0 * vc ELSE vc END"), "dn": s(f"CASE WHEN hac >= phac * (1 - {cutoff} / 1000.0) OR vt > pvt THEN 0 * vc ELSE -vc END")},
         {"ds": roll("sum", "up + dn", period)}, {"delta": s("ds / (vave + 1)")}, *tema_steps("delta", period, "svapo"), {"sd": roll("stddev_samp", "svapo", n)}, {"svapo_ub": s(f"sd * {high}"), "svapo_lb": s(f"-sd * {low}")}],
        ("svapo", "svapo_ub", "svapo_lb"),
    )
