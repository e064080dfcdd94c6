"""Operators across the assets of a date."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaystone.functions.recipe import DATE, Ex, Recipe, Where, fill, lag, rank_avg, roll, s, whole

SIGNAL = [{"c20": lag("close", 20)}, {"sig": s("ln(close / c20)")}, Where("sig IS NOT NULL")]


def median(x: str) -> Ex:
    return Ex(lambda: F.percentile(F.expr(x), F.lit(0.5)).over(Window.partitionBy("date")), f"quantile_cont({x}, 0.5) OVER (PARTITION BY date)")


def scores() -> Recipe:
    return Recipe([*SIGNAL, {"xm": whole("avg", "sig", DATE), "xsd": whole("stddev_samp", "sig", DATE), "n": whole("count", "sig", DATE)}, {"demeaned": s("sig - xm"), "score": s("(sig - xm) / nullif(xsd, 0)")}], ("xm", "demeaned", "score", "n"))


def ranks(tails: float | None = None) -> Recipe:
    """Average-tie ranks around the median, scaled so that weights' absolute sum is 2; with tails (below 0.5) only that share of ranks at either end has a weight."""
    kept = "c" if tails is None else f"CASE WHEN c <= -1 + {2 * tails} OR c >= 1 - {2 * tails} THEN c ELSE 0 END"
    return Recipe(
        [*SIGNAL, {"r": rank_avg("sig"), "n": whole("count", "sig", DATE)}, {"rm": median("r")}, {"c": s("2 * (r - rm) / nullif(n - 1.0, 0)")}, {"kept": s(kept)}, {"total": whole("sum", "abs(kept)", DATE)}, {"weight": s("2 * kept / nullif(total, 0)")}],
        ("r", "weight"),
    )


def rank_cut(share: float = 0.2) -> Recipe:
    return Recipe([*SIGNAL, {"r": rank_avg("sig"), "n": whole("count", "sig", DATE)}, {"k": s(f"floor(n * {share})")}, {"side": s("CASE WHEN n < 4 THEN 0 WHEN r > n - k THEN 1 WHEN r <= k THEN -1 ELSE 0 END")}], ("side",))


def demedian() -> Recipe:
    return Recipe([*SIGNAL, {"med": median("sig"), "m": whole("avg", "sig", DATE), "n": whole("count", "sig", DATE)}, {"demed": s("CASE WHEN n >= 3 THEN sig - med END"), "demean": s("CASE WHEN n >= 3 THEN sig - m END"), "med_sign": s("CASE WHEN n >= 3 THEN sign(sig - med) END")}], ("demed", "demean", "med_sign"))


def asset_scaling() -> Recipe:
    return Recipe([*SIGNAL, {"valid": whole("count", "sig", DATE)}, {"scale": s("25.0 / nullif(valid, 0)")}], ("valid", "scale"))


def directional() -> Recipe:
    """A holding's part in the date's common direction and its own cross-sectional part."""
    return Recipe([*SIGNAL, {"net": whole("avg", "CASE WHEN sig <> 0 THEN sig END", DATE)}, {"direction": s("CASE WHEN sig <> 0 THEN net ELSE 0 END"), "selection": s("CASE WHEN sig <> 0 THEN sig - net ELSE 0 END")}], ("direction", "selection"))


def long_short() -> Recipe:
    return Recipe([*SIGNAL, {"nx": lag("close", -1)}, {"r": s("ln(nx / close)")}, {"long_pnl": s("greatest(sig, 0) * r"), "short_pnl": s("least(sig, 0) * r")}], ("long_pnl", "short_pnl"))


def top_n(n: int = 3) -> Recipe:
    """The n assets with the largest smoothed activity of each date; ties go by asset."""
    w = "PARTITION BY date ORDER BY act DESC, asset"
    place = Ex(lambda: F.row_number().over(Window.partitionBy("date").orderBy(F.desc("act"), "asset")), f"row_number() OVER ({w})")
    return Recipe([{"act": roll("avg", "volume + 0.5 * oi", 3, least=1)}, {"place": place}, Where(f"place <= {n}")], ("act", "place"))


def staggered(slots: int = 5, wins=(10, 20, 40)) -> Recipe:
    """Rank sums over several windows, ranked again (ties by asset), held in slots that are renewed in turn and averaged."""
    steps: list = [{f"c{n}": lag("close", n) for n in wins}, {f"m{n}": s(f"ln(close / c{n})") for n in wins}, Where(f"m{wins[-1]} IS NOT NULL"), {f"r{n}": rank_avg(f"m{n}") for n in wins}, {"total": s(" + ".join(f"r{n}" for n in wins)), "n": whole("count", "close", DATE)}]
    first = Ex(lambda: F.row_number().over(Window.partitionBy("date").orderBy("total", "asset")), "row_number() OVER (PARTITION BY date ORDER BY total, asset)")
    steps += [{"place": first}, {"side": s("CASE WHEN place > n * 0.8 THEN 1.0 WHEN place <= n * 0.2 THEN -1.0 ELSE 0.0 END")}, {f"e{k}": s(f"CASE WHEN rn % {slots} = {k} THEN side END") for k in range(slots)}, {f"h{k}": fill(f"e{k}") for k in range(slots)}]
    return Recipe([*steps, {"weight": s("(" + " + ".join(f"coalesce(h{k}, 0)" for k in range(slots)) + f") / {slots}")}], ("place", "weight"))
