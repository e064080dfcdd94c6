"""Books of holdings over panels: tilt and timing, volatility scaling, beta hedges, simulated trades with cost and margin, residuals, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.operators import research as rs

def by_date():
    """A row's asset in order of date."""
    return Window.partitionBy("asset").orderBy("date")


def _full(fn: Column, of: Column, w, n: int) -> Column:
    """A window's value once it holds n rows that aren't null."""
    return F.when(F.count(of).over(w) >= n, fn.over(w))


def tilt_timing(panel: DataFrame, n: int = 3 * rs.YEAR) -> DataFrame:
    """panel: asset, date, holding. Mean holding of n rows (as many as there are) and of all rows, and what is left of the holding after each."""
    tilt, whole = F.avg("holding").over(by_date().rowsBetween(-n + 1, 0)), F.avg("holding").over(Window.partitionBy("asset"))
    return panel.withColumns({"tilt": tilt, "whole_tilt": whole}).withColumns({"timing": F.col("holding") - F.col("tilt"), "whole_timing": F.col("holding") - F.col("whole_tilt")})


def vol_scaled(panel: DataFrame, n: int = 252) -> DataFrame:
    """panel: asset, date, holding, ret. The holding over the deviation of n rows' returns (as many as there are); null for one row or no deviation."""
    return panel.withColumn("scaled", F.col("holding") / F.nullif(F.stddev_samp("ret").over(by_date().rowsBetween(-n + 1, 0)), F.lit(0.0)))


def _beta(w, win: int, step: int, least: float, most: float):
    """Columns of a rolling beta of pnl on index_pnl: means of some rows, then covariance over variance, held within bounds and filled forward."""
    inside = w.rowsBetween(-step + 1, 0)
    wide = w.rowsBetween(-win + 1, 0)
    means = {f"_{c}": _full(F.avg(c), F.col(c), inside, step) for c in ("pnl", "index_pnl")}
    raw = _full(F.covar_samp("_pnl", "_index_pnl"), F.col("_pnl"), wide, win) / F.nullif(F.var_samp("_index_pnl").over(wide), F.lit(0.0))
    return means, F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(least)), F.lit(most))), F.last("_raw", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def beta_hedged(panel: DataFrame, portfolio: bool, win: int = 240, step: int = 5, least: float = 0.0, most: float = 1e5) -> DataFrame:
    """panel: asset, date, holding, index_holding, ret. beta, neutral (the holding less beta times the index's) and hedged (the day's P&L so hedged).

    Holdings are filled forward and earn from the next row on. By asset, or with one beta by date for the sum of all
    assets: that sum is one row a day and is joined back by date.
    """
    held = by_date().rowsBetween(Window.unboundedPreceding, 0)
    p = panel.withColumns({c: F.last(c, ignorenulls=True).over(held) for c in ("holding", "index_holding")})
    p = p.withColumns({"pnl": F.coalesce(F.lag("holding").over(by_date()), F.lit(0.0)) * F.col("ret"), "index_pnl": F.coalesce(F.lag("index_holding").over(by_date()), F.lit(0.0)) * F.col("ret")}).where("ret IS NOT NULL")
    if portfolio:
        days = p.groupBy("date").agg(F.sum("pnl").alias("pnl"), F.sum("index_pnl").alias("index_pnl"))
        means, raw, filled = _beta(Window.partitionBy(F.lit(0)).orderBy("date"), win, step, least, most)
        p = p.join(days.withColumns(means).withColumn("_raw", raw).select("date", filled.alias("beta")), "date")
    else:
        means, raw, filled = _beta(by_date(), win, step, least, most)
        p = p.withColumns(means).withColumn("_raw", raw).withColumn("beta", filled)
    return p.withColumns({"neutral": F.col("holding") - F.col("index_holding") * F.col("beta"), "hedged": F.col("pnl") - F.col("index_pnl") * F.col("beta")}).drop("_pnl", "_index_pnl", "_raw")


def traded_returns(panel: DataFrame) -> DataFrame:
    """panel: asset, date, pos, trade_px, close, cost. P&L in shares of the price: the old position from close to close, its change from the trade price on, less its cost."""
    p = panel.withColumns({"held": F.coalesce(F.lag("pos").over(by_date()), F.lit(0.0)), "_before": F.lag("close").over(by_date())})
    change = F.col("pos") - F.col("held")
    return p.withColumn("pnl", F.col("held") * F.coalesce(F.col("close") / F.col("_before") - 1, F.lit(0.0)) + change * (F.col("close") / F.col("trade_px") - 1) - F.abs(change) * F.col("cost")).drop("_before")


def simulated(panel: DataFrame, margins: tuple[float, float]) -> DataFrame:
    """panel: asset, date, pos, trade_px, close, cost (an amount). P&L after cost, cost and margin (rates of long and short values) of all assets by date."""
    before, last = F.lag("pos").over(by_date()), F.lag("close").over(by_date())
    p = panel.withColumn("pnl", F.col("pos") * (F.col("close") - F.col("trade_px")) + F.coalesce(before * (F.col("trade_px") - last), F.lit(0.0)) - F.coalesce("cost", F.lit(0.0)))
    value = F.col("pos") * F.col("close")
    return p.groupBy("date").agg(F.sum("pnl").alias("pnl"), F.sum("cost").alias("cost"), F.sum(F.greatest(value * margins[0], -value * margins[1])).alias("margin"))


def tenor_bundle(days: DataFrame, months: list[int]) -> DataFrame:
    """days: date, pnl, cost, margin. Mean, deviation, total, cost, highest margin and the ratios of rs.stats for the last so many months (the first day included)."""
    last = days.agg(F.max("date").alias("last"))
    each = days.crossJoin(F.broadcast(last)).withColumn("tenor", F.explode(F.lit(months))).where(F.col("date") >= F.add_months("last", -F.col("tenor")))
    sums = each.groupBy("tenor").agg(F.avg("pnl").alias("mean"), F.stddev_samp("pnl").alias("sd"), F.sum("cost").alias("cost"), F.max("margin").alias("margin"))
    out = rs.stats(each.select("tenor", "date", "pnl"), "tenor").join(sums, "tenor")
    return out.withColumn("profit_dd", F.coalesce(F.col("total") / F.nullif(F.abs("max_dd"), F.lit(0.0)), F.lit(0.0)))


def residuals(panel: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Least squares of y on a and b with a constant by asset, from one aggregate of moments: coefficients and their t, the share explained, the residual's deviation, and the last row's residual by it; null for singular or exact fits."""
    rows = panel.where(f"{y} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL")
    pairs = {"ya": (y, a), "yb": (y, b), "ab": (a, b), "aa": (a, a), "bb": (b, b), "yy": (y, y)}
    m = rows.groupBy("asset").agg(F.count("*").alias("n"), *[F.covar_pop(p, q).alias(k) for k, (p, q) in pairs.items()], *[F.avg(c).alias(k) for k, c in (("my", y), ("ma", a), ("mb", b))], F.max_by(F.struct(F.col(y).alias("y"), F.col(a).alias("a"), F.col(b).alias("b")), "date").alias("end"))
    c = F.col
    m = m.withColumn("det", F.when(c("aa") * c("bb") - c("ab") ** 2 > 1e-12 * c("aa") * c("bb"), c("aa") * c("bb") - c("ab") ** 2))
    m = m.withColumns({"b1": (c("ya") * c("bb") - c("yb") * c("ab")) / c("det"), "b2": (c("yb") * c("aa") - c("ya") * c("ab")) / c("det")})
    m = m.withColumns({"b0": c("my") - c("b1") * c("ma") - c("b2") * c("mb"), "left": c("yy") - c("b1") * c("ya") - c("b2") * c("yb")})
    m = m.withColumn("var", F.when((c("n") > 3) & (c("left") > 1e-12 * c("yy")), c("left") * c("n") / (c("n") - 3)))
    error = lambda v: F.sqrt(c("var") * c(v) / (c("n") * c("det")))
    end = c("end.y") - c("b0") - c("b1") * c("end.a") - c("b2") * c("end.b")
    return m.select("asset", "n", "b0", "b1", "b2", (c("b1") / error("bb")).alias("t1"), (c("b2") / error("aa")).alias("t2"), (1 - c("left") / F.nullif(c("yy"), F.lit(0.0))).alias("r2"), F.sqrt("var").alias("resid_sd"), (end / F.sqrt("var")).alias("z_last"))


def sheet_rows(wide: DataFrame, header: DataFrame, date: str = "date", zero_is_null: bool = True, look_back: int | None = None) -> DataFrame:
    """Long rows of a wide sheet (date, a column per series) with the columns of header (name, ...): no nulls, zeros as nulls, days of the look-back before the sheet's last day only.

    Series that the header doesn't name go; a header row is small beside the sheet, and Spark picks the join by size.
    """
    names = [c for c in wide.columns if c != date]
    if look_back is not None:
        last = wide.agg(F.max(date).alias("_last"))
        wide = wide.crossJoin(F.broadcast(last)).where(F.datediff("_last", date) <= look_back).drop("_last")
    long = wide.unpivot([date], names, "name", "value").where("value IS NOT NULL")
    return (long.where("value <> 0") if zero_is_null else long).join(header, "name")


def contract_changes(panel: DataFrame) -> DataFrame:
    """panel: asset, date, contract, close. Difference, ratio and log return on the row before; zero where the contract isn't that of the row before, null for the first row."""
    other = F.lag("contract").over(by_date()) != F.col("contract")
    last = F.lag("close").over(by_date())
    each = {"diff": F.col("close") - last, "pct": F.col("close") / F.nullif(last, F.lit(0.0)) - 1, "log_ret": F.ln(F.col("close") / F.nullif(last, F.lit(0.0)))}
    return panel.withColumns({k: F.when(other, 0.0).otherwise(v) for k, v in each.items()})
