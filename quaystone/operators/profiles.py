"""Back-test profiles of a caller's frame: results by shift of the holdings, and by scenario, sample and tenor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def portfolio_stats(x: str, year: int = YEAR) -> dict[str, Column]:
    """Number, mean, deviation, sum, worst day and yearly Sharpe of daily results."""
    mean, sd = F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0))
    return {"days": F.count(x), "mean": mean, "sd": F.stddev_samp(x), "total": F.sum(x), "worst": F.min(x), "sharpe": mean / sd * year**0.5}


def lead_lag(panel: DataFrame, shifts: range, samples: int = 5, holding: str = "holding", ret: str = "ret") -> DataFrame:
    """shift, sample, days and sharpe of a portfolio whose holdings are moved by shift rows (below 0: held before they were known).

    All shifts are lags of one window, summed by day side by side; only a row per day is unfolded. Sample 0 is all days,
    1 to samples are as many parts of the days in order. panel: asset, date, holding and ret, a row per asset and day.
    """
    w = Window.partitionBy("asset").orderBy("date")
    moved = {f"s{i}": F.lag(holding, k).over(w) * F.col(ret) for i, k in enumerate(shifts)}
    by_day = panel.select("asset", "date", holding, ret).withColumns(moved).groupBy("date").agg(*[F.sum(c).alias(c) for c in moved])
    numbered = by_day.withColumn("part", F.ntile(samples).over(Window.orderBy("date")))  # a row per day
    shift = F.element_at(F.create_map(*[x for i, k in enumerate(shifts) for x in (F.lit(f"s{i}"), F.lit(k))]), F.col("name"))
    long = numbered.unpivot(["date", "part"], list(moved), "name", "pnl").select(shift.alias("shift"), F.explode(F.array(F.lit(0), "part")).alias("sample"), "pnl")
    stats = portfolio_stats("pnl")
    return long.groupBy("shift", "sample").agg(stats["days"].alias("days"), stats["sharpe"].alias("sharpe"))


def grid(signals: DataFrame, cuts: list[float], tenors: dict[str, int | None], ret: str = "ret") -> DataFrame:
    """The statistics of each scenario (win and cut) and tenor; signals: win, asset, date, signal and ret.

    A signal beyond cut is held on its side the next day. Thresholds are columns beside each other, so the panel moves once;
    tenors (years back from the last day, None: all) are taken from the daily results.
    """
    w = Window.partitionBy("win", "asset").orderBy("date")
    side = lambda c: F.when(F.col("signal") > c, 1.0).when(F.col("signal") < -c, -1.0).otherwise(0.0)
    held = signals.withColumns({f"c{i}": side(c) for i, c in enumerate(cuts)})
    pnl = held.withColumns({f"c{i}": F.coalesce(F.lag(f"c{i}").over(w) * F.col(ret), F.lit(0.0)) for i in range(len(cuts))})
    by_day = pnl.groupBy("win", "date").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(cuts))])
    cut = F.element_at(F.create_map(*[x for i, c in enumerate(cuts) for x in (F.lit(f"c{i}"), F.lit(c))]), F.col("name"))
    long = by_day.unpivot(["win", "date"], [f"c{i}" for i in range(len(cuts))], "name", "pnl").withColumn("cut", cut)
    last = F.max("date").over(Window.partitionBy("win", "cut"))
    names = F.array(*[F.struct(F.lit(k).alias("tenor"), F.lit(v).cast("int").alias("years")) for k, v in tenors.items()])
    each = long.withColumn("last", last).withColumn("t", F.explode(names)).where("t.years IS NULL OR date > add_months(last, -12 * t.years)")
    return each.groupBy("win", "cut", F.col("t.tenor").alias("tenor")).agg(*[v.alias(k) for k, v in portfolio_stats("pnl").items()])
