"""Signals across assets: scores by a smoothed deviation, leaders of several methods and lags, flows inside a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions.recipe import Ewm


def smoothed_scores(panel: DataFrame, x: str, half_life: float, demean: bool = True) -> DataFrame:
    """panel: asset, date and x. x less the date's mean over the date's deviation, smoothed over dates by a half-life; dates before the first deviation take the first one.

    The deviations are one row a day, smoothed as one series and joined back by date.
    """
    day = Window.partitionBy("date")
    p = panel.withColumn("d", F.col(x) - F.avg(x).over(day) if demean else F.col(x))
    days = p.groupBy("date").agg(F.stddev_samp("d").alias("sd"), F.lit("all").alias("asset"))
    line = Window.partitionBy("asset").orderBy("date")
    days = days.withColumn("rn", F.row_number().over(line) - 1)
    days = Ewm("smooth", "sd", 1 - 0.5 ** (1 / half_life)).apply(days)
    days = days.select("date", F.coalesce("smooth", F.first("smooth", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))).alias("smooth"))
    return p.join(days, "date").withColumn("score", F.col("d") / F.nullif(F.col("smooth"), F.lit(0.0))).drop("d", "smooth")


def leader_signals(panel: DataFrame, methods: dict[str, Column], table: list[tuple[str, str, str, int]]) -> DataFrame:
    """Mean of its leaders' signals for each follower and date. panel: asset, date; methods: a column over panel each; table: leader, follower, method and lag in the leader's rows.

    A follower's mean on a date is over the leaders that have a signal then. The table is part of the plan, so it is for
    hundreds of rows; leaders' rows are sent once per row of the table.
    """
    wanted = sorted({(m, k) for _, _, m, k in table})
    w = Window.partitionBy("asset").orderBy("date")
    leaders = sorted({a for a, *_ in table})
    signals = panel.withColumns({f"_{m}": c for m, c in methods.items()}).where(F.col("asset").isin(leaders))
    signals = signals.withColumns({f"_{m}_{k}": F.lag(f"_{m}", k).over(w).cast("double") for m, k in wanted})
    each = signals.select("asset", "date", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(k).alias("lag"), F.col(f"_{m}_{k}").alias("v")) for m, k in wanted])).alias("s"))
    pairs = panel.sparkSession.createDataFrame(table, "leader string, follower string, method string, lag int")
    hit = each.select(F.col("asset").alias("leader"), "date", "s.*").where("v IS NOT NULL").join(pairs, ["leader", "method", "lag"])
    return hit.groupBy(F.col("follower").alias("asset"), "date").agg(F.avg("v").alias("signal"), F.count("*").alias("leaders"))


def day_flows(rows: DataFrame, order: list[str], halves: str) -> DataFrame:
    """rows: asset, date, price, volume, oi, in an order within the day. Mean and deviation of price changes, money and open-interest flow signed by them, and mean prices (by row) of the day's halves: halves is a condition true in the first."""
    w = Window.partitionBy("asset", "date").orderBy(*order)
    p = rows.withColumns({"d": F.col("price") - F.lag("price").over(w), "doi": F.col("oi") - F.lag("oi").over(w)})
    sign, first = F.signum("d"), F.expr(halves)
    return p.groupBy("asset", "date").agg(
        F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"), F.sum(sign * F.col("price") * F.col("volume")).alias("money_flow"), F.sum(sign * F.col("doi")).alias("oi_flow"),
        F.avg(F.when(first, F.col("price"))).alias("twap_1"), F.avg(F.when(~first, F.col("price"))).alias("twap_2"),
    )
