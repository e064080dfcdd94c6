"""Target positions of several strategies from a repository of factors, against the positions stored the day before.

A repository row says for a strategy which factor it uses, how the factor becomes a signal (kind), how the signal is
smoothed, its weight, and the band within which yesterday's signal is kept. Stores have a version per day; a day reads
the last version before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions.recipe import Ewm, com

REPOSITORY = "strategy string, fact string, name string, kind string, threshold double, smooth string, days int, weight double, band double"
#: Different smoothings in a repository; each is a window of the plan.
MOST_SMOOTHINGS = 100


def transformed(factors: DataFrame, repository: DataFrame) -> DataFrame:
    """strategy, fact, asset, date, signal and the repository's columns: each factor by its kind, before smoothing; factors: asset, date, name, value."""
    rows = factors.join(repository, "name")
    held = Window.partitionBy("strategy", "fact", "asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("x", F.last("value", ignorenulls=True).over(held)).where("x IS NOT NULL")
    day = Window.partitionBy("strategy", "fact", "date")
    n = F.count("x").over(day)
    place = F.rank().over(day.orderBy("x")) + (F.count("*").over(Window.partitionBy("strategy", "fact", "date", "x")) - 1) / 2
    rows = rows.withColumns({"n": n, "place": place, "middle": F.percentile("x", F.lit(0.5)).over(day), "mean": F.avg("x").over(day), "sd": F.stddev_samp("x").over(day)})
    rows = rows.withColumns({"k": F.floor(F.col("n") * F.col("threshold")), "middle_place": F.percentile("place", F.lit(0.5)).over(day)})
    ends = (F.col("place") > F.col("n") - F.col("k")).cast("double") - (F.col("place") < F.col("k") + 1).cast("double")
    kinds = {
        "xs-rank_cutoff": ends, "xs-demedian": F.col("x") - F.col("middle"), "xs-demean": F.col("x") - F.col("mean"), "xs-score": (F.col("x") - F.col("mean")) / F.nullif("sd", F.lit(0)),
        "xs-rank": (F.col("place") - F.col("middle_place")) / F.col("n") * 2, "ts": F.col("x"), "pos": F.col("x"),
    }
    signal = F.lit(None).cast("double")
    for kind, value in kinds.items():
        signal = F.when(F.col("kind") == kind, value).otherwise(signal)
    known = F.assert_true(F.col("kind").isin(*kinds), F.concat(F.lit("no kind "), F.coalesce("kind", F.lit("null"))))
    return rows.withColumn("signal", signal).where(known.isNull()).select("strategy", "fact", "asset", "date", "signal", "kind", "smooth", "days", "weight", "band")


def smoothed(signals: DataFrame, repository: DataFrame) -> DataFrame:
    """signals with signal behind its smoothing (sma: the mean of so many rows, 0 until there are as many; ema: an exponential mean of that centre of mass; positions stay as they are)."""
    found = [tuple(r) for r in repository.select("smooth", "days").distinct().limit(MOST_SMOOTHINGS + 1).collect()]
    if len(found) > MOST_SMOOTHINGS:
        raise ValueError(f"more than {MOST_SMOOTHINGS} smoothings")
    by = Window.partitionBy("strategy", "fact", "asset").orderBy("date")
    value = F.lit(None).cast("double")
    for n in sorted({d for s, d in found if s == "sma"}):
        w = by.rowsBetween(1 - n, 0)
        value = F.when((F.col("smooth") == "sma") & (F.col("days") == n), F.when(F.count("signal").over(w) >= n, F.avg("signal").over(w))).otherwise(value)
    rows = signals.withColumn("plain", value)
    means = sorted({d for s, d in found if s == "ema"})
    if means:  # a history is one of a strategy, factor and asset
        rows = rows.withColumnRenamed("asset", "own").withColumn("asset", F.to_json(F.struct("strategy", "fact", "own"))).withColumn("rn", F.row_number().over(Window.partitionBy("asset").orderBy("date")) - 1)
        for n in means:
            rows = Ewm(f"e{n}", "signal", com(n)).apply(rows)
            rows = rows.withColumn("plain", F.when((F.col("smooth") == "ema") & (F.col("days") == n), F.col(f"e{n}")).otherwise(F.col("plain")))
        rows = rows.drop("asset").withColumnRenamed("own", "asset")
    signal = F.when(F.col("kind") == "pos", F.col("signal")).otherwise(F.coalesce("plain", F.lit(0.0)))
    return rows.select("strategy", "fact", "asset", "date", signal.alias("signal"), "weight", "band")


def on_day(rows: DataFrame, day, *keys: str) -> DataFrame:
    """Each key's last row on or before a day."""
    values = [c for c in rows.columns if c not in keys]
    return rows.where(F.col("date") <= F.lit(day)).groupBy(*keys).agg(F.max_by(F.struct(*values), "date").alias("r")).select(*keys, "r.*")


def buffered(today: DataFrame, stored: DataFrame | None) -> DataFrame:
    """today with signal moved from the stored one (strategy, fact, asset, signal) only as far as the edge of its band; without a stored one or a band it is taken as it is."""
    if stored is None:
        return today
    old = stored.select("strategy", "fact", "asset", F.col("signal").alias("old"))
    gap = F.col("signal") - F.col("old")
    moved = F.col("old") + F.greatest(gap - F.col("band"), F.lit(0.0)) + F.least(gap + F.col("band"), F.lit(0.0))
    kept = F.col("band").isNotNull() & F.col("old").isNotNull()  # greatest() passes over nulls
    return today.join(old, ["strategy", "fact", "asset"], "left").withColumn("signal", F.when(kept, moved).otherwise(F.col("signal"))).drop("old")


def positions(signals: DataFrame, risk: DataFrame, scaler: float, lot: str = "lot") -> DataFrame:
    """asset and position in lots over all strategies; risk: asset, vol and lot size. Strategies' weighted signals are rounded to two places; lots half away from zero."""
    by_strategy = signals.groupBy("strategy", "asset").agg(F.round(F.sum(F.col("weight") * F.col("signal")), 2).alias("held"))
    total = by_strategy.groupBy("asset").agg(F.sum("held").alias("held"), F.count("*").alias("n_strategies"))
    size = F.col("held") * scaler / (F.nullif("vol", F.lit(0)) * F.col(lot))
    out = total.join(risk, "asset").withColumn("exact", size)
    return out.select("asset", "n_strategies", "exact", (F.signum("exact") * F.floor(F.abs(F.round("exact", 6)) + 0.5)).alias("lots"))


def write_version(df: DataFrame, path: str, day) -> None:
    df.withColumn("version", F.lit(day).cast("date")).write.mode("append").partitionBy("version").parquet(path)


def version_before(df: DataFrame, day) -> DataFrame:
    """The rows of the last version before a day; a version is a folder of its own, so only that one is read."""
    last = df.where(F.col("version") < F.lit(day)).agg(F.max("version")).first()[0]
    return df.where(F.col("version") == F.lit(last)) if last else df.limit(0)


def daily_run(factors: DataFrame, risk: DataFrame, repository: DataFrame, days: list, path: str, scaler: float) -> DataFrame:
    """day, asset, n_strategies, exact, lots and change of each day in turn; signals and positions are stored under path by day."""
    spark = factors.sparkSession
    signals = smoothed(transformed(factors, repository), repository)
    signals.write.mode("overwrite").parquet(f"{path}/smoothed")
    signals = spark.read.parquet(f"{path}/smoothed")
    out = None
    for i, day in enumerate(days):
        read = lambda name: version_before(spark.read.parquet(f"{path}/{name}"), day) if i else None  # noqa: E731, B023
        today = buffered(on_day(signals, day, "strategy", "fact", "asset"), read("signals"))
        write_version(today, f"{path}/signals", day)
        own = spark.read.parquet(f"{path}/signals").where(F.col("version") == F.lit(day))
        new, old = positions(own, on_day(risk, day, "asset"), scaler), read("positions")
        write_version(new, f"{path}/positions", day)
        new = spark.read.parquet(f"{path}/positions").where(F.col("version") == F.lit(day)).drop("version")
        before = old.select("asset", F.col("lots").alias("before")) if old is not None else new.select("asset", F.lit(0.0).alias("before"))
        one = new.join(before, "asset", "left").select(F.lit(day).cast("date").alias("day"), "asset", "n_strategies", "exact", "lots", (F.col("lots") - F.coalesce("before", F.lit(0.0))).alias("change"))
        out = one if out is None else out.union(one)
    return out
