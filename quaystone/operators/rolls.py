"""Roll maps of contracts: candidates by activity or expiry, forward-only lists, prices at rolls, near and far chains, resumed histories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def back_bdays(day: Column, n: int) -> Column:
    """The weekday n weekdays before a day (a weekend counts as the Friday before it)."""
    from_friday = F.least(F.weekday(day), F.lit(4))
    friday = F.date_sub(day, F.weekday(day) - from_friday)
    weeks, rest = n // 5, n % 5
    over = F.when(from_friday < rest, 2).otherwise(0)
    return F.date_sub(friday, F.lit(7 * weeks + rest) + over)


def next_bday(day: Column) -> Column:
    return F.date_add(day, F.when(F.weekday(day) >= 4, 7 - F.weekday(day)).otherwise(1))


def activity(bars: DataFrame, volume: float = 0.6, oi: float = 0.4, win: int = 3, cutoff: int = 0, least: float = 0.0) -> DataFrame:
    """bars with ind: the mean of weighted volume and open interest over win rows of the contract, its first rows filled from behind.

    Rows within cutoff business days of the expiry, and those below least, drop out.
    """
    w = Window.partitionBy("asset", "contract").orderBy("date")
    mean = F.avg(F.col("volume") * volume + F.col("oi") * oi).over(w.rowsBetween(-(win - 1), 0))
    kept = bars.where(F.col("date") <= back_bdays(F.col("expiry"), cutoff)) if cutoff else bars
    out = kept.withColumn("act", F.when(F.row_number().over(w) >= win, mean))
    out = out.withColumn("ind", F.first("act", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return out.where(F.col("ind") >= least).drop("act")


def candidates(active: DataFrame, nb: int, most: float | None = None) -> DataFrame:
    """asset, date and names: a date's contracts by expiry; with most only those whose ind reaches that of the nb-th largest, or most if that is less."""
    rows = active
    if most is not None:
        by = Window.partitionBy("asset", "date")
        place = F.row_number().over(by.orderBy(F.desc("ind"), "contract"))
        rows = rows.withColumn("place", place).withColumn("bound", F.least(F.min(F.when(F.col("place") <= nb, F.col("ind"))).over(by), F.lit(most))).where("ind >= bound")
    return rows.groupBy("asset", "date").agg(F.array_sort(F.collect_list("contract")).alias("names"))  # a date's live contracts


def roll_lists(cands: DataFrame, nb: int, full: bool = False) -> DataFrame:
    """asset, date and the nb contracts in use from that date, at each change; only contracts in use or later ones come in.

    full: every change of a list of nb contracts; else only changes of the first. An asset's dates go through in order.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now: list[str] = []
        out = []
        for asset, date, names in pdf.sort_values("date")[["asset", "date", "names"]].itertuples(index=False):
            new = list(names[:nb]) if not now else [n for n in names if n in now or n > now[-1]][:nb]
            stays = bool(now) and ((len(new) < nb or new == now) if full else (not new or new[0] == now[0]))
            if not stays:
                now = new
                out.append((asset, date, new))
        return pd.DataFrame(out, columns=["asset", "date", "contracts"])

    return cands.groupBy("asset").applyInPandas(run, "asset string, date date, contracts array<string>")


def roll_prices(lists: DataFrame, bars: DataFrame) -> DataFrame:
    """Changes of the first contract: asset, date (the business day behind), from, oldclose, to, newclose; closes of the day of the change, 0 without one."""
    w = Window.partitionBy("asset").orderBy("date")
    firsts = lists.select("asset", "date", F.get("contracts", F.lit(0)).alias("to")).withColumn("from", F.lag("to").over(w))
    moved = firsts.where("`from` IS NULL OR `from` <> to")
    close = lambda side: bars.select("asset", "date", F.col("contract").alias(side), F.col("close").alias(f"{side}_px"))
    out = moved.join(close("from"), ["asset", "date", "from"], "left").join(close("to"), ["asset", "date", "to"], "left")
    price = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select("asset", next_bday(F.col("date")).alias("date"), F.coalesce("from", F.lit("")).alias("from"), price("from_px").alias("oldclose"), "to", price("to_px").alias("newclose"))


def nearby(bars: DataFrame, nth: int = 1, before: int = 5) -> DataFrame:
    """Bars of the nth contract, in use up to so many business days before the first's expiry, with seg_start and seg_end."""
    w = Window.partitionBy("asset").orderBy("expiry")
    dim = bars.select("asset", "contract", "expiry").distinct()
    dim = dim.withColumn("seg_end", back_bdays(F.col("expiry"), before))
    dim = dim.withColumns({"seg_start": F.date_add(F.lag("seg_end").over(w), 1), "contract": F.lead("contract", nth - 1).over(w)})
    seg = dim.where("contract IS NOT NULL").select("asset", "contract", F.coalesce("seg_start", F.lit("1900-01-01").cast("date")).alias("seg_start"), "seg_end")
    b, g = bars.alias("b"), seg.alias("g")
    inside = F.col("b.date").between(F.col("g.seg_start"), F.col("g.seg_end"))
    return b.join(g, (F.col("b.asset") == F.col("g.asset")) & (F.col("b.contract") == F.col("g.contract")) & inside).select("b.*", "g.seg_start", "g.seg_end")


def resumed(stored: DataFrame, fresh: DataFrame, prices: list[str]) -> DataFrame:
    """A stored adjusted history (asset, date, prices, shift) carried on by a fresh one.

    The marker is each asset's last stored date. Where the fresh history has another shift there, the stored prices are
    multiplied up to it; then come the fresh rows behind the marker.
    """
    marker = stored.groupBy("asset").agg(F.max("date").alias("marker"), F.max_by("shift", "date").alias("old_shift"))
    at = fresh.join(marker, "asset", "left")
    moved = at.where("date = marker").select("asset", (F.col("shift") - F.col("old_shift")).alias("move"))
    move = F.coalesce(F.col("move"), F.lit(0.0))
    old = stored.join(moved, "asset", "left").select("asset", "date", *[(F.col(c) * F.exp(move)).alias(c) for c in prices], (F.col("shift") + move).alias("shift"))
    new = at.where("marker IS NULL OR date > marker").select("asset", "date", *prices, "shift")
    return old.unionByName(new)


def flattened(cache: DataFrame) -> DataFrame:
    """date, exch, code, volume, oi and close of rows of JSON {date: {exch: {code: {volume, oi, close}}}} (column value)."""
    kind = "map<string, map<string, map<string, struct<volume: double, oi: double, close: double>>>>"
    days = cache.select(F.explode(F.from_json("value", kind)).alias("date", "m")).select("date", F.explode("m").alias("exch", "n"))
    return days.select("date", "exch", F.explode("n").alias("code", "x")).select(F.to_date("date").alias("date"), "exch", "code", "x.*")
