"""Market-data build: resampling, sessions, calendars, cleaning, joins by date and interval, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.operators.sessions import with_session


def resample(ticks: DataFrame, minutes: int) -> DataFrame:
    """n-minute bars of ticks (asset, date, minute, ts, price); empty buckets make no bar."""
    return ticks.groupBy("asset", "date", F.floor(F.col("minute") / minutes).alias("bucket")).agg(
        F.min_by("price", F.struct("ts", "event_id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.count("*").alias("n_ticks"), F.min("ts").alias("first_ts"), F.max("minute").alias("last_minute"),
    )


#: What a column's name says about how it is put together; others keep their last value.
BY_NAME = {"open": "first", "high": "max", "low": "min", "volume": "sum", "money": "sum", "count": "sum"}


def by_name(rows: DataFrame, keys: list[str], order: str, how: dict[str, str] = BY_NAME) -> DataFrame:
    """Rows of each key put together, every other column by its name: first and last in an order, highest, lowest or sum."""
    made = {"first": lambda c: F.min_by(c, order), "last": lambda c: F.max_by(c, order), "max": F.max, "min": F.min, "sum": F.sum}
    return rows.groupBy(*keys).agg(*[made[how.get(c, "last")](c).alias(c) for c in rows.columns if c not in (*keys, order)])


def minute_id() -> Column:
    """hhmm counted from 18:00, so that a night session comes before its day."""
    return ((F.floor(F.col("minute") / 60) + 6) % 24) * 100 + F.col("minute") % 60


def session(cuts: list[int]) -> Column:
    """How many cuts lie at or before the minute id."""
    out = F.lit(0)
    for c in cuts:
        out = out + (F.col("min_id") >= c).cast("int")
    return out


def session_bars(ticks: DataFrame, cuts: list[int]) -> DataFrame:
    return ticks.withColumn("min_id", minute_id()).groupBy("asset", "date", session(cuts).alias("part")).agg(
        F.min_by("price", F.struct("min_id", "ts")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("min_id", "ts")).alias("close"), F.count("*").alias("n_ticks"),
    )


def twaps(ticks: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean price of named ranges of minute ids, in one pass."""
    ids = ticks.withColumn("min_id", minute_id())
    return ids.groupBy("asset", "date").agg(*[F.avg(F.when(F.col("min_id").between(a, b), F.col("price"))).alias(k) for k, (a, b) in ranges.items()])


def trading_date(ticks: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows from 18:00 on belong to the next business day; others on no business day to the next one too. calendar: date, next_bday, is_bday."""
    day = F.when((F.col("minute") >= 18 * 60) | ~F.col("is_bday"), F.col("next_bday")).otherwise(F.col("date"))
    return ticks.join(calendar.select("date", "next_bday", "is_bday"), "date").withColumn("trade_date", day)


def calendar(days: DataFrame, holidays: tuple[str, ...] = ()) -> DataFrame:
    """Weekdays that aren't in a list of holidays (yyyy-mm-dd) are business days: date, is_bday, bday_no, prev_bday and next_bday of a frame with first and last day; a row per day, so it stays small."""
    d = days.select(F.explode(F.sequence("first", "last")).alias("date"))
    d = d.withColumn("is_bday", F.dayofweek("date").between(2, 6) & ~F.col("date").cast("string").isin(list(holidays)))
    b = F.when(F.col("is_bday"), F.col("date"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return d.withColumns({
        "bday_no": F.sum(F.col("is_bday").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "prev_bday": F.last(b, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "next_bday": F.first(b, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })


def shift_bdays(rows: DataFrame, cal: DataFrame, date: str, n: int, out: str) -> DataFrame:
    """out: the business day n after that of date, by number."""
    own = cal.select(F.col("date").alias(date), "bday_no")
    ahead = cal.where("is_bday").select((F.col("bday_no") - n).alias("bday_no"), F.col("date").alias(out))
    return rows.join(own, date).join(ahead, "bday_no", "left").drop("bday_no")


def in_sessions(ticks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Ticks within one of their group's sessions (kind, from_date, to_date, start_minute, end_minute, the last two inclusive), by bit masks."""
    open_ones = sessions.withColumns({"end_minute": F.col("end_minute") + 1, "open": F.lit(True)})
    return with_session(ticks, open_ones, "event_type").where("in_session").drop("in_session")


#: Rates of value added tax and the first days of the later ones.
VAT = ((None, 1.17), ("2018-05-01", 1.16), ("2019-04-01", 1.13))


def vat(price: str, date: str, add: bool = False, rates=VAT) -> Column:
    """Price without value added tax at the rate of its date, or with it."""
    rate = F.lit(rates[0][1])
    for day, r in rates[1:]:
        rate = F.when(F.col(date) >= F.lit(day).cast("date"), r).otherwise(rate)
    return F.col(price) * rate if add else F.col(price) / rate


def halve_before(x: str, date: str, day: str) -> Column:
    return F.when(F.col(date) < F.lit(day).cast("date"), F.col(x) / 2).otherwise(F.col(x))


def chain_segments(roll_map: DataFrame) -> DataFrame:
    """Roll days (asset, contract, start) as segments with an end, the day before the next start."""
    return roll_map.withColumn("end", F.date_sub(F.lead("start").over(Window.partitionBy("asset").orderBy("start")), 1))


def chain(bars: DataFrame, segments: DataFrame) -> DataFrame:
    """Bars of the contract that is in use: equality on asset and contract keeps the interval join a hash join."""
    b, g = bars.alias("b"), segments.alias("g")
    inside = (F.col("b.date") >= F.col("g.start")) & (F.col("g.end").isNull() | (F.col("b.date") <= F.col("g.end")))
    return b.join(g, (F.col("b.asset") == F.col("g.asset")) & (F.col("b.contract") == F.col("g.contract")) & inside).select("b.*", F.col("g.start").alias("seg_start"))


def roll_map(bars: DataFrame) -> DataFrame:
    """Per asset and month the contract with the most volume in the month before (ties: the least contract), where it changes."""
    month = bars.groupBy("asset", "contract", F.trunc("date", "month").alias("month")).agg(F.sum("volume").alias("v"))
    best = month.withColumn("place", F.row_number().over(Window.partitionBy("asset", "month").orderBy(F.desc("v"), "contract"))).where("place = 1")
    w = Window.partitionBy("asset").orderBy("month")
    moved = best.withColumn("last", F.lag("contract").over(w)).where("last IS NULL OR last <> contract")
    return moved.select("asset", "contract", F.add_months("month", 1).alias("start"))


def back_adjusted(chained: DataFrame, ratio: bool = True) -> DataFrame:
    """Adjusted closes of a chain and the shift: each segment is moved by the gaps of all later rolls, as logs of ratios or as differences; a roll without a positive price is skipped."""
    seg = chained.groupBy("asset", "seg_start").agg(F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"))
    w = Window.partitionBy("asset").orderBy("seg_start")
    seg = seg.withColumn("next", F.lead("first_close").over(w))
    gap = F.ln(F.col("next") / F.col("last_close")) if ratio else F.col("next") - F.col("last_close")
    gaps = seg.withColumn("gap", F.when((F.col("next") > 0) & (F.col("last_close") > 0), gap).otherwise(0.0))
    later = F.sum("gap").over(Window.partitionBy("asset").orderBy(F.desc("seg_start")).rowsBetween(Window.unboundedPreceding, 0))
    adjusted = chained.join(gaps.select("asset", "seg_start", later.alias("shift")), ["asset", "seg_start"])
    return adjusted.withColumn("adj_close", F.col("close") * F.exp("shift") if ratio else F.col("close") + F.col("shift"))


def as_of(grid: DataFrame, series: DataFrame, value: str, limit: int | None = None) -> DataFrame:
    """The last value of series (key, date, value) on or before each grid row (key, date), for at most limit grid rows behind the value's date."""
    both = grid.select("key", "date", F.lit(None).cast(series.schema[value].dataType).alias(value), F.lit(1).alias("g")).unionByName(series.select("key", "date", value, F.lit(0).alias("g")))
    w = Window.partitionBy("key").orderBy("date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("seq", F.sum("g").over(w))
    held = both.withColumns({"at": F.last(F.when(F.col(value).isNotNull(), F.col("seq")), ignorenulls=True).over(w), value: F.last(value, ignorenulls=True).over(w)})
    kept = F.col(value) if limit is None else F.when(F.col("seq") - F.col("at") <= limit, F.col(value))
    return held.where("g = 1").select("key", "date", kept.alias(value))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replace: bool = True) -> DataFrame:
    """Rows of both by key: the new one wins (replace) or the old one; within a side the largest row wins."""
    order = F.desc("batch") if replace else F.asc("batch")
    both = old.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    rest = [F.desc_nulls_last(c) for c in old.columns if c not in keys]
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *rest))).where("place = 1").drop("place", "batch")


def splice(old: DataFrame, new: DataFrame, day: str) -> DataFrame:
    """Old rows up to the day, new ones after it, without rows of no volume."""
    d = F.lit(day).cast("date")
    return old.where(F.col("date") <= d).unionByName(new.where(F.col("date") > d)).where("volume > 0")


def broker_sums(ranks: DataFrame) -> DataFrame:
    """Sums over the first 5, 10 and 20 ranks by date, product and contract, and by date and product."""
    top = [F.sum(F.when(F.col("ranknum") <= k, F.col("vol"))).alias(f"vol_{k}") for k in (5, 10, 20)]
    return ranks.groupingSets([["date", "prod", "inst"], ["date", "prod"]], "date", "prod", "inst").agg(*top)


def expiries(cal: DataFrame) -> DataFrame:
    """Last trading day of each month's contract by kind of rule: the 15th or the next business day, the 10th business day, the third Friday, the last but two."""
    b = cal.where("is_bday").withColumn("month", F.trunc("date", "month"))
    w = Window.partitionBy("month").orderBy("date")
    b = b.withColumns({"nth": F.row_number().over(w), "left": F.row_number().over(Window.partitionBy("month").orderBy(F.desc("date")))})
    rules = {
        "fifteenth": F.min(F.when(F.dayofmonth("date") >= 15, F.col("date"))), "tenth_bday": F.max(F.when(F.col("nth") == 10, F.col("date"))),
        "third_friday": F.max(F.when((F.weekday("date") == 4) & F.dayofmonth("date").between(15, 21), F.col("date"))), "third_last": F.max(F.when(F.col("left") == 3, F.col("date"))),
    }
    return b.groupBy("month").agg(*[e.alias(k) for k, e in rules.items()])
