"""Seasonality: labels, look-back samples, year-on-year tables, holiday windows and calendar rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lunar new year days.
NEW_YEARS = (
    "1994-02-10 1995-01-31 1996-02-19 1997-02-07 1998-01-28 1999-02-16 2000-02-05 2001-01-24 2002-02-12 2003-02-01 2004-01-22 2005-02-09 2006-01-29 2007-02-18 2008-02-07 2009-01-26 2010-02-14 "
    "2011-02-03 2012-01-23 2013-02-10 2014-01-31 2015-02-19 2016-02-08 2017-01-28 2018-02-16 2019-02-05 2020-01-25 2021-02-12 2022-02-01 2023-01-22 2024-02-10 2025-01-29 2026-02-17"
).split()


def lunar_labels(df: DataFrame) -> DataFrame:
    """lunar_year, lunar_day and lunar_week from the nearest new year day (the earlier of two as near)."""
    best = F.array_min(F.transform(F.lit(NEW_YEARS), lambda d: F.struct(F.abs(F.datediff("date", d.cast("date"))).alias("far"), d.cast("date").alias("day"))))["day"]
    out = df.withColumn("new_year", best)
    return out.withColumns({"lunar_year": F.year("new_year"), "lunar_day": F.datediff("date", "new_year")}).withColumn("lunar_week", F.floor(F.col("lunar_day") / 7))


def look_back(df: DataFrame, x: str, days: int = 15, years: int = 3) -> DataFrame:
    """Score of x against the days around the same day of this and the former years: an equality join on asset and year."""
    t = df.select("asset", "date", F.col(x).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(years))).alias("back"))
    t = t.withColumn("mid", F.add_months("date", -12 * F.col("back")))
    t = t.withColumns({"lo": F.date_sub("mid", days), "hi": F.when(F.col("back") == 0, F.col("date")).otherwise(F.date_add("mid", days))})
    t = t.withColumn("yr", F.explode(F.array_distinct(F.array(F.year("lo"), F.year("hi")))))
    q = df.select("asset", F.year("date").alias("yr"), F.col("date").alias("d"), F.col(x).alias("v"))
    seen = t.join(q, ["asset", "yr"]).where("d BETWEEN lo AND hi").select("asset", "date", "x", "d", "v").distinct()
    return seen.groupBy("asset", "date").agg(((F.max("x") - F.avg("v")) / F.nullif(F.stddev_samp("v"), F.lit(0))).alias("score"), F.count("*").alias("n"))


def group_score(df: DataFrame, x: str) -> DataFrame:
    """Score of x among all past rows whose week is this one or a neighbour, around the turn of the year too."""
    t = df.withColumn("wk", F.weekofyear("date"))
    near = t.select("asset", "date", F.col(x).alias("x"), F.explode(F.transform(F.lit([-1, 0, 1]), lambda o: F.pmod(F.col("wk") + o - 1, F.lit(53)) + 1)).alias("wk"))
    q = t.select("asset", "wk", F.col("date").alias("d"), F.col(x).alias("v"))
    return near.join(q, ["asset", "wk"]).where("d <= date").groupBy("asset", "date").agg(((F.max("x") - F.avg("v")) / F.nullif(F.stddev_samp("v"), F.lit(0))).alias("score"), F.count("*").alias("n"))


def yoy(df: DataFrame, x: str) -> DataFrame:
    """Weekly means by ISO week, filled along the year, against the same week of the year before."""
    w = df.groupBy("asset", F.year(F.date_add(F.date_trunc("week", "date").cast("date"), 3)).alias("yr"), F.weekofyear("date").alias("wk")).agg(F.avg(x).alias("v"))
    years = w.select("asset", "yr").distinct().withColumn("wk", F.explode(F.sequence(F.lit(1), F.lit(53))))
    full = years.join(w, ["asset", "yr", "wk"], "left").withColumn("v", F.last("v", ignorenulls=True).over(Window.partitionBy("asset").orderBy("yr", "wk").rowsBetween(Window.unboundedPreceding, 0)))
    return full.withColumn("yoy", F.col("v") / F.lag("v").over(Window.partitionBy("asset", "wk").orderBy("yr")) - 1)


def holiday_windows(cal: DataFrame, holidays: list[tuple[str, float]], before: int, after: int) -> DataFrame:
    """Sum of the weights of holidays within so many business days of each day. cal: date, bday_no."""
    h = cal.select(F.col("date").alias("h"), F.col("bday_no").alias("hb")).withColumn("weight", F.element_at(F.create_map(*[x for d, w in holidays for x in (F.lit(d), F.lit(w))]), F.date_format("h", "yyyy-MM-dd"))).where("weight IS NOT NULL")
    hit = h.withColumn("bday_no", F.explode(F.sequence(F.col("hb") - before, F.col("hb") + after))).groupBy("bday_no").agg(F.sum("weight").alias("weight"))
    return cal.join(hit, "bday_no", "left").select("date", F.coalesce("weight", F.lit(0.0)).alias("weight"))


NEW_YEAR_SQL = "list_sort(list_transform([" + ", ".join(f"DATE '{d}'" for d in NEW_YEARS) + "], lambda d: {'far': abs(date - d), 'day': d}))[1].day"


def blend(date: Column) -> Column:
    """The weight of the calendar form: one from 14 April to 1 December, none from 31 December to 15 March, in a line between."""
    part = lambda m, d: F.datediff(date, F.make_date(F.year(date), F.lit(m), F.lit(d))) / 30
    return F.when(F.month(date) == 12, F.greatest(1 - part(12, 1), F.lit(0.0))).otherwise(F.least(F.greatest(part(3, 15), F.lit(0.0)), F.lit(1.0)))


BLEND_SQL = "CASE WHEN month(date) = 12 THEN greatest(1 - (date - make_date(year(date), 12, 1)) / 30.0, 0) ELSE least(greatest((date - make_date(year(date), 3, 15)) / 30.0, 0), 1) END"


@dataclass(frozen=True)
class Yoy:
    """A step of a recipe: x against the same label of the year before.

    kind: cal (day or ISO week of the year), lunar (days or weeks from the nearest lunar new year), or stitched (both,
    blended by date). Of a year's label the last value counts; labels without one take the label's before in that year,
    else the one behind. Rows before the second year's same label have no value and drop out.
    """

    out: str
    x: str
    kind: str = "cal"
    group: str = "day"
    change: str = "diff"

    def _one(self, df: DataFrame, kind: str) -> DataFrame:
        if kind == "cal":
            t = df.withColumns({"yr": F.year("date"), "lab": F.dayofyear("date") if self.group == "day" else F.weekofyear("date")})
        else:
            t = lunar_labels(df).withColumns({"yr": F.col("lunar_year"), "lab": (F.col("lunar_day") if self.group == "day" else F.col("lunar_week")).cast("int")})
        t = t.select("asset", "date", F.expr(self.x).alias("v"), "yr", "lab")
        cells = t.groupBy("asset", "yr", "lab").agg(F.max_by("v", "date").alias("v"))
        grid = cells.select("asset", "yr").distinct().join(cells.select("asset", "lab").distinct(), "asset").join(cells, ["asset", "yr", "lab"], "left")
        w = Window.partitionBy("asset", "yr").orderBy("lab")
        grid = grid.withColumn("v", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        grid = grid.withColumn("v", F.first("v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
        before = F.lag("v").over(Window.partitionBy("asset", "lab").orderBy("yr"))
        value = F.col("v") - before if self.change == "diff" else F.col("v") / F.nullif(before, F.lit(0)) - 1
        start = t.groupBy("asset").agg(F.min_by(F.struct("yr", "lab"), "date").alias("first"))
        rows = t.select("asset", "date", "yr", "lab").join(grid.select("asset", "yr", "lab", value.alias(kind)), ["asset", "yr", "lab"]).join(start, "asset")
        late = (F.col("yr") > F.col("first.yr") + 1) | ((F.col("yr") == F.col("first.yr") + 1) & (F.col("lab") >= F.col("first.lab") + 1))
        return rows.where(late).select("asset", "date", kind)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.kind != "stitched":
            out = self._one(df, self.kind).withColumnRenamed(self.kind, self.out)
        else:
            w = Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
            both = self._one(df, "lunar").join(self._one(df, "cal"), ["asset", "date"], "full")
            both = both.withColumns({k: F.last(k, ignorenulls=True).over(w) for k in ("lunar", "cal")})
            part = blend(F.col("date"))
            out = both.select("asset", "date", (F.col("cal") * part + F.col("lunar") * (1 - part)).alias(self.out))
        return out.withColumn("rn", F.row_number().over(Window.partitionBy("asset").orderBy("date")) - 1)

    def _one_sql(self, prev: str, kind: str) -> str:
        labels = {
            "cal": "year(date) AS yr, " + ("dayofyear(date)" if self.group == "day" else "weekofyear(date)") + "::INT AS lab",
            "lunar": "year(ny) AS yr, " + ("(date - ny)" if self.group == "day" else "floor((date - ny) / 7.0)") + "::INT AS lab",
        }[kind]
        source = f"(SELECT asset, date, {self.x} AS v, {NEW_YEAR_SQL} AS ny FROM {prev})"
        value = "g.v - lag(g.v) OVER (PARTITION BY asset, lab ORDER BY yr)" if self.change == "diff" else "g.v / nullif(lag(g.v) OVER (PARTITION BY asset, lab ORDER BY yr), 0) - 1"
        return f"""WITH t AS (SELECT asset, date, v, {labels} FROM {source}), c AS (SELECT asset, yr, lab, arg_max(v, date) AS v FROM t GROUP BY ALL),
g0 AS (SELECT y.asset, y.yr, l.lab, c.v FROM (SELECT DISTINCT asset, yr FROM c) y JOIN (SELECT DISTINCT asset, lab FROM c) l ON y.asset = l.asset LEFT JOIN c ON c.asset = y.asset AND c.yr = y.yr AND c.lab = l.lab),
g1 AS (SELECT asset, yr, lab, last_value(v IGNORE NULLS) OVER (PARTITION BY asset, yr ORDER BY lab ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM g0),
g2 AS (SELECT asset, yr, lab, first_value(v IGNORE NULLS) OVER (PARTITION BY asset, yr ORDER BY lab ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM g1),
g AS (SELECT asset, yr, lab, {value} AS o FROM g2 g), f AS (SELECT asset, arg_min(yr, date) AS y0, arg_min(lab, date) AS l0 FROM t GROUP BY asset)
SELECT t.asset, t.date, g.o AS {kind} FROM t JOIN g USING (asset, yr, lab) JOIN f USING (asset) WHERE t.yr > y0 + 1 OR (t.yr = y0 + 1 AND t.lab >= l0 + 1)"""

    def sql(self, prev: str) -> str:
        rn = "row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS rn"
        if self.kind != "stitched":
            return f"SELECT asset, date, {self.kind} AS {self.out}, {rn} FROM ({self._one_sql(prev, self.kind)})"
        held = ", ".join(f"last_value({k} IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {k}" for k in ("lunar", "cal"))
        both = f"SELECT asset, date, {held} FROM ({self._one_sql(prev, 'lunar')}) a FULL JOIN ({self._one_sql(prev, 'cal')}) b USING (asset, date)"
        return f"SELECT asset, date, cal * ({BLEND_SQL}) + lunar * (1 - ({BLEND_SQL})) AS {self.out}, {rn} FROM ({both})"
