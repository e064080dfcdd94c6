"""Registered queries of machines that run in blocks (functions/segments.py)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaystone.functions import segments as sg
from quaystone.functions.recipe import Ewm, Recipe, lag, s, span, tidy, tidy_sql
from quaystone.operators.indicators import ribbon
from quaystone.plans.research_queries import z_panel
from quaystone.sources.panels import DAILY_SQL, daily

#: A year of days is a block.
YEAR, DAYS = "year(date)", 366
#: Means of a ribbon, and the correlation and p-value (per cent) at which a side is taken and left.
RIBBONS = {"ribbon": ((5, 10, 20, 40), 0.0, 0.0, 50.0, 50.0), "system": ((10, 20, 60), 60.0, 20.0, 40.0, 60.0)}
LAYER_MEANS, LAYER_LEVEL = (5, 10), 50.0


def held(machine, name="pos"):
    def run(sp, sf):
        panel = z_panel(sp, sf)
        out = sg.scan(panel, {name: machine()}, F.expr(YEAR), longest=DAYS)
        return out.select("asset", "date", tidy(out, name))

    return run


def sides(entry: float, leave: float, p_entry: float, p_leave: float) -> dict[str, str]:
    """Events of a ribbon: what the long and the short side are set to; what comes last in a rule counts."""
    out = lambda sign: f"{sign}corr < {leave} OR p_value > {p_leave}"
    return {"long": f"CASE WHEN {out('')} THEN 0.0 WHEN corr >= {entry} AND p_value < {p_entry} THEN 1.0 END", "short": f"CASE WHEN {out('-')} THEN 0.0 WHEN -corr >= {entry} AND p_value < {p_entry} THEN -1.0 END"}


def ribbon_steps(spans, *levels) -> list:
    events = sides(*levels)
    return [*ribbon(spans).steps, {"up": s(events["long"]), "down": s(events["short"])}]


def traded(df, side):
    """The position of the day before, flat at the end, with the cost of its changes at the open."""
    w = Window.partitionBy("asset").orderBy("date")
    df = df.withColumn("pos", F.when(F.lead("date").over(w).isNull(), 0.0).otherwise(F.coalesce(F.lag(side).over(w), F.lit(0.0))))
    df = df.withColumn("change", F.coalesce(F.col("pos") - F.lag("pos").over(w), F.lit(0.0)))
    return df.withColumn("cost", F.abs("change") * F.col("open") * 2e-4)


def ribbons(sp, sf):
    out = None
    for name, (spans, *levels) in RIBBONS.items():
        panel = Recipe(ribbon_steps(spans, *levels)).apply(daily(sp, sf)).select("asset", "date", "open", "up", "down")
        both = sg.scan(panel, {"long": sg.set_or_keep(F.col("up"), 0.0), "short": sg.set_or_keep(F.col("down"), 0.0)}, F.expr(YEAR), longest=DAYS)
        one = traded(both.withColumn("side", F.col("long") + F.col("short")), "side").select(F.lit(name).alias("strategy"), "asset", "date", "pos", "cost")
        out = one if out is None else out.union(one)
    return out.select("strategy", "asset", "date", tidy(out, "pos"), tidy(out, "cost"))


_RIBBON_SQL = lambda name, spans, levels: f"""SELECT '{name}' AS strategy, asset, date, {tidy_sql('pos')} AS pos, {tidy_sql('abs(coalesce(pos - lag(pos) OVER w, 0)) * open * 2e-4')} AS cost FROM (
SELECT asset, date, open, CASE WHEN lead(date) OVER w IS NULL THEN 0.0 ELSE coalesce(lag(side) OVER w, 0.0) END AS pos FROM (
SELECT asset, date, open, coalesce(last_value(up IGNORE NULLS) OVER f, 0) + coalesce(last_value(down IGNORE NULLS) OVER f, 0) AS side FROM ({Recipe(ribbon_steps(spans, *levels), ("open", "up", "down")).oracle(DAILY_SQL)})
WINDOW f AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY asset ORDER BY date)) WINDOW w AS (PARTITION BY asset ORDER BY date)"""  # noqa: E731

#: Weekly bars filter, daily means trade: the ribbon of weekly closes of the last completed week, and two means of the day before.
WEEK = "date_trunc('week', date)"
_LAYER = [Ewm(f"e{n}", "close", span(n)) for n in LAYER_MEANS] + [{f"m{n}": lag(f"e{n}") for n in LAYER_MEANS}]


def layers(sp, sf):
    """Long while the week's ribbon points up and the short mean is above the long one, until it isn't; short likewise. A week's ribbon counts from the next week on."""
    panel = Recipe(_LAYER).apply(daily(sp, sf)).withColumn("week", F.expr(f"cast({WEEK} AS date)"))
    weekly = panel.groupBy("asset", "week").agg(F.max_by("close", "date").alias("close"))
    w = Window.partitionBy("asset").orderBy("week")
    weekly = weekly.select("asset", F.col("week").alias("date"), "close", (F.row_number().over(w) - 1).alias("rn"))
    filtered = ribbon().apply(weekly).withColumn("way", F.expr(f"CASE WHEN corr > {LAYER_LEVEL} THEN 1 WHEN corr < -{LAYER_LEVEL} THEN -1 ELSE 0 END"))
    filtered = filtered.select("asset", F.col("date").alias("week"), F.lag("way").over(Window.partitionBy("asset").orderBy("date")).alias("way"))
    short, slow = (f"m{n}" for n in LAYER_MEANS)
    met = panel.join(filtered, ["asset", "week"])
    up = F.expr(f"CASE WHEN {short} <= {slow} THEN 0.0 WHEN way > 0 AND {short} > {slow} THEN 1.0 END")
    down = F.expr(f"CASE WHEN {short} > {slow} THEN 0.0 WHEN way < 0 AND {short} <= {slow} THEN -1.0 END")
    both = sg.scan(met, {"long": sg.set_or_keep(up, 0.0), "short": sg.set_or_keep(down, 0.0)}, F.expr(YEAR), longest=DAYS)
    out = both.withColumn("pos", F.col("long") + F.col("short"))
    return out.select("asset", "date", F.coalesce("way", F.lit(0)).alias("way"), tidy(out, "pos"))


_LAYERED = Recipe(_LAYER, ("close", *[f"m{n}" for n in LAYER_MEANS])).oracle(DAILY_SQL)
_WEEKLY = f"""{DAILY_SQL.replace('s0 AS MATERIALIZED', 'sd AS MATERIALIZED')}, s0 AS MATERIALIZED (SELECT asset, w AS date, arg_max(close, date) AS close, row_number() OVER (PARTITION BY asset ORDER BY w) - 1 AS rn FROM (SELECT *, {WEEK}::DATE AS w FROM sd) GROUP BY asset, w)"""
_S, _L = (f"m{n}" for n in LAYER_MEANS)
QUERIES = {
    "sig_hysteresis": held(lambda: sg.hysteresis("z", 1.0, 0.5, "rn = 0")), "sig_buffer": held(lambda: sg.clamp(F.col("z") - F.col("gap"), F.col("z") + F.col("gap"))),
    "sig_ribbons": ribbons, "sig_layers": layers,
}
SQL = {
    "sig_ribbons": " UNION ALL ".join(_RIBBON_SQL(n, spans, levels) for n, (spans, *levels) in RIBBONS.items()),
    "sig_layers": f"""WITH d AS ({_LAYERED}), k AS ({ribbon().oracle(_WEEKLY)}), x AS (SELECT asset, date AS week, lag(CASE WHEN corr > {LAYER_LEVEL} THEN 1 WHEN corr < -{LAYER_LEVEL} THEN -1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY date) AS way FROM k),
e AS (SELECT asset, date, way, CASE WHEN {_S} <= {_L} THEN 0 WHEN way > 0 AND {_S} > {_L} THEN 1 END AS up, CASE WHEN {_S} > {_L} THEN 0 WHEN way < 0 AND {_S} <= {_L} THEN -1 END AS down FROM (SELECT *, {WEEK}::DATE AS week FROM d) JOIN x USING (asset, week))
SELECT asset, date, coalesce(way, 0) AS way, {tidy_sql('coalesce(last_value(up IGNORE NULLS) OVER f, 0) + coalesce(last_value(down IGNORE NULLS) OVER f, 0)')} AS pos FROM e WINDOW f AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)""",
}
