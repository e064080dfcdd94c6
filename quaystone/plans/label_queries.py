"""Registered queries of season statistics from states: neighbours, years taken back, shifted labels, stored states that go on."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions.recipe import tidy, tidy_sql
from quaystone.operators import label_states as ls
from quaystone.operators.seasonal import NEW_YEARS, lunar_labels
from quaystone.plans.research_queries import rets, z_sql
from quaystone.sources.panels import DAILY_SQL, daily

LUNAR = ls.Labels(-28, 27, back=2, forward=1, split=True)
WEEKS = ls.Labels(1, 53)
MONTHS = ls.Labels(1, 12, back=0, forward=2, wrap=False)
CUT = "1997-07-01"


def lunar_score(sp, sf):
    """Closes by the week around the lunar new year, over this and the two former years."""
    d = lunar_labels(daily(sp, sf).select("asset", "date", "close"))
    out = ls.scored(ls.running(d, "close", "lunar_week", "lunar_year", LUNAR, years=2, least=3))
    return out.select("asset", "date", "n", tidy(out, "score"))


def shifted_score(sp, sf):
    """The last close of the same week and its neighbours in the three years before this one, against those years."""
    monday = F.date_trunc("week", "date").cast("date")
    d = daily(sp, sf).select("asset", "date", "close", F.weekofyear("date").alias("wk"), F.year(F.date_add(monday, 3)).alias("yr"))
    out = ls.scored(ls.running(d, "close", "wk", "yr", WEEKS, year_shift=1, years=3, least=2))
    return out.select("asset", "date", "n", tidy(out, "score"))


def _months(sp, sf):
    return rets(sp, sf).select("asset", "date", "ret", F.month("date").alias("mth"), F.year("date").alias("yr"))


def shifted_months(sp, sf):
    """Running mean and deviation of returns by month, each return counted for its month and the two before it."""
    out = ls.running(_months(sp, sf), "ret", "mth", "yr", MONTHS)
    out = out.select("asset", "date", F.col("st.n").alias("n"), F.col("st.mean").alias("mean"), ls.deviation(sample=False).alias("sd"))
    return out.withColumns({c: tidy(out, c) for c in ("mean", "sd")})


def resumed_months(sp, sf):
    """States of all months up to a day, stored, and continued with the rows after it."""
    d = _months(sp, sf)
    parts = [ls.closing(d.where(F.col("date") <= F.lit(CUT).cast("date") if old else F.col("date") > F.lit(CUT).cast("date")), "ret", "mth", MONTHS) for old in (True, False)]
    out = ls.resumed(*parts).select("asset", "label", F.col("st.n").alias("n"), F.col("st.mean").alias("mean"), ls.deviation(sample=False).alias("sd"))
    return out.withColumns({c: tidy(out, c) for c in ("mean", "sd")})


_RETS = f"WITH {z_sql()}, r AS MATERIALIZED (SELECT asset, date, ret, month(date) AS mth FROM z0 WHERE ret IS NOT NULL)"
_DAYS = ", ".join(f"(DATE '{d}')" for d in NEW_YEARS)
_NEAR = "SELECT date, arg_min(day, abs(date - day) * 100000 + year(day)) AS day FROM (SELECT DISTINCT date FROM s0) CROSS JOIN ny GROUP BY date"
QUERIES = {"season_lunar_states": lunar_score, "season_shifted_years": shifted_score, "season_shifted_months": shifted_months, "season_resumed_states": resumed_months}
SQL = {
    "season_lunar_states": f"""WITH {DAILY_SQL}, ny(day) AS (VALUES {_DAYS}), nd AS ({_NEAR}),
t AS MATERIALIZED (SELECT asset, date, close, year(day) AS yr, floor((date - day) / 7.0)::INT AS wk FROM s0 JOIN nd USING (date)),
g AS (SELECT a.asset, a.date, any_value(a.close) AS close, count(q.close) AS n, avg(q.close) AS m, stddev_samp(q.close) AS sd FROM t a JOIN t q ON q.asset = a.asset AND q.date <= a.date AND q.yr >= a.yr - 2
  AND (a.wk >= 0) = (q.wk >= 0) AND ((q.wk BETWEEN a.wk - 2 AND a.wk + 1) OR (q.wk BETWEEN a.wk - 2 + 56 AND a.wk + 1 + 56) OR (q.wk BETWEEN a.wk - 2 - 56 AND a.wk + 1 - 56)) GROUP BY a.asset, a.date)
SELECT asset, date, CASE WHEN n >= 3 THEN n END AS n, {tidy_sql('CASE WHEN n >= 3 THEN (close - m) / nullif(sd, 0) END')} AS score FROM g""",
    "season_shifted_years": f"""WITH {DAILY_SQL}, t AS MATERIALIZED (SELECT asset, date, close, week(date) AS wk, isoyear(date) AS yr FROM s0),
g AS (SELECT a.asset, a.date, count(q.close) AS n, avg(q.close) AS m, stddev_samp(q.close) AS sd, arg_max(q.close, q.date) AS last FROM t a LEFT JOIN t q ON q.asset = a.asset AND q.yr BETWEEN a.yr - 3 AND a.yr - 1 AND (abs(q.wk - a.wk) <= 1 OR abs(q.wk - a.wk) = 52) GROUP BY a.asset, a.date)
SELECT asset, date, CASE WHEN n >= 2 THEN n END AS n, {tidy_sql('CASE WHEN n >= 2 THEN (last - m) / nullif(sd, 0) END')} AS score FROM g""",
    "season_shifted_months": f"{_RETS} SELECT a.asset, a.date, count(q.ret) AS n, {tidy_sql('avg(q.ret)')} AS mean, {tidy_sql('stddev_pop(q.ret)')} AS sd FROM r a JOIN r q ON q.asset = a.asset AND q.date <= a.date AND q.mth BETWEEN a.mth AND a.mth + 2 GROUP BY a.asset, a.date",
    "season_resumed_states": f"{_RETS} SELECT asset, label, count(ret) AS n, {tidy_sql('avg(ret)')} AS mean, {tidy_sql('stddev_pop(ret)')} AS sd FROM (SELECT asset, ret, unnest([m::BIGINT FOR m IN [mth - 2, mth - 1, mth] IF m >= 1]) AS label FROM r) GROUP BY asset, label",
}
