"""Registered queries of signals across assets and flows inside a day."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions.recipe import tidy, tidy_sql
from quaystone.operators import crowd as cr
from quaystone.plans.research_queries import z_panel, z_sql
from quaystone.sources.panels import ORDER, PRINTS_SQL, prints

HALF_LIFE = 10


def _t(df, *cols):
    return df.withColumns({c: tidy(df, c) for c in cols})


def _ts(*cols):
    return ", ".join(f"{tidy_sql(c)} AS {c}" for c in cols)


def scores(sp, sf):
    p = z_panel(sp, sf).where("vol IS NOT NULL").select("asset", "date", "z")
    return _t(cr.smoothed_scores(p, "z", HALF_LIFE).select("asset", "date", "score"), "score")


#: In each five brands by number the first leads the third and fourth by its signal, at once and four rows later, the second all the others by the sign of its return, a row later.
TABLE = [(f"Brand#{5 * g + a}", f"Brand#{5 * g + b}", m, k) for g in range(5) for a, b, m, k in ((1, 3, "z", 0), (1, 3, "z", 4), (1, 4, "z", 4), (2, 1, "side", 1), (2, 3, "side", 1), (2, 4, "side", 1), (2, 5, "side", 1))]


def led(sp, sf):
    p = z_panel(sp, sf).select("asset", "date", "z", "ret")
    return _t(cr.leader_signals(p, {"z": F.col("z"), "side": F.signum("ret")}, TABLE), "signal")


FLOWS = ("mean", "sd", "money_flow", "oi_flow", "twap_1", "twap_2")


def flows(sp, sf):
    """Flows of each day's prints in order of their keys, line numbers standing for open interest; the halves are those of suppliers of even and odd number."""
    p = prints(sp, sf).withColumn("oi", F.col("l_linenumber").cast("double"))
    return _t(cr.day_flows(p, ORDER, "l_suppkey % 2 = 0"), *FLOWS)


_DECAY = f"pow(0.5::DOUBLE, 1.0 / {HALF_LIFE})"
QUERIES = {"xs_smoothed_scores": scores, "xs_leader_table": led, "bars_day_flows": flows}
SQL = {
    "xs_smoothed_scores": f"""WITH RECURSIVE {z_sql()}, p AS (SELECT asset, date, z - avg(z) OVER (PARTITION BY date) AS d FROM z0 WHERE vol IS NOT NULL), s AS MATERIALIZED (SELECT date, stddev_samp(d) AS sd, row_number() OVER (ORDER BY date) AS i FROM p GROUP BY date),
e(i, num, den) AS (SELECT 1::BIGINT, coalesce(sd, 0), (sd IS NOT NULL)::INT::DOUBLE FROM s WHERE i = 1 UNION ALL SELECT s.i, e.num * {_DECAY} + coalesce(s.sd, 0), e.den * {_DECAY} + (s.sd IS NOT NULL)::INT FROM e JOIN s ON s.i = e.i + 1),
v AS (SELECT date, CASE WHEN den > 0 THEN num / den END AS sm, i FROM e JOIN s USING (i)), f AS (SELECT date, coalesce(sm, first_value(sm IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sm FROM v)
SELECT asset, date, {tidy_sql('d / nullif(sm, 0)')} AS score FROM p JOIN f USING (date)""",
    "xs_leader_table": f"""WITH {z_sql()}, q(leader, follower, method, k) AS (VALUES {", ".join(str(t) for t in TABLE)}), l AS (SELECT asset, date, z, lag(z, 4) OVER w AS z4, lag(sign(ret)) OVER w AS s1 FROM z0 WINDOW w AS (PARTITION BY asset ORDER BY date)),
v AS (SELECT follower AS asset, date, CASE WHEN method = 'side' THEN s1 WHEN k = 0 THEN z ELSE z4 END AS v FROM l JOIN q ON asset = leader) SELECT asset, date, {tidy_sql('avg(v)')} AS signal, count(v) AS leaders FROM v WHERE v IS NOT NULL GROUP BY asset, date""",
    "bars_day_flows": f"""WITH {PRINTS_SQL}, d AS (SELECT *, price - lag(price) OVER w AS d, (l_linenumber - lag(l_linenumber) OVER w)::DOUBLE AS doi FROM prints WINDOW w AS (PARTITION BY asset, date ORDER BY {", ".join(ORDER)})),
g AS (SELECT asset, date, count(d) AS n, avg(d) AS mean, stddev_pop(d) AS sd, sum(sign(d) * price * volume) AS money_flow, sum(sign(d) * doi) AS oi_flow, avg(price) FILTER (l_suppkey % 2 = 0) AS twap_1, avg(price) FILTER (l_suppkey % 2 = 1) AS twap_2 FROM d GROUP BY ALL) SELECT asset, date, n, {_ts(*FLOWS)} FROM g""",
}
