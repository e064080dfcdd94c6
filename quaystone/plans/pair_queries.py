"""Registered queries of unit roots and cointegration: weekly log closes of all assets, in groups of five by number."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions.recipe import tidy, tidy_sql
from quaystone.operators import cointegration as co
from quaystone.plans.more_queries import johansen
from quaystone.sources.panels import DAILY_SQL, bars, prints


def weekly(sp, sf):
    """The last close of each week as g, asset, seq (the week's number) and x (its log)."""
    d = bars(prints(sp, sf), "asset", "date").groupBy("asset", F.date_trunc("week", "date").cast("date").alias("week")).agg(F.max_by("close", "date").alias("close"))
    group = F.floor((F.regexp_extract("asset", "([0-9]+)$", 1).cast("int") - 1) / 5)
    return d.select(group.cast("long").alias("g"), "asset", F.floor(F.datediff("week", F.lit("1970-01-05").cast("date")) / 7).alias("seq"), F.ln("close").alias("x"))


def _tidied(df, *cols):
    return df.withColumns({c: tidy(df, c) for c in cols})


def unit_roots(sp, sf):
    return _tidied(co.unit_roots(weekly(sp, sf)), "adf", *co.SURFACES[1])


def pairs(sp, sf):
    return _tidied(co.engle_granger(co.pair_moments(weekly(sp, sf))), "beta", "adf", *co.SURFACES[2])


STATS = ("trace_0", "trace_1", "largest_0")


def johansen_pairs(sp, sf):
    return _tidied(co.johansen_pairs(co.pair_moments(weekly(sp, sf))), *STATS)


WEEKLY_SQL = f"""{DAILY_SQL}, wk AS MATERIALIZED (SELECT ((regexp_extract(asset, '([0-9]+)$', 1)::INT - 1) // 5)::BIGINT AS g, asset, (date_trunc('week', date)::DATE - DATE '1970-01-05') // 7 AS seq, ln(arg_max(close, date)) AS x FROM s0 GROUP BY ALL)"""
_LAGS = "e - e1 AS d, e1 AS l, e1 - e2 AS p"


def _test_sql(rows: str, keys: str, series: int) -> str:
    """Statistic of rows (keys, d, l, p): the level is freed of the lag, then the change is regressed on what is left of it."""
    cv = ", ".join(f"{tidy_sql(f'{a} + ({b}) / n + ({c}) / n ^ 2 + ({d}) / n ^ 3')} AS {k}" for k, (a, b, c, d) in co.SURFACES[series].items())
    return f"""own AS ({rows}), free AS (SELECT *, d - regr_slope(d, p) OVER k * p AS dr, l - regr_slope(l, p) OVER k * p AS lr FROM own WINDOW k AS (PARTITION BY {keys})),
fit AS (SELECT {keys}, count(*) AS n, regr_slope(dr, lr) AS b, regr_r2(dr, lr) AS r2, var_pop(dr) AS vd, var_pop(lr) AS vl, var_pop(d) AS dd, var_pop(l) AS ll FROM free GROUP BY ALL),
tested AS (SELECT *, CASE WHEN n > 4 AND vl > 1e-12 * ll AND vd * (1 - r2) > 1e-12 * dd THEN b / sqrt(vd * (1 - r2) / (n - 3) / vl) END AS t FROM fit), cv AS (SELECT {keys}, n, {tidy_sql('t')} AS adf, {cv} FROM tested)"""


_SIDE = "SELECT g, asset, seq, x, first_value(x) OVER (w RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS x1, first_value(x) OVER (w RANGE BETWEEN 2 PRECEDING AND 2 PRECEDING) AS x2 FROM wk WINDOW w AS (PARTITION BY asset ORDER BY seq)"
_BOTH = "both_ AS MATERIALIZED (SELECT a.g, a.asset AS dep, b.asset AS indep, a.x AS ya, b.x AS xa, a.x1 AS y1, b.x1 AS x1, a.x2 AS y2, b.x2 AS x2 FROM side a JOIN side b ON a.g = b.g AND a.seq = b.seq AND a.asset <> b.asset)"
_PAIRS = f"WITH {WEEKLY_SQL}, side AS ({_SIDE}), {_BOTH}"
_RESIDUAL = "SELECT g, dep, indep, common, beta, ya - beta * xa - (y1 - beta * x1) AS d, y1 - beta * x1 AS l, (y1 - beta * x1) - (y2 - beta * x2) AS p FROM (SELECT *, regr_slope(ya, xa) OVER k AS beta, count(*) OVER k AS common FROM both_ WINDOW k AS (PARTITION BY dep, indep)) WHERE y2 + x2 + y1 + x1 IS NOT NULL"
_FREED = ", ".join(f"{v} - regr_slope({v}, p1) OVER k * p1 - regr_slope({v}, p2) OVER k * p2 AS f{v}" for v in ("u1", "u2", "v1", "v2"))
_COV = ", ".join(f"covar_pop(f{a}, f{b}) AS {a}{b}" for a, b in (("u1", "u1"), ("u1", "u2"), ("u2", "u2"), ("v1", "v1"), ("v1", "v2"), ("v2", "v2"), ("u1", "v1"), ("u1", "v2"), ("u2", "v1"), ("u2", "v2")))
QUERIES = {
    "stat_unit_roots": unit_roots, "stat_cointegrated_pairs": pairs, "stat_johansen_pairs": johansen_pairs,
    "stat_johansen_points": lambda sp, sf: co.with_points(johansen(sp, sf)),
}
SQL = {
    "stat_unit_roots": f"WITH {WEEKLY_SQL}, side AS ({_SIDE}), {_test_sql('SELECT g, asset, x - x1 AS d, x1 AS l, x1 - x2 AS p FROM side WHERE x1 + x2 IS NOT NULL', 'g, asset', 1)} SELECT *, adf < cv_1 AS stationary FROM cv",
    "stat_cointegrated_pairs": f"{_PAIRS}, {_test_sql(_RESIDUAL, 'g, dep, indep', 2)}, every AS (SELECT g, dep, indep, count(*) AS common, {tidy_sql('regr_slope(ya, xa)')} AS beta FROM both_ GROUP BY ALL) SELECT *, adf < cv_5 AS cointegrated FROM every JOIN cv USING (g, dep, indep)",
    "stat_johansen_pairs": f"""{_PAIRS}, r AS (SELECT g, dep AS a, indep AS b, ya - y1 AS u1, xa - x1 AS u2, y1 AS v1, x1 AS v2, y1 - y2 AS p1, x1 - x2 AS q FROM both_ WHERE dep < indep AND y1 + y2 + x1 + x2 IS NOT NULL),
r2 AS (SELECT *, q - regr_slope(q, p1) OVER k * p1 AS p2 FROM r WINDOW k AS (PARTITION BY a, b)), f AS (SELECT g, a, b, {_FREED} FROM r2 WINDOW k AS (PARTITION BY a, b)),
c AS (SELECT g, a, b, count(*) AS n, {_COV} FROM f GROUP BY ALL), i AS (SELECT *, u1u1 * u2u2 - u1u2 * u1u2 AS d0, v1v1 * v2v2 - v1v2 * v1v2 AS d1 FROM c WHERE n > 8),
m AS (SELECT g, a, b, n, (u2u2 * u1v1 - u1u2 * u2v1) / d0 AS a11, (u2u2 * u1v2 - u1u2 * u2v2) / d0 AS a12, (u1u1 * u2v1 - u1u2 * u1v1) / d0 AS a21, (u1u1 * u2v2 - u1u2 * u1v2) / d0 AS a22,
  (v2v2 * u1v1 - v1v2 * u1v2) / d1 AS b11, (v2v2 * u2v1 - v1v2 * u2v2) / d1 AS b12, (v1v1 * u1v2 - v1v2 * u1v1) / d1 AS b21, (v1v1 * u2v2 - v1v2 * u2v1) / d1 AS b22 FROM i),
e AS (SELECT g, a, b, n, b11 * a11 + b12 * a21 AS m11, b11 * a12 + b12 * a22 AS m12, b21 * a11 + b22 * a21 AS m21, b21 * a12 + b22 * a22 AS m22 FROM m),
q AS (SELECT g, a, b, n, (m11 + m22) / 2 AS h, sqrt(greatest((m11 + m22) ^ 2 / 4 - (m11 * m22 - m12 * m21), 0)) AS w FROM e), t AS (SELECT g, a, b, n, -n * ln(1 - h - w) AS largest_0, -n * ln(1 - greatest(h - w, 0)) AS trace_1 FROM q)
SELECT g, a, b, n, {tidy_sql('largest_0 + trace_1')} AS trace_0, {tidy_sql('trace_1')} AS trace_1, {tidy_sql('largest_0')} AS largest_0, 15.4943::DOUBLE AS trace_0_95, 3.8415::DOUBLE AS trace_1_95, 14.2639::DOUBLE AS largest_0_95,
CASE WHEN largest_0 + trace_1 <= 15.4943 THEN 0 WHEN trace_1 <= 3.8415 THEN 1 ELSE 2 END AS rank FROM t""",
}
