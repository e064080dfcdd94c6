"""Registered queries of session masks, Poisson resampling and tables with totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions.recipe import tidy, tidy_sql
from quaystone.operators import resample as rp
from quaystone.operators.sessions import with_session
from quaystone.plans.research_queries import rets, z_sql
from quaystone.sources.panels import TICKS_SQL, read, ticks

#: kind, first and last day, minutes (the end exclusive; not after the start: across midnight), and whether they open or close.
HOURS = (
    ("click", "2024-01-01", "2024-12-31", 540, 690, True), ("click", "2024-01-01", "2024-12-31", 810, 900, True), ("click", "2024-01-10", "2024-01-20", 1260, 150, True), ("click", "2024-01-15", "2024-01-15", 540, 600, False),
    ("view", "2024-01-01", "2024-01-14", 1260, 60, True), ("view", "2024-01-08", "2024-12-31", 540, 900, True), ("view", "2024-01-12", "2024-01-13", 0, 1440, False), ("purchase", "2024-01-05", "2024-01-25", 0, 1440, True), ("purchase", "2024-01-09", "2024-01-09", 1200, 200, False),
)
BUFFER, DRAWS = 3, 50


def hours(sp):
    rows = [(k, a, b, s, e, o) for k, a, b, s, e, o in HOURS]
    return sp.createDataFrame(rows, "kind string, a string, b string, start_minute int, end_minute int, open boolean").select("kind", F.to_date("a").alias("from_date"), F.to_date("b").alias("to_date"), "start_minute", "end_minute", "open")


def session_masks(sp, sf):
    t = ticks(sp, sf).select("event_id", "event_type", "date", "minute")
    exact = with_session(t, hours(sp), "event_type").withColumnRenamed("in_session", "exact")
    return with_session(exact, hours(sp), "event_type", buffer=BUFFER).select("event_id", "exact", F.col("in_session").alias("near"))


def tabled(sp, sf):
    lines = read(sp, sf, "lineitem").join(read(sp, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = rp.pivot_with_totals(lines, ["p_brand", "p_type"], ["l_returnflag", "l_linestatus"], "l_quantity")
    return out.select("p_brand", "p_type", *[F.round(F.col(f"`{c}`").cast("double"), 6).alias(c.replace("|", "_")) for c in out.columns[2:]])


def moments(out, *keys):
    return out.select(*keys, "n", *[tidy(out, c) for c in ("mean", "sd", "skew", "sharpe")])


_U = lambda *k: "('0x' || substr(md5(concat_ws('|', " + ", ".join(f"{x}::VARCHAR" for x in k) + ")), 1, 8))::BIGINT"
_W = lambda *k: " + ".join(f"({_U(*k)} >= {p})::INT" for p in rp.POISSON)
_M2 = "greatest(s2 / n - pow(s1 / n, 2), 0)"
_MOMENTS = {"mean": "s1 / nullif(n, 0)", "sd": f"sqrt({_M2} * n / nullif(n - 1, 0))", "skew": f"(s3 / n - 3 * (s1 / n) * s2 / n + 2 * pow(s1 / n, 3)) / nullif(pow({_M2}, 1.5), 0)", "sharpe": f"s1 / nullif(n, 0) / nullif(sqrt({_M2} * n / nullif(n - 1, 0)), 0) * sqrt({rp.YEAR})"}
_PICKS = ", ".join(f"{tidy_sql(v)} AS {k}" for k, v in _MOMENTS.items())
_INSIDE = lambda m: f"CASE WHEN e > s THEN {m} >= s AND {m} < e ELSE {m} >= s OR {m} < e END"
_KEYS = [f"{a}_{b}" for a in "ANR" for b in "FO"]
_CELLS = ", ".join(f"round(coalesce(sum(l_quantity) FILTER (l_returnflag || '_' || l_linestatus = '{k}'), 0), 6) AS \"{k}\"" for k in _KEYS)
_HOURS_SQL = "h(kind, a, b, s, e, o) AS (VALUES " + ", ".join(f"('{k}', DATE '{a}', DATE '{b}', {s}, {e}, {o})" for k, a, b, s, e, o in HOURS) + ")"
_OPEN = lambda m: f"EXISTS (SELECT 1 FROM h WHERE kind = event_type AND date BETWEEN a AND b AND o AND {_INSIDE(m)}) AND NOT EXISTS (SELECT 1 FROM h WHERE kind = event_type AND date BETWEEN a AND b AND NOT o AND {_INSIDE(m)})"
_RETS = f"WITH {z_sql()}, r AS (SELECT asset, date, ret FROM z0 WHERE ret IS NOT NULL)"
QUERIES = {
    "clean_session_masks": session_masks, "agg_pivot_totals": tabled,
    "stat_bootstrap": lambda sp, sf: moments(rp.bootstrap(rets(sp, sf), DRAWS), "asset", "draw"), "stat_bootstrap_assets": lambda sp, sf: moments(rp.bootstrap_assets(rets(sp, sf), DRAWS), "draw"),
}
SQL = {
    "clean_session_masks": f"WITH {TICKS_SQL}, {_HOURS_SQL} SELECT event_id, {_OPEN('minute')} AS exact, " + " OR ".join(f"({_OPEN(f'((minute + {j} + 1440) % 1440)')})" for j in range(-BUFFER, BUFFER + 1)) + " AS near FROM ticks",
    "agg_pivot_totals": f"SELECT coalesce(p_brand, 'Total') AS p_brand, coalesce(p_type, 'Total') AS p_type, {_CELLS}, round(sum(l_quantity), 6) AS \"Total\" FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY GROUPING SETS ((p_brand, p_type), ())",
    "stat_bootstrap": f"{_RETS}, d AS (SELECT asset, draw, ret, {_W('asset', 'date', 'draw')} AS w FROM r, range(1, {DRAWS} + 1) q(draw)), a AS (SELECT asset, draw::INT AS draw, sum(w)::BIGINT AS n, sum(w * ret) AS s1, sum(w * ret * ret) AS s2, sum(w * ret * ret * ret) AS s3 FROM d GROUP BY ALL) SELECT asset, draw, n, {_PICKS} FROM a",
    "stat_bootstrap_assets": f"{_RETS}, t AS (SELECT asset, count(*) AS c, sum(ret) AS t1, sum(ret * ret) AS t2, sum(ret * ret * ret) AS t3 FROM r GROUP BY asset), d AS (SELECT draw, c, t1, t2, t3, {_W('asset', 'draw')} AS w FROM t, range(1, {DRAWS} + 1) q(draw)), a AS (SELECT draw::INT AS draw, sum(w * c)::BIGINT AS n, sum(w * t1) AS s1, sum(w * t2) AS s2, sum(w * t3) AS s3 FROM d GROUP BY draw) SELECT draw, n, {_PICKS} FROM a",
}
