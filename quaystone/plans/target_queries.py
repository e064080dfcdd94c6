"""Registered query of target positions (operators/targets.py)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions.recipe import tidy, tidy_sql
from quaystone.operators import targets as tg
from quaystone.plans.research_queries import z_panel, z_sql
from quaystone.sources.store import folder

REPO = (
    ("trend", "mom_cut", "mom", "xs-rank_cutoff", 0.2, "sma", 5, 0.5, 0.1), ("trend", "mom_med", "mom", "xs-demedian", 0.0, "ema", 4, 0.3, 0.05), ("trend", "side", "side", "pos", 0.0, "sma", 1, 0.2, None),
    ("revert", "z_ts", "z", "ts", 0.0, "ema", 4, -0.6, 0.2), ("revert", "z_score", "z", "xs-score", 0.0, "sma", 3, -0.4, 0.3), ("revert", "z_rank", "z", "xs-rank", 0.0, "sma", 3, -0.2, 0.1), ("revert", "z_mean", "z", "xs-demean", 0.0, "sma", 10, -0.1, None),
)
N_DAYS, SCALER, LOT = 3, 10.0, 5.0


def targets(sp, sf):
    """Seven factors of two strategies over the last three days: signals are kept within their bands of the day before."""
    z = z_panel(sp, sf).where("vol IS NOT NULL")
    factors = z.select("asset", "date", F.col("ret").alias("mom"), F.signum("z").alias("side"), "z").unpivot(["asset", "date"], ["mom", "side", "z"], "name", "value")
    days = sorted(r[0] for r in z.select("date").distinct().orderBy(F.desc("date")).limit(N_DAYS).collect())
    repository = sp.createDataFrame(list(REPO), tg.REPOSITORY)
    risk = z.select("asset", "date", "vol", F.lit(LOT).alias("lot"))
    out = tg.daily_run(factors, risk, repository, days, folder(sp, "targets"), SCALER)
    return out.select("day", "asset", "n_strategies", *[tidy(out, c) for c in ("exact", "lots", "change")])


_REPO = ", ".join(f"('{s}', '{f}', '{n}', '{k}', {t}, '{m}', {d}, {w}::DOUBLE, {'NULL' if b is None else f'{b}::DOUBLE'})" for s, f, n, k, t, m, d, w, b in REPO)
_BUF = lambda old, new: f"CASE WHEN band IS NULL OR {old} IS NULL THEN {new} ELSE {old} + greatest({new} - {old} - band, 0) + least({new} - {old} + band, 0) END"
SQL = {
    "pos_targets_repository": f"""
WITH {z_sql()}, z AS MATERIALIZED (SELECT * FROM z0 WHERE vol IS NOT NULL), r(strategy, fact, name, kind, threshold, smooth, days, weight, band) AS (VALUES {_REPO}),
f AS (SELECT asset, date, unnest(['mom', 'side', 'z']) AS name, unnest([ret, sign(z), z]) AS x FROM z),
a AS (SELECT *, count(*) OVER d AS n, rank() OVER (PARTITION BY strategy, fact, date ORDER BY x) + (count(*) OVER (PARTITION BY strategy, fact, date, x) - 1) / 2.0 AS place, quantile_cont(x, 0.5) OVER d AS mid, avg(x) OVER d AS mean, stddev_samp(x) OVER d AS sd FROM f JOIN r USING (name) WINDOW d AS (PARTITION BY strategy, fact, date)),
b AS (SELECT *, quantile_cont(place, 0.5) OVER (PARTITION BY strategy, fact, date) AS mp, floor(n * threshold) AS k FROM a),
s AS MATERIALIZED (SELECT strategy, fact, asset, date, kind, smooth, days, weight, band, row_number() OVER (PARTITION BY strategy, fact, asset ORDER BY date) AS rn,
  (CASE kind WHEN 'xs-rank_cutoff' THEN (place > n - k)::INT - (place < k + 1)::INT WHEN 'xs-demedian' THEN x - mid WHEN 'xs-demean' THEN x - mean WHEN 'xs-score' THEN (x - mean) / nullif(sd, 0) WHEN 'xs-rank' THEN (place - mp) / n * 2 ELSE x END)::DOUBLE AS v FROM b),
m AS (SELECT p.strategy, p.fact, p.asset, p.date, any_value(p.weight) AS weight, any_value(p.band) AS band, CASE WHEN any_value(p.kind) = 'pos' THEN any_value(p.v)
  WHEN any_value(p.smooth) = 'sma' THEN CASE WHEN count(q.v) FILTER (q.rn > p.rn - p.days) >= any_value(p.days) THEN avg(q.v) FILTER (q.rn > p.rn - p.days) ELSE 0 END
  ELSE coalesce(sum(q.v * pow(1 - 1 / (1.0 + p.days), p.rn - q.rn)) / sum(pow(1 - 1 / (1.0 + p.days), p.rn - q.rn)) FILTER (q.v IS NOT NULL), 0) END AS v
  FROM s p JOIN s q ON p.strategy = q.strategy AND p.fact = q.fact AND p.asset = q.asset AND q.rn <= p.rn AND q.rn > p.rn - 400 WHERE p.date > (SELECT max(date) - 400 FROM z) GROUP BY p.strategy, p.fact, p.asset, p.date),
d AS (SELECT date AS day, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM z ORDER BY date DESC LIMIT {N_DAYS})),
l AS (SELECT strategy, fact, asset, i, day, arg_max(v, date) AS v, any_value(weight) AS weight, any_value(band) AS band FROM m JOIN d ON m.date <= d.day GROUP BY ALL),
w AS (SELECT strategy, fact, asset, any_value(weight) AS weight, any_value(band) AS band, max(v) FILTER (i = 1) AS v1, max(v) FILTER (i = 2) AS v2, max(v) FILTER (i = 3) AS v3 FROM l GROUP BY ALL),
x AS (SELECT *, v1 AS b1, {_BUF('v1', 'v2')} AS b2 FROM w), y AS (SELECT *, {_BUF('b2', 'v3')} AS b3 FROM x),
h AS (SELECT strategy, asset, i, round(sum(weight * v), 2) AS held FROM (SELECT strategy, asset, weight, unnest([1, 2, 3]) AS i, unnest([b1, b2, b3]) AS v FROM y) WHERE v IS NOT NULL GROUP BY ALL),
t AS (SELECT asset, i, sum(held) AS held, count(*) AS n_strategies FROM h GROUP BY ALL), g AS (SELECT asset, i, arg_max(vol, date) AS vol FROM z JOIN d ON z.date <= d.day GROUP BY ALL),
e AS (SELECT asset, i, n_strategies, held * {SCALER} / (nullif(vol, 0) * {LOT}) AS exact FROM t JOIN g USING (asset, i)), o AS (SELECT *, sign(exact) * floor(abs(round(exact, 6)) + 0.5) AS lots FROM e)
SELECT day, asset, n_strategies, {tidy_sql('exact')} AS exact, {tidy_sql('lots')} AS lots, {tidy_sql('lots - coalesce(lag(lots) OVER (PARTITION BY asset ORDER BY i), 0)')} AS change FROM o JOIN d USING (i)"""
}
QUERIES = {"pos_targets_repository": targets}
