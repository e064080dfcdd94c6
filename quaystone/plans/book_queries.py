"""Registered queries of books of holdings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaystone.functions.recipe import tidy, tidy_sql
from quaystone.operators import books as bk
from quaystone.plans.market_queries import CHAIN_SQL, chained
from quaystone.plans.research_queries import HOLD_SQL, z_panel, z_sql
from quaystone.sources import store
from quaystone.sources.panels import read


def _t(df, *cols):
    return df.withColumns({c: tidy(df, c) for c in cols})


def _ts(*cols):
    return ", ".join(f"{tidy_sql(c)} AS {c}" for c in cols)


def book(sp, sf):
    """Holdings of the signal, and of an index that holds every asset at the same risk."""
    return z_panel(sp, sf).select("asset", "date", "ret", (F.col("z") / F.col("vol") * 0.01).alias("holding"), (F.lit(0.01) / F.col("vol")).alias("index_holding"))


TILT = ("tilt", "timing", "whole_tilt", "whole_timing")


def tilt(sp, sf):
    return _t(bk.tilt_timing(book(sp, sf).select("asset", "date", "holding"), 60), *TILT).drop("holding")


def scaled(sp, sf):
    return _t(bk.vol_scaled(book(sp, sf)).select("asset", "date", "scaled"), "scaled")


def hedged(portfolio: bool):
    def run(sp, sf):
        out = bk.beta_hedged(book(sp, sf), portfolio, win=60)
        return _t(out.select("asset", "date", "beta", "neutral", "hedged"), "beta", "neutral", "hedged")

    return run


def _trades(sp, sf):
    return z_panel(sp, sf).select("asset", "date", F.signum("z").alias("pos"), F.col("open").alias("trade_px"), "close")


def traded(sp, sf):
    return _t(bk.traded_returns(_trades(sp, sf).withColumn("cost", F.lit(0.0005))).select("asset", "date", "pnl"), "pnl")


BUNDLE = ("mean", "sd", "total", "cost", "margin", "sharpe", "max_dd", "profit_dd")


def bundle(sp, sf):
    """A simulation's days with cost and margin, over its last 3, 12 and 36 months."""
    t = _trades(sp, sf)
    change = F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(bk.by_date()), F.lit(0.0)))
    out = bk.tenor_bundle(bk.simulated(t.withColumn("cost", change * F.col("trade_px") * 0.0005), (0.1, 0.12)), [3, 12, 36])
    return _t(out.select("tenor", "days", *BUNDLE), *BUNDLE)


FIT = ("b0", "b1", "b2", "t1", "t2", "r2", "resid_sd", "z_last")


def fitted(sp, sf):
    return _t(bk.residuals(z_panel(sp, sf), "ret", "z", "vol"), *FIT)


def saved_runs(sp, sf):
    """P&L of two saved runs, read back and added up by asset, month and quarter."""
    path = store.folder(sp, "runs")
    t = _trades(sp, sf).withColumn("cost", F.lit(0.0005))
    runs = t.withColumn("run", F.explode(F.array(F.lit("full"), F.lit("half")))).withColumn("k", F.when(F.col("run") == "full", 1.0).otherwise(0.5))
    runs = runs.withColumn("asset", F.concat("run", F.lit("|"), "asset"))  # a run's assets are histories of their own
    out = bk.traded_returns(runs.withColumn("pos", F.col("pos") * F.col("k"))).select("run", F.substring_index("asset", "|", -1).alias("asset"), "date", "pnl")
    out.write.partitionBy("run").parquet(path)
    back = sp.read.parquet(path).withColumn("p", F.explode(F.array(F.lit("month"), F.lit("quarter"))))
    start = F.when(F.col("p") == "month", F.trunc("date", "month")).otherwise(F.trunc("date", "quarter"))
    return _t(back.groupBy("run", "asset", F.col("p").alias("period"), start.alias("start")).agg(F.sum("pnl").alias("total"), F.count("*").alias("days")), "total")


def sheet(sp, sf):
    """Order prices by day as a sheet with a column per priority, long again with names and units, zeros and days over 1,000 before the last left out."""
    o = read(sp, sf, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderpriority", F.floor(F.col("o_totalprice") / 50000).cast("double").alias("v"))
    keys = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = o.groupBy("date").pivot("o_orderpriority", keys).agg(F.min("v"))
    header = read(sp, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.concat(F.lit("X"), F.substring(F.max("o_orderpriority"), 1, 1)).alias("index_code")).withColumn("unit", F.lit("50k"))
    return bk.sheet_rows(wide, header, look_back=1000)


def changes(sp, sf):
    return _t(bk.contract_changes(chained(sp, sf).select("asset", "date", "contract", "close")).select("asset", "date", "contract", "diff", "pct", "log_ret"), "diff", "pct", "log_ret")


_BOOK = f"WITH {z_sql()}, bk AS MATERIALIZED (SELECT asset, date, ret, z / vol * 0.01 AS holding, 0.01 / vol AS ih FROM z0)"
_HELD = """hd AS (SELECT asset, date, ret, last_value(holding IGNORE NULLS) OVER w AS holding, last_value(ih IGNORE NULLS) OVER w AS ih FROM bk WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)),
pn AS MATERIALIZED (SELECT * FROM (SELECT *, coalesce(lag(holding) OVER w, 0) * ret AS pnl, coalesce(lag(ih) OVER w, 0) * ret AS ipnl FROM hd WINDOW w AS (PARTITION BY asset ORDER BY date)) WHERE ret IS NOT NULL)"""


def _beta_sql(source: str, part: str) -> str:
    w = f"{part} ORDER BY date ROWS BETWEEN"
    return f"""m AS (SELECT *, CASE WHEN count(*) OVER f = 5 THEN avg(pnl) OVER f END AS a, CASE WHEN count(*) OVER f = 5 THEN avg(ipnl) OVER f END AS b FROM {source} WINDOW f AS ({w} 4 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, CASE WHEN count(a) OVER g = 60 AND var_pop(b) OVER g > 0 THEN least(greatest((avg(a * b) OVER g - avg(a) OVER g * avg(b) OVER g) / nullif(var_pop(b) OVER g, 0), 0), 100000) END AS raw FROM m WINDOW g AS ({w} 59 PRECEDING AND CURRENT ROW)),
bt AS (SELECT *, last_value(raw IGNORE NULLS) OVER ({w} UNBOUNDED PRECEDING AND CURRENT ROW) AS beta FROM r)"""


_OUT = f"{tidy_sql('beta')} AS beta, {tidy_sql('holding - ih * beta')} AS neutral, {tidy_sql('pnl - ipnl * beta')} AS hedged"
_POS = "p AS (SELECT asset, date, sign(z) AS pos, open, close, coalesce(lag(sign(z)) OVER w, 0) AS held, lag(sign(z)) OVER w AS old, lag(close) OVER w AS pc1 FROM z0 WINDOW w AS (PARTITION BY asset ORDER BY date))"
_PNL = "held * coalesce(close / pc1 - 1, 0) + (pos - held) * (close / open - 1) - abs(pos - held) * 0.0005"
QUERIES = {
    "pnl_holding_tilt": tilt, "pnl_vol_scaled": scaled, "ts_beta_hedged_assets": hedged(False), "ts_beta_hedged_portfolio": hedged(True), "pnl_traded_returns": traded,
    "pnl_simulation_bundle": bundle, "stat_residuals": fitted, "pnl_saved_runs": saved_runs, "join_sheet_rows": sheet, "ts_contract_changes": changes,
}
SQL = {
    "pnl_holding_tilt": f"WITH {HOLD_SQL}, t AS (SELECT asset, date, holding, avg(holding) OVER (PARTITION BY asset ORDER BY date ROWS 59 PRECEDING) AS tilt, avg(holding) OVER (PARTITION BY asset) AS whole_tilt FROM hl) SELECT asset, date, {_ts('tilt', 'whole_tilt')}, {tidy_sql('holding - tilt')} AS timing, {tidy_sql('holding - whole_tilt')} AS whole_timing FROM t",
    "pnl_vol_scaled": f"{_BOOK} SELECT asset, date, {tidy_sql('holding / nullif(stddev_samp(ret) OVER (PARTITION BY asset ORDER BY date ROWS 251 PRECEDING), 0)')} AS scaled FROM bk",
    "ts_beta_hedged_assets": f"{_BOOK}, {_HELD}, {_beta_sql('pn', 'PARTITION BY asset')} SELECT asset, date, {_OUT} FROM bt",
    "ts_beta_hedged_portfolio": f"{_BOOK}, {_HELD}, dy AS (SELECT date, sum(pnl) AS pnl, sum(ipnl) AS ipnl FROM pn GROUP BY date), {_beta_sql('dy', '')} SELECT asset, date, {_OUT} FROM pn JOIN (SELECT date, beta FROM bt) USING (date)",
    "pnl_traded_returns": f"WITH {z_sql()}, {_POS} SELECT asset, date, {tidy_sql(_PNL)} AS pnl FROM p",
    "pnl_simulation_bundle": f"""WITH {z_sql()}, {_POS}, d AS (SELECT date, sum(pos * (close - open) + coalesce(old * (open - pc1), 0) - abs(pos - held) * open * 0.0005) AS pnl, sum(abs(pos - held) * open * 0.0005) AS cost, sum(greatest(pos * close * 0.1, -pos * close * 0.12)) AS margin FROM p GROUP BY date),
t AS (SELECT * FROM d, (VALUES (3), (12), (36)) q(tenor) WHERE date >= (SELECT max(date) FROM d) - to_months(tenor)), c AS (SELECT *, sum(pnl) OVER w AS cum FROM t WINDOW w AS (PARTITION BY tenor ORDER BY date)), x AS (SELECT *, cum - greatest(max(cum) OVER (PARTITION BY tenor ORDER BY date), 0) AS dd FROM c),
a AS (SELECT tenor, count(*) AS days, avg(pnl) AS mean, stddev_samp(pnl) AS sd, sum(pnl) AS total, sum(cost) AS cost, max(margin) AS margin, min(dd) AS max_dd FROM x GROUP BY tenor)
SELECT tenor, days, {_ts('mean', 'sd', 'total', 'cost', 'margin', 'max_dd')}, {tidy_sql('mean / nullif(sd, 0) * sqrt(244)')} AS sharpe, {tidy_sql('coalesce(total / nullif(abs(max_dd), 0), 0)')} AS profit_dd FROM a""",
    "stat_residuals": f"""WITH {z_sql()}, x AS (SELECT asset, date, ret AS y, z AS a, vol AS b FROM z0 WHERE ret + z + vol IS NOT NULL), s AS (SELECT *, b - regr_slope(b, a) OVER k * a AS b_a, a - regr_slope(a, b) OVER k * b AS a_b FROM x WINDOW k AS (PARTITION BY asset)),
g AS (SELECT asset, count(*) AS n, regr_slope(y, a_b) AS b1, regr_slope(y, b_a) AS b2, var_pop(a_b) AS v1, var_pop(b_a) AS v2, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM s GROUP BY asset),
e AS (SELECT asset, date, n, b1, b2, v1, v2, my - b1 * ma - b2 * mb AS b0, y, y - (my - b1 * ma - b2 * mb) - b1 * a - b2 * b AS e FROM x JOIN g USING (asset)),
f AS (SELECT asset, any_value(n) AS n, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, any_value(v1) AS v1, any_value(v2) AS v2, 1 - sum(e * e) / nullif(var_pop(y) * count(*), 0) AS r2, sqrt(sum(e * e) / (count(*) - 3)) AS resid_sd, arg_max(e, date) AS last FROM e GROUP BY asset)
SELECT asset, n, {_ts('b0', 'b1', 'b2', 'r2', 'resid_sd')}, {tidy_sql('b1 / (resid_sd / sqrt(n * v1))')} AS t1, {tidy_sql('b2 / (resid_sd / sqrt(n * v2))')} AS t2, {tidy_sql('last / resid_sd')} AS z_last FROM f""",
    "pnl_saved_runs": f"WITH {z_sql()}, {_POS}, q AS (SELECT run, asset, date, ({_PNL}) * k AS pnl, period FROM p, (VALUES ('full', 1.0::DOUBLE), ('half', 0.5::DOUBLE)) r(run, k), (VALUES ('month'), ('quarter')) d(period)) SELECT run, asset, period, date_trunc(period, date)::DATE AS start, {tidy_sql('sum(pnl)')} AS total, count(*) AS days FROM q GROUP BY run, asset, period, date_trunc(period, date)",
    "join_sheet_rows": "WITH o AS (SELECT o_orderdate::DATE AS date, o_orderpriority AS name, min(floor(o_totalprice / 50000))::DOUBLE AS value FROM orders GROUP BY ALL) SELECT name, date, value, 'X' || substr(name, 1, 1) AS index_code, '50k' AS unit FROM o WHERE value <> 0 AND (SELECT max(date) FROM o) - date <= 1000",
    "ts_contract_changes": f"WITH {CHAIN_SQL}, l AS (SELECT asset, date, contract, close, lag(contract) OVER w AS c0, lag(close) OVER w AS p0 FROM ch WINDOW w AS (PARTITION BY asset ORDER BY date)) SELECT asset, date, contract, "
    + ", ".join(f"{tidy_sql(f'CASE WHEN c0 <> contract THEN 0 ELSE {v} END')} AS {k}" for k, v in (("diff", "close - p0"), ("pct", "close / nullif(p0, 0) - 1"), ("log_ret", "ln(close / nullif(p0, 0))"))) + " FROM l",
}
