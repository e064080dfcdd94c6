"""Registered queries of checks, reports and small models: codes, grades, publication dates, broker tables, conditional results, lagged results, ratios."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaystone.functions.recipe import Recipe, fill, lag, roll, s, tidy_sql
from quaystone.operators import contracts as ct
from quaystone.operators import market as mk
from quaystone.operators import rolls as ro
from quaystone.operators.indicators import atr, bbands
from quaystone.plans.market_queries import _r, _rs
from quaystone.plans.research_queries import holdings, rets, z_panel, z_sql
from quaystone.sources.panels import DAILY_SQL, FUTURES_SQL, TICKS_SQL, daily, futures, read, ticks

YEAR = 244


def _sharpe(x: str):
    return F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0)) * math.sqrt(YEAR)


def _sharpe_sql(x: str) -> str:
    return f"avg({x}) / nullif(stddev_samp({x}), 0) * sqrt({YEAR})"


def grades(sp, sf):
    """Premiums of all grades at the contracts' expiries, twenty years on."""
    days = futures(sp, sf).select(F.add_months("expiry", 240).alias("day")).distinct()
    rows = sp.createDataFrame([(b, *v) for b, v in ct.GRADES.items()], "brand string, fe double, si double, al double, p double, s double")
    each = days.withColumn("b", F.explode(F.lit(list(ct.GRADES)))).join(rows, F.col("b") == F.col("brand"))
    return _r(each.select("brand", "day", F.expr(ct.premium()).alias("premium")), "premium")


def codes(sp, sf):
    """Codes of several styles read back."""
    f = futures(sp, sf).select("asset", "expiry").distinct()
    n = F.regexp_extract("asset", "([0-9]+)$", 1).cast("int")
    yy, y = F.date_format("expiry", "yyMM"), F.substring(F.date_format("expiry", "yyMM"), 2, 3)
    code = F.when(n % 3 == 0, F.concat(F.lit("rb"), yy)).when(n % 3 == 1, F.concat(F.lit("TA"), y)).otherwise(F.concat(F.lit("m"), yy, F.lit("-C-"), 100 * n))
    f = f.withColumn("code", code)
    return f.select("asset", "expiry", "code", *[c.alias(k) for k, c in ct.code_parts(F.col("code"), F.lit(2021)).items()])


_SHIFT = {0: -4, 1: -5, 2: 1, 3: 0, 4: -1, 5: -2, 6: -3}


def published(sp, sf):
    """A weekly series (its Fridays, and the day behind in a line to the next) moved to its publication days by weekday, the first of a day; monthly values nine days behind the month's end, on the next business day."""
    o = read(sp, sf, "orders").select(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("d"), "o_totalprice")
    friday = F.date_add(F.date_trunc("week", F.date_add("d", 2)).cast("date"), 4)
    w = Window.partitionBy("key").orderBy("date")
    week = o.groupBy("key", friday.alias("date")).agg(F.avg("o_totalprice").alias("v")).withColumns({"nd": F.lead("date").over(w), "nv": F.lead("v").over(w)})
    between = week.where("nd IS NOT NULL").select("key", F.date_add("date", 1).alias("date"), (F.col("v") + (F.col("nv") - F.col("v")) / F.datediff("nd", "date")).alias("v"))
    rows = week.select("key", "date", "v").unionByName(between)
    moved = F.element_at(F.create_map(*[F.lit(x) for kv in _SHIFT.items() for x in kv]), F.weekday("date"))
    rows = rows.withColumn("day", F.date_add("date", moved))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("key", "day").orderBy("date"))).where("place = 1")
    month = o.groupBy("key", F.last_day("d").alias("date")).agg(F.avg("o_totalprice").alias("v")).withColumn("day", ro.next_bday(F.date_add("date", 9)))
    return _r(rows.select("key", F.lit("week").alias("freq"), "day", "v").unionByName(month.select("key", F.lit("month").alias("freq"), "day", "v")), "v")


def quality(sp, sf):
    """What is wrong with an instrument's day: no positive price, few rows, an early end."""
    t = ticks(sp, sf).withColumn("min_id", mk.minute_id())
    g = t.groupBy("asset", "date").agg(F.count("*").alias("n"), F.max("min_id").alias("last"), F.min("price").alias("lo"))
    return g.select("asset", "date", "n", (F.col("n") < 3).alias("few"), (F.col("last") < 2055).alias("early"), F.coalesce(F.col("lo") <= 0, F.lit(True)).alias("bad_price"))


TOPS = (5, 10, 15, 20)


def brokers(sp, sf):
    """Sums of volume, long and short sides over the first ranks, by contract and by product."""
    x = read(sp, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("prod"), F.col("l_returnflag").alias("inst"), "l_suppkey")
    x = x.agg(F.sum("l_quantity").alias("vol"), F.sum(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(0.0)).alias("long"), F.sum(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_quantity")).otherwise(0.0)).alias("short"))
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("date", "prod", "inst").orderBy(F.desc("vol"), "l_suppkey")))
    sums = [F.sum(F.when(F.col("rank") <= k, F.col(c)).otherwise(0.0)).alias(f"{c}_{k}") for c in ("vol", "long", "short") for k in TOPS]
    return _r(x.groupingSets([["date", "prod", "inst"], ["date", "prod"]], "date", "prod", "inst").agg(*sums), *[f"{c}_{k}" for c in ("vol", "long", "short") for k in TOPS])


def _brokers_sql() -> str:
    sums = ", ".join(f"{tidy_sql(f'sum(CASE WHEN rank <= {k} THEN {c} ELSE 0 END)')} AS {c}_{k}" for c in ("vol", "long", "short") for k in TOPS)
    return f"""WITH g AS (SELECT l_shipdate::DATE AS date, l_linestatus AS prod, l_returnflag AS inst, l_suppkey, sum(l_quantity) AS vol, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0 END) AS long, sum(CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0 END) AS short FROM lineitem GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY date, prod, inst ORDER BY vol DESC, l_suppkey) AS rank FROM g) SELECT date, prod, inst, {sums} FROM x GROUP BY GROUPING SETS ((date, prod, inst), (date, prod))"""


def weekly_corr(sp, sf):
    """Correlations of every two assets' weekly sums of returns: assets squared rows."""
    w = rets(sp, sf).groupBy("asset", F.date_trunc("week", "date").cast("date").alias("date")).agg(F.sum("ret").alias("ret"))
    a, b = w.select("date", F.col("asset").alias("a"), F.col("ret").alias("x")), w.select("date", F.col("asset").alias("b"), F.col("ret").alias("y"))
    return _r(a.join(b, "date").where("a < b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"), F.count("*").alias("n")), "corr")


def hold_days(sp, sf):
    """Twice the holdings over the trades, times the median step in business days; the first holding is a trade."""
    w = Window.partitionBy("asset").orderBy("date")
    h = holdings(sp, sf).where("holding IS NOT NULL").withColumns({"before": F.lag("holding").over(w), "day": F.lag("date").over(w)})
    number = lambda c: F.floor(F.datediff(c, F.lit("1900-01-01").cast("date")) / 7) * 5 + F.least(F.weekday(c), F.lit(5))  # noqa: E731  1900-01-01 was a Monday
    step = number(F.col("date")) - number(F.col("day"))
    g = h.groupBy("asset").agg((2 * F.sum(F.abs("holding")) / F.nullif(F.sum(F.abs(F.col("holding") - F.coalesce("before", F.lit(0.0)))), F.lit(0))).alias("ratio"), F.percentile(F.when(step > 0, step), F.lit(0.5)).alias("step"))
    return _r(g.select("asset", "step", (F.col("ratio") * F.col("step")).alias("days")), "step", "days")


def conditional(sp, sf):
    """Sharpe ratio and success rate of the next day's result where the signal is larger than its quantiles, and result sums by fifths of the absolute result."""
    w = Window.partitionBy("asset").orderBy("date")
    h = holdings(sp, sf).withColumn("nx", F.lead("ret").over(w)).where("holding IS NOT NULL AND nx IS NOT NULL").withColumns({"pnl": F.col("holding") * F.col("nx"), "size": F.abs("holding")})
    cuts = h.groupBy("asset").agg(*[F.percentile("size", F.lit(q)).alias(f"q{int(100 * q)}") for q in (0.1, 0.25, 0.5)])
    j = h.join(cuts, "asset").withColumn("c", F.explode(F.array(*[F.struct(F.lit(k).alias("kept"), F.lit(v).alias("name")) for k, v in ((0, "all"), (10, "q10"), (25, "q25"), (50, "q50"))])))
    over = F.when(F.col("c.name") == "all", True).when(F.col("c.name") == "q10", F.col("size") > F.col("q10")).when(F.col("c.name") == "q25", F.col("size") > F.col("q25")).otherwise(F.col("size") > F.col("q50"))
    one = j.where(over).groupBy("asset", F.col("c.name").alias("kind")).agg(_sharpe("pnl").alias("value"), F.avg(F.when(F.col("pnl") != 0, (F.col("pnl") > 0).cast("double"))).alias("success"))
    fifth = F.ntile(5).over(Window.partitionBy("asset").orderBy(F.abs("pnl"), "date"))
    two = h.where("pnl <> 0").withColumn("part", fifth).groupBy("asset", F.concat(F.lit("fifth"), "part").alias("kind")).agg(F.sum("pnl").alias("value"), F.avg((F.col("pnl") > 0).cast("double")).alias("success"))
    return _r(one.unionByName(two), "value", "success")


def month_days(sp, sf):
    """Result by business day of the month in five buckets, and by quarter."""
    p = _pnl(sp, sf)
    first = F.trunc("date", "month")
    number = lambda c: F.floor(F.datediff(c, F.lit("1900-01-01").cast("date")) / 7) * 5 + F.least(F.weekday(c), F.lit(5))
    nth = number(F.col("date")) - number(first) + F.when(F.weekday("date") < 5, 1).otherwise(0)
    bucket = F.when(nth <= 4, "1-4").when(nth <= 9, "5-9").when(nth <= 14, "10-14").when(nth <= 20, "15-20").otherwise(">20")
    quarter = F.date_format(F.trunc("date", "quarter"), "yyyy-MM")
    each = p.withColumn("x", F.explode(F.array(F.struct(F.lit("day").alias("kind"), bucket.alias("label")), F.struct(F.lit("quarter").alias("kind"), quarter.alias("label")))))
    return _r(each.groupBy("x.kind", "x.label").agg(F.sum("pnl").alias("total"), _sharpe("pnl").alias("sharpe")), "total", "sharpe")


def _pnl(sp, sf):
    w = Window.partitionBy("asset").orderBy("date")
    h = holdings(sp, sf).withColumn("pnl", F.lag("holding").over(w) * F.col("ret")).where("pnl IS NOT NULL")
    return h.groupBy("date").agg(F.sum("pnl").alias("pnl"))


PNL_SQL = f"{z_sql()}, pp AS (SELECT date, ret, lag(z / vol * 0.01) OVER (PARTITION BY asset ORDER BY date) * ret AS pnl FROM z0), pd AS MATERIALIZED (SELECT date, sum(pnl) AS pnl FROM pp WHERE pnl IS NOT NULL GROUP BY date)"
LAGS = (1, 2, 5, 10, 20)
WINDOWS = (("all", "1900-01-01", "2100-01-01"), ("early", "1990-01-01", "1997-12-31"), ("late", "1998-01-01", "2009-12-31"))


def lagged(sp, sf):
    """Sharpe ratio of the portfolio with holdings of some days before, over all days and parts of them."""
    h = holdings(sp, sf).withColumn("x", F.explode(F.array(*[F.lit(k) for k in LAGS])))
    byk = Window.partitionBy("asset", "x").orderBy("date")
    shifted = F.coalesce(*[F.when(F.col("x") == k, F.lag("holding", k).over(byk)) for k in LAGS])
    p = h.withColumn("pnl", shifted * F.col("ret")).where("pnl IS NOT NULL").groupBy(F.col("x").alias("days"), "date").agg(F.sum("pnl").alias("pnl"))
    part = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.lit(a).cast("date").alias("lo"), F.lit(b).cast("date").alias("hi")) for n, a, b in WINDOWS]))
    return _r(p.withColumn("w", part).where("date BETWEEN w.lo AND w.hi").groupBy("days", "w.part").agg(_sharpe("pnl").alias("sharpe"), F.count("*").alias("n")), "sharpe")


def ratio_test(sp, sf, k: int = 5):
    """Variance ratio of k-day to one-day changes of log closes, with its z-values for equal variances and for variances that change."""
    w = Window.partitionBy("asset").orderBy("date")
    d = daily(sp, sf).withColumn("x", F.ln("close")).withColumns({"d1": F.col("x") - F.lag("x").over(w), "dk": F.col("x") - F.lag("x", k).over(w)})
    whole = Window.partitionBy("asset")
    d = d.withColumns({"n": F.count("*").over(whole).cast("double"), "s1": F.sum("d1").over(whole)}).withColumn("mu", F.col("s1") / F.col("n"))
    d = d.withColumn("e", F.pow(F.col("d1") - F.col("mu"), F.lit(2))).withColumns({f"e{j}": F.col("e") * F.lag("e", j).over(w) for j in range(1, k)})
    g = d.groupBy("asset").agg(F.max("n").alias("n"), F.sum("e").alias("b"), F.sum(F.pow(F.col("dk") - k * F.col("mu"), F.lit(2))).alias("t"), *[F.sum(f"e{j}").alias(f"e{j}") for j in range(1, k)])
    m = (F.col("n") - k + 1) * (1 - k / F.col("n"))
    ratio = F.col("t") / F.nullif(m, F.lit(0)) / F.nullif(k * F.col("b") / (F.col("n") - 1), F.lit(0))
    theta = sum((F.lit((2 * (k - j) / k) ** 2) * F.col(f"e{j}") for j in range(2, k)), F.lit((2 * (k - 1) / k) ** 2) * F.col("e1")) / (F.col("b") * F.col("b"))
    g = g.where(F.col("n") > k + 1).withColumn("ratio", ratio)
    away = F.col("ratio") - 1
    return _r(g.select("asset", "ratio", (away / F.sqrt(2 * (2 * k - 1) * (k - 1) / (3 * k * F.col("n")))).alias("z"), (away / F.nullif(F.sqrt(theta), F.lit(0.0))).alias("z_changing")), "ratio", "z", "z_changing")


def sector_weights(sp, sf):
    """An asset's signal times its sector's weight, summed by sector and date."""
    part = read(sp, sf, "part").groupBy(F.col("p_brand").alias("asset"), F.col("p_type").alias("sector")).agg(F.count("*").alias("n"))
    share = part.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("asset"))).select("asset", "sector", "w")
    return _r(z_panel(sp, sf).join(share, "asset").groupBy("sector", "date").agg(F.sum(F.col("z") * F.col("w")).alias("signal")), "signal")


def risk_as_of(sp, sf):
    """Deviation of each date's holdings under the covariances of the quarter before."""
    q = F.trunc("date", "quarter")
    r = rets(sp, sf).withColumn("q", q)
    a, b = r.select("date", "q", F.col("asset").alias("a"), F.col("ret").alias("x")), r.select("date", F.col("asset").alias("b"), F.col("ret").alias("y"))
    cov = a.join(b, "date").groupBy("q", "a", "b").agg(F.covar_samp("x", "y").alias("cov")).select(F.add_months("q", 3).alias("q"), "a", "b", "cov")
    h = holdings(sp, sf).where("holding IS NOT NULL").withColumn("q", q)
    j = h.select("date", "q", F.col("asset").alias("a"), F.col("holding").alias("u")).join(h.select("date", F.col("asset").alias("b"), F.col("holding").alias("v")), "date").join(cov, ["q", "a", "b"])
    return _r(j.groupBy("date").agg(F.sqrt(F.greatest(F.sum(F.col("u") * F.col("cov") * F.col("v")), F.lit(0.0))).alias("risk")), "risk")


def maps(sp, sf):
    """Sign, log of one plus, bounded range and floor of balances, business days of a year's part, and the parts of an instrument key."""
    c = read(sp, sf, "customer")
    x = F.col("c_acctbal") / 1000
    key = F.concat(F.lower("c_mktsegment"), F.lit("$"), F.col("c_nationkey"), F.lit("b$"), (F.col("c_custkey") % 5 - 2), F.lit("USDCNY^"))
    out = c.select("c_custkey", F.signum(x).alias("sign"), (F.signum(x) * F.log1p(F.abs(x))).alias("slog"), (F.greatest(F.least(x - 2, F.lit(3.0)), F.lit(-3.0)) / 2).alias("rng"), (F.greatest(x - 1, F.lit(0.0)) / 2).alias("flr"), key.alias("k"))
    part = lambda i: F.regexp_extract("k", r"^([a-z]+)\$([0-9]+)b\$(-?[0-9]+)([A-Z]{6})\^$", i)
    return _r(out.select("c_custkey", "sign", "slog", "rng", "flr", part(1).alias("name"), part(2).cast("int").alias("nb"), part(3).cast("int").alias("roll"), part(4).alias("pair")), "sign", "slog", "rng", "flr")


def named_bars(sp, sf):
    """Weekly bars of contracts, each column by what its name says."""
    f = futures(sp, sf).withColumn("week", F.date_trunc("week", "date").cast("date"))
    return _r(mk.by_name(f, ["asset", "contract", "week"], "date").select("asset", "contract", "week", "open", "high", "low", "close", "volume", "oi", "n_prints"), "open", "high", "low", "close", "volume", "oi")


#: Bands with a channel as exit, and breaks by a multiple of the true range.
STRATEGIES = Recipe(
    [*bbands().steps, *atr(14), {"top": roll("max", "high", 10, shift=1), "bottom": roll("min", "low", 10, shift=1), "pcl": lag("close"), "pa": lag("atr")},
     {"band": s("CASE WHEN close > upper THEN 1 WHEN close < lower THEN -1 WHEN close < bottom OR close > top THEN 0 END"), "burst": s("CASE WHEN close > pcl + 1.5 * pa THEN 1 WHEN close < pcl - 1.5 * pa THEN -1 END")},
     {"held_b": fill("band"), "held_r": fill("burst")}, {"pos_band": s("coalesce(held_b, 0)"), "pos_burst": s("coalesce(held_r, 0)")}],
    ("pos_band", "pos_burst"),
)
_NUM = lambda c: f"(floor(({c} - DATE '1900-01-01') / 7.0) * 5 + least(isodow({c}) - 1, 5))"
def breakeven_surface(sp, sf):
    """Tenors of one to four quarters for every contract, at the money and at two deltas."""
    out = ct.breakeven_surface(futures(sp, sf).select("asset", "contract", "expiry", "date", "close"), [91, 182, 273, 365])
    # halving ends within a rounding of the last bit; strikes follow their roots
    return out.withColumns({c: F.round(F.nanvl(c, F.lit(None).cast("double")), 6).alias(c) for c in ("strike", "vol")})


QUERIES = {
    "fn_brand_premium": grades, "fn_contract_codes": codes, "clean_publish": published, "check_days": quality, "agg_broker_sides": brokers, "risk_weekly_correlation": weekly_corr, "pnl_hold_days": hold_days, "pnl_conditional": conditional,
    "pnl_month_days": month_days, "pnl_lagged": lagged, "stat_ratio_test": ratio_test, "xs_sector_weights": sector_weights, "risk_portfolio_asof": risk_as_of, "fn_maps": maps, "bars_named": named_bars,
    "sig_strategies_more": lambda sp, sf: STRATEGIES.result(daily(sp, sf)), "stat_breakeven_surface": breakeven_surface, "stat_breakeven": lambda sp, sf: _r(ct.breakeven(futures(sp, sf).select("asset", "contract", "date", "close")), "vol"),
}
_GRADES = ", ".join(f"('{b}', {', '.join(f'{x}::DOUBLE' for x in v)})" for b, v in ct.GRADES.items())
SQL = {
    "fn_brand_premium": f"WITH {FUTURES_SQL}, d AS (SELECT DISTINCT (expiry + INTERVAL 240 MONTH)::DATE AS d0 FROM fb), e AS (SELECT last_day(d0) AS day FROM d), x AS (SELECT * FROM (SELECT DISTINCT day FROM e), (VALUES {_GRADES}) t(brand, fe, si, al, p, s)) SELECT brand, day, {tidy_sql(ct.premium())} AS premium FROM x",
    "fn_contract_codes": f"""WITH {FUTURES_SQL}, f AS (SELECT DISTINCT asset, expiry, regexp_extract(asset, '([0-9]+)$', 1)::INT AS n FROM fb), c AS (SELECT asset, expiry, CASE n % 3 WHEN 0 THEN 'rb' || strftime(expiry, '%y%m') WHEN 1 THEN 'TA' || substr(strftime(expiry, '%y%m'), 2, 3) ELSE 'm' || strftime(expiry, '%y%m') || '-C-' || (100 * n) END AS code FROM f),
p AS (SELECT *, regexp_extract(code, '{ct.CODE}', 1) AS product, regexp_extract(code, '{ct.CODE}', 2) AS g, nullif(regexp_extract(code, '{ct.CODE}', 3), '') AS side, nullif(regexp_extract(code, '{ct.CODE}', 4), '')::INT AS strike FROM c)
SELECT asset, expiry, code, product, (CASE WHEN length(g) = 4 THEN 200000 + g::INT WHEN g::INT >= 500 THEN 202000 + g::INT ELSE 202000 + g::INT END)::INT AS month, side, strike FROM p""",
    "clean_publish": f"""WITH o AS (SELECT o_orderpriority AS key, o_orderdate::DATE AS d, o_totalprice FROM orders), k AS (SELECT key, (date_trunc('week', d + 2)::DATE + 4) AS date, avg(o_totalprice) AS v FROM o GROUP BY ALL),
n AS (SELECT *, lead(date) OVER w AS nd, lead(v) OVER w AS nv FROM k WINDOW w AS (PARTITION BY key ORDER BY date)), r AS (SELECT key, date, v FROM n UNION ALL SELECT key, date + 1, v + (nv - v) / (nd - date) FROM n WHERE nd IS NOT NULL),
m AS (SELECT *, date + CASE isodow(date) - 1 {' '.join(f'WHEN {a} THEN {b}' for a, b in _SHIFT.items())} END AS day FROM r), e AS (SELECT key, last_day(d) AS date, avg(o_totalprice) AS v FROM o GROUP BY ALL)
SELECT key, 'week' AS freq, day, {_rs('v')} FROM m QUALIFY row_number() OVER (PARTITION BY key, day ORDER BY date) = 1 UNION ALL SELECT key, 'month', date + 9 + CASE WHEN isodow(date + 9) >= 5 THEN 8 - isodow(date + 9)::INT ELSE 1 END, {_rs('v')} FROM e""",
    "check_days": f"WITH {TICKS_SQL}, t AS (SELECT *, ((minute // 60 + 6) % 24) * 100 + minute % 60 AS min_id FROM ticks) SELECT asset, date, count(*) AS n, count(*) < 3 AS few, max(min_id) < 2055 AS early, coalesce(min(price) <= 0, true) AS bad_price FROM t GROUP BY ALL",
    "agg_broker_sides": _brokers_sql(),
    "risk_weekly_correlation": f"WITH {z_sql()}, w AS (SELECT asset, date_trunc('week', date)::DATE AS date, sum(ret) AS ret FROM z0 WHERE ret IS NOT NULL GROUP BY ALL) SELECT a.asset AS a, b.asset AS b, {tidy_sql('corr(a.ret, b.ret)')} AS corr, count(*) AS n FROM w a JOIN w b ON a.date = b.date AND a.asset < b.asset GROUP BY ALL",
    "pnl_hold_days": f"""WITH {z_sql()}, h AS (SELECT asset, date, z / vol * 0.01 AS h FROM z0 WHERE z / vol * 0.01 IS NOT NULL), l AS (SELECT *, lag(h) OVER w AS b, lag(date) OVER w AS pd FROM h WINDOW w AS (PARTITION BY asset ORDER BY date)),
g AS (SELECT asset, 2 * sum(abs(h)) / nullif(sum(abs(h - coalesce(b, 0))), 0) AS ratio, quantile_cont(CASE WHEN {_NUM('date')} - {_NUM('pd')} > 0 THEN {_NUM('date')} - {_NUM('pd')} END, 0.5) AS step FROM l GROUP BY asset) SELECT asset, {_rs('step')}, {tidy_sql('ratio * step')} AS days FROM g""",
    "pnl_conditional": f"""WITH {z_sql()}, h AS MATERIALIZED (SELECT asset, date, abs(z / vol * 0.01) AS size, z / vol * 0.01 * nx AS pnl FROM (SELECT *, lead(ret) OVER (PARTITION BY asset ORDER BY date) AS nx FROM z0) WHERE z / vol * 0.01 IS NOT NULL AND nx IS NOT NULL),
c AS (SELECT asset, quantile_cont(size, 0.1) AS q10, quantile_cont(size, 0.25) AS q25, quantile_cont(size, 0.5) AS q50 FROM h GROUP BY asset), j AS (SELECT h.*, q10, q25, q50, k.kind FROM h JOIN c USING (asset), (VALUES ('all'), ('q10'), ('q25'), ('q50')) k(kind)),
f AS (SELECT *, ntile(5) OVER (PARTITION BY asset ORDER BY abs(pnl), date) AS part FROM h WHERE pnl <> 0)
SELECT asset, kind, {tidy_sql(_sharpe_sql('pnl'))} AS value, {tidy_sql('avg(CASE WHEN pnl <> 0 THEN (pnl > 0)::INT END)')} AS success FROM j WHERE kind = 'all' OR (kind = 'q10' AND size > q10) OR (kind = 'q25' AND size > q25) OR (kind = 'q50' AND size > q50) GROUP BY asset, kind
UNION ALL SELECT asset, 'fifth' || part, {tidy_sql('sum(pnl)')}, {tidy_sql('avg((pnl > 0)::INT)')} FROM f GROUP BY asset, part""",
    "pnl_month_days": f"""WITH {PNL_SQL}, x AS (SELECT *, {_NUM('date')} - {_NUM("date_trunc('month', date)::DATE")} + CASE WHEN isodow(date) < 6 THEN 1 ELSE 0 END AS nth FROM pd)
SELECT 'day' AS kind, CASE WHEN nth <= 4 THEN '1-4' WHEN nth <= 9 THEN '5-9' WHEN nth <= 14 THEN '10-14' WHEN nth <= 20 THEN '15-20' ELSE '>20' END AS label, {tidy_sql('sum(pnl)')} AS total, {tidy_sql(_sharpe_sql('pnl'))} AS sharpe FROM x GROUP BY ALL
UNION ALL SELECT 'quarter', strftime(date_trunc('quarter', date), '%Y-%m'), {tidy_sql('sum(pnl)')}, {tidy_sql(_sharpe_sql('pnl'))} FROM x GROUP BY ALL""",
    "pnl_lagged": f"""WITH {z_sql()}, l AS ({' UNION ALL '.join(f'SELECT {k} AS days, date, lag(z / vol * 0.01, {k}) OVER (PARTITION BY asset ORDER BY date) * ret AS pnl FROM z0' for k in LAGS)}), p AS (SELECT days, date, sum(pnl) AS pnl FROM l WHERE pnl IS NOT NULL GROUP BY ALL)
SELECT days, part, {tidy_sql(_sharpe_sql('pnl'))} AS sharpe, count(*) AS n FROM p JOIN (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in WINDOWS)}) w(part, lo, hi) ON date BETWEEN lo AND hi GROUP BY ALL""",
    "stat_ratio_test": f"""WITH {DAILY_SQL}, d AS (SELECT asset, date, ln(close) - lag(ln(close)) OVER w AS d1, ln(close) - lag(ln(close), 5) OVER w AS dk FROM s0 WINDOW w AS (PARTITION BY asset ORDER BY date)), m AS (SELECT asset, count(*)::DOUBLE AS n, sum(d1) / count(*) AS mu FROM d GROUP BY asset),
e AS (SELECT asset, date, n, dk - 5 * mu AS far, pow(d1 - mu, 2) AS e FROM d JOIN m USING (asset)), l AS (SELECT *, 2.56 * e * lag(e) OVER w AS p1, 1.44 * e * lag(e, 2) OVER w AS p2, 0.64 * e * lag(e, 3) OVER w AS p3, 0.16 * e * lag(e, 4) OVER w AS p4 FROM e WINDOW w AS (PARTITION BY asset ORDER BY date)),
g AS (SELECT asset, any_value(n) AS n, sum(e) AS b, sum(far * far) AS t, (sum(p1) + sum(p2) + sum(p3) + sum(p4)) / pow(sum(e), 2) AS theta FROM l GROUP BY asset HAVING any_value(n) > 6), r AS (SELECT asset, n, theta, t / ((n - 4) * (1 - 5 / n)) / (5 * b / (n - 1)) AS ratio FROM g)
SELECT asset, {_rs('ratio')}, {tidy_sql('(ratio - 1) / sqrt(2 * 9 * 4 / (15 * n))')} AS z, {tidy_sql('(ratio - 1) / nullif(sqrt(theta), 0)')} AS z_changing FROM r""",
    "xs_sector_weights": f"WITH {z_sql()}, p AS (SELECT p_brand AS asset, p_type AS sector, count(*) AS n FROM part GROUP BY ALL), w AS (SELECT asset, sector, n / sum(n) OVER (PARTITION BY asset) AS w FROM p) SELECT sector, date, {tidy_sql('sum(z * w)')} AS signal FROM z0 JOIN w USING (asset) GROUP BY ALL",
    "risk_portfolio_asof": f"""WITH {z_sql()}, r AS (SELECT asset, date, ret, date_trunc('quarter', date)::DATE AS q FROM z0 WHERE ret IS NOT NULL), c AS (SELECT (a.q + INTERVAL 3 MONTH)::DATE AS q, a.asset AS a, b.asset AS b, covar_samp(a.ret, b.ret) AS cov FROM r a JOIN r b USING (date) GROUP BY a.q, a.asset, b.asset),
h AS (SELECT asset, date, z / vol * 0.01 AS h, date_trunc('quarter', date)::DATE AS q FROM z0 WHERE z / vol * 0.01 IS NOT NULL) SELECT x.date, {tidy_sql('sqrt(greatest(sum(x.h * cov * y.h), 0))')} AS risk FROM h x JOIN h y ON x.date = y.date JOIN c ON c.q = x.q AND c.a = x.asset AND c.b = y.asset GROUP BY x.date""",
    "fn_maps": f"""WITH x AS (SELECT *, c_acctbal / 1000 AS x FROM customer) SELECT c_custkey, {tidy_sql('sign(x)')} AS sign, {tidy_sql('sign(x) * ln(1 + abs(x))')} AS slog, {tidy_sql('greatest(least(x - 2, 3.0), -3.0) / 2')} AS rng, {tidy_sql('greatest(x - 1, 0) / 2')} AS flr,
  lower(c_mktsegment) AS name, c_nationkey::INT AS nb, (c_custkey % 5 - 2)::INT AS roll, 'USDCNY' AS pair FROM x""",
    "bars_named": f"WITH {FUTURES_SQL} SELECT asset, contract, date_trunc('week', date)::DATE AS week, {tidy_sql('arg_min(open, date)')} AS open, {tidy_sql('max(high)')} AS high, {tidy_sql('min(low)')} AS low, {tidy_sql('arg_max(close, date)')} AS close, {tidy_sql('sum(volume)')} AS volume, {tidy_sql('arg_max(oi, date)')} AS oi, arg_max(n_prints, date) AS n_prints FROM fb GROUP BY ALL",
    "sig_strategies_more": STRATEGIES.oracle(DAILY_SQL),
}
