"""Registered queries: seasonality, pairs and leaders, models of assets, scalar functions, target positions."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaystone.functions.recipe import Ewm, Recipe, fill, lag, pair, s, span, tidy_sql, whole
from quaystone.operators import seasonal as se
from quaystone.operators import selection as sl
from quaystone.operators import market as mk
from quaystone.operators import research as rs
from quaystone.plans.market_queries import CAL_SQL, CHAIN_SQL, OHLC, _r, _rs, cal, chained
from quaystone.plans.research_queries import HOLD_SQL, holdings, rets, z_panel, z_sql
from quaystone.sources.panels import DAILY_SQL, FUTURES_SQL, TICKS_SQL, bars, daily, futures, read, ticks
from quaystone.streaming import bars as st

_NY = ", ".join(f"DATE '{d}'" for d in se.NEW_YEARS)
HOLIDAYS = [("2024-01-08", 1.0), ("2024-01-15", 0.5), ("2024-01-24", -1.0)]


def labels(sp, sf):
    d = daily(sp, sf).select("date").distinct()
    out = se.lunar_labels(d).select("date", "lunar_year", "lunar_day", "lunar_week", F.year("date").alias("yr"), F.weekofyear("date").alias("iso_week"), F.dayofyear("date").alias("doy"))
    return out


def season_table(sp, sf):
    """Closes by asset, day of the year and year, and with gaps of one day filled from the day before in that year."""
    d = daily(sp, sf).groupBy("asset", F.date_format("date", "MM-dd").alias("md"), F.year("date").alias("yr")).agg(F.sum("close").alias("v"))
    full = d.select("asset", "md").distinct().join(d.select("asset", "yr").distinct(), "asset").join(d, ["asset", "md", "yr"], "left")
    before = F.lag("v").over(Window.partitionBy("asset", "yr").orderBy("md"))
    return _r(full.select("asset", "md", "yr", "v", F.coalesce("v", before).alias("filled")), "v", "filled")


def rules(sp, sf):
    """1 on Mondays of the first half of a month, -1 in December, 0.5 between two days, added up."""
    d = daily(sp, sf).select("date").distinct()
    v = F.when((F.weekday("date") == 0) & (F.dayofmonth("date") <= 15), 1.0).otherwise(0.0) - F.when(F.month("date") == 12, 1.0).otherwise(0.0) + F.when(F.col("date").between("1998-03-01", "1998-06-30"), 0.5).otherwise(0.0)
    return _r(d.select("date", v.alias("signal")), "signal")


def bins(sp, sf):
    """Next-day returns by fifths of each asset's signal."""
    w = Window.partitionBy("asset").orderBy("date")
    z = z_panel(sp, sf).withColumn("nx", F.lead("ret").over(w)).where("nx IS NOT NULL AND vol IS NOT NULL")
    z = z.withColumn("bin", F.ntile(5).over(Window.partitionBy("asset").orderBy("z", "date")))
    out = z.groupBy("asset", "bin").agg(F.avg("nx").alias("mean"), F.percentile("nx", 0.25).alias("q25"), F.percentile("nx", 0.75).alias("q75"), (F.avg("nx") / F.nullif(F.stddev_samp("nx"), F.lit(0)) * math.sqrt(244)).alias("sharpe"), F.count("*").alias("n"))
    return _r(out, "mean", "q25", "q75", "sharpe")


WINS = (5, 10, 20, 40)


def scenarios(sp, sf):
    """asset, date, scen and pnl of sign-of-momentum scenarios over several windows."""
    w = Window.partitionBy("asset").orderBy("date")
    d = daily(sp, sf).withColumns({"ret": F.ln(F.col("close") / F.lag("close").over(w))} | {f"p{n}": F.signum(F.ln(F.col("close") / F.lag("close", n).over(w))) for n in WINS})
    d = d.withColumns({f"p{n}": F.lag(f"p{n}").over(w) * F.col("ret") for n in WINS})
    return d.select("asset", "date", F.explode(F.array(*[F.struct(F.lit(n).alias("scen"), F.col(f"p{n}").alias("pnl")) for n in WINS])).alias("x")).select("asset", "date", "x.*").where("pnl IS NOT NULL")


SCEN_SQL = f"""{DAILY_SQL}, d1 AS (SELECT *, ln(close / lag(close) OVER w) AS ret, {', '.join(f'sign(ln(close / lag(close, {n}) OVER w)) AS p{n}' for n in WINS)} FROM s0 WINDOW w AS (PARTITION BY asset ORDER BY date)),
sc AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(f'SELECT asset, date, {n} AS scen, lag(p{n}) OVER (PARTITION BY asset ORDER BY date) * ret AS pnl FROM d1' for n in WINS)}) WHERE pnl IS NOT NULL)"""


def scen_scores(sp, sf):
    return scenarios(sp, sf).groupBy("asset", "scen").agg((F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0)) * math.sqrt(244)).alias("sharpe"), F.sum("pnl").alias("total"))


def top_scenarios(sp, sf):
    t = scen_scores(sp, sf).withColumn("w", F.round(0.7 * F.col("sharpe") + 0.3 * F.col("total"), 9))
    return _r(t.withColumn("place", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("w"), "scen"))).where("place <= 2"), "sharpe", "total", "w")


def greedy(sp, sf):
    p = scenarios(sp, sf)
    a, b = p.select("asset", "date", F.col("scen").alias("a"), F.col("pnl").alias("x")), p.select("asset", "date", F.col("scen").alias("b"), F.col("pnl").alias("y"))
    corr = a.join(b, ["asset", "date"]).groupBy(F.col("asset").alias("g"), "a", "b").agg(F.corr("x", "y").alias("corr"))
    score = scen_scores(sp, sf).select(F.col("asset").alias("g"), F.col("scen").alias("a"), F.col("sharpe").alias("score"))
    return sl.per_matrix(corr.join(score, ["g", "a"]), sl.greedy(), "g string, a int, place int")


def leaders(sp, sf):
    """The mean signal of a group's leaders (brands that end in 1) given to its other members."""
    z = z_panel(sp, sf).select("asset", "date", "z").withColumn("grp", F.substring("asset", 7, 1))
    lead = z.where("asset LIKE '%1'").groupBy("grp", "date").agg(F.avg("z").alias("lead"))
    return _r(z.where("NOT asset LIKE '%1'").join(lead, ["grp", "date"]).select("asset", "date", "lead"), "lead")


def pairs(sp, sf):
    """Spreads of returns of assets next to each other; each spread's score goes to its legs with opposite signs, added up by asset."""
    r = rets(sp, sf)
    names = r.select("asset").distinct().withColumn("mate", F.lead("asset").over(Window.partitionBy(F.lit(0)).orderBy("asset"))).where("mate IS NOT NULL")
    j = r.join(names, "asset").join(r.select(F.col("asset").alias("mate"), "date", F.col("ret").alias("other")), ["mate", "date"]).withColumn("spread", F.col("ret") - F.col("other"))
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(-19, 0)
    j = j.withColumn("score", F.when(F.count("spread").over(w) >= 20, (F.col("spread") - F.avg("spread").over(w)) / F.nullif(F.stddev_samp("spread").over(w), F.lit(0)))).where("score IS NOT NULL")
    legs = j.select("date", F.explode(F.array(F.struct(F.col("asset").alias("asset"), (-F.col("score")).alias("v")), F.struct(F.col("mate").alias("asset"), F.col("score").alias("v")))).alias("x"))
    return _r(legs.groupBy("x.asset", "date").agg(F.sum("x.v").alias("signal")), "signal")


PAIR_SQL = f"""WITH {z_sql()}, r AS MATERIALIZED (SELECT asset, date, ret FROM z0 WHERE ret IS NOT NULL), n AS (SELECT asset, lead(asset) OVER (ORDER BY asset) AS mate FROM (SELECT DISTINCT asset FROM r)),
j AS (SELECT r.asset, n.mate, r.date, r.ret - o.ret AS spread FROM r JOIN n ON r.asset = n.asset JOIN r o ON o.asset = n.mate AND o.date = r.date),
c AS (SELECT *, CASE WHEN count(spread) OVER w >= 20 THEN (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) END AS score FROM j WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
l AS (SELECT asset, date, -score AS v FROM c WHERE score IS NOT NULL UNION ALL SELECT mate, date, score FROM c WHERE score IS NOT NULL) SELECT asset, date, {tidy_sql('sum(v)')} AS signal FROM l GROUP BY asset, date"""

HEDGE = Recipe(
    [*[{"pc": lag("close")}, {"ret": s("ln(close / pc)")}, {"idx": whole("avg", "ret", ("date",))}], {"beta_raw": pair("regr_slope", "ret", "idx", 60)}, {"beta": fill("CASE WHEN beta_raw IS NOT NULL THEN least(greatest(beta_raw, 0.0), 3.0) END")}, {"pb": lag("beta")}, {"hedged": s("ret - pb * idx")}],
    ("beta", "hedged"),
)
GAPPED = Recipe([{"x": s("CASE WHEN rn % 6 = 2 OR rn % 11 IN (4, 5) THEN NULL ELSE close END")}, {"before": lag("x"), "after": lag("x", -1)}, {"interp": s("coalesce(x, (before + after) / 2)")}], ("interp",))
FIT2 = """{c} count(*) AS n, covar_samp({y}, {a}) AS ya, covar_samp({y}, {b}) AS yb, covar_samp({a}, {b}) AS ab, var_samp({a}) AS aa, var_samp({b}) AS bb, avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb"""


def two_regressors(sp, sf):
    """Least squares of returns on the signal and volatility from sums of products."""
    z = z_panel(sp, sf).where("ret IS NOT NULL AND vol IS NOT NULL")
    g = z.groupBy("asset").agg(F.count("*").alias("n"), F.covar_samp("ret", "z").alias("ya"), F.covar_samp("ret", "vol").alias("yb"), F.covar_samp("z", "vol").alias("ab"), F.var_samp("z").alias("aa"), F.var_samp("vol").alias("bb"), F.avg("ret").alias("my"), F.avg("z").alias("ma"), F.avg("vol").alias("mb"))
    g = g.withColumn("det", F.nullif(F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab"), F.lit(0)))
    g = g.withColumns({"b1": (F.col("ya") * F.col("bb") - F.col("yb") * F.col("ab")) / F.col("det"), "b2": (F.col("yb") * F.col("aa") - F.col("ya") * F.col("ab")) / F.col("det")})
    return _r(g.select("asset", "n", "b1", "b2", (F.col("my") - F.col("b1") * F.col("ma") - F.col("b2") * F.col("mb")).alias("b0")), "b0", "b1", "b2")


def folds(sp, sf):
    """Fits on date folds whose bounds belong to both neighbours."""
    cuts = ["1995-01-01", "1997-01-01", "1999-01-04", "2002-01-01"]
    f = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(a).cast("date").alias("lo"), F.lit(b).cast("date").alias("hi")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]))
    z = z_panel(sp, sf).withColumn("f", f).where("date BETWEEN f.lo AND f.hi AND ret IS NOT NULL")
    return _r(z.groupBy("f.fold").agg(F.regr_slope("ret", "z").alias("slope"), F.regr_r2("ret", "z").alias("r2"), F.count("*").alias("n")), "slope", "r2")


def targets(sp, sf):
    """Two factors demeaned across assets and averaged, scaled by volatility, summed to positions in lots, with the change since the day before."""
    z = z_panel(sp, sf).where("vol IS NOT NULL").withColumn("mom", F.signum("ret"))
    w = Window.partitionBy("date")
    z = z.withColumn("raw", 0.6 * (F.col("z") - F.avg("z").over(w)) + 0.4 * (F.col("mom") - F.avg("mom").over(w))).withColumn("pos", F.col("raw") / F.nullif("vol", F.lit(0)))
    z = z.withColumn("lots", F.signum("pos") * F.floor(F.abs(F.round("pos", 9)) / 4 + 0.5) * 4)
    return _r(z.select("asset", "date", "lots", (F.col("lots") - F.coalesce(F.lag("lots").over(Window.partitionBy("asset").orderBy("date")), F.lit(0.0))).alias("change")), "lots", "change")


def portfolio_risk(sp, sf):
    """Deviation of each date's holdings under the whole sample's covariances."""
    h = holdings(sp, sf).where("holding IS NOT NULL")
    cov = sl.moments(rets(sp, sf)).select("a", "b", "cov")
    j = h.select("date", F.col("asset").alias("a"), F.col("holding").alias("x")).join(h.select("date", F.col("asset").alias("b"), F.col("holding").alias("y")), "date").join(cov, ["a", "b"])
    return _r(j.groupBy("date").agg(F.sqrt(F.sum(F.col("x") * F.col("cov") * F.col("y"))).alias("risk")), "risk")


def hold_period(sp, sf):
    w = Window.partitionBy("asset").orderBy("date")
    h = holdings(sp, sf).where("holding IS NOT NULL").withColumn("d", F.abs(F.col("holding") - F.lag("holding").over(w)))
    return _r(h.groupBy("asset").agg((2 * F.sum(F.abs("holding")) / F.nullif(F.sum("d"), F.lit(0))).alias("days")), "days")


HALF_SPREAD = 0.25


def quotes(sp, sf):
    """Bid and ask of the spread of each instrument and the next: the bid takes the other leg's ask. At every tick of either leg, once both have a price."""
    t = ticks(sp, sf).where("price IS NOT NULL").withColumn("pair", F.explode(F.array(F.col("asset"), F.col("asset") - 1)))
    w = Window.partitionBy("pair").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    leg = lambda k: F.last(F.when(F.col("asset") == F.col("pair") + k, F.col("price")), ignorenulls=True).over(w)
    both = t.withColumns({"a": leg(0), "b": leg(1)}).where("a IS NOT NULL AND b IS NOT NULL")
    return _r(both.select("pair", "event_id", (F.col("a") - F.col("b") - 2 * HALF_SPREAD).alias("bid"), (F.col("a") - F.col("b") + 2 * HALF_SPREAD).alias("ask")), "bid", "ask")


def scalars(sp, sf):
    o = read(sp, sf, "orders")
    day = F.to_date("o_orderdate")
    return _r(o.select(
        "o_orderkey", "o_totalprice", (F.datediff(day, F.lit("1970-01-01").cast("date")) + 25569).alias("xl"), (F.datediff(F.lit("2002-01-01").cast("date"), day) / 365).alias("act365"),
        F.last_day(day).alias("mend"), F.concat(F.lit("Q"), F.quarter(day), F.lit(" "), F.date_format(day, "yy")).alias("tenor"), F.split(F.concat(F.lit("rb$1$"), F.lower("o_orderpriority"), F.lit("*USDCNY^")), r"\$")[2].alias("key_tail"),
        F.regexp_replace(F.format_number("o_totalprice", 2), ",", "").try_cast("double").alias("number"), F.when(F.col("o_orderpriority").rlike("[-_]"), 2.0).otherwise(1.0).alias("cost"), (F.signum("o_totalprice") * F.floor(F.abs("o_totalprice") / 10 + 0.5) * 10).alias("lots"),
        (F.signum("o_totalprice") * F.pow(F.least(F.abs(F.col("o_totalprice") / 1e5), F.lit(1.25)), F.lit(4))).alias("clip_pow"),
    ).drop("o_totalprice"), "act365", "number", "cost", "lots", "clip_pow")


SCALAR_SQL = f"""WITH o AS (SELECT *, o_orderdate::DATE AS d FROM orders) SELECT o_orderkey, (d - DATE '1970-01-01' + 25569)::INT AS xl, {tidy_sql("(DATE '2002-01-01' - d) / 365.0")} AS act365, last_day(d) AS mend, 'Q' || quarter(d) || ' ' || strftime(d, '%y') AS tenor,
 lower(o_orderpriority) || '*USDCNY^' AS key_tail, {tidy_sql('o_totalprice')} AS number, {tidy_sql("CASE WHEN regexp_matches(o_orderpriority, '[-_]') THEN 2.0 ELSE 1.0 END")} AS cost, {tidy_sql('sign(o_totalprice) * floor(abs(o_totalprice) / 10 + 0.5) * 10')} AS lots, {tidy_sql('sign(o_totalprice) * pow(least(abs(o_totalprice / 1e5), 1.25), 4)')} AS clip_pow FROM o"""


def risk_map(sp, sf):
    """Positions by nation mapped to regions and buckets by weights."""
    c = read(sp, sf, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("pos"))
    m = read(sp, sf, "nation").withColumn("x", F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(w).alias("w")) for b, w in (("near", 0.75), ("far", 0.25))]))).select("n_nationkey", "n_regionkey", "x.*")
    return _r(c.join(m, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "bucket").agg(F.sum(F.col("pos") * F.col("w")).alias("risk")), "risk")


def recipe(r):
    return lambda sp, sf: r.result(daily(sp, sf))


def week_recipe(sp, sf):
    w = Window.partitionBy("asset", "wk").orderBy("date")
    d = daily(sp, sf).withColumn("wk", F.date_trunc("week", "date"))
    d = d.withColumns({"wmean": F.avg("close").over(Window.partitionBy("asset", "wk")), "nr": F.row_number().over(w)})
    by = Window.partitionBy("asset").orderBy("date")
    d = d.withColumn("pm", F.lag("wmean").over(by)).withColumn("done", F.last(F.when(F.col("nr") == 1, F.col("pm")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return _r(d.select("asset", "date", "done", (F.col("close") - F.col("done")).alias("over")), "done", "over")


def johansen(sp, sf):
    """Log closes of all assets, in groups of five by number."""
    number = F.regexp_extract("asset", "([0-9]+)$", 1).cast("int")
    d = daily(sp, sf).select(F.floor((number - 1) / 5).cast("string").alias("g"), "date", F.col("asset").alias("name"), F.ln("close").alias("x"))
    return _r(rs.johansen(d), "trace", "largest")


def forward_rolls(sp, sf):
    """The contract in use when rolls only go forward: the latest expiry among each day's most active contracts up to now."""
    b = futures(sp, sf).withColumn("place", F.row_number().over(Window.partitionBy("asset", "date").orderBy(F.desc("volume"), "contract"))).where("place = 1")
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return b.select("asset", "date", F.col("contract").alias("best"), F.max("contract").over(w).alias("in_use"))


def traded(sp, sf):
    z = z_panel(sp, sf).select("asset", "date", F.signum("z").alias("pos"), F.col("open").alias("trade_px"), "close")
    return _r(rs.traded_pnl(z).select("asset", "date", "pnl"), "pnl")


def monthly(sp, sf):
    p = rs.pnl(holdings(sp, sf))
    return _r(p.groupBy("asset", F.trunc("date", "month").alias("m")).agg(F.sum("pnl").alias("total")), "total")


def tenor_mean(sp, sf):
    """Monthly fixings and curve points put together and averaged by tenor."""
    fix = read(sp, sf, "orders").groupBy(F.trunc("o_orderdate", "quarter").alias("tenor")).agg(F.avg("o_totalprice").alias("px"))
    curve = read(sp, sf, "lineitem").groupBy(F.trunc("l_shipdate", "quarter").alias("tenor")).agg(F.avg("l_extendedprice").alias("px"))
    return _r(fix.unionByName(curve).groupBy("tenor").agg(F.avg("px").alias("px"), F.count("*").alias("n")), "px")


def expiry_days(sp, sf):
    days = read(sp, sf, "lineitem").agg(F.trunc(F.min("l_shipdate"), "month").alias("first"), F.last_day(F.max("l_shipdate")).alias("last"))
    return mk.expiries(mk.calendar(days))


def merged_maps(sp, sf):
    """Two maps of counts per region merged with weights 2 and -1, missing keys as nothing."""
    n = read(sp, sf, "nation")
    def counts(t, key, out):
        c = read(sp, sf, t).join(n, F.col(key) == F.col("n_nationkey")).groupBy("n_regionkey", "n_name").agg(F.count("*").cast("double").alias("c"))
        return c.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "c"))).alias(out))  # at most the nations of a region
    j = counts("customer", "c_nationkey", "a").join(counts("supplier", "s_nationkey", "b"), "n_regionkey")
    m = F.map_zip_with("a", "b", lambda k, x, y: 2 * F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0)))
    return j.select("n_regionkey", F.explode(m).alias("n_name", "v"))


def season_tilt(sp, sf):
    """Mean holding of the same day of the former three years, and what is left of the holding: an equality join on the day."""
    h = holdings(sp, sf).where("holding IS NOT NULL").select("asset", "date", "holding")
    past = h.select("asset", F.year("date").alias("y"), F.date_format("date", "MM-dd").alias("md"), F.col("holding").alias("v"))
    now = h.withColumns({"md": F.date_format("date", "MM-dd"), "y": F.explode(F.sequence(F.year("date") - 3, F.year("date") - 1))})
    out = now.join(past, ["asset", "md", "y"], "left").groupBy("asset", "date").agg(F.max("holding").alias("holding"), F.avg("v").alias("tilt"))
    return _r(out.select("asset", "date", "tilt", (F.col("holding") - F.col("tilt")).alias("timing")), "tilt", "timing")


def cheapest(sp, sf):
    """The least of several grades' premiums on each segment's last day, by a join on that day and the last known before it."""
    c = chained(sp, sf).groupBy("asset", "seg_start").agg(F.max("date").alias("date"))
    o = read(sp, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(*[F.avg(F.when(F.col("o_orderpriority") == k, F.col("o_totalprice"))).alias(n) for k, n in (("1-URGENT", "g1"), ("3-MEDIUM", "g2"), ("5-LOW", "g3"))])
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = c.select("date").distinct().join(o, "date", "full").withColumns({g: F.last(g, ignorenulls=True).over(w) for g in ("g1", "g2", "g3")})  # a row per day
    return _r(c.join(days, "date").select("asset", "seg_start", F.col("date").alias("expiry"), F.least("g1", "g2", "g3").alias("premium")), "premium")


QUERIES = {
    "season_labels": labels, "season_table": season_table, "season_look_back": lambda sp, sf: _r(se.look_back(daily(sp, sf), "close"), "score"), "season_group_score": lambda sp, sf: _r(se.group_score(daily(sp, sf), "close"), "score"), "season_yoy": lambda sp, sf: _r(se.yoy(daily(sp, sf), "close"), "v", "yoy"),
    "season_holidays": lambda sp, sf: _r(se.holiday_windows(cal(sp, sf), HOLIDAYS, 3, 2), "weight"), "season_rules": rules, "pnl_signal_bins": bins, "scen_top": top_scenarios, "scen_greedy": greedy, "xs_leaders": leaders, "xs_pairs": pairs, "ts_beta_hedge": recipe(HEDGE),
    "join_completed_week": week_recipe, "clean_gaps": recipe(GAPPED), "stat_two_regressors": two_regressors, "stat_folds": folds, "pos_targets": targets, "risk_portfolio": portfolio_risk, "pnl_hold_period": hold_period, "tick_spread_quote": quotes, "fn_scalars": scalars, "risk_map": risk_map,
    "stat_components": lambda sp, sf: _r(sl.per_matrix(sl.moments(rets(sp, sf)), sl.components, "asset string, component int, loading double, eigenvalue double"), "loading", "eigenvalue"),
    "stat_clusters": lambda sp, sf: sl.per_matrix(sl.moments(rets(sp, sf)), sl.clusters(), "asset string, cluster int"), "stat_least_variance": lambda sp, sf: _r(sl.per_matrix(sl.moments(rets(sp, sf)), sl.least_variance(), "asset string, weight double"), "weight"),
    "stream_indicators": lambda sp, sf: _r(st.running_indicators(sp, st.replayed(sp, sf)), "ma", "don_h", "don_l", "rsi"), "pnl_season_tilt": season_tilt, "join_cheapest": cheapest, "cal_expiries": expiry_days, "fn_map_merge": merged_maps, "stat_johansen": johansen, "roll_forward": forward_rolls, "pnl_traded": traded, "pnl_monthly": monthly, "agg_tenor": tenor_mean, "stream_session_bars": lambda sp, sf: _r(st.session_bars(sp, st.replayed(sp, sf), [540, 690, 900]), *OHLC), "stream_season_stats": lambda sp, sf: _r(st.season_stats(sp, sf), "mean", "sd"),
}
SQL = {
    "season_labels": f"WITH {DAILY_SQL}, d AS (SELECT DISTINCT date FROM s0), n AS (SELECT date, (SELECT y FROM (SELECT unnest([{_NY}]) AS y) ORDER BY abs(date - y), y LIMIT 1) AS ny FROM d) SELECT date, year(ny)::INT AS lunar_year, (date - ny)::INT AS lunar_day, floor((date - ny) / 7.0)::BIGINT AS lunar_week, year(date)::INT AS yr, week(date)::INT AS iso_week, dayofyear(date)::INT AS doy FROM n",
    "season_table": f"""WITH {DAILY_SQL}, d AS (SELECT asset, strftime(date, '%m-%d') AS md, year(date)::INT AS yr, sum(close) AS v FROM s0 GROUP BY ALL),
f AS (SELECT m.asset, m.md, y.yr, d.v FROM (SELECT DISTINCT asset, md FROM d) m JOIN (SELECT DISTINCT asset, yr FROM d) y ON m.asset = y.asset LEFT JOIN d ON d.asset = m.asset AND d.md = m.md AND d.yr = y.yr),
g AS (SELECT *, coalesce(v, lag(v) OVER (PARTITION BY asset, yr ORDER BY md)) AS filled FROM f) SELECT asset, md, yr, {_rs('v', 'filled')} FROM g""",
    "season_look_back": f"WITH {DAILY_SQL}, t AS (SELECT asset, date, close, back, (date - to_years(back))::DATE AS mid FROM s0, (SELECT unnest(range(0, 4))::INT AS back)), w AS (SELECT *, mid - 15 AS lo, CASE WHEN back = 0 THEN date ELSE mid + 15 END AS hi FROM t), g AS (SELECT DISTINCT t.asset, t.date, t.close, q.date AS d, q.close AS v FROM w t JOIN s0 q ON q.asset = t.asset AND q.date BETWEEN t.lo AND t.hi) SELECT asset, date, {tidy_sql('(max(close) - avg(v)) / nullif(stddev_samp(v), 0)')} AS score, count(*) AS n FROM g GROUP BY asset, date",
    "season_group_score": f"WITH {DAILY_SQL}, t AS MATERIALIZED (SELECT asset, date, close, week(date) AS wk FROM s0), g AS (SELECT t.asset, t.date, t.close, q.close AS v FROM t JOIN t q ON q.asset = t.asset AND q.date <= t.date AND (abs(q.wk - t.wk) <= 1 OR abs(q.wk - t.wk) = 52)) SELECT asset, date, {tidy_sql('(max(close) - avg(v)) / nullif(stddev_samp(v), 0)')} AS score, count(*) AS n FROM g GROUP BY asset, date",
    "season_yoy": f"WITH {DAILY_SQL}, w AS (SELECT asset, isoyear(date)::INT AS yr, week(date)::INT AS wk, avg(close) AS v FROM s0 GROUP BY ALL), f AS (SELECT y.asset, y.yr, k.wk, last_value(w.v IGNORE NULLS) OVER (PARTITION BY y.asset ORDER BY y.yr, k.wk ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT DISTINCT asset, yr FROM w) y CROSS JOIN (SELECT unnest(range(1, 54))::INT AS wk) k LEFT JOIN w ON w.asset = y.asset AND w.yr = y.yr AND w.wk = k.wk), o AS (SELECT *, v / lag(v) OVER (PARTITION BY asset, wk ORDER BY yr) - 1 AS yoy FROM f) SELECT asset, yr, wk, {_rs('v', 'yoy')} FROM o",
    "season_holidays": f"WITH {CAL_SQL}, h(h, weight) AS (VALUES {', '.join(f'''(DATE '{d}', {w})''' for d, w in HOLIDAYS)}), b AS (SELECT bday_no, weight FROM h JOIN cal ON date = h) SELECT c.date, {tidy_sql('coalesce((SELECT sum(weight) FROM b WHERE c.bday_no BETWEEN b.bday_no - 3 AND b.bday_no + 2), 0)')} AS weight FROM cal c",
    "season_rules": f"WITH {DAILY_SQL}, d AS (SELECT DISTINCT date FROM s0) SELECT date, {tidy_sql('''(CASE WHEN isodow(date) = 1 AND day(date) <= 15 THEN 1.0 ELSE 0 END - CASE WHEN month(date) = 12 THEN 1.0 ELSE 0 END + CASE WHEN date BETWEEN DATE '1998-03-01' AND DATE '1998-06-30' THEN 0.5 ELSE 0 END)''')} AS signal FROM d",
    "pnl_signal_bins": f"WITH {z_sql()}, n AS (SELECT *, lead(ret) OVER (PARTITION BY asset ORDER BY date) AS nx FROM z0), b AS (SELECT *, ntile(5) OVER (PARTITION BY asset ORDER BY z, date)::INT AS bin FROM n WHERE nx IS NOT NULL AND vol IS NOT NULL) SELECT asset, bin, {tidy_sql('avg(nx)')} AS mean, {tidy_sql('quantile_cont(nx, 0.25)')} AS q25, {tidy_sql('quantile_cont(nx, 0.75)')} AS q75, {tidy_sql('avg(nx) / nullif(stddev_samp(nx), 0) * sqrt(244)')} AS sharpe, count(*) AS n FROM b GROUP BY asset, bin",
    "scen_top": f"WITH {SCEN_SQL}, c AS (SELECT asset, scen, avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(244) AS sharpe, sum(pnl) AS total FROM sc GROUP BY ALL), w AS (SELECT *, round(0.7 * sharpe + 0.3 * total, 9) AS w FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY w DESC, scen)::INT AS place FROM w) SELECT asset, scen, place, {_rs('sharpe', 'total', 'w')} FROM p WHERE place <= 2",
    "xs_leaders": f"WITH {z_sql()}, l AS (SELECT substr(asset, 7, 1) AS grp, date, avg(z) AS lead FROM z0 WHERE asset LIKE '%1' GROUP BY ALL) SELECT asset, z0.date, {_rs('lead')} FROM z0 JOIN l ON l.grp = substr(asset, 7, 1) AND l.date = z0.date WHERE NOT asset LIKE '%1'",
    "xs_pairs": PAIR_SQL, "ts_beta_hedge": HEDGE.oracle(DAILY_SQL), "clean_gaps": GAPPED.oracle(DAILY_SQL),
    "join_completed_week": f"WITH {DAILY_SQL}, a AS (SELECT *, avg(close) OVER (PARTITION BY asset, date_trunc('week', date)) AS wmean, row_number() OVER (PARTITION BY asset, date_trunc('week', date) ORDER BY date) AS nr FROM s0), b AS (SELECT *, lag(wmean) OVER (PARTITION BY asset ORDER BY date) AS pm FROM a), c AS (SELECT *, last_value(CASE WHEN nr = 1 THEN pm END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS done FROM b) SELECT asset, date, {_rs('done')}, {tidy_sql('close - done')} AS over FROM c",
    "stat_two_regressors": f"WITH {z_sql()}, g AS (SELECT asset, {FIT2.format(c='', y='ret', a='z', b='vol')} FROM z0 WHERE ret IS NOT NULL AND vol IS NOT NULL GROUP BY asset), b AS (SELECT *, (ya * bb - yb * ab) / nullif(aa * bb - ab * ab, 0) AS b1, (yb * aa - ya * ab) / nullif(aa * bb - ab * ab, 0) AS b2 FROM g) SELECT asset, n, {tidy_sql('my - b1 * ma - b2 * mb')} AS b0, {_rs('b1', 'b2')} FROM b",
    "stat_folds": f"WITH {z_sql()}, f(fold, lo, hi) AS (VALUES (0, DATE '1995-01-01', DATE '1997-01-01'), (1, DATE '1997-01-01', DATE '1999-01-04'), (2, DATE '1999-01-04', DATE '2002-01-01')) SELECT fold, {tidy_sql('regr_slope(ret, z)')} AS slope, {tidy_sql('regr_r2(ret, z)')} AS r2, count(*) AS n FROM z0 JOIN f ON date BETWEEN lo AND hi WHERE ret IS NOT NULL GROUP BY fold",
    "pos_targets": f"WITH {z_sql()}, a AS (SELECT *, 0.6 * (z - avg(z) OVER (PARTITION BY date)) + 0.4 * (sign(ret) - avg(sign(ret)) OVER (PARTITION BY date)) AS raw FROM z0 WHERE vol IS NOT NULL), b AS (SELECT *, raw / nullif(vol, 0) AS pos FROM a), c AS (SELECT *, sign(pos) * floor(abs(round(pos, 9)) / 4 + 0.5) * 4 AS lots FROM b) SELECT asset, date, {_rs('lots')}, {tidy_sql('lots - coalesce(lag(lots) OVER (PARTITION BY asset ORDER BY date), 0)')} AS change FROM c",
    "risk_portfolio": f"WITH {HOLD_SQL}, r AS MATERIALIZED (SELECT asset, date, ret FROM z0 WHERE ret IS NOT NULL), c AS MATERIALIZED (SELECT x.asset AS a, y.asset AS b, covar_samp(x.ret, y.ret) AS cov FROM r x JOIN r y USING (date) GROUP BY ALL), h AS MATERIALIZED (SELECT asset, date, holding FROM hl WHERE holding IS NOT NULL) SELECT x.date, {tidy_sql('sqrt(sum(x.holding * cov * y.holding))')} AS risk FROM h x JOIN h y USING (date) JOIN c ON c.a = x.asset AND c.b = y.asset GROUP BY x.date",
    "pnl_hold_period": f"WITH {HOLD_SQL}, h AS (SELECT asset, holding, abs(holding - lag(holding) OVER (PARTITION BY asset ORDER BY date)) AS d FROM hl WHERE holding IS NOT NULL) SELECT asset, {tidy_sql('2 * sum(abs(holding)) / nullif(sum(d), 0)')} AS days FROM h GROUP BY asset",
    "tick_spread_quote": f"""WITH {TICKS_SQL}, l AS (SELECT *, unnest([asset, asset - 1]) AS pair FROM ticks WHERE price IS NOT NULL),
q AS (SELECT pair, event_id, last_value(CASE WHEN asset = pair THEN price END IGNORE NULLS) OVER w AS a, last_value(CASE WHEN asset = pair + 1 THEN price END IGNORE NULLS) OVER w AS b FROM l WINDOW w AS (PARTITION BY pair ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT pair, event_id, {tidy_sql(f'a - b - {2 * HALF_SPREAD}')} AS bid, {tidy_sql(f'a - b + {2 * HALF_SPREAD}')} AS ask FROM q WHERE a IS NOT NULL AND b IS NOT NULL""",
    "fn_scalars": SCALAR_SQL,
    "risk_map": f"SELECT n_regionkey, bucket, {tidy_sql('sum(c_acctbal * w)')} AS risk FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES ('near', 0.75::DOUBLE), ('far', 0.25::DOUBLE)) m(bucket, w) GROUP BY ALL",
    "roll_forward": f"WITH {FUTURES_SQL}, t AS (SELECT asset, date, contract AS best FROM fb QUALIFY row_number() OVER (PARTITION BY asset, date ORDER BY volume DESC, contract) = 1) SELECT asset, date, best, max(best) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS in_use FROM t",
    "pnl_traded": f"WITH {z_sql()}, p AS (SELECT asset, date, sign(z) AS pos, open, close, coalesce(lag(sign(z)) OVER w, 0) AS held, lag(close) OVER w AS pc1 FROM z0 WINDOW w AS (PARTITION BY asset ORDER BY date)) SELECT asset, date, {tidy_sql('coalesce(held * (close - pc1), 0) + (pos - held) * (close - open)')} AS pnl FROM p",
    "pnl_monthly": f"WITH {HOLD_SQL} SELECT asset, date_trunc('month', date)::DATE AS m, {tidy_sql('sum(pnl)')} AS total FROM pl GROUP BY asset, date_trunc('month', date)",
    "agg_tenor": f"WITH u AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS tenor, avg(o_totalprice) AS px FROM orders GROUP BY 1 UNION ALL SELECT date_trunc('quarter', l_shipdate)::DATE, avg(l_extendedprice) FROM lineitem GROUP BY 1) SELECT tenor, {tidy_sql('avg(px)')} AS px, count(*) AS n FROM u GROUP BY tenor",
    "stream_session_bars": f"WITH {TICKS_SQL}, p AS (SELECT *, (minute >= 540)::INT + (minute >= 690)::INT + (minute >= 900)::INT AS part FROM ticks) SELECT asset, date, part, {tidy_sql('first(price ORDER BY ts, event_id)')} AS open, {tidy_sql('max(price)')} AS high, {tidy_sql('min(price)')} AS low, {tidy_sql('last(price ORDER BY ts, event_id)')} AS close, count(*) AS n_ticks FROM p GROUP BY asset, date, part",
    "stream_season_stats": f"WITH {TICKS_SQL} SELECT asset, hour(ts)::INT AS hour, count(price) AS n, {tidy_sql('avg(price)')} AS mean, {tidy_sql('stddev_pop(price)')} AS sd FROM ticks WHERE price IS NOT NULL GROUP BY asset, hour(ts)",
    "cal_expiries": "WITH c AS (SELECT unnest(generate_series(date_trunc('month', min(l_shipdate))::DATE, last_day(max(l_shipdate)::DATE), INTERVAL 1 DAY))::DATE AS date FROM lineitem), b AS (SELECT date, date_trunc('month', date)::DATE AS month, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date) AS nth, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date DESC) AS lft FROM c WHERE isodow(date) <= 5) SELECT month, min(date) FILTER (day(date) >= 15) AS fifteenth, max(date) FILTER (nth = 10) AS tenth_bday, max(date) FILTER (isodow(date) = 5 AND day(date) BETWEEN 15 AND 21) AS third_friday, max(date) FILTER (lft = 3) AS third_last FROM b GROUP BY month",
    "fn_map_merge": "WITH a AS (SELECT n_regionkey, n_name, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), b AS (SELECT n_regionkey, n_name, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) SELECT n_regionkey, n_name, 2.0::DOUBLE * coalesce(a.c, 0) - coalesce(b.c, 0) AS v FROM a FULL JOIN b USING (n_regionkey, n_name) WHERE n_regionkey IN (SELECT n_regionkey FROM a) AND n_regionkey IN (SELECT n_regionkey FROM b)",
    "stream_indicators": f"WITH RECURSIVE {TICKS_SQL}, n AS MATERIALIZED (SELECT asset, event_id, price, row_number() OVER w - 1 AS rn, price - lag(price) OVER w AS d, CASE WHEN count(*) OVER x >= 20 THEN avg(price) OVER x END AS ma, CASE WHEN count(*) OVER x >= 20 THEN max(price) OVER x END AS don_h, CASE WHEN count(*) OVER x >= 20 THEN min(price) OVER x END AS don_l FROM ticks WHERE price IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY ts, event_id), x AS (PARTITION BY asset ORDER BY ts, event_id ROWS 19 PRECEDING)), r(asset, rn, up, down) AS (SELECT asset, rn, greatest(d, 0), greatest(-d, 0) FROM n WHERE rn = 1 UNION ALL SELECT n.asset, n.rn, r.up + (greatest(n.d, 0) - r.up) / 14, r.down + (greatest(-n.d, 0) - r.down) / 14 FROM r JOIN n ON n.asset = r.asset AND n.rn = r.rn + 1) SELECT event_id, asset, {_rs('ma', 'don_h', 'don_l')}, {tidy_sql('100 * up / nullif(up + down, 0)')} AS rsi FROM n LEFT JOIN r USING (asset, rn)",
    "pnl_season_tilt": f"WITH {HOLD_SQL}, h AS MATERIALIZED (SELECT asset, date, holding, strftime(date, '%m-%d') AS md, year(date) AS y FROM hl WHERE holding IS NOT NULL), g AS (SELECT a.asset, a.date, max(a.holding) AS holding, avg(b.holding) AS tilt FROM h a LEFT JOIN h b ON b.asset = a.asset AND b.md = a.md AND b.y BETWEEN a.y - 3 AND a.y - 1 GROUP BY ALL) SELECT asset, date, {_rs('tilt')}, {tidy_sql('holding - tilt')} AS timing FROM g",
    "join_cheapest": f"WITH {CHAIN_SQL}, e AS (SELECT asset, seg_start, max(date) AS date FROM ch GROUP BY ALL), o AS (SELECT o_orderdate::DATE AS date, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS g1, avg(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') AS g2, avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS g3 FROM orders GROUP BY 1), d AS (SELECT coalesce(x.date, o.date) AS date, g1, g2, g3 FROM (SELECT DISTINCT date FROM e) x FULL JOIN o ON x.date = o.date), f AS (SELECT date, last_value(g1 IGNORE NULLS) OVER w AS g1, last_value(g2 IGNORE NULLS) OVER w AS g2, last_value(g3 IGNORE NULLS) OVER w AS g3 FROM d WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)) SELECT asset, seg_start, date AS expiry, {tidy_sql('least(g1, g2, g3)')} AS premium FROM e JOIN f USING (date)",
}
