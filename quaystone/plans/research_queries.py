"""Registered queries of signals with memory, back-tests, statistics, risk and streaming."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaystone.functions import kernels as kn
from quaystone.functions.recipe import Ewm, Recipe, lag, quantile, roll, s, span, tidy, tidy_sql
from quaystone.operators import profiles as pf
from quaystone.operators import research as rs
from quaystone.plans.market_queries import OHLC, _r, _rs
from quaystone.sources.panels import DAILY_SQL, TICKS_SQL, daily, read
from quaystone.streaming import bars as st

Z = Recipe([{"pc": lag("close"), "m": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20)}, {"ret": s("ln(close / pc)"), "z": s("coalesce((close - m) / nullif(sd, 0), 0)")}, {"vol": roll("stddev_samp", "ret", 20)}, {"gap": s("0.2 * pow(3 * 0.001 / nullif(coalesce(vol, 1), 0), 1e0 / 3)")}], ("z", "ret", "vol", "gap"))


def z_sql() -> str:
    """WITH items that end in z0: asset, date, rn and the columns of Z, unrounded."""
    text = Z.oracle(DAILY_SQL)
    head = text[len("WITH ") : text.rindex(" SELECT asset")]
    last = text.rsplit(" FROM ", 1)[1]
    return f"{head}, z0 AS MATERIALIZED (SELECT * FROM {last})"


def z_panel(spark, sf):
    return Z.apply(daily(spark, sf))


def scanned(step, inputs, states, keep):
    def run(spark, sf):
        out = kn.scan(z_panel(spark, sf), step, inputs, states)
        return out.select("asset", "date", *[tidy(out, c) for c in keep])

    return run


def holdings(spark, sf):
    """Signal over volatility at a target risk; what is held is known at the day's end."""
    return z_panel(spark, sf).select("asset", "date", "rn", "ret", (F.col("z") / F.col("vol") * 0.01).alias("holding"))


HOLD_SQL = f"{z_sql()}, hl AS (SELECT asset, date, ret, z / vol * 0.01 AS holding, lag(z / vol * 0.01) OVER (PARTITION BY asset ORDER BY date) AS held FROM z0), pl AS MATERIALIZED (SELECT *, coalesce(held * ret, 0) - coalesce(abs(held - lag(held) OVER (PARTITION BY asset ORDER BY date)), 0) * 0.0005 AS pnl FROM hl)"
_STATS = f"""count(*) AS days, sum(pnl) AS total, avg(CASE WHEN pnl <> 0 THEN (pnl > 0)::INT::DOUBLE END) AS success, min(dd) AS max_dd, avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt({rs.YEAR}) AS sharpe, avg(pnl) / nullif(stddev_pop(pnl), 0) * sqrt({rs.YEAR}) AS sharpe_pop,
 avg(pnl) / nullif(sqrt(avg(pow(least(pnl, 0), 2))), 0) * sqrt({rs.YEAR}) AS sortino, avg(pnl) * {rs.YEAR} / nullif(-min(dd), 0) AS calmar"""


def stats_sql(src: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"cs AS (SELECT *, sum(pnl) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING) AS cum FROM {src}), cd AS (SELECT *, cum - greatest(max(cum) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS dd FROM cs), sa AS (SELECT {k}, {_STATS} FROM cd GROUP BY {k})"


STATS = ("total", "success", "max_dd", "sharpe", "sharpe_pop", "sortino", "calmar")


def pnl_daily(spark, sf):
    return _r(rs.pnl(holdings(spark, sf)).select("asset", "date", "pnl"), "pnl")


def portfolio(spark, sf):
    return rs.pnl(holdings(spark, sf)).groupBy("date").agg(F.sum("pnl").alias("pnl"))


def stats_by_tenor(spark, sf):
    return _r(rs.stats(rs.tenors(portfolio(spark, sf), [0, 1, 3]), "tenor"), *STATS)


def stats_by_asset(spark, sf):
    return _r(rs.stats(rs.pnl(holdings(spark, sf)), "asset"), *STATS)


def calendar_pnl(spark, sf):
    p = portfolio(spark, sf).withColumn("x", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), e.cast("long").alias("label")) for k, e in (("year", F.year("date")), ("month", F.month("date")), ("weekday", F.weekday("date")))])))
    return _r(p.groupBy("x.kind", "x.label").agg(F.sum("pnl").alias("total"), (F.avg("pnl") / F.nullif(F.stddev_samp("pnl"), F.lit(0)) * math.sqrt(rs.YEAR)).alias("sharpe")), "total", "sharpe")


def grid(spark, sf):
    """Scenarios of momentum window and threshold: each window's signal is worked out once, thresholds share it."""
    d = daily(spark, sf)
    w = Window.partitionBy("asset").orderBy("date")
    wins, cuts = [5, 20, 60], [0.0, 0.05, 0.1]
    d = d.withColumns({"ret": F.ln(F.col("close") / F.lag("close").over(w))} | {f"m{n}": F.ln(F.col("close") / F.lag("close", n).over(w)) for n in wins})
    each = d.select("asset", "date", "ret", F.explode(F.array(*[F.struct(F.lit(n).alias("win"), F.col(f"m{n}").alias("mom")) for n in wins])).alias("x")).select("asset", "date", "ret", "x.*").withColumn("cut", F.explode(F.lit(cuts)))
    pos = each.withColumn("holding", F.when(F.col("mom") > F.col("cut"), 1.0).when(F.col("mom") < -F.col("cut"), -1.0).otherwise(0.0))
    k = Window.partitionBy("win", "cut", "asset").orderBy("date")
    p = pos.withColumn("pnl", F.coalesce(F.lag("holding").over(k) * F.col("ret"), F.lit(0.0)))
    by_date = p.groupBy("win", "cut", "date").agg(F.sum("pnl").alias("pnl"))
    out = by_date.groupBy("win").pivot("cut", cuts).agg(F.avg("pnl") / F.stddev_samp("pnl") * math.sqrt(rs.YEAR))
    return _r(out.select("win", *[F.col(f"`{c}`").alias(f"cut{i}") for i, c in enumerate(cuts)]), "cut0", "cut1", "cut2")


GRID_SQL = f"""WITH {DAILY_SQL}, d AS (SELECT *, ln(close / lag(close) OVER w) AS ret, ln(close / lag(close, 5) OVER w) AS m5, ln(close / lag(close, 20) OVER w) AS m20, ln(close / lag(close, 60) OVER w) AS m60 FROM s0 WINDOW w AS (PARTITION BY asset ORDER BY date)),
e AS (SELECT asset, date, ret, x.win, x.mom, c.cut FROM (SELECT asset, date, ret, unnest([{{'win': 5, 'mom': m5}}, {{'win': 20, 'mom': m20}}, {{'win': 60, 'mom': m60}}]) AS x FROM d), (VALUES (0.0::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) c(cut)),
p AS (SELECT *, coalesce(lag(CASE WHEN mom > cut THEN 1.0 WHEN mom < -cut THEN -1.0 ELSE 0.0 END) OVER (PARTITION BY win, cut, asset ORDER BY date) * ret, 0) AS pnl FROM e),
q AS (SELECT win, cut, date, sum(pnl) AS pnl FROM p GROUP BY ALL), g AS (SELECT win, cut, avg(pnl) / stddev_samp(pnl) * sqrt({rs.YEAR}) AS v FROM q GROUP BY ALL)
SELECT win, {', '.join(f'{tidy_sql(f"max(v) FILTER (cut = {c})")} AS cut{i}' for i, c in enumerate((0.0, 0.05, 0.1)))} FROM g GROUP BY win"""


SHIFTS, SAMPLES = range(-20, 61), 5


def lead_lag(spark, sf):
    """Sharpe of the portfolio with its holdings moved from 20 days early to 60 days late, over all days and five parts of them."""
    return _r(pf.lead_lag(holdings(spark, sf).where("holding IS NOT NULL"), SHIFTS, SAMPLES), "sharpe")


LEAD_SQL = f"""WITH {z_sql()}, h AS MATERIALIZED (SELECT asset, rn, date, ret, z / vol * 0.01 AS holding FROM z0 WHERE z / vol * 0.01 IS NOT NULL), x AS (SELECT asset, shift, rn + shift AS rn, holding FROM h, (SELECT unnest(range({SHIFTS.start}, {SHIFTS.stop})) AS shift)),
n AS (SELECT date, ntile({SAMPLES}) OVER (ORDER BY date) AS part FROM (SELECT DISTINCT date FROM h)), d AS (SELECT shift, h.date, sum(x.holding * h.ret) AS pnl FROM x JOIN h USING (asset, rn) GROUP BY ALL),
e AS (SELECT shift, unnest([0, part]) AS sample, pnl FROM d JOIN n USING (date)), k AS (SELECT shift, sample FROM (SELECT unnest(range({SHIFTS.start}, {SHIFTS.stop})) AS shift), (SELECT unnest(range(0, {SAMPLES + 1})) AS sample))
SELECT shift::INT AS shift, sample::INT AS sample, {tidy_sql(f'avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt({pf.YEAR})')} AS sharpe, count(pnl) AS days FROM k LEFT JOIN e USING (shift, sample) GROUP BY ALL"""

WINS, CUTS, TENORS = (5, 10, 20, 40, 60, 120, 240), (0.0, 0.02, 0.05, 0.1, 0.2), {"all": None, "1y": 1, "2y": 2, "3y": 3}
GRID_STATS = ("mean", "sd", "total", "worst", "sharpe")


def scenarios(spark, sf):
    """Momentum over seven windows and five thresholds: statistics by scenario and tenor."""
    w = Window.partitionBy("asset").orderBy("date")
    moms = F.array(*[F.struct(F.lit(n).alias("win"), F.ln(F.col("close") / F.lag("close", n).over(w)).alias("signal")) for n in WINS])
    d = daily(spark, sf).select("asset", "date", F.ln(F.col("close") / F.lag("close").over(w)).alias("ret"), moms.alias("m"))
    return _r(pf.grid(d.select("asset", "date", "ret", F.explode("m").alias("m")).select("asset", "date", "ret", "m.*"), list(CUTS), TENORS), *GRID_STATS)


_MOMS = ", ".join(f"{{'win': {n}, 'signal': ln(close / lag(close, {n}) OVER w)}}" for n in WINS)
_GRID_STATS = {"mean": "avg(pnl)", "sd": "stddev_samp(pnl)", "total": "sum(pnl)", "worst": "min(pnl)", "sharpe": f"avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt({pf.YEAR})"}
SCENARIOS_SQL = f"""WITH {DAILY_SQL}, d AS (SELECT asset, date, ln(close / lag(close) OVER w) AS ret, [{_MOMS}] AS m FROM s0 WINDOW w AS (PARTITION BY asset ORDER BY date)),
e AS (SELECT asset, date, ret, x.win, x.signal, cut FROM (SELECT asset, date, ret, unnest(m) AS x FROM d), (SELECT unnest([{', '.join(f'{c}::DOUBLE' for c in CUTS)}]) AS cut)),
p AS (SELECT win, cut, date, coalesce(lag(CASE WHEN signal > cut THEN 1.0 WHEN signal < -cut THEN -1.0 ELSE 0 END) OVER (PARTITION BY win, cut, asset ORDER BY date) * ret, 0) AS pnl FROM e), g AS (SELECT win, cut, date, sum(pnl) AS pnl FROM p GROUP BY ALL),
t(tenor, years) AS (VALUES ('all', NULL), ('1y', 1), ('2y', 2), ('3y', 3)), l AS (SELECT max(date) AS last FROM g)
SELECT win, cut, tenor, count(pnl) AS days, {', '.join(f'{tidy_sql(v)} AS {k}' for k, v in _GRID_STATS.items())} FROM g, t, l WHERE years IS NULL OR date > (last - to_months(12 * years))::DATE GROUP BY win, cut, tenor"""


def rets(spark, sf):
    return z_panel(spark, sf).where("ret IS NOT NULL").select("asset", "date", "ret")


def weights(spark, sf):
    return rets(spark, sf).groupBy("asset").agg((F.count("*") / 1000 - 1.5).alias("w"))


def summary(spark, sf):
    n = F.count("ret")
    out = rets(spark, sf).groupBy("asset").agg(F.avg("ret").alias("mean"), F.percentile("ret", 0.5).alias("median"), F.stddev_samp("ret").alias("sd"), (F.skewness("ret") * F.sqrt(n * (n - 1.0)) / (n - 2.0)).alias("skew"), ((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis("ret") + 6)).alias("kurt"))
    return _r(out, "mean", "median", "sd", "skew", "kurt")


def variance_ratio(spark, sf):
    """Variance of k-day over k times that of one-day log changes."""
    d, w = daily(spark, sf), Window.partitionBy("asset").orderBy("date")
    d = d.withColumns({f"r{k}": F.ln(F.col("close") / F.lag("close", k).over(w)) for k in (1, 2, 5, 10)})
    return _r(d.groupBy("asset").agg(*[(F.var_samp(f"r{k}") / (k * F.var_samp("r1"))).alias(f"vr{k}") for k in (2, 5, 10)]), "vr2", "vr5", "vr10")


HURST_LAGS = range(2, 100)


def hurst(spark, sf):
    """Slope of the log deviation of k-day log-price changes on log k, k = 2 to 99."""
    d, w = daily(spark, sf), Window.partitionBy("asset").orderBy("date")
    ks = HURST_LAGS
    d = d.withColumns({f"d{k}": F.ln("close") - F.lag(F.ln("close"), k).over(w) for k in ks})
    sds = d.groupBy("asset").agg(*[F.stddev_pop(f"d{k}").alias(f"s{k}") for k in ks])
    long = sds.select("asset", F.explode(F.array(*[F.struct(F.lit(math.log(k)).alias("x"), F.ln(f"s{k}").alias("y")) for k in ks])).alias("p")).select("asset", "p.*")
    return _r(long.groupBy("asset").agg(F.regr_slope("y", "x").alias("hurst")), "hurst")


def half_life(spark, sf):
    d, w = daily(spark, sf), Window.partitionBy("asset").orderBy("date")
    d = d.withColumn("l", F.lag("close").over(w)).withColumn("d", F.col("close") - F.col("l"))
    return _r(d.groupBy("asset").agg(F.regr_slope("d", "l").alias("slope")).withColumn("half_life", F.when(F.col("slope") < 0, -math.log(2) / F.col("slope"))), "slope", "half_life")


def rollup(spark, sf):
    """Balances by region, nation and segment with totals."""
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return _r(c.cube("r_name", "c_mktsegment").agg(F.sum("c_acctbal").alias("bal"), F.count("*").alias("n")), "bal")


def positions(spark, sf):
    """Old positions and trades by full join: new position, rounded to lots half away from zero, and margin."""
    old = read(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.sum("s_acctbal").alias("old"))
    trade = read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sum("c_acctbal").alias("trade"))
    j = old.join(trade, "k", "full").select("k", F.coalesce("old", F.lit(0.0)).alias("old"), F.coalesce("trade", F.lit(0.0)).alias("trade"))
    new = F.col("old") + F.col("trade")
    lots = F.signum(new) * F.floor(F.abs(new) / 40 + 0.5) * 40
    return _r(j.select("k", new.alias("pos"), lots.alias("lots"), (F.abs(lots) * 0.1).alias("margin")), "pos", "lots", "margin")


def json_props(spark, sf):
    t = read(spark, sf, "events")
    return t.select("event_id", F.length("props").cast("long").alias("n"), F.get_json_object("props", "$.k").alias("k"))


def responses(spark, sf):
    z = z_panel(spark, sf)
    kinds = ("reverting", "absorbing", "sigmoid", "semilinear", "buffer", "band", "sign")
    return _r(z.select("asset", "date", *[rs.response(k, F.col("z")).alias(k) for k in kinds]), *kinds)


def responses_sql() -> str:
    p = 1.0
    phi, tail = math.exp(-0.5) / math.sqrt(2 * math.pi), 0.5 * math.erfc(1 / math.sqrt(2))
    clip = "least(1.0, greatest(-1.0, z))"
    e = {
        "reverting": f"{(1 + 2 / p**2) ** 0.75!r} * z * exp(-0.5 * z * z)", "absorbing": f"{7 ** 1.75 / math.sqrt(15)!r} * z * z * z * exp(-1.5 * z * z)",
        "sigmoid": f"z / sqrt(1 + z * z) / {math.sqrt(1 - math.sqrt(math.pi / 2) * math.exp(0.5) * math.erfc(1 / math.sqrt(2)))!r}", "semilinear": f"{clip} / {math.sqrt(1 - 2 * phi)!r}",
        "buffer": f"(z - {clip}) / {math.sqrt(2 * (2 * tail - phi))!r}", "band": f"CASE WHEN abs(z) > 1 THEN z ELSE 0 END / {math.sqrt(2 * tail + 2 * phi)!r}", "sign": "CASE WHEN z >= 0 THEN 1.0 ELSE -1.0 END",
    }
    return f"WITH {z_sql()} SELECT asset, date, {', '.join(f'{tidy_sql(v)} AS {k}' for k, v in e.items())} FROM z0"


def trades(spark, sf):
    z = kn.scan(z_panel(spark, sf), kn.hysteresis(1.0, 0.5), ["z"], {"pos": 0.0, "seen": 0.0})
    out = kn.lifo_trades(z.join(daily(spark, sf).select("asset", "date", F.col("close").alias("price")), ["asset", "date"]))
    return _r(out, "size", "entry_price", "exit_price", "profit")


def expanded(spark, sf):
    out = rs.kalman(z_panel(spark, sf).where("ret IS NOT NULL").select("asset", "date", F.col("ret").alias("y"), "z").withColumnRenamed("z", "x"))
    return _r(out, "slope", "intercept")


_TRAIL = {"pos": 0.0, "best": 0.0, "entry": 0.0, "pnl": 0.0}
_SAR = dict.fromkeys(("sar", "side", "extreme", "speed", "h1", "l1", "h2", "l2"), 0.0)


def banded(spark, sf):
    d = Recipe([{"m": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20)}, {"ub": s("m + 2 * sd"), "lb": s("m - 2 * sd")}]).apply(daily(spark, sf))
    out = kn.scan(d, kn.band_stop, ["close", "ub", "lb"], {"upper": math.nan, "lower": math.nan, "trend": 0.0})
    return out.select("asset", "date", *[F.nanvl(tidy(out, c), F.lit(None).cast("double")).alias(c) for c in ("upper", "lower", "trend")])


def filtered(spark, sf):
    """Super passband of closes, with the root mean square of its last 50 values."""
    out = kn.scan(daily(spark, sf), kn.passband(5 / 40, 5 / 60), ["close"], {"spb": 0.0, "before": 0.0, "x": 0.0})
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(-49, 0)
    return _r(out.select("asset", "date", "spb", F.when(F.count("spb").over(w) >= 50, F.sqrt(F.avg(F.col("spb") * F.col("spb")).over(w))).alias("rms")), "spb", "rms")


STOP_COSTS = {"cost": 0.0003, "close_out": 0.001}


def trailing(spark, sf, **costs):
    out = kn.scan(z_panel(spark, sf).withColumn("want", F.signum(F.when(F.abs("z") > 1, F.col("z")).otherwise(0.0))), kn.trail(0.1, **costs), ["open", "high", "low", "close", "want"], _TRAIL)
    return _r(out.select("asset", "date", "pos", "pnl"), "pos", "pnl")


def stream_minutes(spark, sf):
    return _r(st.minute_bars(spark, st.replayed(spark, sf)), *OHLC)


_A = span(5)
#: The batch form of the indicators that the stream of bars carries on.
STREAMED = Recipe(
    [{"pc": lag("close"), "c5": lag("close", 5)}, {"tr": s("greatest(high - low, abs(high - pc), abs(low - pc))")}, Ewm("atr", "tr", _A, adjust=False),
     {"ma": roll("avg", "close", 5), "stdev": roll("stddev_pop", "close", 5), "sq": roll("avg", "close * close", 5), "don_h": roll("max", "high", 5), "don_l": roll("min", "low", 5), "pct_ch": quantile("close", 0.5, 5, shift=1)},
     {f"{f}{x[0]}{n}": roll(f, x, n) for n in (2, 4, 10) for f, x in (("max", "high"), ("min", "low"), ("max", "close"), ("min", "close"))},
     Ewm("ema", "close", _A, adjust=False), {"pe": lag("ema")}, Ewm("emavar", f"{1 - _A!r} * pow(close - pe, 2)", _A, adjust=False),
     {"rise": s("greatest(close - pc, 0 * pc)"), "fall": s("greatest(pc - close, 0 * pc)")}, Ewm("up", "rise", 0.2, adjust=False), Ewm("down", "fall", 0.2, adjust=False),
     {"svar": s("sq - ma * ma"), "rsi": s("100 * up / nullif(up + down, 0)"), "roc": s("close / c5 - 1"), "cmi": s("100 * abs(close - c5) / nullif(don_h - don_l, 0)"), "stoch": s("100 * (close - don_l) / nullif(don_h - don_l, 0)")},
     {"dt_rng": s("greatest(maxh2 - minc2, maxc2 - minl2)"), "tk": s("(maxh4 + minl4) / 2"), "kj": s("(maxh10 + minl10) / 2"), "ha_c": s("(open + high + low + close) / 4")},
     {"lag_c": lag("ha_c")}, Ewm("ha_o", "CASE WHEN rn = 0 THEN open ELSE lag_c END", 0.5, adjust=False), Ewm("fisher", "CASE WHEN don_h > don_l THEN 2 * (close - don_l) / (don_h - don_l) - 1 WHEN don_h IS NOT NULL THEN 0.0 END", 0.7, adjust=False)],
    tuple(c for c in st.BAR_COLUMNS if c != "spb"),
)
TICK_BARS_SQL = f"""{TICKS_SQL}, tb AS (SELECT asset, date, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close FROM ticks WHERE price IS NOT NULL GROUP BY ALL),
s0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS rn FROM tb QUALIFY lead(date) OVER (PARTITION BY asset ORDER BY date) IS NOT NULL)"""


_P = _rs
QUERIES = {
    "sig_hump": scanned(kn.hump(0.5), ["z"], {"pos": 0.0}, ("pos",)),
    "sig_responses": responses, "ind_psar": lambda s_, d: _r(kn.scan(daily(s_, d), kn.parabolic(), ["high", "low"], _SAR).select("asset", "date", "sar", "side"), "sar", "side"), "ind_band_stop": banded, "ind_passband": filtered, "sim_trailing_stop": trailing, "sim_stop_costs": lambda s_, d: trailing(s_, d, **STOP_COSTS), "sim_lifo_trades": trades,
    "pnl_daily": pnl_daily, "pnl_stats_tenor": stats_by_tenor, "pnl_stats_asset": stats_by_asset, "pnl_calendar": calendar_pnl, "pnl_lead_lag": lead_lag, "grid_backtest": grid, "grid_scenarios": scenarios,
    "risk_correlation": lambda s_, d: _r(rs.correlations(rets(s_, d)), "corr", "cov"), "risk_var": lambda s_, d: _r(rs.risk(rets(s_, d), weights(s_, d)), "part", "var95"), "stat_summary": summary, "stat_variance_ratio": variance_ratio, "stat_hurst": hurst, "stat_half_life": half_life,
    "stat_adf": lambda s_, d: _r(rs.adf(daily(s_, d).select("asset", "date", F.ln("close").alias("x"))), "adf"), "stat_kalman": expanded,
    "agg_cube": rollup, "pos_update": positions, "fn_json": json_props, "stream_minute_bars": stream_minutes, "stream_daily_bars": lambda s_, d: _r(st.daily_bars(s_, st.replayed(s_, d)), *OHLC), "stream_bars": lambda s_, d: _r(st.running_bars(s_, st.replayed(s_, d)).drop("spb"), *STREAMED.keep), "stream_running_means": lambda s_, d: _r(st.running_means(s_, st.replayed(s_, d)), "ema", "mean"),
}
_Z0 = z_sql()
SQL = {
    "sig_hysteresis": kn.recursion(_Z0, "z0", {"pos": ("0.0::DOUBLE", "(CASE WHEN r.pos <> 0 AND p.z * r.pos > 0.5 THEN r.pos WHEN abs(p.z) > 1 THEN sign(p.z) ELSE 0 END)::DOUBLE")}, _P("pos")),
    "sig_hump": kn.recursion(_Z0, "z0", {"pos": ("CASE WHEN abs(p.z) >= 0.5 THEN p.z ELSE 0 END", "CASE WHEN abs(p.z - r.pos) >= 0.5 THEN p.z ELSE r.pos END")}, _P("pos")),
    "sig_buffer": kn.recursion(_Z0, "z0", {"pos": ("least(greatest(0, p.z - p.gap), p.z + p.gap)", "least(greatest(r.pos, p.z - p.gap), p.z + p.gap)")}, _P("pos")),
    "sig_responses": responses_sql(),
    "ind_passband": kn.recursion(DAILY_SQL, "s0", {"spb": (f"{5 / 40 - 5 / 60!r} * p.close", f"{5 / 40 - 5 / 60!r} * p.close + {5 / 60 - 5 / 40!r} * r.x + {2 - 5 / 40 - 5 / 60!r} * r.spb - {(1 - 5 / 40) * (1 - 5 / 60)!r} * r.prior"), "prior": ("0::DOUBLE", "r.spb"), "x": ("p.close", "p.close")},
        f"{tidy_sql('spb')} AS spb, {tidy_sql('CASE WHEN count(spb) OVER w >= 50 THEN sqrt(avg(spb * spb) OVER w) END')} AS rms") + " WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)",
    "pnl_daily": f"WITH {HOLD_SQL} SELECT asset, date, {_rs('pnl')} FROM pl",
    "pnl_stats_tenor": f"WITH {HOLD_SQL}, po AS (SELECT date, sum(pnl) AS pnl FROM pl GROUP BY date), tn AS (SELECT date, pnl, tenor FROM po, (VALUES (0), (1), (3)) t(tenor) WHERE tenor = 0 OR date > (SELECT max(date) FROM po) - to_years(tenor)), {stats_sql('tn', 'tenor')} SELECT tenor, days, {_rs(*STATS)} FROM sa",
    "pnl_stats_asset": f"WITH {HOLD_SQL}, {stats_sql('pl', 'asset')} SELECT asset, days, {_rs(*STATS)} FROM sa",
    "pnl_calendar": f"WITH {HOLD_SQL}, po AS (SELECT date, sum(pnl) AS pnl FROM pl GROUP BY date), u AS (SELECT 'year' AS kind, year(date) AS label, pnl FROM po UNION ALL SELECT 'month', month(date), pnl FROM po UNION ALL SELECT 'weekday', isodow(date) - 1, pnl FROM po) SELECT kind, label::BIGINT AS label, {tidy_sql('sum(pnl)')} AS total, {tidy_sql(f'avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt({rs.YEAR})')} AS sharpe FROM u GROUP BY kind, label",
    "pnl_lead_lag": LEAD_SQL, "grid_backtest": GRID_SQL, "grid_scenarios": SCENARIOS_SQL,
    "risk_correlation": f"WITH {_Z0}, r AS (SELECT asset, date, ret FROM z0 WHERE ret IS NOT NULL), c AS (SELECT x.asset AS a, y.asset AS b, corr(x.ret, y.ret) AS corr, covar_samp(x.ret, y.ret) AS cov, count(*) AS n FROM r x JOIN r y ON x.date = y.date AND x.asset < y.asset GROUP BY ALL) SELECT a, b, n, {_rs('corr', 'cov')} FROM c",
    "risk_var": f"WITH {_Z0}, r AS MATERIALIZED (SELECT asset, date, ret FROM z0 WHERE ret IS NOT NULL), w AS (SELECT asset, count(*) / 1000 - 1.5 AS w FROM r GROUP BY asset), c AS (SELECT x.asset AS a, y.asset AS b, covar_samp(x.ret, y.ret) AS cov FROM r x JOIN r y USING (date) GROUP BY ALL), j AS (SELECT a, sum(cov * w.w) AS cw FROM c JOIN w ON w.asset = b GROUP BY a), v AS (SELECT j.a, w.w, cw, sum(cw * w.w) OVER () AS v FROM j JOIN w ON w.asset = a) SELECT a AS asset, {tidy_sql('w * cw / sqrt(v)')} AS part, {tidy_sql('1.6448536269514722 * sqrt(v)')} AS var95 FROM v",
    "stat_summary": f"WITH {_Z0} SELECT asset, {tidy_sql('avg(ret)')} AS mean, {tidy_sql('quantile_cont(ret, 0.5)')} AS median, {tidy_sql('stddev_samp(ret)')} AS sd, {tidy_sql('skewness(ret)')} AS skew, {tidy_sql('kurtosis(ret)')} AS kurt FROM z0 WHERE ret IS NOT NULL GROUP BY asset",
    "stat_variance_ratio": f"WITH {DAILY_SQL}, d AS (SELECT asset, {', '.join(f'ln(close / lag(close, {k}) OVER w) AS r{k}' for k in (1, 2, 5, 10))} FROM s0 WINDOW w AS (PARTITION BY asset ORDER BY date)) SELECT asset, {', '.join(f'{tidy_sql(f"var_samp(r{k}) / ({k} * var_samp(r1))")} AS vr{k}' for k in (2, 5, 10))} FROM d GROUP BY asset",
    "stat_hurst": f"WITH {DAILY_SQL}, d AS (SELECT asset, {', '.join(f'ln(close) - lag(ln(close), {k}) OVER w AS d{k}' for k in HURST_LAGS)} FROM s0 WINDOW w AS (PARTITION BY asset ORDER BY date)), l AS ({' UNION ALL '.join(f'SELECT asset, ln({k}) AS x, ln(stddev_pop(d{k})) AS y FROM d GROUP BY asset' for k in HURST_LAGS)}) SELECT asset, {tidy_sql('regr_slope(y, x)')} AS hurst FROM l GROUP BY asset",
    "stat_half_life": f"WITH {DAILY_SQL}, d AS (SELECT asset, close - lag(close) OVER w AS d, lag(close) OVER w AS l FROM s0 WINDOW w AS (PARTITION BY asset ORDER BY date)), g AS (SELECT asset, regr_slope(d, l) AS slope FROM d GROUP BY asset) SELECT asset, {_rs('slope')}, {tidy_sql('CASE WHEN slope < 0 THEN -ln(2) / slope END')} AS half_life FROM g",
    "agg_cube": f"SELECT r_name, c_mktsegment, {tidy_sql('sum(c_acctbal)')} AS bal, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, c_mktsegment)",
    "stream_bars": STREAMED.oracle(TICK_BARS_SQL),
    "pos_update": f"WITH o AS (SELECT s_nationkey AS k, sum(s_acctbal) AS v FROM supplier GROUP BY 1), t AS (SELECT c_nationkey AS k, sum(c_acctbal) AS v FROM customer GROUP BY 1), j AS (SELECT coalesce(o.k, t.k) AS k, coalesce(o.v, 0) + coalesce(t.v, 0) AS pos FROM o FULL JOIN t ON o.k = t.k), l AS (SELECT k, pos, sign(pos) * floor(abs(pos) / 40 + 0.5) * 40 AS lots FROM j) SELECT k, {_rs('pos', 'lots')}, {tidy_sql('abs(lots) * 0.1')} AS margin FROM l",
    "fn_json": "SELECT event_id, length(props) AS n, json_extract_string(props, '$.k') AS k FROM events",
    "stream_minute_bars": f"WITH {TICKS_SQL} SELECT asset, time_bucket(INTERVAL 5 MINUTE, ts) AS start, {tidy_sql('first(price ORDER BY ts, event_id)')} AS open, {tidy_sql('max(price)')} AS high, {tidy_sql('min(price)')} AS low, {tidy_sql('last(price ORDER BY ts, event_id)')} AS close, count(*) AS n_ticks FROM ticks GROUP BY asset, time_bucket(INTERVAL 5 MINUTE, ts)",
    "stream_daily_bars": f"WITH {TICKS_SQL} SELECT asset, date, {tidy_sql('first(price ORDER BY ts, event_id)')} AS open, {tidy_sql('max(price)')} AS high, {tidy_sql('min(price)')} AS low, {tidy_sql('last(price ORDER BY ts, event_id)')} AS close, count(*) AS n_ticks FROM ticks GROUP BY asset, date",
    "stream_running_means": f"WITH RECURSIVE {TICKS_SQL}, n AS MATERIALIZED (SELECT asset, event_id, price, row_number() OVER w - 1 AS rn, avg(price) OVER (w ROWS UNBOUNDED PRECEDING) AS mean FROM ticks WHERE price IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY ts, event_id)), r(asset, event_id, rn, ema, mean) AS (SELECT asset, event_id, rn, price, mean FROM n WHERE rn = 0 UNION ALL SELECT n.asset, n.event_id, n.rn, {1 - 2 / 11!r} * r.ema + {2 / 11!r} * n.price, n.mean FROM r JOIN n ON n.asset = r.asset AND n.rn = r.rn + 1) SELECT event_id, asset, {_rs('ema', 'mean')} FROM r",
}


def _sar_sql() -> str:
    stop = "(r.sar + r.speed * (r.extreme - r.sar))"
    flip = f"(CASE WHEN r.side > 0 THEN p.low < {stop} ELSE p.high > {stop} END)"
    return kn.recursion(DAILY_SQL, "s0", {
        "sar": ("p.low", f"CASE WHEN {flip} THEN r.extreme WHEN r.side > 0 THEN least({stop}, r.l1, r.l2) ELSE greatest({stop}, r.h1, r.h2) END"),
        "side": ("1e0", f"CASE WHEN {flip} THEN -r.side ELSE r.side END"),
        "extreme": ("p.high", f"CASE WHEN {flip} AND r.side > 0 THEN p.low WHEN {flip} THEN p.high WHEN r.side > 0 THEN greatest(r.extreme, p.high) ELSE least(r.extreme, p.low) END"),
        "speed": ("0.02::DOUBLE", f"CASE WHEN {flip} THEN 0.02::DOUBLE WHEN (r.side > 0 AND p.high > r.extreme) OR (r.side < 0 AND p.low < r.extreme) THEN least(r.speed + 0.02::DOUBLE, 0.2::DOUBLE) ELSE r.speed END"),
        "h1": ("p.high", "p.high"), "l1": ("p.low", "p.low"), "h2": ("p.high", "r.h1"), "l2": ("p.low", "r.l1"),
    }, _rs("sar", "side"))


def _band_sql() -> str:
    base = f"{DAILY_SQL}, m0 AS (SELECT *, CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END AS m, CASE WHEN count(close) OVER w >= 20 THEN stddev_samp(close) OVER w END AS sd FROM s0 WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), b0 AS MATERIALIZED (SELECT asset, date, rn, close, m + 2 * sd AS ub, m - 2 * sd AS lb FROM m0)"
    fresh, trend = "(p.ub IS NULL OR r.upper IS NULL)", "(CASE WHEN p.close > r.upper THEN 1e0 WHEN p.close < r.lower THEN -1e0 ELSE r.trend END)"
    return kn.recursion(base, "b0", {
        "upper": ("p.ub", f"CASE WHEN {fresh} OR {trend} >= 0 THEN p.ub ELSE least(p.ub, r.upper) END"), "lower": ("p.lb", f"CASE WHEN {fresh} OR {trend} <= 0 THEN p.lb ELSE greatest(p.lb, r.lower) END"), "trend": ("0e0", f"CASE WHEN {fresh} THEN r.trend ELSE {trend} END"),
    }, _rs("upper", "lower", "trend"))


def _trail_sql(cost: float = 0.0, close_out: float = 0.0) -> str:
    base = f"{_Z0}, t0 AS MATERIALIZED (SELECT asset, date, rn, open, high, low, close, CASE WHEN abs(z) > 1 THEN sign(z) ELSE 0 END::DOUBLE AS want FROM z0)"
    level = "(r.best * (1 - r.pos * 0.1::DOUBLE))"
    gap = f"(r.pos * (p.open - {level}) <= 0)"
    out = f"(r.pos <> 0 AND ({gap} OR r.pos * (CASE WHEN r.pos > 0 THEN p.low ELSE p.high END - {level}) <= 0))"
    turn = "(p.want <> 0 AND p.want <> r.pos)"
    return kn.recursion(base, "t0", {
        "pos": ("p.want", f"CASE WHEN {out} THEN 0 WHEN {turn} THEN p.want ELSE r.pos END"),
        "best": ("CASE WHEN p.want <> 0 THEN p.close ELSE 0 END", f"CASE WHEN {out} THEN 0 WHEN {turn} THEN p.close WHEN r.pos > 0 THEN greatest(r.best, p.high) WHEN r.pos < 0 THEN least(r.best, p.low) ELSE r.best END"),
        "entry": ("CASE WHEN p.want <> 0 THEN p.close ELSE 0 END", f"CASE WHEN {out} THEN 0 WHEN {turn} THEN p.close ELSE r.entry END"),
        "pnl": (f"CASE WHEN p.want <> 0 THEN -{cost!r}::DOUBLE ELSE 0e0 END", f"r.pnl - CASE WHEN {out} THEN {cost + close_out!r}::DOUBLE WHEN {turn} THEN {cost!r}::DOUBLE * (1 + abs(r.pos)) ELSE 0 END + CASE WHEN {out} THEN r.pos * (CASE WHEN {gap} THEN p.open ELSE {level} END / nullif(r.entry, 0) - 1) WHEN {turn} AND r.pos <> 0 THEN r.pos * (p.close / nullif(r.entry, 0) - 1) ELSE 0 END"),
    }, _rs("pos", "pnl"))


def _kalman_sql() -> str:
    base = f"{_Z0}, k0 AS MATERIALIZED (SELECT asset, date, ret AS y, z AS x, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS rn FROM z0 WHERE ret IS NOT NULL)"
    q = repr(1e-4 / (1 - 1e-4))

    def after(t0: str, t1: str, a: str, b: str, c: str) -> dict[str, str]:
        """The next slope, intercept and covariances from the former ones."""
        a, c = f"({a} + {q})", f"({c} + {q})"
        g0, g1 = f"({a} * p.x + {b})", f"({b} * p.x + {c})"
        total = f"(p.x * {g0} + {g1} + 1e-3)"
        e = f"(p.y - {t0} * p.x - {t1})"
        return {"slope": f"{t0} + {g0} / {total} * {e}", "intercept": f"{t1} + {g1} / {total} * {e}", "pa": f"{a} - {g0} * {g0} / {total}", "pb": f"{b} - {g0} * {g1} / {total}", "pc": f"{c} - {g1} * {g1} / {total}"}

    first, later = after("0e0", "0e0", "0e0", "0e0", "0e0"), after("r.slope", "r.intercept", "r.pa", "r.pb", "r.pc")
    return kn.recursion(base, "k0", {k: (first[k], later[k]) for k in first}, _rs("slope", "intercept"))


SQL |= {"ind_psar": _sar_sql(), "ind_band_stop": _band_sql(), "sim_trailing_stop": _trail_sql(), "sim_stop_costs": _trail_sql(**STOP_COSTS), "stat_kalman": _kalman_sql()}
SQL["stat_adf"] = f"""WITH {DAILY_SQL}, x AS (SELECT asset, ln(close) AS x, lag(ln(close)) OVER w AS a, lag(ln(close), 2) OVER w AS a2 FROM s0 WINDOW w AS (PARTITION BY asset ORDER BY date)),
d AS (SELECT asset, x - a AS y, a, a - a2 AS b FROM x WHERE a2 IS NOT NULL),
g AS (SELECT asset, count(*) AS n, var_samp(y) AS yy, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(y, a) AS ya, covar_samp(y, b) AS yb, covar_samp(a, b) AS ab FROM d GROUP BY asset),
f AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS b1, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS b2 FROM g)
SELECT asset, n, {tidy_sql('b1 / sqrt((yy - b1 * ya - b2 * yb) / (n - 3) * bb / (aa * bb - ab * ab))')} AS adf FROM f"""
