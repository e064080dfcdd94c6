"""Registered queries of stores, look-ups, cleaning rules and intraday factors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaystone.functions.recipe import Ewm, Ex, Recipe, fill, lag, roll, run, s, span, tidy_sql
from quaystone.operators import market as mk
from quaystone.plans.market_queries import CHAIN_SQL, _r, _rs
from quaystone.sources import store
from quaystone.sources.panels import DAILY_SQL, FUTURES_SQL, PRINTS_SQL, TICKS_SQL, bars, bars_sql, daily, futures, prints, read, ticks


def factors(sp, sf):
    path = store.folder(sp, "factors")
    w = Window.partitionBy("asset").orderBy("date")
    store.write_factors(daily(sp, sf).select("asset", "date", (F.col("close") / F.lag("close", 20).over(w) - 1).alias("mom20"), F.ln("volume").alias("lvol"), F.col("oi").alias("oi")), ["mom20", "lvol", "oi"], path)
    return _r(store.read_factors(sp, path, ["mom20", "lvol"], "1997-01-01", "1998-12-31"), "fact_val").select("product_code", "fact_name", "date", "fact_val")


def roll_json(sp, sf):
    path = store.folder(sp, "rolls")
    store.write_roll_json(mk.roll_map(bars(prints(sp, sf), "asset", "contract", "date")), path)
    return store.read_roll_json(sp, path)


def scen_reload(sp, sf):
    """Results of scenarios written by name and read back for some of them."""
    path = store.folder(sp, "scen")
    d = daily(sp, sf).withColumn("scen_id", F.explode(F.lit([1, 2, 3])))
    d.groupBy("scen_id", "asset").agg(F.avg(F.col("close") * F.col("scen_id")).alias("v"), F.to_json(F.struct(F.first("scen_id").alias("win"))).alias("params")).write.partitionBy("scen_id").parquet(path)
    back = sp.read.parquet(path).where("scen_id IN (1, 3)")
    return _r(back.select("asset", F.col("scen_id").cast("int").alias("scen_id"), "v", F.get_json_object("params", "$.win").alias("win")), "v")


def patched(sp, sf):
    d = daily(sp, sf).select("asset", "date", "close")
    return _r(store.patch(d, d.withColumn("close", -F.col("close")), F.col("date").between(F.lit("1997-06-01").cast("date"), F.lit("1997-06-30").cast("date"))), "close")


def layout(sp, sf):
    """Bars with money, change of open interest, integer date and the bucket's end time."""
    b = mk.resample(ticks(sp, sf), 5)
    w = Window.partitionBy("asset").orderBy("date", "bucket")
    out = b.select("asset", F.date_format("date", "yyyyMMdd").cast("int").alias("d"), (F.floor((F.col("bucket") + 1) * 5 / 60) * 100 + (F.col("bucket") + 1) * 5 % 60).cast("int").alias("hhmm"), (F.col("close") * F.col("n_ticks") * 10).alias("money"), (F.col("n_ticks") - F.lag("n_ticks").over(w)).alias("d_oi"))
    return _r(out, "money")


def tick_day(sp, sf):
    """Ticks with their instrument's close of the last day it traded."""
    t = ticks(sp, sf)
    close = t.groupBy("asset", "date").agg(F.max_by("price", F.struct("ts", "event_id")).alias("close"))
    pre = close.withColumn("pre_close", F.lag("close").over(Window.partitionBy("asset").orderBy("date"))).drop("close")
    return _r(t.join(pre, ["asset", "date"]).select("event_id", "asset", "price", "pre_close"), "price", "pre_close")


def trade_file(sp, sf):
    """Signed lots by side, vendor codes to products and lot sizes by a dimension."""
    dim = sp.createDataFrame([("A", "rb", 10), ("N", "cu", 5), ("R", "MA", 20)], "flag string, product string, lot int")
    t = read(sp, sf, "lineitem").join(dim, F.col("l_returnflag") == F.col("flag"))
    side = F.when(F.col("l_linestatus").startswith("O"), -1).otherwise(1)
    return _r(t.groupBy("product", "lot").agg(F.sum(side * F.col("l_quantity")).alias("net"), F.sum(side * F.col("l_quantity") * F.col("lot")).alias("units")), "net", "units")


def vendor(sp, sf):
    """Old prices rescaled, ids lower-cased, pending orders marked as text, and rows that aren't numbers dropped."""
    o = read(sp, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.format_string("%.2f", "o_totalprice"))
    px = text.try_cast("double")
    d = F.to_date("o_orderdate")
    return _r(o.select("o_orderkey", F.lower("o_orderpriority").alias("id"), F.when(d <= F.lit("1997-12-31").cast("date"), px / 100).otherwise(px).alias("px")).where("px IS NOT NULL"), "px")


def deals(sp, sf):
    """Wildcards on one column and a list on another."""
    return _r(read(sp, sf, "part").where(F.col("p_brand").like("Brand#%2") & F.col("p_size").isin(1, 5, 9, 14, 23)).select("p_partkey", "p_brand", "p_size", "p_retailprice"), "p_retailprice")


def curve_on(sp, sf):
    """All contracts of each asset on the asset's last day before a date, by expiry."""
    b = futures(sp, sf).where(F.col("date") <= F.lit("2000-06-30").cast("date"))
    last = b.groupBy("asset").agg(F.max("date").alias("date"))
    return _r(b.join(last, ["asset", "date"]).select("asset", "date", "contract", "expiry", "close"), "close")


def after_expiry(sp, sf):
    """A contract's closes blanked after its asset's third-last month, with the days left."""
    b = bars(prints(sp, sf), "asset", "contract", "date")
    e = b.groupBy("asset").agg(F.add_months(F.max("date"), -3).alias("expiry"))
    return _r(b.join(e, "asset").select("asset", "contract", "date", F.when(F.col("date") <= F.col("expiry"), F.col("close")).alias("px"), F.datediff("expiry", "date").alias("left")), "px")


def main_months(sp, sf):
    """Rows of an asset's main months, with a rule that changes on a day."""
    dim = sp.createDataFrame([("1", "1990-01-01", "1997-12-31", [1, 5, 9]), ("1", "1998-01-01", "2030-01-01", [1, 6, 11]), ("2", "1990-01-01", "2030-01-01", [3, 12])], "grp string, lo string, hi string, months array<int>")
    dim = dim.select("grp", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi"), F.explode("months").alias("m"))
    d = daily(sp, sf).select("asset", "date", F.substring("asset", 7, 1).alias("grp"), F.month("date").alias("m"))
    x = dim.alias("x")
    return d.alias("d").join(x, (F.col("d.grp") == F.col("x.grp")) & (F.col("d.m") == F.col("x.m")) & F.col("d.date").between(F.col("x.lo"), F.col("x.hi")), "left_semi").select("asset", "date")


def derived(sp, sf):
    """Sums, ratios, log ratios and differences of named series of a day."""
    l = read(sp, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(*[F.sum(F.when(F.col("o_orderpriority") == k, F.col("o_totalprice"))).alias(n) for k, n in (("1-URGENT", "a"), ("2-HIGH", "b"), ("5-LOW", "c"))])  # noqa: E741
    return _r(l.select("date", (F.col("a") + F.col("b")).alias("total"), (F.col("a") / F.col("b")).alias("ratio"), F.ln(F.col("a") / F.col("c")).alias("lr"), (F.col("a") - F.col("c")).alias("spread")), "total", "ratio", "lr", "spread")


def stocks(sp, sf):
    """Weighted sum of several inventories by day and product."""
    w = sp.createDataFrame([("A", 1.0), ("N", 0.5), ("R", 0.25)], "l_returnflag string, w double")
    t = read(sp, sf, "lineitem").join(w, "l_returnflag")
    return _r(t.groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("prod")).agg(F.sum(F.col("l_quantity") * F.col("w")).alias("inv")), "inv")


def day_buckets(sp, sf):
    """Labels by rules of which the last that holds wins."""
    c = read(sp, sf, "customer")
    label = F.when(F.col("c_mktsegment") == "BUILDING", "build").when(F.col("c_acctbal") < 0, "short").when(F.col("c_acctbal") > 5000, "large").otherwise("other")
    return c.select("c_custkey", label.alias("label"))


def wide_sessions(sp, sf):
    """Bars of sessions that run across days: a session starts where 12 hours have passed since the last tick."""
    w = Window.partitionBy("asset").orderBy("ts", "event_id")
    t = ticks(sp, sf).withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w))
    t = t.withColumn("part", F.sum(F.when(F.col("gap") > 12 * 3600 * 1_000_000, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _r(t.groupBy("asset", "part").agg(F.min("ts").alias("first_ts"), F.min_by("price", F.struct("ts", "event_id")).alias("open"), F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.count("*").alias("n")), "open", "close")


def realised(sp, sf):
    """Intraday mean, variance, up share, trend strength and signed flow of price changes, by day."""
    w = Window.partitionBy("asset", "date").orderBy("ts", "event_id")
    t = ticks(sp, sf).withColumn("d", F.col("price") - F.lag("price").over(w))
    d2 = F.sum(F.col("d") * F.col("d"))
    out = t.groupBy("asset", "date").agg(F.avg("d").alias("mean"), d2.alias("rv"), (F.sum(F.when(F.col("d") > 0, F.col("d") * F.col("d")).otherwise(0.0)) / F.nullif(d2, F.lit(0))).alias("up_share"), (F.sum("d") / F.nullif(F.sum(F.abs("d")), F.lit(0))).alias("trend"), F.sum(F.signum("d") * F.abs("price")).alias("flow"), F.sum(F.when(F.col("d") > 0, 1).when(F.col("d") < 0, -1).otherwise(0)).alias("ticks_up"), F.skewness("d").alias("skew"), F.kurtosis("d").alias("kurt"), F.count("d").alias("n"))
    flat = F.col("n") < 4
    out = out.withColumns({c: F.when(~flat & (F.col("rv") > 0), F.col(c)) for c in ("skew", "kurt")})
    return _r(out, "mean", "rv", "up_share", "trend", "flow", "skew", "kurt")


def dropped(sp, sf):
    """Keys of one side that the other lacks, and those of both, as sets."""
    a = read(sp, sf, "customer").select(F.col("c_nationkey").alias("k"))
    b = read(sp, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return a.distinct().subtract(b).withColumn("kind", F.lit("missing")).unionByName(a.intersect(b).withColumn("kind", F.lit("both")))


def lags_corr(sp, sf):
    """Correlation of returns with the index's returns k days before, k = -3 to 3."""
    w = Window.partitionBy("asset").orderBy("date")
    d = daily(sp, sf).withColumn("ret", F.ln(F.col("close") / F.lag("close").over(w)))
    d = d.withColumn("idx", F.avg("ret").over(Window.partitionBy("date")))
    d = d.withColumns({f"l{k + 3}": F.lag("idx", k).over(w) if k >= 0 else F.lead("idx", -k).over(w) for k in range(-3, 4)})
    return _r(d.groupBy("asset").agg(*[F.corr("ret", f"l{i}").alias(f"c{i}") for i in range(7)]), *[f"c{i}" for i in range(7)])


#: A stored signal definition: feature, steps before, method, steps after.
CHAIN = Recipe(
    [{"pc": lag("close")}, {"lr": s("ln(close / pc)")}, {"df": s("CASE WHEN lr IS NOT NULL THEN lr ELSE 0 END")}, {"csum": run("sum", "df")}, {"sma": roll("avg", "csum", 5)}, {"m": roll("avg", "sma", 30), "sd": roll("stddev_samp", "sma", 30)},
     {"z": s("(sma - m) / nullif(sd, 0)")}, {"capped": s("CASE WHEN z IS NOT NULL THEN greatest(-2.0, least(2.0, z)) END")}, Ewm("smooth", "capped", span(5)), {"pos_only": s("CASE WHEN smooth IS NOT NULL THEN greatest(smooth, 0.0) END"), "neg_only": s("CASE WHEN smooth IS NOT NULL THEN least(smooth, 0.0) END"), "side": s("sign(smooth)")}],
    ("smooth", "pos_only", "neg_only", "side"),
)
#: Vector strategies: cross of averages inside a channel, and break of the dual-thrust range.
STRATEGY = Recipe(
    [{"fast": roll("avg", "close", 5), "slow": roll("avg", "close", 20), "top": roll("max", "high", 10, shift=1), "bottom": roll("min", "low", 10, shift=1), "hh": roll("max", "high", 2, shift=1), "lc": roll("min", "close", 2, shift=1)},
     {"crossed": s("CASE WHEN fast > slow AND close > top THEN 1 WHEN fast < slow AND close < bottom THEN -1 WHEN (fast > slow) <> (close > slow) THEN 0 END"), "thrust": s("CASE WHEN close > open + 0.5 * (hh - lc) THEN 1 WHEN close < open - 0.5 * (hh - lc) THEN -1 END")},
     {"held": fill("crossed"), "held_t": fill("thrust")}, {"pos_cross": s("coalesce(held, 0)"), "pos_thrust": s("coalesce(held_t, 0)")}],
    ("pos_cross", "pos_thrust"),
)

def recipe(r):
    return lambda sp, sf: r.result(daily(sp, sf))


QUERIES = {
    "store_factors": factors, "store_roll_json": roll_json, "store_scenarios": scen_reload, "store_patch": patched, "store_layout": layout, "store_tick_day": tick_day, "store_trade_file": trade_file, "store_vendor": vendor, "store_deals": deals, "store_curve": curve_on,
    "clean_expiry": after_expiry, "clean_main_months": main_months, "clean_derived": derived, "clean_stocks": stocks, "clean_labels": day_buckets, "bars_wide_session": wide_sessions, "bars_realised": realised, "set_differences": dropped, "stat_lag_corr": lags_corr,
    "sig_chain": recipe(CHAIN), "sig_strategies": recipe(STRATEGY),
}
SQL = {
    "store_factors": f"WITH {DAILY_SQL}, f AS (SELECT asset, date, close / lag(close, 20) OVER (PARTITION BY asset ORDER BY date) - 1 AS mom20, ln(volume) AS lvol FROM s0), l AS (SELECT asset AS product_code, 'mom20' AS fact_name, date, mom20 AS fact_val FROM f UNION ALL SELECT asset, 'lvol', date, lvol FROM f) SELECT product_code, fact_name, date, {_rs('fact_val')} FROM l WHERE fact_val IS NOT NULL AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
    "store_roll_json": f"WITH {CHAIN_SQL} SELECT 'X' AS exch, asset, start, contract FROM cmv",
    "store_scenarios": f"WITH {DAILY_SQL}, x AS (SELECT asset, scen_id, avg(close * scen_id) AS v FROM s0, (VALUES (1), (3)) t(scen_id) GROUP BY ALL) SELECT asset, scen_id, {_rs('v')}, scen_id::VARCHAR AS win FROM x",
    "store_patch": f"WITH {DAILY_SQL} SELECT asset, date, {tidy_sql('''CASE WHEN date BETWEEN DATE '1997-06-01' AND DATE '1997-06-30' THEN -close ELSE close END''')} AS close FROM s0",
    "store_layout": f"WITH {TICKS_SQL}, b AS (SELECT asset, date, minute // 5 AS bucket, last(price ORDER BY ts, event_id) AS close, count(*) AS n FROM ticks GROUP BY ALL) SELECT asset, strftime(date, '%Y%m%d')::INT AS d, (((bucket + 1) * 5 // 60) * 100 + (bucket + 1) * 5 % 60)::INT AS hhmm, {tidy_sql('close * n * 10')} AS money, n - lag(n) OVER (PARTITION BY asset ORDER BY date, bucket) AS d_oi FROM b",
    "store_tick_day": f"WITH {TICKS_SQL}, c AS (SELECT asset, date, last(price ORDER BY ts, event_id) AS close FROM ticks GROUP BY ALL), p AS (SELECT asset, date, lag(close) OVER (PARTITION BY asset ORDER BY date) AS pre_close FROM c) SELECT event_id, asset, {_rs('price', 'pre_close')} FROM ticks JOIN p USING (asset, date)",
    "store_trade_file": f"WITH d(flag, product, lot) AS (VALUES ('A', 'rb', 10), ('N', 'cu', 5), ('R', 'MA', 20)), t AS (SELECT product, lot, CASE WHEN starts_with(l_linestatus, 'O') THEN -1 ELSE 1 END * l_quantity AS q FROM lineitem JOIN d ON l_returnflag = flag) SELECT product, lot, {tidy_sql('sum(q)')} AS net, {tidy_sql('sum(q * lot)')} AS units FROM t GROUP BY ALL",
    "store_vendor": f"WITH o AS (SELECT o_orderkey, lower(o_orderpriority) AS id, round(o_totalprice, 2) AS p, o_orderdate::DATE AS d FROM orders WHERE o_orderstatus <> 'P'), x AS (SELECT o_orderkey, id, CASE WHEN d <= DATE '1997-12-31' THEN p / 100 ELSE p END AS px FROM o) SELECT o_orderkey, id, {_rs('px')} FROM x",
    "store_deals": f"SELECT p_partkey, p_brand, p_size, {_rs('p_retailprice')} FROM part WHERE p_brand LIKE 'Brand#%2' AND p_size IN (1, 5, 9, 14, 23)",
    "store_curve": f"WITH {FUTURES_SQL}, b AS (SELECT * FROM fb WHERE date <= DATE '2000-06-30') SELECT asset, date, contract, expiry, {_rs('close')} FROM b WHERE (asset, date) IN (SELECT (asset, max(date)) FROM b GROUP BY asset)",
    "clean_expiry": f"WITH {PRINTS_SQL}, b AS ({bars_sql('asset', 'contract', 'date')}), e AS (SELECT asset, (max(date) - INTERVAL 3 MONTH)::DATE AS expiry FROM b GROUP BY asset) SELECT asset, contract, date, {tidy_sql('CASE WHEN date <= expiry THEN close END')} AS px, (expiry - date)::INT AS left FROM b JOIN e USING (asset)",
    "clean_main_months": f"WITH {DAILY_SQL}, d AS (SELECT asset, date, substr(asset, 7, 1) AS g, month(date) AS m FROM s0) SELECT asset, date FROM d WHERE (g = '1' AND date <= DATE '1997-12-31' AND m IN (1, 5, 9)) OR (g = '1' AND date > DATE '1997-12-31' AND m IN (1, 6, 11)) OR (g = '2' AND m IN (3, 12))",
    "clean_derived": f"WITH l AS (SELECT o_orderdate::DATE AS date, sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS a, sum(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS b, sum(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS c FROM orders GROUP BY ALL) SELECT date, {tidy_sql('a + b')} AS total, {tidy_sql('a / b')} AS ratio, {tidy_sql('ln(a / c)')} AS lr, {tidy_sql('a - c')} AS spread FROM l",
    "clean_stocks": f"WITH w(f, w) AS (VALUES ('A', 1.0::DOUBLE), ('N', 0.5::DOUBLE), ('R', 0.25::DOUBLE)) SELECT l_shipdate::DATE AS date, l_linestatus AS prod, {tidy_sql('sum(l_quantity * w)')} AS inv FROM lineitem JOIN w ON f = l_returnflag GROUP BY ALL",
    "clean_labels": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'build' WHEN c_acctbal < 0 THEN 'short' WHEN c_acctbal > 5000 THEN 'large' ELSE 'other' END AS label FROM customer",
    "bars_wide_session": f"WITH {TICKS_SQL}, g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY asset ORDER BY ts, event_id) AS gap FROM ticks), p AS (SELECT *, sum(CASE WHEN gap > 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS part FROM g) SELECT asset, part, min(ts) AS first_ts, {tidy_sql('first(price ORDER BY ts, event_id)')} AS open, {tidy_sql('last(price ORDER BY ts, event_id)')} AS close, count(*) AS n FROM p GROUP BY asset, part",
    "bars_realised": f"WITH {TICKS_SQL}, d AS (SELECT *, price - lag(price) OVER (PARTITION BY asset, date ORDER BY ts, event_id) AS d FROM ticks), g AS (SELECT asset, date, avg(d) AS mean, sum(d * d) AS rv, sum(CASE WHEN d > 0 THEN d * d ELSE 0 END) / nullif(sum(d * d), 0) AS up_share, sum(d) / nullif(sum(abs(d)), 0) AS trend, sum(sign(d) * abs(price)) AS flow, sum(coalesce(sign(d), 0))::BIGINT AS ticks_up, (avg(d*d*d) - 3 * avg(d) * avg(d*d) + 2 * pow(avg(d), 3)) / nullif(pow(var_pop(d), 1.5), 0) AS skew0, (avg(d*d*d*d) - 4 * avg(d) * avg(d*d*d) + 6 * pow(avg(d), 2) * avg(d*d) - 3 * pow(avg(d), 4)) / nullif(pow(var_pop(d), 2), 0) - 3 AS kurt0, count(d) AS n FROM d GROUP BY ALL), h AS (SELECT *, CASE WHEN n >= 4 AND rv > 0 THEN skew0 END AS skew, CASE WHEN n >= 4 AND rv > 0 THEN kurt0 END AS kurt FROM g) SELECT asset, date, n, ticks_up, {_rs('mean', 'rv', 'up_share', 'trend', 'flow', 'skew', 'kurt')} FROM h",
    "set_differences": "WITH b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT k, 'missing' AS kind FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'both' FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT k FROM b)",
    "stat_lag_corr": f"WITH {DAILY_SQL}, d AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY date)) AS ret FROM s0), i AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS idx FROM d), l AS (SELECT asset, ret, {', '.join(f'lag(idx, {k}) OVER w AS l{k + 3}' if k >= 0 else f'lead(idx, {-k}) OVER w AS l{k + 3}' for k in range(-3, 4))} FROM i WINDOW w AS (PARTITION BY asset ORDER BY date)) SELECT asset, {', '.join(f'{tidy_sql(f"corr(ret, l{i})")} AS c{i}' for i in range(7))} FROM l GROUP BY asset",
    "sig_chain": CHAIN.oracle(DAILY_SQL), "sig_strategies": STRATEGY.oracle(DAILY_SQL),
}
