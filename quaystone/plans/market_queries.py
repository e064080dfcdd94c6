"""Registered queries of the market-data build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.functions.recipe import tidy, tidy_sql
from quaystone.operators import market as mk
from quaystone.sources import store
from quaystone.sources.panels import DAILY_SQL, PRINTS_SQL, TICKS_SQL, bars, bars_sql, daily, prints, read, ticks

CUTS = [300, 1500, 1630, 1900]
RANGES = {f"twap_{a}": (a, a + 255) for a in (0, 300, 600, 900, 1200, 1500, 1800, 2100)}


def _r(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: tidy(df, c) for c in cols})


def _rs(*cols: str) -> str:
    return ", ".join(f"{tidy_sql(c)} AS {c}" for c in cols)


OHLC = ("open", "high", "low", "close")


def daily_bars(spark, sf):
    return _r(bars(prints(spark, sf), "asset", "date"), *OHLC, "volume", "oi")


def contract_bars(spark, sf):
    return _r(bars(prints(spark, sf), "asset", "contract", "date"), *OHLC, "volume", "oi")


def period_bars(spark, sf):
    """Weeks that end on Friday, months, quarters and years in one pass over daily bars: label, first, last, sum, mean and compounded return."""
    d = daily(spark, sf).withColumn("ret", F.ln(F.col("close") / F.lag("close").over(Window.partitionBy("asset").orderBy("date"))))
    ends = {"W": F.date_add(F.date_trunc("week", F.date_add("date", 2)).cast("date"), 4), "M": F.last_day("date"), "Q": F.last_day(F.add_months(F.trunc("date", "quarter"), 2)), "A": F.last_day(F.add_months(F.trunc("date", "year"), 11))}
    each = d.withColumn("p", F.explode(F.array(*[F.struct(F.lit(k).alias("period"), e.alias("period_end")) for k, e in ends.items()]))).select("asset", "date", "close", "volume", "ret", "p.*")
    out = each.groupBy("asset", "period", "period_end").agg(F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"), F.sum("volume").alias("total"), F.avg("close").alias("mean_close"), (F.exp(F.coalesce(F.sum("ret"), F.lit(0))) - 1).alias("comp"))
    return _r(out, "first_close", "last_close", "total", "mean_close", "comp")


PERIOD_SQL = f"""WITH {DAILY_SQL}, d AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY date)) AS ret FROM s0),
e AS (SELECT asset, date, close, volume, ret, unnest(['W', 'M', 'Q', 'A']) AS period, unnest([(date_trunc('week', date + 2) + INTERVAL 4 DAY)::DATE, last_day(date), (date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE, (date_trunc('year', date) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE]) AS period_end FROM d),
g AS (SELECT asset, period, period_end, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close, sum(volume) AS total, avg(close) AS mean_close, exp(coalesce(sum(ret), 0)) - 1 AS comp FROM e GROUP BY ALL)
SELECT asset, period, period_end, {_rs('first_close', 'last_close', 'total', 'mean_close', 'comp')} FROM g"""


def minute_bars(n: int):
    return lambda spark, sf: _r(mk.resample(ticks(spark, sf), n), *OHLC)


def minute_sql(n: int) -> str:
    return f"WITH {TICKS_SQL} SELECT asset, date, (minute // {n})::BIGINT AS bucket, {tidy_sql('first(price ORDER BY ts, event_id)')} AS open, {tidy_sql('max(price)')} AS high, {tidy_sql('min(price)')} AS low, {tidy_sql('last(price ORDER BY ts, event_id)')} AS close, count(*) AS n_ticks, min(ts) AS first_ts, max(minute) AS last_minute FROM ticks GROUP BY asset, date, minute // {n}"


_MINID = "(((minute // 60) + 6) % 24) * 100 + minute % 60"
_PART = " + ".join(f"(min_id >= {c})::INT" for c in CUTS)


#: Days without trading in the ticks' weeks.
CLOSED = ("2024-01-01", "2024-01-15")


def cal(spark, sf):
    days = ticks(spark, sf).agg(F.date_sub(F.min("date"), 10).alias("first"), F.date_add(F.max("date"), 10).alias("last"))
    return mk.calendar(days, CLOSED)


CAL_SQL = f"""{TICKS_SQL}, cd AS (SELECT unnest(generate_series(min(date) - 10, max(date) + 10, INTERVAL 1 DAY))::DATE AS date FROM ticks),
cb AS (SELECT date, isodow(date) <= 5 AND date NOT IN ({", ".join(f"DATE '{d}'" for d in CLOSED)}) AS is_bday FROM cd),
cal AS MATERIALIZED (SELECT date, is_bday, sum(is_bday::INT) OVER (ORDER BY date)::BIGINT AS bday_no,
  last_value(CASE WHEN is_bday THEN date END IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_bday,
  first_value(CASE WHEN is_bday THEN date END IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_bday FROM cb)"""


def sessions(spark):
    rows = [("click", 540, 690), ("click", 810, 900), ("view", 540, 900), ("purchase", 600, 1320), ("signup", 0, 720)]
    return spark.createDataFrame([(k, a, b) for k, a, b in rows], "kind string, start_minute int, end_minute int").withColumns({"from_date": F.to_date(F.lit("2024-01-01")), "to_date": F.to_date(F.lit("2024-01-20"))})


SESS_SQL = "sess(kind, start_minute, end_minute) AS (VALUES ('click', 540, 690), ('click', 810, 900), ('view', 540, 900), ('purchase', 600, 1320), ('signup', 0, 720))"


def clean_daily(spark, sf):
    """Prices of twenty years later without and with tax, halved early volumes, and clipped prices."""
    d = daily(spark, sf).withColumn("day", F.add_months("date", 240))
    out = d.select("asset", "date", mk.vat("close", "day").alias("net_close"), mk.vat("close", "day", add=True).alias("gross_close"), mk.halve_before("volume", "date", "1998-01-01").alias("vol"), F.least(F.greatest("close", F.lit(1000.0)), F.lit(2000.0)).alias("capped"))
    return _r(out, "net_close", "gross_close", "vol", "capped")


_RATE = "CASE WHEN date + INTERVAL 240 MONTH < DATE '2018-05-01' THEN 1.17 WHEN date + INTERVAL 240 MONTH < DATE '2019-04-01' THEN 1.16 ELSE 1.13 END"


def chained(spark, sf):
    b = bars(prints(spark, sf), "asset", "contract", "date")
    return mk.chain(b, mk.chain_segments(mk.roll_map(b)))


CHAIN_SQL = f"""{PRINTS_SQL}, cbar AS MATERIALIZED ({bars_sql('asset', 'contract', 'date')}),
cm AS (SELECT asset, contract, date_trunc('month', date)::DATE AS mon, sum(volume) AS v FROM cbar GROUP BY ALL),
cbst AS (SELECT asset, contract, mon FROM cm QUALIFY row_number() OVER (PARTITION BY asset, mon ORDER BY v DESC, contract) = 1),
cmv AS (SELECT asset, contract, (mon + INTERVAL 1 MONTH)::DATE AS start FROM (SELECT *, lag(contract) OVER (PARTITION BY asset ORDER BY mon) AS last FROM cbst) WHERE last IS NULL OR last <> contract),
seg AS (SELECT *, lead(start) OVER (PARTITION BY asset ORDER BY start) - 1 AS stop FROM cmv),
ch AS MATERIALIZED (SELECT b.*, g.start AS seg_start FROM cbar b JOIN seg g ON b.asset = g.asset AND b.contract = g.contract AND b.date >= g.start AND (g.stop IS NULL OR b.date <= g.stop)),
sg AS (SELECT asset, seg_start, arg_min(close, date) AS fc, arg_max(close, date) AS lc FROM ch GROUP BY ALL),
gp AS (SELECT *, CASE WHEN lead(fc) OVER w / lc > 0 THEN ln(lead(fc) OVER w / lc) ELSE 0 END AS gap FROM sg WINDOW w AS (PARTITION BY asset ORDER BY seg_start)),
sh AS (SELECT asset, seg_start, sum(gap) OVER (PARTITION BY asset ORDER BY seg_start DESC) AS shift FROM gp)"""


def low_series(spark, sf):
    return read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("v"))


def month_series(spark, sf):
    """The highest order of each month and priority, known on the month's last day."""
    return low_series(spark, sf).groupBy("key", F.last_day("date").alias("date")).agg(F.max("v").alias("v"))


def as_of(limit):
    def run(spark, sf):
        lows = month_series(spark, sf)
        # every trading day from a key's first value to its last
        spans = lows.groupBy("key").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
        days = daily(spark, sf).select("date").distinct()
        grid = spans.select("key", F.explode(F.sequence("lo", "hi")).alias("date")).join(days, "date", "left_semi")
        return _r(mk.as_of(grid, lows, "v", limit), "v")

    return run


def as_of_sql(limit) -> str:
    held = "v" if limit is None else f"CASE WHEN seq - since <= {limit} THEN v END"
    return f"""WITH lows AS (SELECT o_orderpriority AS key, last_day(o_orderdate::DATE) AS date, max(o_totalprice) AS v FROM orders GROUP BY ALL), sp AS (SELECT key, min(date) AS lo, max(date) AS hi FROM lows GROUP BY key),
g AS (SELECT key, date FROM sp JOIN (SELECT DISTINCT l_shipdate::DATE AS date FROM lineitem) d ON date BETWEEN lo AND hi),
u AS (SELECT key, date, NULL::DOUBLE AS v, 1 AS g FROM g UNION ALL SELECT key, date, v, 0 FROM lows), n AS (SELECT *, sum(g) OVER (PARTITION BY key ORDER BY date) AS seq FROM u),
h AS (SELECT key, date, g, seq, last_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER w AS since, last_value(v IGNORE NULLS) OVER w AS v FROM n WINDOW w AS (PARTITION BY key ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT key, date, {tidy_sql(held)} AS v FROM h WHERE g = 1"""


def upserts(replace: bool):
    def run(spark, sf):
        o = read(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
        first = o.groupBy("k", "d").agg(F.min("v").alias("v"))
        second = o.where("month(d) = 6").groupBy("k", "d").agg((F.max("v") + 1).alias("v"))
        return _r(mk.upsert(first, second, ["k", "d"], replace), "v")

    return run


def upsert_sql(replace: bool) -> str:
    return f"""WITH o AS (SELECT o_custkey AS k, o_orderdate::DATE AS d, o_totalprice AS v FROM orders), b AS (SELECT k, d, min(v) AS v, 0 AS batch FROM o GROUP BY ALL UNION ALL SELECT k, d, max(v) + 1, 1 FROM o WHERE month(d) = 6 GROUP BY ALL)
SELECT k, d, {_rs('v')} FROM b QUALIFY row_number() OVER (PARTITION BY k, d ORDER BY batch {'DESC' if replace else 'ASC'}) = 1"""


def spliced(spark, sf):
    a = bars(prints(spark, sf), "asset", "date").select("asset", "date", "close", "volume")
    return _r(mk.splice(a, a.withColumn("close", F.col("close") * 2), "1998-01-01"), "close", "volume")


def brokers(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = o.groupBy(F.trunc("o_orderdate", "month").alias("date"), F.col("c_mktsegment").alias("prod"), F.col("o_orderpriority").alias("inst"), "o_custkey").agg(F.sum("o_totalprice").alias("vol"))
    ranked = day.withColumn("ranknum", F.row_number().over(Window.partitionBy("date", "prod", "inst").orderBy(F.desc("vol"), "o_custkey")))
    return _r(mk.broker_sums(ranked), "vol_5", "vol_10", "vol_20")


BROKER_SQL = f"""WITH d AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, c_mktsegment AS prod, o_orderpriority AS inst, o_custkey, sum(o_totalprice) AS vol FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY date, prod, inst ORDER BY vol DESC, o_custkey) AS n FROM d),
g AS (SELECT date, prod, inst, sum(vol) FILTER (n <= 5) AS vol_5, sum(vol) FILTER (n <= 10) AS vol_10, sum(vol) FILTER (n <= 20) AS vol_20 FROM r GROUP BY GROUPING SETS ((date, prod, inst), (date, prod)))
SELECT date, prod, inst, {_rs('vol_5', 'vol_10', 'vol_20')} FROM g"""


def spread(spark, sf):
    """Leg-wise spreads of an asset's contracts 0 and 1 and of 2 and 3 on days that have both legs."""
    b = bars(prints(spark, sf), "asset", "contract", "date").withColumn("leg", F.col("contract").cast("int"))
    sign = F.when(F.col("leg") % 2 == 0, 1.0).otherwise(-1.0)
    out = b.groupBy("asset", "date", F.floor(F.col("leg") / 2).alias("pair")).agg(F.sum(sign * F.col("open")).alias("open"), F.sum(sign * F.col("close")).alias("close"), F.count("*").alias("legs")).where("legs = 2")
    return _r(out.select("asset", "date", "pair", "open", "close", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low")), *OHLC)


def tick_turnover(spark, sf):
    """Volume from a cumulative count: its change within the day, with the day's last tick marked."""
    w = Window.partitionBy("asset", "date").orderBy("ts", "event_id")
    t = ticks(spark, sf).withColumn("cum", F.sum(F.abs("price")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumns({"vol": F.col("cum") - F.coalesce(F.lag("cum").over(w), F.lit(0.0)), "last_tick": F.lead("event_id").over(w).isNull()})
    return _r(t.select("event_id", "asset", "cum", "vol", "last_tick"), "cum", "vol")


def missing_days(spark, sf):
    """Business days of an instrument's span without a tick, and rows that fail checks."""
    t = ticks(spark, sf).select("asset", "date").distinct()
    spans = t.groupBy("asset").agg(F.min("date").alias("a"), F.max("date").alias("b")).select("asset", F.explode(F.sequence("a", "b")).alias("date")).where(F.dayofweek("date").between(2, 6))
    return spans.join(t, ["asset", "date"], "left_anti")


def roll_gaps(spark, sf):
    """Business days of a chain's segments without a bar."""
    c = chained(spark, sf).select("asset", "seg_start", "date")
    spans = c.groupBy("asset", "seg_start").agg(F.min("date").alias("a"), F.max("date").alias("b")).select("asset", "seg_start", F.explode(F.sequence("a", "b")).alias("date")).where(F.dayofweek("date").between(2, 6))
    return spans.join(c.select("asset", "date"), ["asset", "date"], "left_anti").groupBy("asset", "seg_start").agg(F.count("*").alias("missing"))


#: Series of the orders, and the names of their columns.
KEYS = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


def fx(spark, sf):
    """Closes divided or multiplied by their pair's rate of the day, as the pair is quoted; every series is the rate of some assets."""
    number = F.regexp_extract("asset", "([0-9]+)$", 1).cast("int")
    d = daily(spark, sf).select("asset", "date", "close", F.element_at(F.lit(list(KEYS)), number % 5 + 1).alias("key"), (number % 2).alias("direct"))
    rate = low_series(spark, sf).select("key", "date", (F.col("v") / 100000 + 1).alias("rate"))
    return _r(d.join(rate, ["key", "date"]).select("asset", "date", F.when(F.col("direct") == 1, F.col("close") / F.col("rate")).otherwise(F.col("close") * F.col("rate")).alias("conv")), "conv")


def wide(spark, sf):
    """All series side by side on all their dates, and long again."""
    sheet = low_series(spark, sf).groupBy("date").pivot("key", list(KEYS)).agg(F.max("v"))
    sheet = sheet.select("date", *[F.col(f"`{k}`").alias(c) for k, c in KEYS.items()])
    return _r(sheet.unpivot(["date"], list(KEYS.values()), "series", "v").where("v IS NOT NULL AND v <> 0"), "v")


def pivoted(spark, sf):
    """The last value of each month, a column per series."""
    out = low_series(spark, sf).withColumn("m", F.trunc("date", "month")).groupBy("m").pivot("key", list(KEYS)).agg(F.max_by("v", "date"))
    return _r(out.select("m", *[F.col(f"`{k}`").alias(c) for k, c in KEYS.items()]), *KEYS.values())


def curve(spark, sf):
    """Average duplicate marks, pivot to columns, wings less the middle."""
    t = read(spark, sf, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("tenor")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_discount"))
    return _r(t.select("tenor", F.col("N").alias("mid"), (F.col("A") - F.col("N")).alias("put"), (F.col("R") - F.col("N")).alias("call")), "mid", "put", "call")


def csv_round_trip(spark, sf):
    """Ticks written by date as CSV to the shared folder and read back with a schema."""
    path = store.folder(spark, "csv")
    ticks(spark, sf).select("event_id", "asset", "price", F.date_format("ts", "HH:mm:ss").alias("clock"), "date").write.partitionBy("date").csv(path, header=True)
    back = spark.read.schema("event_id long, asset long, price double, clock string, date date").csv(path, header=True)
    return _r(back.select("event_id", "asset", "date", "price", F.split("clock", ":")[0].cast("int").alias("hour"), F.split("clock", ":")[1].cast("int").alias("min")), "price")


def snapshot(spark, sf):
    w = Window.partitionBy("asset").orderBy("date")
    d = daily(spark, sf)
    return _r(d.select("asset", "date", "close", F.lag("close").over(w).alias("pre_close"), F.lag("oi").over(w).alias("pre_oi"), (F.coalesce("close", "open") * F.col("volume") * 10).alias("turnover"), (F.col("oi") - F.lag("oi").over(w)).alias("d_oi")), "close", "pre_close", "pre_oi", "turnover", "d_oi")


def contracts(spark, sf):
    """Contracts of an asset with first and last day and days alive."""
    return prints(spark, sf).groupBy("asset", "contract").agg(F.min("date").alias("first_day"), F.max("date").alias("expiry"), F.countDistinct("date").alias("days"))


def bday_shift(spark, sf):
    t = ticks(spark, sf).select("date").distinct()
    c = cal(spark, sf)
    return mk.shift_bdays(mk.shift_bdays(t, c, "date", 3, "plus3"), c, "date", -2, "minus2").select("date", "plus3", "minus2")


def code_parts(spark, sf):
    """Product, exchange and month from codes like SHFE.rb2405, built from supplier keys."""
    s = read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("SHFE."), F.element_at(F.lit(["rb", "cu", "MA", "TC"]), F.col("s_nationkey") % 4 + 1), F.lpad((F.col("s_suppkey") % 1200).cast("string"), 4, "0")).alias("code"))
    return s.select("s_suppkey", "code", F.regexp_extract("code", r"^(\w+)\.", 1).alias("exch"), F.regexp_extract("code", r"\.([A-Za-z]+)", 1).alias("product"), F.regexp_extract("code", r"(\d+)$", 1).cast("int").alias("month"), F.regexp_replace("code", r"\.TC", ".ZC").alias("renamed"))


CODE_SQL = """WITH s AS (SELECT s_suppkey, 'SHFE.' || ['rb', 'cu', 'MA', 'TC'][s_nationkey % 4 + 1] || lpad((s_suppkey % 1200)::VARCHAR, 4, '0') AS code FROM supplier)
SELECT s_suppkey, code, regexp_extract(code, '^(\\w+)\\.', 1) AS exch, regexp_extract(code, '\\.([A-Za-z]+)', 1) AS product, regexp_extract(code, '(\\d+)$', 1)::INT AS month, replace(code, '.TC', '.ZC') AS renamed FROM s"""

QUERIES = {
    "bars_daily": daily_bars, "bars_contract": contract_bars, "bars_period": period_bars, "bars_5min": minute_bars(5), "bars_60min": minute_bars(60),
    "bars_session": lambda s, d: _r(mk.session_bars(ticks(s, d), CUTS), *OHLC), "bars_twap": lambda s, d: _r(mk.twaps(ticks(s, d), RANGES), *RANGES),
    "clean_sessions": lambda s, d: mk.in_sessions(ticks(s, d), sessions(s)).select("event_id", "asset", "date", "minute"), "clean_daily": clean_daily,
    "cal_business": lambda s, d: cal(s, d), "cal_shift": bday_shift, "cal_trading_date": lambda s, d: mk.trading_date(ticks(s, d), cal(s, d)).select("event_id", "asset", "trade_date"),
    "roll_map": lambda s, d: mk.chain_segments(mk.roll_map(bars(prints(s, d), "asset", "contract", "date"))), "roll_chain": lambda s, d: _r(chained(s, d).select("asset", "contract", "date", "close", "seg_start"), "close"),
    "roll_back_adjust": lambda s, d: _r(mk.back_adjusted(chained(s, d)).select("asset", "date", "seg_start", "shift", "adj_close"), "shift", "adj_close"), "roll_gaps": roll_gaps,
    "join_as_of": as_of(None), "join_as_of_limit": as_of(5), "join_fx": fx, "join_wide": wide, "join_spread": spread, "upsert_replace": upserts(True), "upsert_ignore": upserts(False), "store_splice": spliced,
    "store_csv": csv_round_trip, "store_snapshot": snapshot, "store_contracts": contracts, "agg_brokers": brokers, "agg_pivot": pivoted, "agg_curve": curve, "tick_turnover": tick_turnover, "check_missing_days": missing_days, "fn_code_parts": code_parts,
}
SQL = {
    "bars_daily": f"WITH {PRINTS_SQL}, b AS ({bars_sql('asset', 'date')}) SELECT asset, date, n_prints, {_rs(*OHLC, 'volume', 'oi')} FROM b",
    "bars_contract": f"WITH {PRINTS_SQL}, b AS ({bars_sql('asset', 'contract', 'date')}) SELECT asset, contract, date, n_prints, {_rs(*OHLC, 'volume', 'oi')} FROM b",
    "bars_period": PERIOD_SQL, "bars_5min": minute_sql(5), "bars_60min": minute_sql(60),
    "bars_session": f"WITH {TICKS_SQL}, m AS (SELECT *, {_MINID} AS min_id FROM ticks), p AS (SELECT *, {_PART} AS part FROM m) SELECT asset, date, part, {tidy_sql('first(price ORDER BY min_id, ts)')} AS open, {tidy_sql('max(price)')} AS high, {tidy_sql('min(price)')} AS low, {tidy_sql('last(price ORDER BY min_id, ts)')} AS close, count(*) AS n_ticks FROM p GROUP BY asset, date, part",
    "bars_twap": f"WITH {TICKS_SQL}, m AS (SELECT *, {_MINID} AS min_id FROM ticks) SELECT asset, date, {', '.join(f'{tidy_sql(f"avg(price) FILTER (min_id BETWEEN {a} AND {b})")} AS {k}' for k, (a, b) in RANGES.items())} FROM m GROUP BY asset, date",
    "clean_sessions": f"WITH {TICKS_SQL}, {SESS_SQL} SELECT event_id, asset, date, minute FROM ticks t WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20' AND EXISTS (SELECT 1 FROM sess WHERE kind = event_type AND minute BETWEEN start_minute AND end_minute)",
    "clean_daily": f"WITH {DAILY_SQL}, c AS (SELECT asset, date, close / {_RATE} AS net_close, close * {_RATE} AS gross_close, CASE WHEN date < DATE '1998-01-01' THEN volume / 2 ELSE volume END AS vol, least(greatest(close, 1000), 2000) AS capped FROM s0) SELECT asset, date, {_rs('net_close', 'gross_close', 'vol', 'capped')} FROM c",
    "cal_business": f"WITH {CAL_SQL} SELECT * FROM cal",
    "cal_shift": f"WITH {CAL_SQL}, n AS (SELECT * FROM cal WHERE is_bday) SELECT t.date, p.date AS plus3, m.date AS minus2 FROM (SELECT DISTINCT date FROM ticks) t JOIN cal c USING (date) LEFT JOIN n p ON p.bday_no = c.bday_no + 3 LEFT JOIN n m ON m.bday_no = c.bday_no - 2",
    "cal_trading_date": f"WITH {CAL_SQL} SELECT event_id, asset, CASE WHEN minute >= 1080 OR NOT is_bday THEN next_bday ELSE date END AS trade_date FROM ticks JOIN cal USING (date)",
    "roll_map": f'WITH {CHAIN_SQL} SELECT asset, contract, start, stop AS "end" FROM seg', "roll_chain": f"WITH {CHAIN_SQL} SELECT asset, contract, date, {_rs('close')}, seg_start FROM ch",
    "roll_back_adjust": f"WITH {CHAIN_SQL} SELECT asset, date, seg_start, {_rs('shift')}, {tidy_sql('close * exp(shift)')} AS adj_close FROM ch JOIN sh USING (asset, seg_start)",
    "roll_gaps": f"WITH {CHAIN_SQL}, sp AS (SELECT asset, seg_start, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM ch GROUP BY asset, seg_start) SELECT asset, seg_start, count(*) AS missing FROM sp WHERE isodow(date) <= 5 AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.asset = sp.asset AND ch.date = sp.date) GROUP BY ALL",
    "join_as_of": as_of_sql(None), "join_as_of_limit": as_of_sql(5),
    "join_fx": f"WITH {DAILY_SQL}, r AS (SELECT o_orderpriority AS key, o_orderdate::DATE AS date, max(o_totalprice) / 100000 + 1 AS rate FROM orders GROUP BY ALL), n AS (SELECT *, replace(asset, 'Brand#', '')::INT AS k FROM s0), c AS (SELECT asset, n.date, CASE WHEN k % 2 = 1 THEN close / rate ELSE close * rate END AS conv FROM n JOIN r ON r.date = n.date AND substr(r.key, 1, 1)::INT = k % 5 + 1) SELECT asset, date, {_rs('conv')} FROM c",
    "join_wide": f"WITH l AS (SELECT o_orderdate::DATE AS date, CASE o_orderpriority {' '.join(f"WHEN '{k}' THEN '{c}'" for k, c in KEYS.items())} END AS series, max(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT date, series, {_rs('v')} FROM l WHERE v <> 0 AND series IS NOT NULL",
    "join_spread": f"WITH {PRINTS_SQL}, cbar AS ({bars_sql('asset', 'contract', 'date')}), x AS (SELECT a.asset, a.date, a.contract::INT // 2 AS pair, a.open - b.open AS open, a.close - b.close AS close FROM cbar a JOIN cbar b USING (asset, date) WHERE (a.contract = '0' AND b.contract = '1') OR (a.contract = '2' AND b.contract = '3')) SELECT asset, date, pair::BIGINT AS pair, {_rs('open', 'close')}, {tidy_sql('greatest(open, close)')} AS high, {tidy_sql('least(open, close)')} AS low FROM x",
    "upsert_replace": upsert_sql(True), "upsert_ignore": upsert_sql(False),
    "store_splice": f"WITH {DAILY_SQL} SELECT asset, date, {tidy_sql('CASE WHEN date <= DATE $$1998-01-01$$ THEN close ELSE close * 2 END')} AS close, {_rs('volume')} FROM s0 WHERE volume > 0",
    "store_csv": f"WITH {TICKS_SQL} SELECT event_id, asset, date, {_rs('price')}, hour(ts)::INT AS hour, minute(ts)::INT AS min FROM ticks",
    "store_snapshot": f"WITH {DAILY_SQL}, w AS (SELECT asset, date, close, lag(close) OVER x AS pre_close, lag(oi) OVER x AS pre_oi, close * volume * 10 AS turnover, oi - lag(oi) OVER x AS d_oi FROM s0 WINDOW x AS (PARTITION BY asset ORDER BY date)) SELECT asset, date, {_rs('close', 'pre_close', 'pre_oi', 'turnover', 'd_oi')} FROM w",
    "store_contracts": f"WITH {PRINTS_SQL} SELECT asset, contract, min(date) AS first_day, max(date) AS expiry, count(DISTINCT date) AS days FROM prints GROUP BY ALL",
    "agg_brokers": BROKER_SQL,
    "agg_pivot": f"WITH l AS (SELECT o_orderpriority AS key, o_orderdate::DATE AS date, max(o_totalprice) AS v FROM orders GROUP BY ALL), p AS (SELECT date_trunc('month', date)::DATE AS m, {', '.join(f"arg_max(v, date) FILTER (key = '{k}') AS {c}" for k, c in KEYS.items())} FROM l GROUP BY m) SELECT m, {_rs(*KEYS.values())} FROM p",
    "agg_curve": f"WITH p AS (SELECT date_trunc('month', l_shipdate)::DATE AS tenor, avg(l_discount) FILTER (l_returnflag = 'N') AS mid, avg(l_discount) FILTER (l_returnflag = 'A') - avg(l_discount) FILTER (l_returnflag = 'N') AS put, avg(l_discount) FILTER (l_returnflag = 'R') - avg(l_discount) FILTER (l_returnflag = 'N') AS call FROM lineitem GROUP BY ALL) SELECT tenor, {_rs('mid', 'put', 'call')} FROM p",
    "tick_turnover": f"WITH {TICKS_SQL}, c AS (SELECT *, sum(abs(price)) OVER (PARTITION BY asset, date ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cum FROM ticks), v AS (SELECT event_id, asset, cum, cum - coalesce(lag(cum) OVER w, 0) AS vol, lead(event_id) OVER w IS NULL AS last_tick FROM c WINDOW w AS (PARTITION BY asset, date ORDER BY ts, event_id)) SELECT event_id, asset, {_rs('cum', 'vol')}, last_tick FROM v",
    "check_missing_days": f"WITH {TICKS_SQL}, sp AS (SELECT asset, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM ticks GROUP BY asset) SELECT asset, date FROM sp WHERE isodow(date) <= 5 EXCEPT SELECT asset, date FROM ticks",
    "fn_code_parts": CODE_SQL,
}
