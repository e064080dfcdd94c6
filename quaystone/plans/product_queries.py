"""Registered queries of the dated product table: snapshots, position histories, expiries, code changes, price fall-backs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions.recipe import tidy, tidy_sql
from quaystone.operators import market as mk
from quaystone.operators import products as pr
from quaystone.sources.panels import FUTURES_SQL, PRINTS_SQL, TICKS_SQL, futures, prints, read, ticks

CODES, EXCHANGES = ("m", "lh", "rb", "TA", "ZC", "MA", "IF", "T", "sc", "pb"), ("DCE", "DCE", "SHFE", "CZCE", "CZCE", "CZCE", "CFFEX", "CFFEX", "INE", "LME")
HOLIDAYS = ("1996-01-01", "1996-07-19", "1997-05-15", "1998-02-02", "1998-12-25")


def products(sp, sf) -> DataFrame:
    """Two spans of each brand of the parts: product, exchange, lot and margin, with lots twice as large from 1997 on; no span before 1993."""
    n = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    own = read(sp, sf, "part").select(F.col("p_brand").alias("asset"), n.alias("n")).distinct()
    own = own.withColumns({"product": F.element_at(F.lit(list(CODES)), F.col("n") % 10 + 1), "exch": F.element_at(F.lit(list(EXCHANGES)), F.col("n") % 10 + 1), "base": 5 * (1 + F.col("n") % 4), "margin": 0.05 + 0.01 * (F.col("n") % 3)})
    day = lambda d: F.lit(d).cast("date")
    span = F.explode(F.array(F.struct(day("1993-01-01").alias("from_date"), day("1996-12-31").alias("to_date"), F.lit(1).alias("k")), F.struct(day("1997-01-01").alias("from_date"), day(None).alias("to_date"), F.lit(2).alias("k"))))
    return own.withColumn("s", span).select("asset", "product", "exch", (F.col("base") * F.col("s.k")).alias("lot"), "margin", "s.from_date", "s.to_date")


def _tidied(df, *cols):
    return df.withColumns({c: tidy(df, c) for c in cols})


def snapshot(sp, sf):
    """Each day's settle (mean price by volume of days with two prints or more, else the close), turnover by the lot of the day, margin, and the settle before."""
    p = prints(sp, sf).groupBy("asset", "date").agg(F.max_by("price", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "volume")).alias("close"), F.sum(F.col("price") * F.col("volume")).alias("money"), F.sum("volume").alias("volume"), F.count("*").alias("k"))
    p = p.where("volume > 0").withColumn("settle", F.coalesce(F.when(F.col("k") > 1, F.col("money") / F.col("volume")), "close"))
    d = pr.as_dated(p, products(sp, sf), ["asset"]).withColumn("turnover", F.col("lot") * F.col("settle") * F.col("volume"))
    d = d.select("asset", "date", "product", "exch", "lot", "settle", "turnover", (F.col("turnover") * F.col("margin")).alias("margin_value"), F.lag("settle").over(Window.partitionBy("asset").orderBy("date")).alias("pre_settle"))
    return _tidied(d, "settle", "turnover", "margin_value", "pre_settle")


def positions(sp, sf):
    """Position history by contract from signed prints, with the exchange and the lot of the day, in lots and in units."""
    side = F.when(F.col("l_suppkey") % 8 < 4, 1).otherwise(-1)
    t = prints(sp, sf).groupBy("asset", "contract", "date").agg(F.sum(side * F.col("volume")).alias("traded"))
    t = t.withColumn("position", F.sum("traded").over(Window.partitionBy("asset", "contract").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    d = pr.as_dated(t, products(sp, sf), ["asset"])
    return _tidied(d.select("asset", "contract", "date", "exch", "lot", "position", (F.col("position") * F.col("lot")).alias("units")), "position", "units")


def expiries(sp, sf):
    """Contracts of all assets with the expiry that their product's or their exchange's rule gives."""
    f = futures(sp, sf).select("asset", F.trunc("expiry", "month").alias("month")).distinct()
    named = f.join(products(sp, sf).select("asset", "product", "exch").distinct(), "asset")
    days = named.agg(F.add_months(F.min("month"), -1).alias("first"), F.last_day(F.max("month")).alias("last"))
    return pr.expiries(named, mk.calendar(days, HOLIDAYS)).select("asset", "product", "exch", "month", "rule", "expiry")


DROPPED, RENAMED = ("rb9509", "pb9712"), {"MA9606": "MA9606_old"}
CHANGES = {"MA": ("ME", "1996-06-01"), "ZC": ("TC", "1997-05-01")}


def contracts(sp, sf):
    """Daily bars of three products read under old and new codes, a contract dropped and one renamed."""
    f = futures(sp, sf).withColumn("month", F.trunc("expiry", "month")).join(products(sp, sf).select("asset", F.col("product").alias("listed")).distinct(), "asset")
    stored = f.withColumn("inst", F.concat(pr.stored_code("listed", "month", CHANGES), F.date_format("month", "yyMM"))).select("asset", "inst", "date", "close", "volume")
    return _tidied(pr.contracts_of(stored, ["MA", "ZC", "rb", "pb"], CHANGES, DROPPED, RENAMED), "close", "volume")


def fallback(sp, sf):
    """Mean price of the night, else of the afternoon, else the last of the day, with where it's from."""
    mean = lambda lo, hi: F.avg(F.when(F.col("minute").between(lo, hi), F.col("price")))
    d = ticks(sp, sf).groupBy("asset", "date").agg(mean(1260, 1439).alias("night"), mean(810, 899).alias("afternoon"), F.max_by("price", "ts").alias("close"))
    price, source = pr.first_known(night=F.col("night"), afternoon=F.col("afternoon"), close=F.col("close"))
    return _tidied(d.select("asset", "date", price.alias("price"), source.alias("source")), "price")


_PICK = lambda names: "[" + ", ".join(f"'{c}'" for c in names) + "][n % 10 + 1]"
_DIM = f"""pn AS (SELECT DISTINCT p_brand AS asset, regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS n FROM part), pd AS (SELECT asset, {_PICK(CODES)} AS product, {_PICK(EXCHANGES)} AS exch, 5 * (1 + n % 4) AS base, 0.05::DOUBLE + 0.01::DOUBLE * (n % 3) AS margin FROM pn)"""
_LOT = "CASE WHEN date >= DATE '1997-01-01' THEN 2 * base WHEN date >= DATE '1993-01-01' THEN base END"
_IN = "CASE WHEN date >= DATE '1993-01-01' THEN {} END"
_RULE = """CASE WHEN product IN ('sc') THEN 'before_month' WHEN product IN ('lh') THEN 'fourth_last' WHEN product IN ('IF') THEN 'third_friday' WHEN product IN ('T') THEN 'second_friday' WHEN product IN ('ZC') THEN 'fifth'
  WHEN exch IN ('DCE', 'CZCE') THEN 'tenth' WHEN exch = 'SHFE' THEN 'fifteenth' WHEN exch = 'LME' THEN 'last' END"""
_BDAYS = f"""bd AS (SELECT d::DATE AS d FROM (SELECT unnest(generate_series((SELECT min(month) FROM c) - INTERVAL 1 MONTH, (SELECT last_day(max(month)) FROM c), INTERVAL 1 DAY)) AS d) WHERE isodow(d) <= 5 AND d::DATE NOT IN ({", ".join(f"DATE '{h}'" for h in HOLIDAYS)}))"""
QUERIES = {"dim_snapshot": snapshot, "dim_positions": positions, "dim_expiries": expiries, "dim_contracts": contracts, "dim_price_fallback": fallback}
SQL = {
    "dim_snapshot": f"""WITH {PRINTS_SQL}, {_DIM}, b AS (SELECT asset, date, last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price, volume) AS close, sum(price * volume) AS money, sum(volume) AS volume, count(*) AS k FROM prints GROUP BY ALL HAVING sum(volume) > 0),
s AS (SELECT *, CASE WHEN k > 1 THEN money / volume ELSE close END AS settle, {_LOT} AS lot FROM b JOIN pd USING (asset))
SELECT asset, date, {_IN.format('product')} AS product, {_IN.format('exch')} AS exch, lot::INT AS lot, {tidy_sql('settle')} AS settle, {tidy_sql('lot * settle * volume')} AS turnover, {tidy_sql('lot * settle * volume * margin')} AS margin_value, {tidy_sql('lag(settle) OVER (PARTITION BY asset ORDER BY date)')} AS pre_settle FROM s""",
    "dim_positions": f"""WITH {PRINTS_SQL}, {_DIM}, t AS (SELECT asset, contract, date, sum(CASE WHEN l_suppkey % 8 < 4 THEN volume ELSE -volume END) AS traded FROM prints GROUP BY ALL),
p AS (SELECT asset, contract, date, sum(traded) OVER (PARTITION BY asset, contract ORDER BY date) AS position FROM t) SELECT asset, contract, date, {_IN.format('exch')} AS exch, ({_LOT})::INT AS lot, {tidy_sql('position')} AS position, {tidy_sql(f'position * ({_LOT})')} AS units FROM p JOIN pd USING (asset)""",
    "dim_expiries": f"""WITH {FUTURES_SQL}, {_DIM}, c AS (SELECT DISTINCT asset, product, exch, date_trunc('month', expiry)::DATE AS month, {_RULE} AS rule FROM fb JOIN pd USING (asset)), {_BDAYS}
SELECT asset, product, exch, month, rule, CASE rule WHEN 'before_month' THEN (SELECT max(d) FROM bd WHERE d < month) WHEN 'fourth_last' THEN (SELECT list(d ORDER BY d DESC)[4] FROM bd WHERE date_trunc('month', d) = month)
  WHEN 'third_friday' THEN (SELECT min(d) FROM bd WHERE d >= (SELECT f::DATE FROM (SELECT unnest(generate_series(month::TIMESTAMP, month + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS f) WHERE isodow(f) = 5 AND day(f) BETWEEN 15 AND 21))
  WHEN 'second_friday' THEN (SELECT min(d) FROM bd WHERE d >= (SELECT f::DATE FROM (SELECT unnest(generate_series(month::TIMESTAMP, month + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS f) WHERE isodow(f) = 5 AND day(f) BETWEEN 8 AND 14))
  WHEN 'fifth' THEN (SELECT list(d ORDER BY d)[5] FROM bd WHERE date_trunc('month', d) = month) WHEN 'tenth' THEN (SELECT list(d ORDER BY d)[10] FROM bd WHERE date_trunc('month', d) = month)
  WHEN 'fifteenth' THEN (SELECT min(d) FROM bd WHERE d > month + 13) WHEN 'last' THEN (SELECT max(d) FROM bd WHERE date_trunc('month', d) = month) END AS expiry FROM c""",
    "dim_contracts": f"""WITH {FUTURES_SQL}, {_DIM}, i AS (SELECT asset, date, close, volume, product, CASE WHEN product = 'MA' AND expiry < DATE '1996-06-01' THEN 'ME' WHEN product = 'ZC' AND expiry < DATE '1997-05-01' THEN 'TC' ELSE product END || strftime(expiry, '%y%m') AS inst FROM fb JOIN pd USING (asset) WHERE product IN ('MA', 'ZC', 'rb', 'pb'))
SELECT asset, CASE inst WHEN 'MA9606' THEN 'MA9606_old' ELSE inst END AS inst, date, {tidy_sql('close')} AS close, {tidy_sql('volume')} AS volume, product FROM i WHERE inst NOT IN ('rb9509', 'pb9712')""",
    "dim_price_fallback": f"""WITH {TICKS_SQL}, d AS (SELECT asset, date, avg(price) FILTER (minute >= 1260) AS night, avg(price) FILTER (minute BETWEEN 810 AND 899) AS afternoon, arg_max(price, ts) AS close FROM ticks GROUP BY ALL)
SELECT asset, date, {tidy_sql('coalesce(night, afternoon, close)')} AS price, CASE WHEN night IS NOT NULL THEN 'night' WHEN afternoon IS NOT NULL THEN 'afternoon' WHEN close IS NOT NULL THEN 'close' END AS source FROM d""",
}
