"""Registered queries of contracts: activity, roll maps by volume, open interest or expiry, near and far chains, resumed histories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaystone.functions.recipe import Ewm, com, tidy_sql
from quaystone.operators import market as mk
from quaystone.operators import rolls as ro
from quaystone.plans.market_queries import CHAIN_SQL, _r, _rs, chained
from quaystone.sources import store
from quaystone.sources.panels import FUTURES_SQL, bars, futures, prints, read

#: Contracts in a list, bound of activity that is always enough, business days before expiry at which contracts end.
NB, ENOUGH, CUTOFF = 2, 60.0, 10


def back_sql(day: str, n: int) -> str:
    friday = f"least(isodow({day}) - 1, 4)"
    return f"({day} - (isodow({day})::INT - 1) + {friday}::INT - {7 * (n // 5) + n % 5} - CASE WHEN {friday} < {n % 5} THEN 2 ELSE 0 END)"


def _activity(sp, sf, cutoff=0):
    return ro.activity(futures(sp, sf), cutoff=cutoff)


def active_sql(cutoff: int = 0, least: float = 0.0) -> str:
    kept = f"WHERE date <= {back_sql('expiry', cutoff)}" if cutoff else ""
    return f"""{FUTURES_SQL}, ac AS (SELECT *, CASE WHEN row_number() OVER w >= 3 THEN avg(volume * 0.6 + oi * 0.4) OVER (PARTITION BY asset, contract ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS act
  FROM fb {kept} WINDOW w AS (PARTITION BY asset, contract ORDER BY date)),
av AS MATERIALIZED (SELECT * FROM (SELECT *, first_value(act IGNORE NULLS) OVER (PARTITION BY asset, contract ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ind FROM ac) WHERE ind >= {least})"""


def lists(mode: str):
    """oi: the most active contracts, by the first; oi_full: by the whole list; expiry: all contracts up to some days before they end."""

    def run(sp, sf):
        act = _activity(sp, sf, CUTOFF if mode == "expiry" else 0)
        return ro.roll_lists(ro.candidates(act, NB, None if mode == "expiry" else ENOUGH), NB, mode == "oi_full")

    return run


def lists_sql(mode: str) -> str:
    rows = "av" if mode == "expiry" else f"""(SELECT * FROM (SELECT *, least(min(CASE WHEN place <= {NB} THEN ind END) OVER (PARTITION BY asset, date), {ENOUGH}) AS bound FROM
  (SELECT *, row_number() OVER (PARTITION BY asset, date ORDER BY ind DESC, contract) AS place FROM av)) WHERE ind >= bound)"""
    new = f"list_filter(p.names, lambda x: list_contains(r.cur, x) OR x > r.cur[-1])[1:{NB}]"
    stays = f"(len({new}) < {NB} OR {new} = r.cur)" if mode == "oi_full" else f"(len({new}) = 0 OR {new}[1] = r.cur[1])"
    return f"""{active_sql(CUTOFF if mode == "expiry" else 0)}, nm AS MATERIALIZED (SELECT asset, date, list(contract ORDER BY contract) AS names, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS rn FROM {rows} GROUP BY asset, date),
r(asset, date, rn, cur, hit) AS (SELECT asset, date, rn, names[1:{NB}], true FROM nm WHERE rn = 0 UNION ALL
  SELECT p.asset, p.date, p.rn, CASE WHEN {stays} THEN r.cur ELSE {new} END, NOT {stays} FROM r JOIN nm p ON p.asset = r.asset AND p.rn = r.rn + 1),
rl AS (SELECT asset, date, cur FROM r WHERE hit)"""


def joined(sp, sf, mode):
    return lists(mode)(sp, sf).select("asset", "date", F.array_join("contracts", ",").alias("contracts"))


def prices(sp, sf):
    return _r(ro.roll_prices(lists("oi")(sp, sf), futures(sp, sf)), "oldclose", "newclose")


def near(n: int):
    return lambda sp, sf: _r(ro.nearby(futures(sp, sf), n).select("asset", "contract", "date", "close", "seg_start"), "close")


def near_sql(n: int, name: str) -> str:
    return f"""{name}d AS (SELECT DISTINCT asset, contract, expiry FROM fb), {name}e AS (SELECT *, {back_sql('expiry', 5)} AS seg_end FROM {name}d),
{name}s AS (SELECT asset, lead(contract, {n - 1}) OVER w AS contract, coalesce(lag(seg_end) OVER w + 1, DATE '1900-01-01') AS seg_start, seg_end FROM {name}e WINDOW w AS (PARTITION BY asset ORDER BY expiry)),
{name} AS MATERIALIZED (SELECT fb.*, g.seg_start FROM fb JOIN {name}s g ON fb.asset = g.asset AND fb.contract = g.contract AND fb.date BETWEEN g.seg_start AND g.seg_end)"""


def additive(sp, sf):
    return _r(mk.back_adjusted(chained(sp, sf), ratio=False).select("asset", "date", "shift", "adj_close"), "shift", "adj_close")


def job(sp, sf):
    """The history up to a day is stored with the rolls known then, and carried on by a later run over all; the result is that of one run."""

    def history(rows):
        return mk.back_adjusted(mk.chain(rows, mk.chain_segments(mk.roll_map(rows)))).select("asset", "date", F.col("adj_close").alias("close"), "shift")

    every, path = bars(prints(sp, sf), "asset", "contract", "date"), store.folder(sp, "history")
    history(every.where("date <= '1998-06-30'")).write.parquet(path)
    return _r(ro.resumed(sp.read.parquet(path), history(every), ["close"]), "close", "shift")


def pair_panel(sp, sf):
    """Near and far contract of an asset's day, with each contract's own return and the roll yield a year."""
    w = Window.partitionBy("asset", "contract").orderBy("date")
    each = futures(sp, sf).withColumn("lr", F.ln(F.col("close") / F.lag("close").over(w)))
    one = ro.nearby(each, 1).select("asset", "date", "contract", "open", "high", "low", "close", "volume", "expiry", "lr")
    two = ro.nearby(each, 2).select("asset", "date", F.col("close").alias("far"), F.col("expiry").alias("far_expiry"), F.col("lr").alias("far_lr"))
    both = one.join(two, ["asset", "date"])
    both = both.withColumn("ryield", (F.ln("close") - F.ln("far")) / F.nullif(F.datediff("far_expiry", "expiry"), F.lit(0)) * 365)
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("asset").orderBy("date")) - 1)


_FB = FUTURES_SQL.replace("fb AS MATERIALIZED (SELECT", "fb0 AS MATERIALIZED (SELECT") + ", fb AS MATERIALIZED (SELECT *, ln(close / lag(close) OVER (PARTITION BY asset, contract ORDER BY date)) AS lr FROM fb0)"
#: Ends in s0.
PAIR_SQL = f"""{_FB}, {near_sql(1, 'n1')}, {near_sql(2, 'n2')},
s0 AS MATERIALIZED (SELECT a.asset, a.date, a.contract, a.open, a.high, a.low, a.close, a.volume, a.expiry, a.lr, b.close AS far, b.expiry AS far_expiry, b.lr AS far_lr,
  (ln(a.close) - ln(b.close)) / nullif(b.expiry - a.expiry, 0) * 365 AS ryield, row_number() OVER (PARTITION BY a.asset ORDER BY a.date) - 1 AS rn FROM n1 a JOIN n2 b ON a.asset = b.asset AND a.date = b.date)"""


def physical_carry(sp, sf):
    """A spot price against the near contract, annualised by the days to its expiry, plus a smoothed rate; spot, rate and contract hold until the next known."""
    near1 = ro.nearby(futures(sp, sf), 1).select("asset", "date", "close", "expiry")
    spot = read(sp, sf, "part").join(read(sp, sf, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("asset"), F.to_date("l_shipdate").alias("date")).agg(F.avg("p_retailprice").alias("spot"), (100 * F.avg("l_discount")).alias("rate"))
    both = near1.join(spot, ["asset", "date"], "full").withColumn("rn", F.row_number().over(Window.partitionBy("asset").orderBy("date")) - 1)
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in ("close", "expiry", "spot", "rate")})
    rated = Ewm("smooth", "rate / 100", com(5)).apply(held)
    carry = (F.ln("spot") - F.ln("close")) / F.nullif(F.datediff("expiry", "date"), F.lit(0)) * 365 + F.col("smooth")
    return _r(rated.select("asset", "date", carry.alias("carry")), "carry")


def carry_sql() -> str:
    held = ", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ("close", "expiry", "spot", "rate"))
    return f"""WITH {FUTURES_SQL}, {near_sql(1, 'n1')}, sp AS (SELECT p_brand AS asset, l_shipdate::DATE AS date, avg(p_retailprice) AS spot, 100 * avg(l_discount) AS rate FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL),
bt AS (SELECT asset, date, close, expiry, spot, rate FROM n1 FULL JOIN sp USING (asset, date)), h AS MATERIALIZED (SELECT asset, date, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS rn, {held} FROM bt WINDOW w AS (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING)),
x AS ({Ewm('smooth', 'rate / 100', com(5)).sql('h')}) SELECT asset, date, {tidy_sql('(ln(spot) - ln(close)) / nullif(expiry - date, 0) * 365 + smooth')} AS carry FROM x"""


def hot_schedule(sp, sf):
    """Daily rows written as nested JSON, read back flat, and the two contracts of most open interest of each asset's day."""
    path = store.folder(sp, "cache")
    rows = futures(sp, sf).select(F.col("date").cast("string").alias("date"), "asset", "contract", F.struct(F.col("volume"), "oi", "close").alias("x"))
    by_asset = rows.groupBy("date", "asset").agg(F.map_from_entries(F.collect_list(F.struct("contract", "x"))).alias("m"))  # a day's live contracts
    by_asset.select(F.to_json(F.create_map("date", F.create_map("asset", "m"))).alias("value")).write.text(path)
    flat = ro.flattened(sp.read.text(path))
    w = Window.partitionBy("exch", "date").orderBy(F.desc("oi"), "code")
    flat = flat.withColumn("place", F.row_number().over(w)).where("place <= 2")
    return _r(flat.select(F.col("exch").alias("asset"), "date", "place", "code", "close"), "close")


QUERIES = {
    "roll_activity": lambda sp, sf: _r(ro.activity(futures(sp, sf), cutoff=CUTOFF, least=10.0).select("asset", "contract", "date", "ind"), "ind"),
    "roll_lists_oi": lambda sp, sf: joined(sp, sf, "oi"), "roll_lists_full": lambda sp, sf: joined(sp, sf, "oi_full"), "roll_lists_expiry": lambda sp, sf: joined(sp, sf, "expiry"),
    "roll_prices": prices, "roll_near": near(1), "roll_far": near(2), "roll_back_adjust_diff": additive, "roll_resumed": job, "roll_hot": hot_schedule, "ts_carry": physical_carry,
}
_LIST = "SELECT asset, date, array_to_string(cur, ',') AS contracts FROM rl"
SQL = {
    "roll_activity": f"WITH {active_sql(CUTOFF, 10.0)} SELECT asset, contract, date, {_rs('ind')} FROM av",
    "roll_lists_oi": f"WITH RECURSIVE {lists_sql('oi')} {_LIST}", "roll_lists_full": f"WITH RECURSIVE {lists_sql('oi_full')} {_LIST}", "roll_lists_expiry": f"WITH RECURSIVE {lists_sql('expiry')} {_LIST}",
    "roll_prices": f"""WITH RECURSIVE {lists_sql('oi')}, f AS (SELECT asset, date, cur[1] AS c, lag(cur[1]) OVER (PARTITION BY asset ORDER BY date) AS p FROM rl)
SELECT f.asset, f.date + CASE WHEN isodow(f.date) >= 5 THEN 8 - isodow(f.date)::INT ELSE 1 END AS date, coalesce(f.p, '') AS "from", {tidy_sql('coalesce(o.close, 0)')} AS oldclose, f.c AS "to", {tidy_sql('coalesce(n.close, 0)')} AS newclose
FROM f LEFT JOIN fb o ON o.asset = f.asset AND o.contract = f.p AND o.date = f.date LEFT JOIN fb n ON n.asset = f.asset AND n.contract = f.c AND n.date = f.date WHERE f.p IS NULL OR f.p <> f.c""",
    "roll_near": f"WITH {FUTURES_SQL}, {near_sql(1, 'n1')} SELECT asset, contract, date, {_rs('close')}, seg_start FROM n1",
    "roll_far": f"WITH {FUTURES_SQL}, {near_sql(2, 'n2')} SELECT asset, contract, date, {_rs('close')}, seg_start FROM n2",
    "roll_back_adjust_diff": f"""WITH {CHAIN_SQL}, gd AS (SELECT asset, seg_start, CASE WHEN lead(fc) OVER w > 0 AND lc > 0 THEN lead(fc) OVER w - lc ELSE 0 END AS gap FROM sg WINDOW w AS (PARTITION BY asset ORDER BY seg_start)),
sd AS (SELECT asset, seg_start, sum(gap) OVER (PARTITION BY asset ORDER BY seg_start DESC) AS shift FROM gd) SELECT asset, date, {_rs('shift')}, {tidy_sql('close + shift')} AS adj_close FROM ch JOIN sd USING (asset, seg_start)""",
    "roll_resumed": f"WITH {CHAIN_SQL} SELECT asset, date, {tidy_sql('close * exp(shift)')} AS close, {_rs('shift')} FROM ch JOIN sh USING (asset, seg_start)",
    "roll_hot": f"WITH {FUTURES_SQL} SELECT asset, date, place::INT AS place, contract AS code, {_rs('close')} FROM (SELECT *, row_number() OVER (PARTITION BY asset, date ORDER BY oi DESC, contract) AS place FROM fb) WHERE place <= 2",
    "ts_carry": carry_sql(),
}
