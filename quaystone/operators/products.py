"""A dated table of products (lot, margin, exchange by spans of days), expiries by each product's rule, code changes on reading, and price fall-backs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which rule of expiry holds, by product and else by exchange.
PRODUCT_RULES = {
    "before_month": ("fu", "sc", "lu"), "fourth_last": ("lh", "jd", "pg", "eb", "eg"), "third_friday": ("IF", "IH", "IC", "IM"), "second_friday": ("T", "TF", "TS", "TL"), "fifth": ("ZC", "TC"),
}
EXCHANGE_RULES = {"tenth": ("DCE", "CZCE", "GFEX"), "fifteenth": ("SHFE", "INE"), "last": ("SGX", "LME", "NYMEX", "OTC")}
#: Old codes of products, and the first contract month of the new one.
CODE_CHANGES = {"MA": ("ME", "2015-06-01"), "ZC": ("TC", "2016-05-01")}


def as_dated(rows: DataFrame, dim: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """rows with the columns of dim (keys, from_date, to_date or null for open) whose span holds the row's date; nulls where none does.

    An equality join on the keys with the span as its filter. Spans of a key must not overlap.
    """
    d = dim.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in dim.columns if c not in keys])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    inside = (F.col(date) >= F.col("from_date")) & (F.col("to_date").isNull() | (F.col(date) <= F.col("to_date")))
    on = inside
    for s in same:
        on = on & s
    return rows.join(d, on, "left").drop(*[f"_{k}" for k in keys], "from_date", "to_date")


def overlapping(dim: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of a key that begin before the one before them ends: to be empty before a table is used."""
    w = Window.partitionBy(*keys).orderBy("from_date")
    return dim.withColumns({"_open": F.lag(F.col("to_date").isNull()).over(w), "_end": F.lag("to_date").over(w)}).where(F.col("_open") | (F.col("from_date") <= F.col("_end"))).drop("_open", "_end")


def rule_of(product: Column, exchange: Column) -> Column:
    """Name of the rule of expiry; null where neither the product nor the exchange has one."""
    out = F.lit(None).cast("string")
    for rule, names in EXCHANGE_RULES.items():
        out = F.when(exchange.isin(*names), rule).otherwise(out)
    for rule, names in PRODUCT_RULES.items():
        out = F.when(product.isin(*names), rule).otherwise(out)
    return out


def rule_days(calendar: DataFrame) -> DataFrame:
    """month, rule, expiry: the day each rule gives to a month's contract. calendar: date, is_bday, of whole months and the one before; a row per day."""
    b = calendar.where("is_bday").withColumn("month", F.trunc("date", "month"))
    w = Window.partitionBy("month")
    b = b.withColumns({"nth": F.row_number().over(w.orderBy("date")), "left": F.row_number().over(w.orderBy(F.desc("date")))})
    friday = lambda week: F.date_add("month", F.pmod(4 - F.weekday("month"), F.lit(7)) + 7 * (week - 1))
    first = lambda hit: F.min(F.when(hit, F.col("date")))
    rules = {
        "fourth_last": first(F.col("left") == 4), "third_friday": first(F.col("date") >= friday(3)), "second_friday": first(F.col("date") >= friday(2)),
        "fifth": first(F.col("nth") == 5), "tenth": first(F.col("nth") == 10), "fifteenth": first(F.dayofmonth("date") >= 15), "last": F.max("date"),
    }
    m = b.groupBy("month").agg(*[e.alias(k) for k, e in rules.items()])
    long = m.unpivot(["month"], list(rules), "rule", "expiry")
    before = m.select(F.add_months("month", 1).alias("month"), F.lit("before_month").alias("rule"), F.col("last").alias("expiry"))
    return long.unionByName(before).where("expiry IS NOT NULL")


def expiries(contracts: DataFrame, calendar: DataFrame) -> DataFrame:
    """contracts (product, exch, month, ...) with rule and expiry by product, else by exchange; null without a rule or beyond the calendar."""
    named = contracts.withColumn("rule", rule_of(F.col("product"), F.col("exch")))
    return named.join(rule_days(calendar), ["month", "rule"], "left")


def stored_code(product: str, month: str, changes: dict[str, tuple[str, str]] = CODE_CHANGES) -> Column:
    """The code under which a product's contract of a month was listed."""
    out = F.col(product)
    for new, (old, first) in changes.items():
        out = F.when((F.col(product) == new) & (F.col(month) < F.lit(first).cast("date")), old).otherwise(out)
    return out


def contracts_of(rows: DataFrame, products: list[str] | None = None, changes: dict[str, tuple[str, str]] = CODE_CHANGES, dropped: tuple[str, ...] = (), renamed: dict[str, str] | None = None) -> DataFrame:
    """rows (inst, ...) of products under whatever code they were listed, with product: old codes count for the new product.

    dropped contracts go, renamed ones (stored name to name) get their other name, both by the name as stored.
    """
    now = {old: new for new, (old, _) in changes.items()}
    code = F.regexp_extract("inst", r"^([A-Za-z]+)", 1)
    product = code
    for old, new in now.items():
        product = F.when(code == old, new).otherwise(product)
    out = rows.where(~F.col("inst").isin(*dropped)) if dropped else rows
    if products is not None:  # stated as prefixes of the stored names, so that the scan can use them
        codes = sorted({*products, *[old for old, new in now.items() if new in products]})
        hit = F.lit(False)
        for c in codes:
            hit = hit | F.col("inst").startswith(c)
        out = out.where(hit)
    out = out.withColumn("product", product)
    if products is not None:
        out = out.where(F.col("product").isin(*products))
    name = F.col("inst")
    for a, b in (renamed or {}).items():
        name = F.when(F.col("inst") == a, b).otherwise(name)
    return out.withColumn("inst", name)


def first_known(**prices: Column) -> tuple[Column, Column]:
    """The first price that isn't null, in the order given, and its name."""
    which = F.lit(None).cast("string")
    for name, p in reversed(prices.items()):
        which = F.when(p.isNotNull(), name).otherwise(which)
    return F.coalesce(*prices.values()), which
