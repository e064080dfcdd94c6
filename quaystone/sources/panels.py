"""Panels built from the stored tables: prints, daily bars, ticks and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, sector, contract, date, price and volume of each line item, with the columns that put a day's prints in order."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("asset"), F.col("p_type").alias("sector"), (F.col("l_suppkey") % 4).cast("string").alias("contract"),
        F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "volume"]


def bars(trades: DataFrame, *keys: str) -> DataFrame:
    """Open, high, low, close, volume and number of prints of each group; partial sums come before the shuffle."""
    place = F.struct(*ORDER)
    return trades.groupBy(*keys).agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"),
        F.sum("volume").alias("volume"), F.sum("l_linenumber").cast("double").alias("oi"), F.count("*").alias("n_prints"),
    )


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy("asset").orderBy("date")) - 1)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily panel: a row per asset and date, with rn."""
    return numbered(bars(prints(spark, sf_dir), "asset", "date"))


PRINTS_SQL = """prints AS (SELECT p_brand AS asset, p_type AS sector, (l_suppkey % 4)::VARCHAR AS contract, l_shipdate::DATE AS date, l_extendedprice / l_quantity AS price,
  l_quantity AS volume, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_BY = "ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price, volume"


def bars_sql(*keys: str, source: str = "prints") -> str:
    k = ", ".join(keys)
    return f"SELECT {k}, first(price {_BY}) AS open, max(price) AS high, min(price) AS low, last(price {_BY}) AS close, sum(volume) AS volume, sum(l_linenumber)::DOUBLE AS oi, count(*) AS n_prints FROM {source} GROUP BY {k}"


DAILY_SQL = f"{PRINTS_SQL}, s0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS rn FROM ({bars_sql('asset', 'date')}))"


def futures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of contracts: a print belongs to the contract that expires at the end of its quarter or of one of the next three."""
    expiry = F.last_day(F.add_months(F.trunc("date", "quarter"), 3 * F.col("contract").cast("int") + 2))
    named = prints(spark, sf_dir).withColumn("expiry", expiry).withColumn("contract", F.date_format("expiry", "yyyyMM"))
    return bars(named, "asset", "contract", "expiry", "date")


FUTURES_SQL = f"""{PRINTS_SQL}, fp AS (SELECT * REPLACE (strftime(expiry, '%Y%m') AS contract) FROM (SELECT *, last_day((date_trunc('quarter', date) + to_months((3 * contract::INT + 2)::INT))::DATE) AS expiry FROM prints)),
fb AS MATERIALIZED ({bars_sql('asset', 'contract', 'expiry', 'date', source='fp')})"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, ts, date, price and size of each event."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("asset"), "event_id", "ts", F.to_date("ts").alias("date"), F.col("value").alias("price"), "event_type",
        (F.hour("ts") * 60 + F.minute("ts")).alias("minute"), F.col("props"),
    )


TICKS_SQL = "ticks AS (SELECT user_id AS asset, event_id, ts, ts::DATE AS date, value AS price, event_type, (hour(ts) * 60 + minute(ts))::INT AS minute, props FROM events)"
