"""Stores as Parquet tables in the shared folder: factor rows, roll maps as JSON, scenario results, patches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets one of its own; a cluster must name one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quaystone-"))
        found = sc.getCheckpointDir()
    return found


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


FACTOR_KEYS = ["product_code", "roll_label", "freq", "fact_name", "date"]


def write_factors(panel: DataFrame, fields: list[str], path: str, roll_label: str = "hot", freq: str = "d") -> None:
    """Long factor rows without nulls, stamped and laid out so that reads by name touch only their folders."""
    long = panel.unpivot(["asset", "date"], fields, "fact_name", "fact_val").where("fact_val IS NOT NULL")
    long.select(F.col("asset").alias("product_code"), F.lit(roll_label).alias("roll_label"), F.lit(freq).alias("freq"), "fact_name", "date", "fact_val").write.mode("overwrite").partitionBy("roll_label", "freq", "fact_name").parquet(path)


def read_factors(spark: SparkSession, path: str, names: list[str], first: str, last: str, products: list[str] | None = None) -> DataFrame:
    f = spark.read.parquet(path).where(F.col("fact_name").isin(names) & F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return f.where(F.col("product_code").isin(products)) if products else f


def write_roll_json(rolls: DataFrame, path: str, exch: str = "X") -> None:
    """asset, contract, start as a line of JSON per asset: {exch: {asset: [{date, to}]}}. No task holds more than an asset's rolls."""
    lists = rolls.groupBy("asset").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("string").alias("date"), F.col("contract").alias("to")))).alias("rolls"))
    lists.select(F.to_json(F.create_map(F.lit(exch), F.create_map("asset", "rolls"))).alias("value")).write.text(path)


def read_roll_json(spark: SparkSession, path: str) -> DataFrame:
    kind = "map<string, map<string, array<struct<date: string, to: string>>>>"
    m = spark.read.text(path).select(F.from_json("value", kind).alias("m"))
    return m.select(F.explode("m").alias("exch", "n")).select("exch", F.explode("n").alias("asset", "rolls")).select("exch", "asset", F.explode("rolls").alias("r")).select("exch", "asset", F.to_date("r.date").alias("start"), F.col("r.to").alias("contract"))


def patch(old: DataFrame, new: DataFrame, inside) -> DataFrame:
    """Rows of old outside a range and of new inside it."""
    return old.where(~inside).unionByName(new.where(inside))
