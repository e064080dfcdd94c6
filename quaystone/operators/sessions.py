"""Trading sessions as bit masks: a word of 60 minute bits for each hour, per product and dated group.

A product's rows of sessions (with exceptions that close) become groups of days with the same hours, and each group one
mask. The table of masks has a row per product, so a tick finds its product's masks by one equality join and then only
tests a bit, however many sessions and exceptions there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURS, MINUTES = 24, 60


def masks(sessions: DataFrame) -> DataFrame:
    """kind and groups (from_date and mask, by date); sessions: kind, from_date, to_date (both inclusive), start_minute, end_minute (exclusive; not after start: across midnight) and open (false: an exception that closes those minutes)."""
    bounds = sessions.select("kind", F.explode(F.array("from_date", F.date_add("to_date", 1))).alias("day")).distinct()
    active = bounds.join(sessions, "kind").where("day BETWEEN from_date AND to_date")
    last = F.when(F.col("end_minute") > F.col("start_minute"), F.col("end_minute")).otherwise(F.col("end_minute") + HOURS * MINUTES) - 1
    minutes = active.select("kind", "day", "open", F.explode(F.sequence("start_minute", last)).alias("m")).withColumn("m", F.col("m") % (HOURS * MINUTES))
    bit = F.expr(f"shiftleft(1L, m % {MINUTES})")
    words = minutes.groupBy("kind", "day", F.expr(f"m div {MINUTES}").alias("hour")).agg(F.bit_or(F.when(F.col("open"), bit).otherwise(0)).alias("on"), F.bit_or(F.when(F.col("open"), 0).otherwise(bit)).alias("off"))
    words = words.withColumn("word", F.col("on").bitwiseAND(F.bitwise_not("off")))
    found = words.groupBy("kind", "day").agg(F.map_from_entries(F.collect_list(F.struct("hour", "word"))).alias("at"))
    full = bounds.join(found, ["kind", "day"], "left")
    mask = F.transform(F.sequence(F.lit(0), F.lit(HOURS - 1)), lambda h: F.coalesce(F.try_element_at("at", h.cast("long")), F.lit(0).cast("long")))
    return full.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct(F.col("day").alias("from_date"), mask.alias("mask")))).alias("groups"))


def bit_at(mask: Column, minute: Column) -> Column:
    minute = F.pmod(minute, F.lit(HOURS * MINUTES)).cast("int")
    word = F.get(mask, F.floor(minute / MINUTES).cast("int"))
    return F.call_function("getbit", word, minute % MINUTES) == 1


def with_session(ticks: DataFrame, sessions: DataFrame, kind: str, date: str = "date", minute: str = "minute", buffer: int = 0) -> DataFrame:
    """ticks with in_session: whether the minute, or one at most buffer minutes away, is in a session of its kind on its date (false where there is none)."""
    met = ticks.join(masks(sessions).withColumnRenamed("kind", "kind_"), F.col(kind) == F.col("kind_"), "left")
    mask = F.try_element_at(F.filter("groups", lambda g: g["from_date"] <= F.col(date)), F.lit(-1))["mask"]
    met = met.withColumn("mask_", mask)
    near = F.lit(False)
    for shift in range(-buffer, buffer + 1):
        near = near | F.coalesce(bit_at(F.col("mask_"), F.col(minute) + shift), F.lit(False))
    return met.withColumn("in_session", near).select(*ticks.columns, "in_session")
