"""Blocked Bloom filters as small tables, in DataFrame functions only.

A filter is a table of blocks of eight 64-bit words; a key sets one bit in each word of one block. The number of blocks
follows that of the keys up to MOST_BLOCKS, so the table may always be sent to every executor; with more keys than
it is made for only more keys pass that aren't in it, and the exact join behind the filter removes those.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import cut

WORDS, BITS_PER_KEY = 8, 16
#: At 72 bytes a block no more than 19 MB.
MOST_BLOCKS = 1 << 18


def _bits(hashed: Column) -> list[Column]:
    return [F.shiftrightunsigned(hashed, 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in range(WORDS)]


def build(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The table (block, w0 to w7) of a key column, and the number of blocks."""
    blocks = min(MOST_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, keys.count() * BITS_PER_KEY / (64 * WORDS))))))
    second = F.xxhash64(F.lit(1), F.col(key))
    rows = keys.select(F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).alias("block"), *[b.alias(f"b{j}") for j, b in enumerate(_bits(second))])
    return cut(rows.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, b{j})")).alias(f"w{j}") for j in range(WORDS)])), blocks


def probed(rows: DataFrame, key: str, filters: DataFrame, blocks: int, keep_all: bool = False) -> DataFrame:
    """The rows whose key may be among those of the filter; with keep_all every row, with a column possible."""
    sent = F.broadcast(filters)  # at most MOST_BLOCKS rows
    keyed = rows.withColumns({"block": F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)), "__h": F.xxhash64(F.lit(1), F.col(key))})
    met = keyed.join(sent, "block", "left" if keep_all else "inner")
    sure = F.lit(True)
    for j in range(WORDS):
        sure = sure & (F.expr(f"(shiftrightunsigned(w{j}, cast(shiftrightunsigned(__h, {6 * j}) & 63 as int)) & 1) = 1"))
    if keep_all:
        return met.withColumn("possible", F.coalesce(sure, F.lit(False))).select(*rows.columns, "possible")
    return met.where(sure).select(*rows.columns)
