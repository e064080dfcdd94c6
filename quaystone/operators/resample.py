"""Resampling by Poisson weights, and tables with totals on both axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of 2^32: where a uniform number stops giving a weight of 0, 1, 2, ... by the Poisson distribution of mean one.
POISSON = tuple(round(p * 2**32) for p in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974021))
YEAR = 244


def poisson_weight(*keys: str) -> Column:
    """A weight that follows from the keys by a hash: the same in every run, whatever the partitioning."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).cast("binary")), 1, 8), 16, 10).cast("long")
    return sum(((u >= p).cast("int") for p in POISSON[1:]), (u >= POISSON[0]).cast("int"))


def weighted_moments(n: Column, s1: Column, s2: Column, s3: Column) -> dict[str, Column]:
    """Mean, deviation, skew and yearly Sharpe from weighted power sums."""
    mean = s1 / F.nullif(n, F.lit(0))
    m2 = F.greatest(s2 / F.nullif(n, F.lit(0)) - mean * mean, F.lit(0.0))
    sd = F.sqrt(m2 * n / F.nullif(n - 1, F.lit(0)))
    m3 = s3 / F.nullif(n, F.lit(0)) - 3 * mean * s2 / F.nullif(n, F.lit(0)) + 2 * mean * mean * mean
    return {"mean": mean, "sd": sd, "skew": m3 / F.nullif(F.pow(m2, F.lit(1.5)), F.lit(0.0)), "sharpe": mean / F.nullif(sd, F.lit(0.0)) * YEAR**0.5}


def _sums(rows: DataFrame, draws: int, by: list[str], keys: list[str], x: str) -> DataFrame:
    """Weighted power sums of every draw: rows are summed where they lie, only a row per group and draw moves."""
    each = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", poisson_weight(*keys, "draw"))
    return each.groupBy(*by, "draw").agg(F.sum("w").alias("n"), *[F.sum(F.expr(f"w * {' * '.join([x] * k)}")).alias(f"s{k}") for k in (1, 2, 3)])


def bootstrap(rets: DataFrame, draws: int = 50, x: str = "ret") -> DataFrame:
    """asset, draw, n, mean, sd, skew and sharpe of each resample of an asset's returns (a row per asset and date)."""
    sums = _sums(rets, draws, ["asset"], ["asset", "date"], x)
    return sums.select("asset", "draw", "n", *[v.alias(k) for k, v in weighted_moments(F.col("n"), F.col("s1"), F.col("s2"), F.col("s3")).items()])


def bootstrap_assets(rets: DataFrame, draws: int = 50, x: str = "ret") -> DataFrame:
    """draw, n and the moments of the pooled returns of drawn assets: an asset's sums count as often as it is drawn."""
    totals = rets.groupBy("asset").agg(F.count(x).alias("n"), *[F.sum(F.expr(" * ".join([x] * k))).alias(f"s{k}") for k in (1, 2, 3)])
    each = totals.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", poisson_weight("asset", "draw"))
    pooled = each.groupBy("draw").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("n", "s1", "s2", "s3")])
    return pooled.select("draw", "n", *[v.alias(k) for k, v in weighted_moments(F.col("n"), F.col("s1"), F.col("s2"), F.col("s3")).items()])


def pivot_with_totals(df: DataFrame, rows: list[str], columns: list[str], value: str, most: int = 500, total: str = "Total") -> DataFrame:
    """Sums of value by rows, a column for each combination of columns that occurs, and totals on both axes; what doesn't occur is 0.

    A null key reads null. More than most combinations are refused: they become columns.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    flat = df.select(*[name(c).alias(f"r{i}") for i, c in enumerate(rows)], F.concat_ws("|", *map(name, columns)).alias("key"), F.col(value).alias("v"))
    keys = sorted(r[0] for r in flat.select("key").distinct().limit(most + 1).collect())
    if len(keys) > most:
        raise ValueError(f"more than {most} columns")
    ids = [f"r{i}" for i in range(len(rows))]
    sums = flat.groupingSets([[*ids, "key"], ids, ["key"], []], *ids, "key").agg(F.sum("v").alias("v"), F.grouping("key").alias("all_keys"), F.grouping(ids[0]).alias("all_rows"))
    sums = sums.select(*[F.when(F.col("all_rows") == 1, total).otherwise(F.col(i)).alias(i) for i in ids], F.when(F.col("all_keys") == 1, total).otherwise(F.col("key")).alias("key"), "v")
    wide = sums.groupBy(*ids).pivot("key", [*keys, total]).agg(F.first("v"))
    return wide.select(*[F.col(i).alias(c) for i, c in zip(ids, rows, strict=True)], *[F.coalesce(F.col(f"`{k}`"), F.lit(0)).alias(k) for k in [*keys, total]])
