"""Statistics of a row's season label and its neighbours from running states (n, mean, m2) that add up and can be taken back.

A row counts for its own label and for those it is a neighbour of, so a label's sample comes from one window over
(asset, label) and no row is joined to its past.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Labels:
    """Labels low to high; a label's sample holds those from back before it to forward behind it.

    wrap: the label after high is low; otherwise labels beyond either end don't count. split: labels below zero and
    the others don't mix.
    """

    low: int
    high: int
    back: int = 1
    forward: int = 1
    wrap: bool = True
    split: bool = False

    def counted_for(self, label: str) -> Column:
        """The labels whose sample a row of this label belongs to, each once."""
        own = F.col(label).cast("long")
        near = F.sequence(own - self.forward, own + self.back)
        if self.wrap:
            near = F.array_distinct(F.transform(near, lambda j: F.pmod(j - self.low, F.lit(self.high - self.low + 1)) + self.low))
        else:
            near = F.filter(near, lambda j: j.between(self.low, self.high))
        return F.filter(near, lambda j: (j >= 0) == (own >= 0)) if self.split else near


def state(x: str, window=None) -> Column:
    """n, mean and m2 (sum of squared deviations) of x, over a window or as an aggregate."""
    n, mean, var = (f(x) if window is None else f(x).over(window) for f in (F.count, F.avg, F.var_pop))
    return F.struct(n.alias("n"), F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(var * n, F.lit(0.0)).alias("m2"))


def _of(n: Column, mean: Column, m2: Column) -> Column:
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))


def plus(a: str, b: str) -> Column:
    """The state of two samples put together."""
    n, gap = F.col(f"{a}.n") + F.col(f"{b}.n"), F.col(f"{b}.mean") - F.col(f"{a}.mean")
    share = F.coalesce(F.col(f"{b}.n") / F.nullif(n, F.lit(0)), F.lit(0.0))
    return _of(n, F.col(f"{a}.mean") + gap * share, F.col(f"{a}.m2") + F.col(f"{b}.m2") + gap * gap * F.col(f"{a}.n") * share)


def minus(a: str, b: str) -> Column:
    """The state of what is left of sample a without its part b; an empty rest is all zero, a rest of one has no spread."""
    n = F.col(f"{a}.n") - F.col(f"{b}.n")
    mean = (F.col(f"{a}.mean") * F.col(f"{a}.n") - F.col(f"{b}.mean") * F.col(f"{b}.n")) / F.nullif(n, F.lit(0))
    m2 = F.col(f"{a}.m2") - F.col(f"{b}.m2") - (mean - F.col(f"{b}.mean")) ** 2 * F.col(f"{b}.n") * n / F.nullif(F.col(f"{a}.n"), F.lit(0))
    return _of(n, F.coalesce(mean, F.lit(0.0)), F.when(n > 1, F.greatest(m2, F.lit(0.0))).otherwise(0.0))


def running(df: DataFrame, x: str, label: str, year: str, labels: Labels, year_shift: int = 0, years: int | None = None, least: int = 0) -> DataFrame:
    """df (asset, date once each, label, year that never falls with the date) with st, the state of each row's sample, and its last value.

    The sample holds the rows up to the row's date whose label is near, from years before its year to year_shift before
    it. Without a shift, older years are taken back from the running state. Rows with a label outside low to high are
    dropped; with fewer than least rows st and last are null. Null x don't count.
    """
    rows = df.where(F.col(label).between(labels.low, labels.high)).withColumn("_target", F.explode(labels.counted_for(label)))
    by = Window.partitionBy("asset", "_target")
    if year_shift:
        w = by.orderBy(year).rangeBetween(Window.unboundedPreceding if years is None else -years, -year_shift)
        rows = rows.withColumns({"st": state(x, w), "last": F.max_by(x, F.when(F.col(x).isNotNull(), F.col("date"))).over(w)})
    else:
        rows = rows.withColumns({"st": state(x, by.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)), "last": F.col(x)})
        if years is not None:
            rows = rows.withColumn("_old", state(x, by.orderBy(year).rangeBetween(Window.unboundedPreceding, -years - 1))).withColumn("st", minus("st", "_old")).drop("_old")
    own = rows.where(F.col("_target") == F.col(label)).drop("_target")
    enough = F.col("st.n") >= least
    return own.withColumns({"last": F.when(enough, F.col("last")), "st": F.when(enough, F.col("st"))})


def deviation(st: str = "st", sample: bool = True) -> Column:
    n = F.col(f"{st}.n")
    return F.sqrt(F.col(f"{st}.m2") / F.nullif(n - 1 if sample else n, F.lit(0)))


def scored(found: DataFrame) -> DataFrame:
    """The last value of each sample less its mean, by its deviation: n, score; null without spread."""
    return found.withColumns({"n": F.col("st.n"), "score": (F.col("last") - F.col("st.mean")) / F.nullif(deviation(), F.lit(0.0))}).drop("st", "last")


def closing(df: DataFrame, x: str, label: str, labels: Labels) -> DataFrame:
    """The states of all labels of an asset at the end, to be stored and added to: asset, label, st."""
    rows = df.where(F.col(label).between(labels.low, labels.high)).select("asset", x, F.explode(labels.counted_for(label)).alias("label"))
    return rows.groupBy("asset", "label").agg(state(x).alias("st"))


def resumed(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored states with those of new rows added; a label that only one side has keeps its state."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    both = stored.withColumnRenamed("st", "a").join(new.withColumnRenamed("st", "b"), ["asset", "label"], "full")
    both = both.withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none)})
    return both.select("asset", "label", plus("a", "b").alias("st"))
