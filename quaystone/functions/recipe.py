"""Recipes: steps on a long panel, each stated as Spark Columns and as SQL text for the cross-check.

A panel has key columns (asset by default), an order column (date) and rn, the row's number within its asset from 0.
Steps are dictionaries of new columns, ewm() steps, or where() filters. Windows that share partition and order share
one exchange and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSET, DATE = ("asset",), ("date",)


@dataclass(frozen=True)
class Ex:
    """An expression: col() makes the Column, sql is the same in SQL."""

    col: Callable[[], Column]
    sql: str


def s(text: str) -> Ex:
    """A scalar expression that reads the same in both dialects; divisors need nullif(..., 0)."""
    return Ex(lambda: F.expr(text), text)


def _over(keys, order) -> str:
    return f"PARTITION BY {', '.join(keys)}" + (f" ORDER BY {', '.join(order)}" if order else "")


def roll(fn: str, x: str, n: int, least: int | None = None, keys=ASSET, order=DATE, shift: int = 0) -> Ex:
    """fn of the last n rows (shift rows ago), null until least of them (n if not given) aren't null."""
    least, lo, hi = n if least is None else least, -(n - 1) - shift, -shift
    frame = f"{_over(keys, order)} ROWS BETWEEN {-lo} PRECEDING AND {f'{-hi} PRECEDING' if hi else 'CURRENT ROW'}"

    def col():
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(lo, hi)
        return F.when(F.count(F.expr(x)).over(w) >= least, getattr(F, fn)(F.expr(x)).over(w))

    return Ex(col, f"CASE WHEN count({x}) OVER ({frame}) >= {least} THEN {fn}({x}) OVER ({frame}) END")


def quantile(x: str, p: float, n: int, least: int | None = None, shift: int = 0) -> Ex:
    """Exact quantile with linear interpolation over a row window."""
    least = n if least is None else least
    frame = f"{_over(ASSET, DATE)} ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'}"

    def col():
        w = Window.partitionBy(*ASSET).orderBy(*DATE).rowsBetween(-(n - 1) - shift, -shift)
        return F.when(F.count(F.expr(x)).over(w) >= least, F.percentile(F.expr(x), F.lit(p)).over(w))

    return Ex(col, f"CASE WHEN count({x}) OVER ({frame}) >= {least} THEN quantile_cont({x}, {p}) OVER ({frame}) END")


@dataclass(frozen=True)
class RollingQuantile:
    """A quantile of the last n rows with linear interpolation, from a sorted window that moves along an asset's history.

    A window aggregate would sort n values for every row; here one asset's daily history is a group, in Arrow batches.
    """

    out: str
    x: str
    p: float
    n: int
    least: int

    def apply(self, df: DataFrame) -> DataFrame:
        df = df.withColumn(self.out, F.expr(self.x).cast("double"))

        def quantiles(pdf):
            pdf = pdf.sort_values("date", ignore_index=True)
            pdf[self.out] = pdf[self.out].rolling(self.n, min_periods=self.least).quantile(self.p)
            return pdf

        return df.groupBy(*ASSET).applyInPandas(quantiles, df.schema)

    def sql(self, prev: str) -> str:
        frame = f"{_over(ASSET, DATE)} ROWS BETWEEN {self.n - 1} PRECEDING AND CURRENT ROW"
        return f"SELECT *, CASE WHEN count({self.x}) OVER ({frame}) >= {self.least} THEN quantile_cont({self.x}, {self.p}) OVER ({frame}) END AS {self.out} FROM {prev}"


def pair(fn: str, y: str, x: str, n: int) -> Ex:
    """A two-column aggregate (corr, covar_samp, regr_slope, ...) over n rows in which both aren't null."""
    both = f"CASE WHEN ({y}) IS NOT NULL AND ({x}) IS NOT NULL THEN 1 END"
    frame = f"{_over(ASSET, DATE)} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"

    def col():
        w = Window.partitionBy(*ASSET).orderBy(*DATE).rowsBetween(-(n - 1), 0)
        return F.when(F.count(F.expr(both)).over(w) >= n, getattr(F, fn)(F.expr(y), F.expr(x)).over(w))

    return Ex(col, f"CASE WHEN count({both}) OVER ({frame}) >= {n} THEN {fn}({y}, {x}) OVER ({frame}) END")


def run(fn: str, x: str, keys=ASSET, order=DATE) -> Ex:
    """fn of all rows up to this one."""
    frame = f"{_over(keys, order)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return Ex(lambda: getattr(F, fn)(F.expr(x)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), f"{fn}({x}) OVER ({frame})")


def whole(fn: str, x: str, keys=ASSET) -> Ex:
    """fn of all rows of the key."""
    return Ex(lambda: getattr(F, fn)(F.expr(x)).over(Window.partitionBy(*keys)), f"{fn}({x}) OVER ({_over(keys, ())})")


def lag(x: str, k: int = 1, keys=ASSET, order=DATE) -> Ex:
    """The value k rows ago; negative: ahead."""
    f = "lag" if k >= 0 else "lead"
    return Ex(lambda: getattr(F, f)(F.expr(x), abs(k)).over(Window.partitionBy(*keys).orderBy(*order)), f"{f}({x}, {abs(k)}) OVER ({_over(keys, order)})")


def fill(x: str, back: int | None = None, keys=ASSET, order=DATE) -> Ex:
    """The last value that isn't null, at most back rows ago."""
    lo = f"{back} PRECEDING" if back else "UNBOUNDED PRECEDING"

    def col():
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-back if back else Window.unboundedPreceding, 0)
        return F.last(F.expr(x), ignorenulls=True).over(w)

    return Ex(col, f"last_value({x} IGNORE NULLS) OVER ({_over(keys, order)} ROWS BETWEEN {lo} AND CURRENT ROW)")


def fill_back(x: str, ahead: int | None = None, keys=ASSET, order=DATE) -> Ex:
    hi = f"{ahead} FOLLOWING" if ahead else "UNBOUNDED FOLLOWING"

    def col():
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, ahead or Window.unboundedFollowing)
        return F.first(F.expr(x), ignorenulls=True).over(w)

    return Ex(col, f"first_value({x} IGNORE NULLS) OVER ({_over(keys, order)} ROWS BETWEEN CURRENT ROW AND {hi})")


def rank_avg(x: str, keys=DATE, desc: bool = False) -> Ex:
    """Rank among the rows of the key with a value, ties averaged."""
    d = " DESC" if desc else ""

    def col():
        e = F.expr(x)
        r = F.rank().over(Window.partitionBy(*keys).orderBy(e.desc_nulls_last() if desc else e.asc_nulls_last()))
        same = F.count(e).over(Window.partitionBy(*keys, e))
        return F.when(e.isNotNull(), r + (same - 1) / 2)

    k = ", ".join(keys)
    return Ex(col, f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {k} ORDER BY {x}{d} NULLS LAST) + (count({x}) OVER (PARTITION BY {k}, {x}) - 1) / 2.0 END")


@dataclass(frozen=True)
class Ewm:
    """Exponentially weighted mean (or bias-corrected std) of x as pandas has it, weights decaying over null rows.

    In blocks of so many rows that older weights are below a double's precision: a block's sums are a prefix sum, and
    the block before adds its last one. So no row needs more than two blocks, and nothing leaves the JVM.
    """

    out: str
    x: str
    alpha: float
    adjust: bool = True
    least: int = 0
    stat: str = "mean"
    skip: bool = False  # weights decay over rows with a value only

    @property
    def width(self) -> int:
        return max(8, math.ceil(37 / -math.log(1 - self.alpha))) if self.alpha < 1 else 8

    def apply(self, df: DataFrame) -> DataFrame:
        d, n, o = 1 - self.alpha, self.width, f"_{self.out}"
        by = Window.partitionBy("asset").orderBy("date")
        df = df.withColumn(f"{o}_x", F.expr(self.x).cast("double"))
        at = F.count(f"{o}_x").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1 if self.skip else F.col("rn")
        df = df.withColumn(f"{o}_at", at).withColumn(f"{o}_i", F.pmod(f"{o}_at", F.lit(n)).cast("double"))
        df = df.withColumn(f"{o}_x0", F.first(f"{o}_x", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        ok, up = F.col(f"{o}_x").isNotNull(), F.pow(F.lit(1 / d if d else 1.0), F.col(f"{o}_i"))
        c = F.col(f"{o}_x") - F.col(f"{o}_x0")  # centred, so that squares keep their digits
        sums = {"n": c * up, "d": F.when(ok, up), "q": c * c * up, "w": F.when(ok, up * up)}
        used = ["n", "d"] if self.stat == "mean" else list(sums)
        inside = Window.partitionBy("asset", f"{o}_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(f"{o}_b", F.floor(F.col(f"{o}_at") / n))
        df = df.withColumns({f"{o}_{k}": F.sum(sums[k]).over(inside) for k in used})
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        last = F.col(f"{o}_i") == n - 1
        df = df.withColumns({f"{o}_p{k}": F.last(F.when(last, F.col(f"{o}_{k}")), ignorenulls=True).over(before) for k in used})
        df = df.withColumn(f"{o}_c", F.count(f"{o}_x").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        df = df.withColumn(f"{o}_r0", F.min(F.when(ok, F.col("rn"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        zero = F.lit(0.0)

        def total(k: str, power: int = 1):
            down = F.pow(F.lit(d), F.col(f"{o}_i") * power)
            return down * (F.coalesce(F.col(f"{o}_{k}"), zero) + F.pow(F.lit(d), F.lit(float(n * power))) * F.coalesce(F.col(f"{o}_p{k}"), zero))

        x0, num, den = F.col(f"{o}_x0"), total("n"), total("d")
        if self.stat == "std":
            mean = num / den
            bias = den * den / F.nullif(den * den - total("w", 2), zero)
            value = F.sqrt(F.greatest(total("q") / den - mean * mean, zero) * bias)
        elif self.adjust:
            value = x0 + num / den
        else:
            value = x0 + self.alpha * num  # the first value's weight falls on zero as values are centred on it
        df = df.withColumn(self.out, F.when(F.col(f"{o}_c") >= max(1, self.least), value))
        return df.drop(*[c for c in df.columns if c.startswith(f"{o}_")])

    def sql(self, prev: str) -> str:
        d, n = 1 - self.alpha, 2 * self.width
        at = "c_" if self.skip else "rn"
        p = f"pow({d!r}, p.{at} - q.{at})"
        ok = f"FILTER (q.x_ IS NOT NULL)"
        if self.stat == "std":
            value = f"sqrt(greatest(sum(q.x_ * q.x_ * {p}) / sum({p}) {ok} - pow(sum(q.x_ * {p}) / sum({p}) {ok}, 2), 0) * pow(sum({p}) {ok}, 2) / nullif(pow(sum({p}) {ok}, 2) - sum({p} * {p}) {ok}, 0))"
        elif self.adjust:
            value = f"sum(q.x_ * {p}) / sum({p}) {ok}"
        else:
            value = f"{self.alpha!r} * sum(q.x_ * {p}) + {d!r} * arg_min(q.x_, q.rn) {ok} * pow({d!r}, p.rn - min(q.rn) {ok})"
        # the first value's share needs all rows when not adjusted; its weight is lost in rounding beyond n rows
        src = f"(SELECT asset, rn, ({self.x})::DOUBLE AS x_, count({self.x}) OVER (PARTITION BY asset ORDER BY rn) AS c_ FROM {prev})"
        if self.adjust is False:
            near = f"q.rn <= p.rn AND (q.rn > p.rn - {n})"
            value = f"{self.alpha!r} * sum(q.x_ * {p}) + CASE WHEN p.rn - any_value(p.r0_) < {n} THEN {d!r} * any_value(p.x0_) * pow({d!r}, p.rn - any_value(p.r0_)) ELSE 0 END"
            src_p = f"(SELECT *, min(CASE WHEN x_ IS NOT NULL THEN rn END) OVER (PARTITION BY asset) AS r0_, first_value(x_ IGNORE NULLS) OVER (PARTITION BY asset ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x0_ FROM {src})"
        else:
            near, src_p = f"q.rn <= p.rn AND q.{at} > p.{at} - {n}", src
        inner = f"SELECT p.asset, p.rn, CASE WHEN any_value(p.c_) >= {max(1, self.least)} THEN {value} END AS {self.out} FROM {src_p} p JOIN {src} q ON p.asset = q.asset AND {near} GROUP BY p.asset, p.rn"
        return f"SELECT t.*, e.{self.out} FROM {prev} t JOIN ({inner}) e USING (asset, rn)"


def span(n: float) -> float:
    return 2 / (n + 1)


def com(c: float) -> float:
    return 1 / (1 + c)


def halflife(h: float) -> float:
    return 1 - math.exp(-math.log(2) / h)


@dataclass(frozen=True)
class Where:
    text: str

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.text)

    def sql(self, prev: str) -> str:
        return f"SELECT * FROM {prev} WHERE {self.text}"


@dataclass(frozen=True)
class Renumber:
    """rn anew, after rows have been left out."""

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn("rn", F.row_number().over(Window.partitionBy(*ASSET).orderBy(*DATE)) - 1)

    def sql(self, prev: str) -> str:
        return f"SELECT * REPLACE (row_number() OVER ({_over(ASSET, DATE)}) - 1 AS rn) FROM {prev}"


@dataclass(frozen=True)
class Grid:
    """x on every day of some weekdays (0: Monday) from an asset's first to its last date: the last row on or before the day. Each row is repeated up to the next one's day, so nothing is joined."""

    x: str
    weekdays: tuple[int, ...] = (0, 1, 2, 3, 4)

    def apply(self, df: DataFrame) -> DataFrame:
        after = F.date_sub(F.lead("date").over(Window.partitionBy(*ASSET).orderBy(*DATE)), 1)
        held = df.select("asset", F.col(self.x), F.col("date").alias("from_"), F.coalesce(after, "date").alias("to_"))
        out = held.select("asset", self.x, F.explode(F.sequence("from_", "to_")).alias("date")).where(F.weekday("date").isin(*self.weekdays))
        return Renumber().apply(out.withColumn("rn", F.lit(0)))

    def sql(self, prev: str) -> str:
        days = ", ".join(str(d + 1) for d in self.weekdays)
        inner = f"SELECT asset, {self.x}, unnest(generate_series(date, coalesce(lead(date) OVER ({_over(ASSET, DATE)}) - 1, date), INTERVAL 1 DAY))::DATE AS date FROM {prev}"
        return f"SELECT asset, {self.x}, date, row_number() OVER ({_over(ASSET, DATE)}) - 1 AS rn FROM ({inner}) WHERE isodow(date) IN ({days})"


@dataclass(frozen=True)
class Machine:
    """out: a state machine's first state. step goes over an asset's rows in order; first and after are its states as SQL (over p, and over p and the row before r)."""

    out: str
    step: Callable
    inputs: tuple[str, ...]
    states: dict[str, tuple[float, str, str]]

    def apply(self, df: DataFrame) -> DataFrame:
        names = list(self.states)

        def run(pdf):
            pdf = pdf.sort_values("date", ignore_index=True)
            state, out = tuple(v[0] for v in self.states.values()), []
            for row in zip(*[pdf[c].to_numpy(float) for c in self.inputs], strict=True):
                state = self.step(state, *row)
                out.append(state[0])
            pdf[self.out] = out
            return pdf

        assert names
        return df.groupBy(*ASSET).applyInPandas(run, df.withColumn(self.out, F.lit(0.0)).schema)

    def sql(self, prev: str) -> str:
        names = ", ".join(self.states)
        first, after = (", ".join(v[i] for v in self.states.values()) for i in (1, 2))
        loop = f"WITH RECURSIVE r(asset, rn, {names}) AS (SELECT asset, rn, {first} FROM {prev} p WHERE rn = 0 UNION ALL SELECT p.asset, p.rn, {after} FROM r JOIN {prev} p ON p.asset = r.asset AND p.rn = r.rn + 1) SELECT asset, rn, {next(iter(self.states))} AS {self.out} FROM r"
        return f"SELECT t.*, m.{self.out} FROM {prev} t JOIN ({loop}) m USING (asset, rn)"


@dataclass(frozen=True)
class Recipe:
    """Steps over a panel; a step is a dictionary of new columns, or has apply() and sql()."""

    steps: list = field(default_factory=list)
    keep: tuple[str, ...] = ()  # columns that come out, after the keys

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            if isinstance(step, dict):
                df = df.withColumns({k: (v.col() if isinstance(v, Ex) else F.expr(v)) for k, v in step.items()})
            else:
                df = step.apply(df)
        return df

    def result(self, df: DataFrame, keys=("asset", "date")) -> DataFrame:
        out = self.apply(df)
        return out.select(*keys, *[tidy(out, c) for c in self.keep])

    def oracle(self, base: str, keys=("asset", "date")) -> str:
        """base: WITH items that end in one called s0."""
        items, prev = [base], "s0"
        for i, step in enumerate(self.steps, 1):
            if isinstance(step, dict):
                body = f"SELECT *, {', '.join(f'{v.sql if isinstance(v, Ex) else v} AS {k}' for k, v in step.items())} FROM {prev}"
            else:
                body = step.sql(prev)
            prev = f"s{i}"
            items.append(f"{prev} AS MATERIALIZED ({body})")
        picks = ", ".join(f"{tidy_sql(c)} AS {c}" for c in self.keep)
        return f"WITH {', '.join(items)} SELECT {', '.join(keys)}, {picks} FROM {prev}"


#: Added before rounding, so that sums that end in a five at the seventh place round alike in both engines.
NUDGE = 2.3e-8


def tidy(df: DataFrame, c: str) -> Column:
    """The column as a double of six places, without minus zero."""
    return (F.round(F.col(c).cast("double") + NUDGE, 6) + F.lit(0.0)).alias(c)


def tidy_sql(c: str) -> str:
    return f"round(({c})::DOUBLE + {NUDGE}, 6) + 0.0"
