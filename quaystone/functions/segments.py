"""Scans of step functions that compose, so that one history runs in many blocks at once.

A machine whose step is a small table (a state number for each state), a clamp (a floor and a cap for what is held) or a
value that is set or kept has steps that can be put together before anyone knows the state they start from. Inside a
block of a key's rows each row's step is put behind those of the rows 1, 2, 4, ... before it, by lag windows of one
partition and sort; the last rows of the blocks are scanned alike, a row per block; and each block's start is joined to
its rows. Rows are exchanged by key and block, so no task needs a whole history, and nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Parts = dict[str, Column]


@dataclass(frozen=True)
class Machine:
    """steps: the columns of a row's step; then: a later and an earlier step as one; result: what a step makes of the first state."""

    steps: Parts
    then: Callable[[Parts, Parts], Parts]
    result: Callable[[Parts], Column]


def table(values: tuple[float, ...], to: tuple[str, ...], first: int = 0) -> Machine:
    """A state machine: to has for each state the SQL of the next state's number, values what the states stand for."""
    names = [f"to{i}" for i in range(len(to))]

    def pick(number: Column, of: list[Column]) -> Column:
        chosen = of[-1]
        for i in range(len(of) - 2, -1, -1):
            chosen = F.when(number == i, of[i]).otherwise(chosen)
        return chosen

    return Machine({n: F.expr(t).cast("int") for n, t in zip(names, to, strict=True)}, lambda a, b: {n: pick(b[n], [a[m] for m in names]) for n in names}, lambda p: pick(p[names[first]], [F.lit(v) for v in values]))


def clamp(low: Column, high: Column, first: float = 0.0) -> Machine:
    """What is held moves up to low or down to high; a row without them leaves it."""
    held = lambda x, p: F.least(F.greatest(x, p["low"]), p["high"])
    steps = {"low": F.coalesce(low, F.lit(float("-inf"))), "high": F.coalesce(high, F.lit(float("inf")))}
    return Machine(steps, lambda a, b: {"low": held(b["low"], a), "high": held(b["high"], a)}, lambda p: held(F.lit(first), p))


def set_or_keep(event: Column, first: float | None = None) -> Machine:
    """The last event that isn't null."""
    return Machine({"value": event}, lambda a, b: {"value": F.coalesce(a["value"], b["value"])}, lambda p: F.coalesce(p["value"], F.lit(first)))


def hysteresis(x: str, enter: float, gap: float, first_row: str = "false") -> Machine:
    """Take the side of x beyond enter, and leave it (or turn) when x falls back by gap; flat on the first row, kept while x is null."""
    take = f"CASE WHEN abs({x}) > {enter} THEN CASE WHEN {x} > 0 THEN 1 ELSE 2 END ELSE 0 END"
    held = lambda state, back: f"CASE WHEN {first_row} THEN 0 WHEN {back} THEN {take} ELSE {state} END"
    return table((0.0, 1.0, -1.0), (f"CASE WHEN {first_row} OR {x} IS NULL THEN 0 ELSE {take} END", held(1, f"{x} <= {enter - gap}"), held(2, f"-({x}) <= {enter - gap}")))


def _prefix(df: DataFrame, machines: dict[str, Machine], names: dict[str, list[str]], by: list[str], order: list[str], longest: int | None) -> DataFrame:
    """Each row's steps behind those of all rows before it with the same by."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("at_", F.row_number().over(w))
    if longest is None:
        longest = df.groupBy(*by).agg(F.max("at_").alias("n")).agg(F.max("n")).first()[0] or 0
    columns, reach = [c for n in names.values() for c in n], 1
    while reach < longest:
        before = df.withColumns({f"{c}_b": F.lag(c, reach).over(w) for c in columns})
        put = {}
        for m, machine in machines.items():
            made = machine.then({p: F.col(f"{m}_{p}") for p in machine.steps}, {p: F.col(f"{m}_{p}_b") for p in machine.steps})
            put |= {f"{m}_{p}": F.when(F.col("at_") > reach, v).otherwise(F.col(f"{m}_{p}")) for p, v in made.items()}
        df = before.withColumns(put).drop(*[f"{c}_b" for c in columns])
        reach *= 2
    return df


def scan(df: DataFrame, machines: dict[str, Machine], block: Column, keys: tuple[str, ...] = ("asset",), order: tuple[str, ...] = ("date",), longest: int | None = None) -> DataFrame:
    """df with a column of results per machine. block must not fall along the order; longest: the rows of the longest block (counted, if not given). Keys must not be null."""
    names = {m: [f"{m}_{p}" for p in machine.steps] for m, machine in machines.items()}
    columns = [c for n in names.values() for c in n]
    steps = {f"{m}_{p}": c for m, machine in machines.items() for p, c in machine.steps.items()}
    rows = _prefix(df.withColumns(steps | {"block_": block}), machines, names, [*keys, "block_"], list(order), longest)
    ends = rows.groupBy(*keys, "block_").agg(F.max_by(F.struct(*columns), "at_").alias("end_")).select(*keys, "block_", "end_.*")
    w = Window.partitionBy(*keys).orderBy("block_")
    starts = _prefix(ends, machines, names, list(keys), ["block_"], None)
    starts = starts.select(*keys, "block_", *[F.lag(c).over(w).alias(f"{c}_s") for c in columns], (F.col("at_") == 1).alias("first_"))
    met = rows.join(starts, [*keys, "block_"])
    out = {}
    for m, machine in machines.items():
        own = {p: F.col(f"{m}_{p}") for p in machine.steps}
        made = machine.then(own, {p: F.col(f"{m}_{p}_s") for p in machine.steps})
        out[m] = F.when(F.col("first_"), machine.result(own)).otherwise(machine.result(made))
    return met.select(*df.columns, *[c.alias(m) for m, c in out.items()])
