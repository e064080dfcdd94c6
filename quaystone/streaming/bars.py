"""Streaming forms of bars and running indicators; results are upserted per batch and equal the batch form."""

from __future__ import annotations

import contextlib
import functools
import uuid

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quaystone.sources.store import shared_dir

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events as a stream, a file a batch at most: what a batch brings for one instrument is bounded by a file. Streams that keep sums only may take more."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/[e]vents.parquet")


#: Rows of a file of replayed events; it bounds what a batch brings for one instrument.
REPLAYED = 16_000_000


def replayed(spark: SparkSession, sf_dir: str, rows: int = REPLAYED) -> str:
    """A folder whose events come in order of time: the files of a stored table have no order, and a stream drops what comes behind later rows.

    A table of one file with no more than rows stays where it is. Else files of about as many rows each are written to the
    shared folder one after the other, as streams take files by the time they were written.
    """
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/[e]vents.parquet")
    n, at = -(-events.count() // rows), F.unix_micros("ts")
    if n < 2 and len(events.inputFiles()) < 2:
        return sf_dir
    cuts = events.select(at.alias("at")).approxQuantile("at", [i / n for i in range(1, n)], 0.001) if n > 1 else []
    folder = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    place = sum((F.coalesce(at >= int(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    for i in range(len(cuts) + 1):
        events.where(place == i).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder


def newer(frames, last_ts, last_id) -> pd.DataFrame:
    """An instrument's rows of a batch in order, once each, without those that aren't behind the last row taken (ts as microseconds, event_id)."""
    rows = pd.concat(list(frames)).drop_duplicates("event_id").sort_values(["ts", "event_id"], ignore_index=True)
    if last_ts is not None:
        rows = rows[(rows["ts"] > last_ts) | ((rows["ts"] == last_ts) & (rows["event_id"] > last_id))]
    return rows.reset_index(drop=True)


def carried_mean(x: pd.Series, before: float | None, alpha: float) -> pd.Series:
    """The exponential mean that goes on from before (none: it starts with the first value)."""
    seeded = x if before is None else pd.concat([pd.Series([before]), x], ignore_index=True)
    out = seeded.ewm(alpha=alpha, adjust=False).mean()
    return out if before is None else out.iloc[1:].reset_index(drop=True)


TICKS = "value IS NOT NULL"


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source(spark, sf_dir).where(TICKS).select("event_id", F.unix_micros("ts").alias("ts"), F.col("user_id").alias("asset"), "value")


def run_available(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Runs the stream over what is there; every batch is written to the shared folder with its number, and read as batch_id."""
    spark, folder = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    write = lambda df, n: df.withColumn("batch_id", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = stream.schema.add("batch_id", "long")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


#: The state store that keeps its rows on disk, besides maps and timers.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_on_disk(spark: SparkSession):
    """Streams that start inside keep their state in ROCKS, so that it needn't fit in memory."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return rows.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place", "batch_id")


def minute_bars(spark: SparkSession, sf_dir: str, width: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling bars of first, highest, lowest and last price; repeated events count once, rows later than late are dropped."""
    t = source(spark, sf_dir).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    place = F.struct("ts", "event_id")
    agg = t.groupBy(F.col("user_id").alias("asset"), F.window("ts", width).alias("w")).agg(
        F.min_by("value", place).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", place).alias("close"), F.count("*").alias("n_ticks")
    )
    rows = run_available(agg.select("asset", F.col("w.start").alias("start"), "open", "high", "low", "close", "n_ticks"))
    return latest(rows, "asset", "start")


def _day_bars(spark: SparkSession, sf_dir: str, part=None, late: str = "1 day") -> DataFrame:
    """Bars of a day or of its parts; a day's state goes once the watermark has passed it, repeated events count once."""
    t = source(spark, sf_dir).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    place, by = F.struct("ts", "event_id"), [F.col("user_id").alias("asset"), F.window("ts", "1 day").alias("w"), *([part.alias("part")] if part is not None else [])]
    agg = t.groupBy(*by).agg(F.min_by("value", place).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", place).alias("close"), F.count("*").alias("n_ticks"))
    keys = ["asset", "date", *(["part"] if part is not None else [])]
    return latest(run_available(agg.select("*", F.to_date("w.start").alias("date")).select(*keys, "open", "high", "low", "close", "n_ticks")), *keys)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running daily bar, in update mode."""
    return _day_bars(spark, sf_dir)


def running_means(spark: SparkSession, sf_dir: str, span: int = 10) -> DataFrame:
    """Exponential mean (first value as start) and running mean per instrument, from keyed state; a row per tick, late and repeated ticks dropped."""
    a = 2 / (span + 1)

    def step(key, frames, state):
        ema, total, n, ts, event = state.get if state.exists else (None, 0.0, 0, None, None)
        rows = newer(frames, ts, event)
        if len(rows):
            means, sums = carried_mean(rows["value"], ema, a), total + rows["value"].cumsum()
            yield pd.DataFrame({"event_id": rows["event_id"], "asset": key[0], "ema": means, "mean": sums / (n + 1 + pd.RangeIndex(len(rows)))})
            state.update((float(means.iloc[-1]), float(sums.iloc[-1]), n + len(rows), int(rows["ts"].iloc[-1]), int(rows["event_id"].iloc[-1])))

    out = _ticks(spark, sf_dir).groupBy("asset").applyInPandasWithState(step, "event_id long, asset long, ema double, mean double", "ema double, total double, n long, ts long, event long", "append", GroupStateTimeout.NoTimeout)
    return run_available(out, "append").drop("batch_id")


def session_bars(spark: SparkSession, sf_dir: str, cuts: list[int]) -> DataFrame:
    """Running bars of the parts of a day between cut minutes, in update mode."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    part = F.lit(0)
    for c in cuts:
        part = part + (minute >= c).cast("int")
    return _day_bars(spark, sf_dir, part)


def season_stats(spark: SparkSession, sf_dir: str, files: int = 64) -> DataFrame:
    """Count, mean and deviation per instrument and hour, carried on from keyed state: Spark keeps moments and puts those of a batch to them, so no row goes through Python."""
    stream = source(spark, sf_dir, files).where(TICKS).groupBy(F.col("user_id").alias("asset"), F.hour("ts").alias("hour"))
    out = stream.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    with state_on_disk(spark):
        return latest(run_available(out), "asset", "hour")


def running_indicators(spark: SparkSession, sf_dir: str, n: int = 20, m: int = 14) -> DataFrame:
    """Moving average, channel and relative strength per instrument and tick, from the last n prices and two running legs; late and repeated ticks dropped."""

    def step(key, frames, state):
        up, down, ring, ts, event = state.get if state.exists else (None, None, [], None, None)
        rows = newer(frames, ts, event)
        if not len(rows):
            return
        ring = list(ring)
        prices = pd.concat([pd.Series(ring, dtype=float), rows["value"]], ignore_index=True)
        change, window = prices.diff(), prices.rolling(n)
        moves = change.iloc[len(ring) :].reset_index(drop=True)
        first = not ring  # the first price of all has no change
        legs = []
        for part, before in ((moves.clip(lower=0), up), ((-moves).clip(lower=0), down)):
            part = part.iloc[1:].reset_index(drop=True) if first else part
            leg = carried_mean(part, before, 1 / m) if len(part) else part
            legs.append(pd.concat([pd.Series([float("nan")]), leg], ignore_index=True) if first else leg)
        total = legs[0] + legs[1]
        rsi = (100 * legs[0] / total).where(total > 0)
        tail = lambda s: s.iloc[len(ring) :].reset_index(drop=True)
        yield pd.DataFrame({"event_id": rows["event_id"], "asset": key[0], "ma": tail(window.mean()), "don_h": tail(window.max()), "don_l": tail(window.min()), "rsi": rsi})
        last = [None if pd.isna(x.iloc[-1]) else float(x.iloc[-1]) for x in legs]
        state.update((*last, prices.iloc[-n:].tolist(), int(rows["ts"].iloc[-1]), int(rows["event_id"].iloc[-1])))

    out = _ticks(spark, sf_dir).groupBy("asset").applyInPandasWithState(step, "event_id long, asset long, ma double, don_h double, don_l double, rsi double", "up double, down double, ring array<double>, ts long, event long", "append", GroupStateTimeout.NoTimeout)
    return run_available(out, "append").drop("batch_id")


#: Indicators of a closed bar, and how many bars back they look at most.
BAR_COLUMNS = "tr atr ma stdev svar ema emavar rsi don_h don_l roc cmi stoch pct_ch dt_rng tk kj ha_o ha_c fisher spb".split()
LOOK_BACK = 12
CARRIED = "atr ema emavar up down ha_o ha_c fisher spb spb1 last".split()


def bar_indicators(ring: np.ndarray, new: np.ndarray, carry: dict[str, float | None], n: int = 5) -> dict[str, np.ndarray]:
    """Indicators of new closed bars (rows of open, high, low, close) behind the former ones in ring, whole columns at once; carry has the running ones' last values and gets the new. Every window is added up anew, oldest first, as the SQL does."""
    o, h, low, c = np.concatenate([ring, new]).T
    k, nan, out, a = len(ring), np.nan, {}, 2 / (n + 1)
    tail = lambda x: x[k:]
    back = lambda x, by=1: np.concatenate([np.full(by, nan), x])[: len(x)]
    last = lambda x, n: sliding_window_view(np.concatenate([np.full(n - 1, nan), x]), n)[k:]
    some = lambda ok, x: np.where(ok, x, nan)

    def run(name: str, x: np.ndarray, alpha: float) -> np.ndarray:
        y, got = carry.get(name), np.full(len(x), nan)
        for i, v in enumerate(x.tolist()):
            if v == v:
                y = v if y is None else (1 - alpha) * y + alpha * v
                got[i] = y
        carry[name] = y
        return got

    def mean(x: np.ndarray) -> np.ndarray:
        return functools.reduce(np.add, last(x, n).T) / n

    def deviation(x: np.ndarray) -> np.ndarray:
        m, q = np.zeros(len(new)), np.zeros(len(new))
        for i, v in enumerate(last(x, n).T, 1):
            before, m = m, m + (v - m) / i
            q = q + (v - m) * (v - before)
        return np.sqrt(q / n)

    with np.errstate(divide="ignore", invalid="ignore"):
        pc, cn = back(c), tail(back(c, n))
        out["tr"] = tail(np.fmax(h - low, np.fmax(np.abs(h - pc), np.abs(low - pc))))
        out["atr"] = run("atr", out["tr"], a)
        out["ma"], out["stdev"] = mean(c), deviation(c)
        out["svar"] = mean(c * c) - out["ma"] * out["ma"]
        before = carry.get("ema")
        out["ema"] = run("ema", tail(c), a)
        prior = np.concatenate([[nan if before is None else before], out["ema"]])[:-1]
        out["emavar"] = run("emavar", (1 - a) * (tail(c) - prior) ** 2, a)
        move = tail(c - pc)
        up, down = run("up", np.maximum(move, 0), 1 / n), run("down", np.maximum(-move, 0), 1 / n)
        out["rsi"] = some(up + down > 0, 100 * up / (up + down))
        top, bottom, x = last(h, n).max(axis=1), last(low, n).min(axis=1), tail(c)
        out["don_h"], out["don_l"], out["roc"] = top, bottom, x / cn - 1
        out["cmi"] = some(top > bottom, 100 * np.abs(x - cn) / (top - bottom))
        out["stoch"] = some(top > bottom, 100 * (x - bottom) / (top - bottom))
        out["pct_ch"] = np.median(last(pc, n), axis=1)
        out["dt_rng"] = np.maximum(last(h, 2).max(axis=1) - last(c, 2).min(axis=1), last(c, 2).max(axis=1) - last(low, 2).min(axis=1))
        out["tk"], out["kj"] = ((last(h, w).max(axis=1) + last(low, w).min(axis=1)) / 2 for w in (4, 10))
        # opens of smoothed candles are means of the last open and close: an exponential mean of the former closes
        out["ha_c"] = tail((o + h + low + c) / 4)
        former = carry["ha_c"] if carry.get("ha_c") is not None else nan
        lagged = np.concatenate([[o[k] if carry.get("ha_o") is None else former], out["ha_c"]])[:-1]
        out["ha_o"] = run("ha_o", lagged, 0.5)
        carry["ha_c"] = float(out["ha_c"][-1])
        out["fisher"] = run("fisher", np.where(np.isnan(top), nan, np.where(top > bottom, 2 * (x - bottom) / (top - bottom) - 1, 0.0)), 0.7)
    y, y1, x1, values = carry.get("spb") or 0.0, carry.get("spb1") or 0.0, carry.get("last") or 0.0, []
    a1, a2 = 5 / 10, 5 / 20
    for v in x.tolist():  # a two-pole filter has no closed form
        y, y1, x1 = (a1 - a2) * v + (a2 - a1) * x1 + (2 - a1 - a2) * y - (1 - a1) * (1 - a2) * y1, y, v
        values.append(y)
    out["spb"] = np.array(values)
    carry |= {"spb": y, "spb1": y1, "last": x1}
    return out


def day_bars(ts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A row of day, open, high, low and close for each day of ticks in order."""
    day = ts // 86_400_000_000
    at = np.flatnonzero(np.diff(day, prepend=day[0] - 1))
    return np.column_stack([day[at], x[at], np.maximum.reduceat(x, at), np.fmin.reduceat(x, at), x[np.append(at[1:], len(x)) - 1]]).astype(float)


def running_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators on bar close: an instrument's ticks make a running daily bar; when a later day's tick comes the bar closes and a row comes out. Late and repeated ticks are dropped."""

    def step(key, frames, state):
        got = state.get if state.exists else None
        ts, event = (got[0], got[1]) if got else (None, None)
        rows = newer(frames, ts, event)
        if not len(rows):
            return
        carry = dict(zip(CARRIED, got[2 : 2 + len(CARRIED)], strict=True)) if got else {}
        ring, bars = np.array(got[2 + len(CARRIED) :], float).T if got else np.empty((0, 5)), day_bars(rows["ts"].to_numpy(), rows["value"].to_numpy())
        if len(ring):
            was, b = ring[-1], bars[0]
            if was[0] == b[0]:  # the open bar goes on
                bars[0] = [b[0], was[1], max(was[2], b[2]), min(was[3], b[3]), b[4]]
            else:
                bars = np.concatenate([ring[-1:], bars])
            ring = ring[:-1]
        closed = bars[:-1]
        if len(closed):
            out = bar_indicators(ring[:, 1:], closed[:, 1:], carry)
            yield pd.DataFrame({"asset": key[0], "date": closed[:, 0].astype("datetime64[D]").astype(object)} | {c: out[c] for c in BAR_COLUMNS})
        kept = np.concatenate([ring, bars])[-(LOOK_BACK + 1) :]
        state.update((int(rows["ts"].iloc[-1]), int(rows["event_id"].iloc[-1]), *[carry.get(c) for c in CARRIED], [int(d) for d in kept[:, 0]], *kept[:, 1:].T.tolist()))

    kinds = "ts long, event long, " + ", ".join(f"{c} double" for c in CARRIED) + ", day array<long>, open array<double>, high array<double>, low array<double>, close array<double>"
    made = "asset long, date date, " + ", ".join(f"{c} double" for c in BAR_COLUMNS)
    out = _ticks(spark, sf_dir).groupBy("asset").applyInPandasWithState(step, made, kinds, "append", GroupStateTimeout.NoTimeout)
    return run_available(out, "append").drop("batch_id")
