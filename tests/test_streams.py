"""Streams over several batches: state is carried on, late and repeated rows are dropped."""

import datetime
import time

import duckdb
import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from quaystone.plans import registry
from quaystone.streaming import bars as st
from quaystone.streaming import quotes as qt
from tests.conftest import rows

START = datetime.datetime(2024, 1, 1, 9)


def ticks(n=240, assets=3, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        out.append((i, START + datetime.timedelta(hours=4 * i // assets, seconds=i), i % assets, "click", round(float(100 + rng.normal(0, 1)), 3), "{}"))
    return out


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same ticks in one file, and in four that come one behind the other, with repeated rows and a late one."""
    rows = ticks()
    one, many = tmp_path_factory.mktemp("one"), tmp_path_factory.mktemp("many")
    frame = lambda part: spark.createDataFrame(part, st.EVENTS).coalesce(1)
    frame(rows).write.parquet(f"{one}/events.parquet")
    late = (9999, START - datetime.timedelta(days=9), 0, "click", 1e6, "{}")
    for i, part in enumerate((rows[:50], rows[40:110], [*rows[110:180], late], [*rows[180:], *rows[100:120]])):
        frame(part).write.mode("append").parquet(f"{many}/events.parquet")
    return str(one), str(many)


def as_frame(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)


@pytest.mark.parametrize("name, keys", [("running_means", ["event_id"]), ("running_indicators", ["event_id"]), ("running_bars", ["asset", "date"])])
def test_batches_carry_state_on(spark, folders, name, keys):
    one, many = (as_frame(getattr(st, name)(spark, f), *keys) for f in folders)
    pd.testing.assert_frame_equal(one, many, check_exact=False, rtol=1e-9, check_dtype=False)
    assert 9999 not in set(many.get("event_id", [])) and len(one) > 30


def test_late_ticks_change_no_bar_and_repeats_count_once(spark, folders):
    one, many = (as_frame(st.minute_bars(spark, f, "1 day", "1 hour"), "asset", "start") for f in folders)
    pd.testing.assert_frame_equal(one, many)


def test_running_bars_equal_plain_indicators(spark, folders):
    got = as_frame(st.running_bars(spark, folders[1]), "asset", "date")
    rows = pd.DataFrame(ticks(), columns=["event_id", "ts", "asset", "kind", "value", "props"])
    rows["date"] = rows["ts"].dt.date
    for asset, part in rows.sort_values(["ts", "event_id"]).groupby("asset"):
        bars = part.groupby("date")["value"].agg(["first", "max", "min", "last"]).set_axis(["open", "high", "low", "close"], axis=1).iloc[:-1]
        mine = got[got["asset"] == asset].reset_index(drop=True)
        c, h, low = bars["close"].to_numpy(), bars["high"], bars["low"]
        assert np.allclose(mine["ema"], bars["close"].ewm(span=5, adjust=False).mean())
        assert np.allclose(mine["ma"], bars["close"].rolling(5).mean(), equal_nan=True) and np.allclose(mine["don_h"], h.rolling(5).max(), equal_nan=True)
        assert np.allclose(mine["stdev"].iloc[4:], [np.std(c[i - 4 : i + 1]) for i in range(4, len(c))])
        tr = np.maximum(h - low, np.maximum((h - bars["close"].shift()).abs().fillna(0), (low - bars["close"].shift()).abs().fillna(0)))
        assert np.allclose(mine["atr"], tr.ewm(span=5, adjust=False).mean())
        opens, last = [], None
        for o, x in zip(bars["open"], (bars["open"] + h + low + bars["close"]) / 4):
            opens.append(o if last is None else (last[0] + last[1]) / 2)
            last = opens[-1], x
        assert np.allclose(mine["ha_o"], opens)
        assert np.allclose(mine["pct_ch"], bars["close"].rolling(5).median().shift(), equal_nan=True)


def test_season_stats_of_batches(spark, folders):
    got = as_frame(st.season_stats(spark, folders[0]), "asset", "hour")
    rows = pd.DataFrame(ticks(), columns=["event_id", "ts", "asset", "kind", "value", "props"])
    want = rows.groupby(["asset", rows["ts"].dt.hour])["value"].agg(["count", "mean"]).reset_index()
    assert np.allclose(got["mean"], want["mean"]) and list(got["n"]) == list(want["count"])


def closed(spark, folder, width=86_400):
    def stream():
        t = st.source(spark, folder)
        return qt.closed_bars(t.select(F.col("user_id").alias("asset"), "event_id", "ts", F.col("value").alias("price"), (F.hour("ts") * 60 + F.col("event_id") % 60).alias("cumulative"), F.col("event_id").alias("oi")), width, "1 hour")

    return as_frame(qt.run_with_timers(stream, spark), "asset", "start")


def test_timers_close_bars(spark, folders):
    one, many = (closed(spark, f) for f in folders)
    pd.testing.assert_frame_equal(one, many)
    rows = pd.DataFrame(ticks(), columns=["event_id", "ts", "asset", "kind", "value", "props"])
    rows["start"], rows["cumulative"] = rows["ts"].dt.floor("1D"), rows["ts"].dt.hour * 60 + rows["event_id"] % 60
    want = rows.groupby(["asset", "start"]).agg(open=("value", "first"), high=("value", "max"), low=("value", "min"), close=("value", "last"), volume=("cumulative", "last"), oi=("event_id", "last"), n_ticks=("value", "size")).reset_index()
    want = want[want["start"] + pd.Timedelta(days=1) <= rows["ts"].max() - pd.Timedelta(hours=1)].reset_index(drop=True)
    assert list(one["start"]) == list(want["start"]) and np.allclose(one.drop(columns="start").astype(float), want.drop(columns="start").astype(float))
    last = want[want["asset"] == 2]["start"].max()  # closed though the instrument itself may have no later tick
    assert last in set(one[one["asset"] == 2]["start"])


def test_volume_is_the_change_within_a_day(spark, folders):
    got = closed(spark, folders[1], 3600)
    rows = pd.DataFrame(ticks(), columns=["event_id", "ts", "asset", "kind", "value", "props"])
    rows["start"], rows["day"] = rows["ts"].dt.floor("1h"), rows["ts"].dt.date
    rows["cumulative"] = rows["ts"].dt.hour * 60 + rows["event_id"] % 60
    bars = rows.groupby(["asset", "day", "start"])["cumulative"].last()
    want = bars - bars.groupby(["asset", "day"]).shift().fillna(0)
    want = want.reset_index().drop(columns="day").sort_values(["asset", "start"])
    want = want[want["start"] + pd.Timedelta(hours=1) <= rows["ts"].max() - pd.Timedelta(hours=1)]
    assert list(got["volume"]) == list(want["cumulative"].astype(int))


def test_spread_quotes_of_batches(spark, folders):
    legs = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 1, -2), (0, 2, 2, 1), (7, 0, 1, -1), (7, 1, 2, 3), (8, 0, 0, 1), (8, 1, 99, 1)], "spread long, leg int, asset long, weight int")

    def quotes(folder):
        def stream():
            t = st.source(spark, folder)
            return qt.spread_quotes(t.select(F.col("user_id").alias("asset"), "event_id", "ts", (F.col("value") - 0.1).alias("bid"), (F.col("value") + 0.2).alias("ask"), (5 + F.col("event_id") % 4).alias("bid_size"), (7 + F.col("event_id") % 5).alias("ask_size")), legs)

        return as_frame(qt.run_with_timers(stream, spark), "spread", "event_id")

    one, many = (quotes(f) for f in folders)
    many = many[many["event_id"] != 9999].reset_index(drop=True)
    pd.testing.assert_frame_equal(one, many)
    held, want = {}, []
    for event, _, asset, _, value, _ in ticks():
        held[asset] = (value - 0.1, value + 0.2, 5 + event % 4, 7 + event % 5)
        for spread, parts in ((0, {0: 1, 1: -2, 2: 1}), (7, {1: -1, 2: 3})):
            if asset in parts and all(a in held for a in parts):
                side = lambda i: sum(w * held[a][i if w > 0 else 1 - i] for a, w in parts.items())  # noqa: E731, B023
                fill = lambda i: min(held[a][2 + (i if w > 0 else 1 - i)] // abs(w) for a, w in parts.items())  # noqa: E731, B023
                want.append((spread, event, side(0), side(1), fill(0), fill(1)))
    want = sorted(want)
    assert list(zip(one["spread"], one["event_id"])) == [r[:2] for r in want]
    assert np.allclose(one[["bid", "ask", "bid_volume", "ask_volume"]], [r[2:] for r in want])


def test_an_instrument_with_many_open_bars_takes_little_time(spark, tmp_path):
    """All bars of a file are open until its end; each must not look through the others when it closes."""
    rows = [(i, START + datetime.timedelta(minutes=i), 0, "click", float(i % 97), "{}") for i in range(3000)]
    spark.createDataFrame(rows, st.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    before = time.monotonic()
    got = closed(spark, tmp_path, 60)
    assert time.monotonic() - before < 40
    assert len(got) == 2939 and list(got["oi"]) == list(range(2939)) and list(got["close"]) == [float(i % 97) for i in range(2939)]


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """The ticks in four files that weren't written in order of time."""
    folder, data = tmp_path_factory.mktemp("scattered"), ticks()
    for i in (2, 0, 3, 1):
        spark.createDataFrame(data[i * 60 : i * 60 + 60], st.EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return str(folder)


def test_queries_over_files_in_any_order_lose_no_row(spark, scattered):
    got = rows(registry.queries()["stream_bars"](spark, scattered))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{scattered}/events.parquet/*.parquet'")
    cursor = con.execute(registry.oracle_sql()["stream_bars"])
    want = rows(cursor.fetchall(), [d[0] for d in cursor.description])
    assert got == want and len(want[0]) > 30


def test_replayed_files_follow_time(spark, folders, scattered):
    again = st.replayed(spark, scattered, 70)
    assert spark.read.parquet(f"{again}/events.parquet").count() == 240 and again != scattered
    one, many = (as_frame(st.running_bars(spark, f), "asset", "date") for f in (folders[0], again))
    pd.testing.assert_frame_equal(one, many, check_exact=False, rtol=1e-9, check_dtype=False)
    ends = [(r.lo, r.hi) for r in spark.read.parquet(f"{again}/events.parquet").groupBy(F.input_file_name()).agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).orderBy("lo").collect()]
    assert len(ends) == 4 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert st.replayed(spark, folders[0]) == folders[0]  # one small file stays where it is


def test_season_stats_go_on_over_batches(spark, folders):
    got = as_frame(st.season_stats(spark, folders[1], 1), "asset", "hour")
    every = spark.read.parquet(f"{folders[1]}/events.parquet").toPandas()
    want = every.groupby(["user_id", every["ts"].dt.hour])["value"].agg(["count", "mean", lambda x: x.std(ddof=0)]).reset_index()
    assert list(got["n"]) == list(want["count"]) and np.allclose(got[["mean", "sd"]], want.iloc[:, 3:])


def test_many_seasons_take_little_time(spark, tmp_path):
    """A row each of 60,000 instruments and hours."""
    ids = spark.range(60_000)
    events = ids.select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") % 24 * 3600).alias("ts"), (F.col("id") / 24).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    before = time.monotonic()
    got = st.season_stats(spark, str(tmp_path)).agg(F.count("*"), F.sum("n"), F.sum("mean")).first()
    assert time.monotonic() - before < 20
    assert tuple(got) == (60_000, 60_000, 60_000 * 59_999 / 2)
