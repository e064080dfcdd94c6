"""State machines: invariants and small cases."""

import datetime

import numpy as np
import pytest

from quaystone.functions import kernels as kn
from quaystone.operators import market as mk
from quaystone.operators import research as rs
from quaystone.plans import registry
from tests.conftest import SF


def run(step, rows, start):
    out, state = [], start
    for r in rows:
        state = step(state, *r)
        out.append(state)
    return out


def test_hysteresis_enters_holds_and_leaves():
    got = [x[0] for x in run(kn.hysteresis(1.0, 0.5), [(v,) for v in (9.0, 0.5, 1.2, 0.8, float("nan"), 0.4, -1.5, -0.6, 1.4)], (0.0, 0.0))]
    assert got == [0, 0, 1, 1, 1, 0, -1, -1, 1]  # flat on the first row
    assert [x[0] for x in run(kn.hysteresis(1.0, 0.5, False), [(0.0,), (1.2,), (1.5,), (-1.4,)], (0.0, 0.0))] == [0, 1.2, 1.2, -1.4]


def test_hump_and_buffer():
    assert [x[0] for x in run(kn.hump(0.5), [(0.3,), (0.6,), (0.9,), (float("nan"),), (1.2,)], (0.0,))] == [0, 0.6, 0.6, 0.6, 1.2]
    assert [round(x[0], 6) for x in run(kn.buffered, [(1.0, 0.2), (0.7, 0.2), (0.4, 0.2)], (0.0,))] == [0.8, 0.8, 0.6]


def test_parabolic_flips_through_its_stop():
    rows = [(10 + i, 9 + i) for i in range(10)] + [(12, 5)]
    sides = [x[1] for x in run(kn.parabolic(), rows, (0.0,) * 8)]
    assert sides[:-1] == [1.0] * 10 and sides[-1] == -1.0


def test_lifo_trades_add_up_to_the_positions_profit(spark):
    path = [0, 2, 5, 4, -1, -1, 3, 0]
    days = [datetime.date(2024, 1, 1 + i) for i in range(len(path))]
    price = [10.0, 11.0, 12.5, 12.0, 9.0, 9.5, 8.0, 8.5]
    df = spark.createDataFrame([("x", d, float(p), c) for d, p, c in zip(days, path, price, strict=True)], "asset string, date date, pos double, price double")
    got = kn.lifo_trades(df).toPandas()
    assert np.isclose(got["profit"].sum(), sum(p * (b - a) for p, a, b in zip(path, price, price[1:])))
    assert got.iloc[0]["entry_price"] == 12.5  # the latest lot goes first


def test_trailing_stop_leaves_at_the_open_when_it_gaps():
    got = run(kn.trail(0.1), [(10, 10, 10, 10, 1.0), (8, 8, 8, 8, 0.0)], (0.0,) * 4)
    assert got[1][0] == 0 and np.isclose(got[1][3], -0.2)


@pytest.mark.parametrize("name", ["ind_psar", "ind_band_stop", "sim_trailing_stop", "sim_lifo_trades", "stat_adf", "stat_kalman"])
def test_queries_without_sql_give_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_scan_equals_a_plain_loop(spark):
    rng = np.random.default_rng(1)
    rows = [(k, datetime.date(2024, 1, 1) + datetime.timedelta(i), float(rng.normal())) for k in "ab" for i in range(50)]
    got = kn.scan(spark.createDataFrame(rows, "asset string, date date, z double"), kn.hysteresis(1, 0.5), ["z"], {"pos": 0.0, "seen": 0.0}).collect()
    for k in "ab":
        want = [x[0] for x in run(kn.hysteresis(1, 0.5), [(z,) for a, _, z in rows if a == k], (0.0, 0.0))]
        assert [r["pos"] for r in sorted((r for r in got if r["asset"] == k), key=lambda r: r["date"])] == want


def test_chain_keeps_one_contract_a_day_and_adjusts_without_gaps(spark):
    d = [datetime.date(2024, 1, 1) + datetime.timedelta(i) for i in range(4)]
    bars = spark.createDataFrame([("x", c, day, p) for c, ps in (("1", (10.0, 11.0, 12.0, 13.0)), ("2", (20.0, 22.0, 24.0, 26.0))) for day, p in zip(d, ps, strict=True)], "asset string, contract string, date date, close double")
    rolls = spark.createDataFrame([("x", "1", d[0]), ("x", "2", d[2])], "asset string, contract string, start date")
    got = [r["adj_close"] for r in mk.back_adjusted(mk.chain(bars, mk.chain_segments(rolls))).orderBy("date").collect()]
    assert np.allclose(got, [10 * 24 / 11, 24.0, 24.0, 26.0])


def test_upsert_of_empty_sides(spark):
    rows = spark.createDataFrame([(1, 1.0)], "k int, v double")
    assert mk.upsert(rows, rows.limit(0), ["k"]).count() == 1 and mk.upsert(rows.limit(0), rows, ["k"], False).count() == 1


def test_adf_and_stats_on_short_groups(spark):
    df = spark.createDataFrame([("x", datetime.date(2024, 1, 1), 1.0)], "asset string, date date, x double")
    assert rs.adf(df).count() == 1
    assert rs.stats(df.withColumnRenamed("x", "pnl"), "asset").collect()[0]["sharpe"] is None
