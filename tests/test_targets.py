"""Target positions: kinds, bands and versions."""

import datetime

import pytest

from quaystone.operators import targets as tg

DAY = datetime.date(2024, 1, 2)


def test_signals_move_to_the_edge_of_their_band(spark):
    schema = "strategy string, fact string, asset string, signal double, weight double, band double"
    today = spark.createDataFrame([("s", "f", a, x, 1.0, b) for a, x, b in (("up", 1.0, 0.3), ("in", 0.6, 0.3), ("down", -1.0, 0.3), ("free", 1.0, None), ("new", 1.0, 0.3))], schema)
    stored = spark.createDataFrame([("s", "f", a, 0.5) for a in ("up", "in", "down", "free")], "strategy string, fact string, asset string, signal double")
    got = {r["asset"]: round(r["signal"], 9) for r in tg.buffered(today, stored).collect()}
    assert got == {"up": 0.7, "in": 0.5, "down": -0.7, "free": 1.0, "new": 1.0}
    assert {r["signal"] for r in tg.buffered(today, None).collect()} == {1.0, 0.6, -1.0}


def test_unknown_kinds_are_refused(spark):
    factors = spark.createDataFrame([("a", DAY, "x", 1.0)], "asset string, date date, name string, value double")
    repository = spark.createDataFrame([("s", "f", "x", "what", 0.0, "sma", 1, 1.0, None)], tg.REPOSITORY)
    with pytest.raises(Exception, match="no kind what"):
        tg.transformed(factors, repository).collect()


def test_versions_before_a_day(spark, tmp_path):
    path = f"{tmp_path}/v"
    for k in (1, 3):
        tg.write_version(spark.createDataFrame([(k,)], "x int"), path, datetime.date(2024, 1, k))
    rows = spark.read.parquet(path)
    assert [[r["x"] for r in tg.version_before(rows, datetime.date(2024, 1, d)).collect()] for d in (1, 2, 3, 4)] == [[], [1], [1], [3]]


def test_positions_add_strategies_up_and_round_lots(spark):
    signals = spark.createDataFrame([("s1", "f", "a", 0.333, 1.0, None), ("s1", "g", "a", 0.5, 0.5, None), ("s2", "f", "a", -0.08, 1.0, None), ("s1", "f", "b", -0.25, 1.0, None)], "strategy string, fact string, asset string, signal double, weight double, band double")
    risk = spark.createDataFrame([("a", 2.0, 5.0), ("b", 0.5, 5.0)], "asset string, vol double, lot double")
    got = {r["asset"]: (r["n_strategies"], round(r["exact"], 6), r["lots"]) for r in tg.positions(signals, risk, 50.0).collect()}
    assert got == {"a": (2, 2.5, 3.0), "b": (1, -5.0, -5.0)}
