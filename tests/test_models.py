"""Small-matrix models, stores and selection: invariants on made panels."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaystone.operators import research as rs
from quaystone.operators import seasonal as se
from quaystone.operators import selection as sl
from quaystone.sources import store


@pytest.fixture(scope="module")
def rets(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.01, 200)
    rows = []
    for k, (load, noise) in {"a": (1.0, 0.002), "b": (1.0, 0.002), "c": (0.0, 0.01), "d": (0.0, 0.02)}.items():
        x = load * base + rng.normal(0, noise, 200)
        rows += [(k, datetime.date(2024, 1, 1) + datetime.timedelta(i), float(v)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "asset string, date date, ret double").cache()


def wide(rets):
    return rets.toPandas().pivot(index="date", columns="asset", values="ret")


def test_components_are_those_of_the_correlations(rets):
    got = sl.per_matrix(sl.moments(rets), sl.components, "asset string, component int, loading double, eigenvalue double").toPandas()
    v = got.pivot(index="asset", columns="component", values="loading").to_numpy()
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-9)
    assert np.allclose(sorted(got["eigenvalue"].unique()), np.sort(np.linalg.eigvalsh(wide(rets).corr().to_numpy()))[1:])


def test_clusters_put_like_assets_together(rets):
    got = {r["asset"]: r["cluster"] for r in sl.per_matrix(sl.moments(rets), sl.clusters(0.9), "asset string, cluster int").collect()}
    assert got["a"] == got["b"] and len({got["a"], got["c"], got["d"]}) == 3


def test_least_variance_weights(rets):
    got = sl.per_matrix(sl.moments(rets), sl.least_variance(0.0), "asset string, weight double").orderBy("asset").toPandas()["weight"].to_numpy()
    cov = wide(rets).cov().to_numpy()
    assert np.isclose(got.sum(), 1) and (got >= 0).all()
    for w in np.vstack([np.eye(4), np.full((1, 4), 0.25), np.random.default_rng(1).dirichlet(np.ones(4), 50)]):
        assert got @ cov @ got <= w @ cov @ w + 1e-12


def test_greedy_takes_no_two_that_move_together(rets, spark):
    m = sl.moments(rets).join(spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0), ("d", 0.5)], "a string, score double"), "a").drop("cov")
    got = sl.per_matrix(m, sl.greedy(0.5, 2), "g string, a string, place int").orderBy("place").toPandas()["a"].tolist()
    assert got == ["a", "c"]


def test_johansen_finds_the_common_trend(spark):
    rng = np.random.default_rng(4)
    trend = rng.normal(0, 1, 500).cumsum()
    rows = [("g", datetime.date(2023, 1, 1) + datetime.timedelta(i), k, float(v)) for k, x in {"x": trend + rng.normal(0, 1, 500), "y": 2 * trend + rng.normal(0, 1, 500)}.items() for i, v in enumerate(x)]
    got = rs.johansen(spark.createDataFrame(rows, "g string, date date, name string, x double")).orderBy("rank").collect()
    assert got[0]["trace"] > 19.9 and got[1]["trace"] < 6.6  # the 99 % points of two series with a constant
    assert np.isclose(got[0]["trace"], got[0]["largest"] + got[1]["largest"])


def test_kalman_follows_a_fixed_line(spark):
    x = np.random.default_rng(3).normal(0, 1, 300)
    df = spark.createDataFrame([("a", datetime.date(2023, 1, 1) + datetime.timedelta(i), float(v), float(3 * v + 1)) for i, v in enumerate(x)], "asset string, date date, x double, y double")
    last = rs.kalman(df).orderBy("date").toPandas().iloc[-1]
    assert abs(last["slope"] - 3) < 0.1 and abs(last["intercept"] - 1) < 0.1


def test_lunar_labels_take_the_nearest_new_year(spark):
    df = spark.createDataFrame([(datetime.date(2024, 2, 9),), (datetime.date(2024, 2, 10),), (datetime.date(2024, 9, 1),)], "date date")
    got = [(r["lunar_year"], r["lunar_day"], r["lunar_week"]) for r in se.lunar_labels(df).orderBy("date").collect()]
    assert got[:2] == [(2024, -1, -1), (2024, 0, 0)] and got[2][0] == 2025


def test_factor_store_reads_only_what_is_asked(spark, rets):
    path = store.folder(spark, "factors")
    store.write_factors(rets.withColumn("f2", F.lit(None).cast("double")), ["ret", "f2"], path)
    got = store.read_factors(spark, path, ["ret"], "2024-01-02", "2024-01-03", ["a"])
    assert got.count() == 2 and "PartitionFilters: [isnotnull(fact_name" in got._jdf.queryExecution().toString()


def test_roll_json_round_trip(spark):
    rolls = spark.createDataFrame([("x", "1", datetime.date(2024, 1, 1)), ("x", "2", datetime.date(2024, 5, 1)), ("y", "1", datetime.date(2024, 2, 1))], "asset string, contract string, start date")
    path = store.folder(spark, "rolls")
    store.write_roll_json(rolls, path)
    assert sorted(map(tuple, store.read_roll_json(spark, path).select("asset", "contract", "start").collect())) == sorted(map(tuple, rolls.collect()))


def test_correlations_equal_pandas(rets):
    got = {(r["a"], r["b"]): r["corr"] for r in rs.correlations(rets).collect()}
    want = wide(rets).corr()
    assert len(got) == 6 and all(np.isclose(v, want.loc[a, b]) for (a, b), v in got.items())
    assert isinstance(want, pd.DataFrame)


def test_surface_of_break_even_vols_is_that_of_a_plain_solver(spark):
    import math

    from quaystone.operators import contracts as ct

    rng = np.random.default_rng(11)
    expiry = datetime.date(2024, 12, 31)
    days = [expiry - datetime.timedelta(int(d)) for d in sorted(rng.choice(370, 120, replace=False), reverse=True)]
    rows = [("a", f"c{k}", expiry, d, float(p)) for k in range(3) for d, p in zip(days, 100 * np.exp(rng.normal(0, 0.02, 120).cumsum()), strict=True)]
    rows += [("a", "bad", expiry, d, -1.0 if i == 3 else 5.0) for i, d in enumerate(days)] + [("a", "few", expiry, d, 5.0 + i) for i, d in enumerate(days[-3:])] + [("a", "c0", expiry, expiry + datetime.timedelta(1), 9.0), ("a", "few", expiry, days[0], None)]
    df = spark.createDataFrame(rows, "asset string, contract string, expiry date, date date, close double")
    got = ct.breakeven_surface(df, [30, 91, 365]).toPandas().set_index(["contract", "tenor", "strike_name"])
    assert len(got) == 5 * 9 and got.loc[["bad", "few"], "vol"].isna().all()
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))

    def value(path, strike, vol):
        d1 = lambda p, left: math.log(p / strike) / (vol * math.sqrt(max(left, 1) / 365.25)) + vol * math.sqrt(max(left, 1) / 365.25) / 2
        out = path[0][0] * cdf(d1(*path[0])) - strike * cdf(d1(*path[0]) - vol * math.sqrt(max(path[0][1], 1) / 365.25))
        return out + sum(cdf(d1(*a)) * (b[0] - a[0]) for a, b in zip(path, path[1:], strict=False)) - max(path[-1][0] - strike, 0)

    found = 0
    for k in range(3):
        for tenor in (30, 91, 365):
            path = [(p, (expiry - d).days) for a, c, e, d, p in rows if c == f"c{k}" and d <= expiry and (expiry - d).days <= tenor]
            for name, delta in ct.DELTAS.items():
                r = got.loc[(f"c{k}", tenor, name)]
                assert r["n"] == len(path)
                if np.isnan(r["vol"]):
                    continue
                found += 1
                assert abs(value(path, r["strike"], r["vol"])) < 1e-6
                middle = got.loc[(f"c{k}", tenor, "atm"), "vol"] * math.sqrt(path[0][1] / 365.25)
                z = {0.5: 0.0, 0.25: -0.6744897501960817, 0.75: 0.6744897501960817}[delta]
                assert np.isclose(r["strike"], path[0][0] if delta == 0.5 else path[0][0] / math.exp((z - middle / 2) * middle))
    assert found >= 15


def test_break_even_vol_is_found_where_prices_move_as_it_says(spark):
    from quaystone.operators import contracts as ct

    expiry, rng = datetime.date(2024, 12, 31), np.random.default_rng(4)
    n = 3000
    steps = np.exp(rng.normal(-0.5 * 0.3**2 / 365.25, 0.3 / np.sqrt(365.25), n).cumsum())
    left = np.arange(n)[::-1].astype(float)
    _, vols, _ = ct.surface(100 * steps, left, [n])
    assert abs(vols[0, 0] - 0.3) < 0.05
