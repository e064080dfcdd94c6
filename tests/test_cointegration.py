"""Unit roots and cointegration from moments against plain least squares."""

import numpy as np
import pandas as pd
import pytest

from quaystone.operators import cointegration as co
from quaystone.operators import research as rs


@pytest.fixture(scope="module")
def made(spark):
    """Three walks and a fourth series tied to the first, with gaps; a flat one and one of three rows in a group of their own."""
    rng = np.random.default_rng(7)
    walk = rng.normal(0, 1, (3, 160)).cumsum(axis=1) + 50
    series = {("p", "a"): walk[0], ("p", "b"): walk[1], ("p", "c"): walk[2], ("p", "d"): 0.6 * walk[0] + rng.normal(0, 0.5, 160), ("q", "flat"): np.ones(40), ("q", "short"): np.array([1.0, 2.0, 4.0])}
    gone = {("p", "b"): {20, 21, 90}, ("p", "d"): {5, 60}}
    return pd.DataFrame([(g, a, i, float(v)) for (g, a), xs in series.items() for i, v in enumerate(xs) if i not in gone.get((g, a), ())], columns=["g", "asset", "seq", "x"])


def panel(spark, pdf):
    return spark.createDataFrame(pdf, "g string, asset string, seq long, x double")


def lags(x):
    x = x.reindex(range(160))
    return pd.DataFrame({"d": x.diff(), "l": x.shift(), "p": x.diff().shift()})


def t_of_level(rows):
    m = np.column_stack([rows["l"], np.ones(len(rows)), rows["p"]])
    beta, *_ = np.linalg.lstsq(m, rows["d"], rcond=None)
    e = rows["d"] - m @ beta
    return beta[0] / np.sqrt(e @ e / (len(rows) - 3) * np.linalg.inv(m.T @ m)[0, 0])


def series(made, name):
    return made[made["asset"] == name].set_index("seq")["x"]


def test_unit_roots_are_those_of_least_squares(spark, made):
    got = co.unit_roots(panel(spark, made)).toPandas().set_index("asset")
    for a in "abcd":
        rows = lags(series(made, a)).dropna()
        assert got.loc[a, "n"] == len(rows)
        assert np.isclose(got.loc[a, "adf"], t_of_level(rows), rtol=1e-8)
    assert np.isnan(got.loc["flat", "adf"]) and np.isnan(got.loc["short", "adf"])
    n = got.loc["a", "n"]
    assert np.isclose(got.loc["a", "cv_5"], -2.86154 - 2.8903 / n - 4.234 / n**2 - 40.04 / n**3)


def test_residuals_of_pairs_are_those_of_least_squares(spark, made):
    got = co.engle_granger(co.pair_moments(panel(spark, made))).toPandas().set_index(["dep", "indep"])
    assert set(got.index) >= {(y, x) for y in "abcd" for x in "abcd" if y != x}
    for y in "abcd":
        for x in "abcd":
            if x == y:
                continue
            a, b = series(made, y), series(made, x)
            common = a.index.intersection(b.index)
            slope, cut = np.polyfit(b[common], a[common], 1)
            # a row needs the two former steps of both
            rows = lags((a - slope * b - cut).reindex(common)).dropna()
            r = got.loc[(y, x)]
            assert r["common"] == len(common) and r["n"] == len(rows) and np.isclose(r["beta"], slope)
            assert np.isclose(r["adf"], t_of_level(rows), rtol=1e-7)
    assert got.loc[("d", "a"), "cointegrated"] and not got.loc[("c", "b"), "cointegrated"]


def test_johansen_of_pairs_is_that_of_the_matrix_form(spark, made):
    whole = made[made["g"] == "p"].merge(made[made["asset"] == "b"][["seq"]]).merge(made[made["asset"] == "d"][["seq"]])
    whole = whole.assign(seq=whole["seq"].rank(method="dense").astype(int))  # no gaps, so that both forms have the same rows
    got = co.johansen_pairs(co.pair_moments(panel(spark, whole))).toPandas().set_index(["a", "b"])
    for a, b in got.index:
        two = whole[whole["asset"].isin([a, b])].assign(g="g", date=lambda t: pd.to_datetime("2024-01-01") + pd.to_timedelta(t["seq"], unit="D"))
        df = spark.createDataFrame(two[["g", "date", "asset", "x"]].rename(columns={"asset": "name"}))
        want = co.with_points(rs.johansen(df)).toPandas().set_index("rank")
        r = got.loc[(a, b)]
        assert r["n"] == want.loc[0, "n"]
        assert np.allclose([r["trace_0"], r["trace_1"], r["largest_0"]], [want.loc[0, "trace"], want.loc[1, "trace"], want.loc[0, "largest"]], rtol=1e-6)
        assert (want.loc[0, "trace_95"], want.loc[1, "trace_95"], want.loc[0, "largest_99"]) == (15.4943, 3.8415, 18.52)
    assert got.loc[("a", "d"), "rank"] >= 1


def test_an_empty_panel_gives_empty_results(spark, made):
    none = panel(spark, made).where("false")
    m = co.pair_moments(none)
    assert co.unit_roots(none).count() == co.engle_granger(m).count() == co.johansen_pairs(m).count() == 0
